"""License scan: known sentences become identifiers, ordered rules match their sequences. DataFrame operations alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Sentences of licence notices and texts after normalisation: identifier, sentence. Fixed values.
SENTENCES = (
    ("apache2-licensed", "licensed under the apache license version 2 0"),
    ("apache2-you-may-not", "you may not use this file except in compliance with the license"),
    ("apache2-obtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-released", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-useful", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("ccbync4-licensed", "licensed under cc by nc 4 0"),
    ("ccbync4-work", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("ccby4-licensed", "licensed under cc by 4 0"),
    ("ccby4-work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd3-licensed", "licensed under the bsd 3 clause license"),
    ("isc-permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("rights-reserved", "all rights reserved"),
)

#: Rules: name, licence, kind, identifiers in order. Fixed values.
RULES = (
    ("apache2-line", "Apache-2.0", "permissive", ("apache2-licensed",)),
    ("apache2-header", "Apache-2.0", "permissive", ("apache2-licensed", "apache2-you-may-not", "apache2-obtain", "apache2-as-is")),
    ("mit-line", "MIT", "permissive", ("mit-released",)),
    ("mit-line-2", "MIT", "permissive", ("mit-licensed",)),
    ("mit-text", "MIT", "permissive", ("mit-permission", "mit-notice")),
    ("gpl3-line", "GPL-3.0", "copyleft", ("gpl3-work",)),
    ("gpl3-header", "GPL-3.0", "copyleft", ("gpl3-free", "gpl-useful")),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "noncommercial", ("ccbync4-licensed",)),
    ("cc-by-nc-work", "CC-BY-NC-4.0", "noncommercial", ("ccbync4-work",)),
    ("cc-by-line", "CC-BY-4.0", "permissive", ("ccby4-licensed",)),
    ("cc-by-work", "CC-BY-4.0", "permissive", ("ccby4-work",)),
    ("bsd3-line", "BSD-3-Clause", "permissive", ("bsd3-licensed",)),
    ("isc-text", "ISC", "permissive", ("isc-permission",)),
    ("mpl2-header", "MPL-2.0", "copyleft", ("mpl2-subject",)),
    ("reserved", "All-Rights-Reserved", "proprietary", ("rights-reserved",)),
)

#: Sentences between two of a rule that aren't of the rule.
GAP = 2

#: Names of licences in notices such as "licensed under ...": licence, kind, names after normalisation. Fixed values.
NAMES = (
    ("MIT", "permissive", ("the mit license", "mit license", "the mit licence", "mit")),
    ("Apache-2.0", "permissive", ("the apache license version 2 0", "apache license version 2 0", "the apache license 2 0", "apache license 2 0", "the apache 2 0 license", "apache 2 0", "apache 2 0 license")),
    ("BSD-2-Clause", "permissive", ("the bsd 2 clause license", "bsd 2 clause", "the 2 clause bsd license", "a 2 clause bsd license", "the simplified bsd license")),
    ("BSD-3-Clause", "permissive", ("the bsd 3 clause license", "bsd 3 clause", "the 3 clause bsd license", "a 3 clause bsd license", "the new bsd license", "the modified bsd license")),
    ("ISC", "permissive", ("the isc license", "isc")),
    ("Zlib", "permissive", ("the zlib license", "zlib")),
    ("BSL-1.0", "permissive", ("the boost software license version 1 0", "the boost software license 1 0", "bsl 1 0")),
    ("Unlicense", "permissive", ("the unlicense", "unlicense")),
    ("CC0-1.0", "permissive", ("cc0", "cc0 1 0", "cc0 1 0 universal", "the cc0 1 0 universal license", "a creative commons zero v1 0 universal license")),
    ("MPL-2.0", "copyleft", ("the mozilla public license version 2 0", "the mozilla public license 2 0", "the mozilla public license v2 0", "mpl 2 0", "the mpl 2 0")),
    *(
        (licence, "copyleft", tuple(f"{the}{name}" for the in ("the ", "") for name in (
            *(f"{gnu}{full} {v}" for gnu in ("gnu ", "") for v in (f"version {spoken}", f"v{spoken}", spoken)),
            *(f"{gnu}{short}{v}" for gnu in ("gnu ", "") for v in (f" version {spoken}", f" v{spoken}", f"v{spoken}", f" {spoken}")), *exact,
        )))
        for licence, full, short, spoken, exact in (
            ("GPL-2.0", "general public license", "gpl", "2", ("gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later")),
            ("GPL-3.0", "general public license", "gpl", "3", ("gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later")),
            ("LGPL-2.1", "lesser general public license", "lgpl", "2 1", ("lgpl 2 1 only", "lgpl 2 1 or later")),
            ("LGPL-3.0", "lesser general public license", "lgpl", "3", ("lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later")),
            ("AGPL-3.0", "affero general public license", "agpl", "3", ("agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later")),
        )
    ),
    *(
        (f"CC-{code}-4.0", kind, tuple(
            f"{a}{name}" for a in ("", "a ", "the ") for name in (
                f"cc {code.lower().replace('-', ' ')} 4 0", f"creative commons {words} 4 0 international license", f"creative commons {words} 4 0 international", f"creative commons {words} 4 0 license",
            )
        ))
        for code, kind, words in (
            ("BY", "permissive", "attribution"), ("BY-SA", "copyleft", "attribution sharealike"), ("BY-NC", "noncommercial", "attribution noncommercial"),
            ("BY-NC-SA", "noncommercial", "attribution noncommercial sharealike"),
        )
    ),
)
_UNDER = ("licensed under", "released under", "distributed under", "available under", "provided under", "licensed under the terms of", "released under the terms of", "distributed under the terms of", "spdx license identifier")


def _gnu(who: str, which: str, version: str) -> str:
    return f"this {who} is free software you can redistribute it and or modify it under the terms of the gnu {which} as published by the free software foundation either version {version} of the license or at your option any later version"


#: Sentences as published headers and texts have them, beside SENTENCES; readings() and canonical() say how texts are compared with them.
MORE_SENTENCES = tuple({sentence: (i, sentence) for i, sentence in (
    *((f"{licence.lower()}-named", f"{under} {name}") for licence, _, names in NAMES for under in _UNDER for name in names),
    ("apache2-licensed", "licensed under the apache license version 2 0 the license"),
    ("apache2-obtain", "you may obtain a copy of the license at"),
    ("mit-notice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("bsd-permission", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    *(("bsd-names", f"neither the name of {holder} nor the names of {its}contributors may be used to endorse or promote products derived from this software without specific prior written permission") for holder in ("the copyright holder", "the copyright holders") for its in ("its ", "their ", "")),
    *((f"gpl{v}-free", _gnu(who, "general public license", v)) for v in "23" for who in ("program", "software", "library", "file")),
    *((f"lgpl{v[0]}-free", _gnu(who, "lesser general public license", v)) for v in ("2 1", "3") for who in ("program", "software", "library", "file")),
    *(("agpl3-free", _gnu(who, "affero general public license", "3")) for who in ("program", "software", "library", "file")),
    *(("gpl-useful", f"this {who} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose") for who in ("software", "library", "file")),
    ("mpl2-subject", "this source code form is subject to the terms of the mozilla public license v"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
) if sentence not in {known for _, known in SENTENCES}}.values())

MORE_RULES = (
    *((f"{licence.lower()}-named", licence, kind, (f"{licence.lower()}-named",)) for licence, kind, _ in NAMES),
    ("bsd2-text", "BSD-2-Clause", "permissive", ("bsd-permission", "bsd-source", "bsd-binary")),
    ("bsd3-text", "BSD-3-Clause", "permissive", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-names")),
    ("gpl2-header", "GPL-2.0", "copyleft", ("gpl2-free", "gpl-useful")),
    ("lgpl2-header", "LGPL-2.1", "copyleft", ("lgpl2-free", "gpl-useful")),
    ("lgpl3-header", "LGPL-3.0", "copyleft", ("lgpl3-free", "gpl-useful")),
    ("agpl3-header", "AGPL-3.0", "copyleft", ("agpl3-free", "gpl-useful")),
    ("unlicense-text", "Unlicense", "permissive", ("unlicense-free", "unlicense-anyone")),
)
#: A match of the first rule is in every match of the second, and doesn't count for it.
PART_OF = (("bsd2-text", "bsd3-text"),)

#: What a notice is about, before what it is under.
_SUBJECT = r"^(?:this|the) (?:[a-z0-9]+ ){1,4}(?:is|are) (?:made )?(?=(?:licensed|released|distributed|available|provided) under )"


def canonical(sentence: Column) -> Column:
    """A normalised sentence without the subject of "this file is licensed under" and the like."""
    return F.when(sentence.contains(" under "), F.regexp_replace(sentence, _SUBJECT, "")).otherwise(sentence)


def sentences(text: Column) -> Column:
    """A text's sentences, normalised: they end at . ! or ? before white space and at line ends; only a-z and 0-9 stay, runs of others are one space."""
    lines = F.split(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"([.!?])[ \t\r]+", "$1\n"), "\n")
    return F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def readings(text: Column) -> Column:
    """A text's sentences in four ways: as sentences() has them, with wrapped lines joined, and both with ; as an end too.

    Joined, a line goes on in the next one unless it ends a sentence or with a colon, or a line
    without a-z and 0-9 follows.
    """
    lower = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\1", " ")
    # \1 ends a sentence
    lines = F.translate(F.regexp_replace(lower, r"([.!?])[ \t\r]+", "$1\n"), "\n", "\1")
    joined = F.regexp_replace(F.regexp_replace(lower, r"\n[^a-z0-9]*\n", "\1"), r":[ \t\r]*\n|[.!?][ \t\r\n]+", "\1")

    def pieces(marked: Column) -> Column:
        return F.filter(F.transform(F.split(marked, "\1"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")

    return F.array(sentences(text), pieces(joined), *(pieces(F.regexp_replace(marked, r";[ \t\r\n]+", "\1")) for marked in (lines, joined)))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple = SENTENCES + MORE_SENTENCES, rules: tuple = RULES + MORE_RULES, gap: int = GAP
) -> DataFrame:
    """One row per document: id, n_sentences, n_known, n_matches (of rules), licenses and kinds (sorted, comma-joined).

    A rule matches where its identifiers follow one another, with at most ``gap`` other
    sentences between two. Texts are read line by line and, for wrapped texts, with lines
    joined, each with and without ; as an end; n_sentences is of the lines. A known sentence,
    and a rule, counts as often as in the reading that has it most. Null and empty texts have
    no sentences. Equal rows are reported alike, each on its own row, and so are rows with a
    null id; different texts of one id are kept apart. An empty table gives an empty one;
    other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    version = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # the tables of sentences and rules are constants of the job
    ids: dict[str, str] = {}
    for i, sentence in known:
        ids.setdefault(re.sub(_SUBJECT, "", sentence), i)
    table = spark.createDataFrame([(i, sentence) for sentence, i in ids.items()], "sentence_id string, key string")
    steps = [(name, licence, kind, i, s, len(of)) for name, licence, kind, of in rules for i, s in enumerate(of)]
    steps = spark.createDataFrame(steps, "rule string, license string, kind string, step int, sentence_id string, steps int")
    split = docs.select(F.col(id_col).alias("id"), version.alias("version"), F.posexplode(readings(F.col(text_col))).alias("reading", "s"))
    # the place behind the last sentence of the lines stands for the document itself
    end = F.when(F.col("reading") == 0, F.array(F.lit(""))).otherwise(F.expr("filter(s, x -> false)"))
    each = split.select("id", "version", "reading", F.posexplode(F.concat("s", end)).alias("pos", "sentence"))
    each = each.select("id", "version", "reading", "pos", canonical(F.col("sentence")).alias("key"))
    marks = spark.createDataFrame([("", "")], "sentence_id string, key string")
    found = scratch.write(each.join(F.broadcast(table.union(marks)), "key").select("id", "version", "reading", "pos", "sentence_id"))
    documents = found.where("sentence_id = ''").select("id", "version", F.col("pos").cast("long").alias("n_sentences"))
    known_at = found.where("sentence_id <> ''").distinct()
    state = known_at.join(F.broadcast(steps.where("step = 0")), "sentence_id")
    matched = []
    for step in range(max((len(r[3]) for r in rules), default=0)):
        matched.append(state.where(f"steps = {step + 1}").select("id", "version", "reading", "rule", "license", "kind", "pos"))
        following = F.broadcast(steps.where(f"step = {step + 1}").select("rule", "sentence_id"))
        wanted = state.where(f"steps > {step + 1}").drop("sentence_id").join(following, "rule").alias("x")
        near = F.expr(f"x.sentence_id = y.sentence_id AND x.version = y.version AND x.id <=> y.id AND x.reading = y.reading AND y.pos > x.pos AND y.pos <= x.pos + {gap + 1}")
        state = wanted.join(known_at.alias("y"), near).select("x.id", "x.version", "x.reading", "x.rule", "x.license", "x.kind", "x.steps", "x.sentence_id", "y.pos").distinct()
    hits = matched[0] if matched else None
    for more in matched[1:]:
        hits = hits.union(more)

    def most(rows: DataFrame, *what: str) -> DataFrame:
        each = rows.groupBy("id", "version", "reading", *what).agg(F.count("*").alias("n"))
        return each.groupBy("id", "version", *what).agg(F.max("n").alias("n"))

    hits = most(hits, "rule", "license", "kind")
    # matches of a rule, without those that are part of a longer one's
    of = {name: (licence, kind) for name, licence, kind, _ in rules}
    parts = [(longer, part, *of[part]) for part, longer in PART_OF if part in of]
    parts = spark.createDataFrame(parts, "longer string, rule string, license string, kind string")
    less = hits.select("id", "version", F.col("rule").alias("longer"), (-F.col("n")).alias("n")).join(F.broadcast(parts), "longer").select(*hits.columns)
    hits = hits.union(less).groupBy("id", "version", "rule", "license", "kind").agg(F.sum("n").alias("n")).where("n > 0")
    by_doc = hits.groupBy("id", "version").agg(
        F.sum("n").alias("n_matches"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
    )
    counted = most(known_at, "sentence_id").groupBy("id", "version").agg(F.sum("n").alias("n_known"))
    x, y, z = documents.alias("x"), counted.alias("y"), by_doc.alias("z")
    out = x.join(y, F.expr("x.id <=> y.id AND x.version = y.version"), "left").join(z, F.expr("x.id <=> z.id AND x.version = z.version"), "left")
    return out.select(
        F.col("x.id").alias(id_col), "n_sentences", F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("kinds", F.lit("")).alias("kinds"),
    )
