"""Each operator against a brute-force version on odd small tables: nulls, empty and repeated rows, ties, clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from caselens.llm import bpe, chunks, decontaminate, html_text, language_id, licenses, lines, minhash, quality, suffixes
from caselens.llm.store import Scratch

SCHEMA = "doc_id long, text string, lang string, version int, pos int, word string, fp string, n int, id string, at int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, 1, 2, "w", "f", 3, "x", 4) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeérst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))

    shared = prose(40)
    base = prose(120).split(" ")
    rows = [(i, prose(rng.randrange(5, 150)), "en") for i in range(20)]
    rows += [(100 + i, prose(20) + " " + shared + " " + prose(15), "en") for i in range(12)]
    for i in range(12):
        copy = list(base)
        for _ in range(i // 2):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((200 + i, " ".join(copy), "fr"))
    rows += [(300 + i, " ".join(base), "fr") for i in range(3)]
    rows += [(400, None, None), (401, "", "en"), (402, "   \n ", "en"), (403, "a" * 700, "en"), (404, "ab" * 300, None), (405, "Word", "de")]
    rows += [(406, prose(30000), "en"), (100, rows[20][1], "en")]
    return rows


def ids(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def repeated_bytes(rows, length):
    seen, out = set(), {}
    for i, t, _ in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            else:
                seen.add(b[k : k + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [4096, 2])
def test_suffix_arrays_remove_what_starts_earlier(spark, texts, monkeypatch, bucket):
    # a bucket of two sends nearly all anchors the way of crowded ones
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    got = suffixes.remove_repeats(frame(spark, [*texts, (None, texts[0][1], "en")])).collect()
    assert len(got) == len(texts) + 1
    want = repeated_bytes(texts, suffixes.LENGTH)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert tuple(r)[1:] == want[r["doc_id"]]


def test_longest_previous_factor_equals_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 40)))
        order = sorted(range(len(text)), key=lambda i: text[i:])

        def common(i, j, text=text):
            k = 0
            while k < len(text) - max(i, j) and text[i + k] == text[j + k]:
                k += 1
            return k

        lcp = np.array([0, *(common(order[k - 1], order[k]) for k in range(1, len(order)))])
        got = suffixes.longest_previous_factor(np.array(order), lcp)
        assert [int(got[order.index(i)]) for i in range(len(text))] == [max([common(i, j) for j in range(i)], default=0) for i in range(len(text))]


def test_chunks_keep_the_first_and_resist_shifts(spark, texts):
    got = {r["doc_id"]: r for r in chunks.chunk_duplicates(frame(spark, [*texts, (None, texts[0][1], "en")]), with_kept=True).collect()}
    seen, want = set(), {}
    for i, t, _ in sorted({r for r in texts}, key=lambda r: r[0]):
        b = (t or "").encode()
        cuts = [k + 1 for k in np.flatnonzero(chunks.gear_hash(np.frombuffer(b, np.uint8)) >> np.uint32(32 - chunks.CUT_BITS) == 0)]
        last, kept = 0, b""
        for end in chunks.chunk_ends(cuts, 0, len(b)):
            if b[last:end] not in seen:
                kept += b[last:end]
            seen.add(b[last:end])
            last = end
        want[i] = kept
    assert {i: r["kept"] for i, r in got.items() if i is not None} == {i: bytearray(k) for i, k in want.items()}
    assert got[None]["n_removed"] == 0
    assert got[105]["n_removed"] > 0  # a shared passage at another place of its document


def test_bpe_equals_the_library_and_comes_back(spark, texts):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    reference = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = [(500, "<|endoftext|> <unk> ▁ 　中文 \U0001f600\U00019127a 12345's", "x"), (None, "no id", "en")]
    docs = frame(spark, [*texts, *odd])
    encoded = bpe.encode_texts(docs, path, tokenizers.PATTERN, with_ids=True)
    got = ids((r["doc_id"], list(r["ids"]), r["n_tokens"]) for r in encoded.collect())
    want = ids((i, reference.encode_ordinary(t or ""), len(reference.encode_ordinary(t or ""))) for i, t, _ in [*texts, *odd])
    assert got == want
    back = bpe.decode_ids(encoded, path, tokenizers.PATTERN).collect()
    assert ids((r["doc_id"], bytes(r["decoded"])) for r in back) == ids((i, (t or "").encode()) for i, t, _ in [*texts, *odd])


def test_pages_give_the_article_alone(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>x';</script></head><body>"
        "<header><a href='/'>Home</a></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies on this page, please accept all of them now.</div>"
        "<article><h1>Big &amp; <i>small</i></h1><p>First\n  para&shy;graph<br>goes on &#233;.<p>Second.</p>"
        "<aside>Read more</aside><form>Mail <input name=q></form><section class=comments><p>Great post, I liked reading it.</p></section></article>"
        "<!-- <p>gone</p> --><footer>&copy; someone</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut &amp; off &am"), (4, "u", "<nav><a href=x>only</a></nav>"), (None, "u", "<p>")]
    tree = html_text.train_tree(spark)
    got = html_text.extract_pages(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string"), tree).collect()
    want = [(1, "Big & small\n\nFirst para­graph goes on é.\n\nSecond."), (2, ""), (3, ""), (4, ""), (4, "cut & off &am"), (None, "")]
    assert ids((r["page_id"], r["text"]) for r in got) == ids(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_pages_keep_articles_in_named_wrappers_and_drop_link_lists(spark):
    tree = html_text.train_tree(spark)
    long = "The committee met again and agreed on a plan for the coming year after a long talk about what it would cost and who would pay for it in the end."
    links = "".join(f'<li><a href="/{i}">Other story number {i}</a></li>' for i in range(6))
    article = f"<article><h1>A headline of some words</h1><p>{long}</p><p>{long}</p></article>"
    want = f"A headline of some words\n\n{long}\n\n{long}"
    for wrapper in (
        'class="has-sidebar"', 'class="page header-fixed"', 'style="overflow:hidden"', 'class="with-sidebar no-comments"', 'id="sidebar-wrapper"',
        'data-note="is hidden here"', 'class="visually hidden-xs"',
    ):
        assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav><div {wrapper}>{article}</div></body>", tree) == want, wrapper
    assert html_text.main_text(f"<body><form id=f><main>{article}</main></form></body>", tree) == want
    for hider in ("hidden", 'style="color:red; display: none"', 'hidden=""', 'aria-hidden="true"'):
        assert html_text.main_text(f"<body><div {hider}>{article}</div></body>", tree) == "", hider
    assert html_text.main_text(f"<body><aside>{article}</aside></body>", tree) == ""
    # unmarked links inside the article go, a linked block between paragraphs stays
    inside = article.replace("</article>", f"<ul>{links}</ul><p>{long}</p></article>")
    assert html_text.main_text(f"<body>{inside}</body>", tree) == f"{want}\n\n{long}"
    # a page without an article element
    plain = f"<body><div><p>{long}</p><p>{long}</p></div><ul>{links}</ul></body>"
    assert html_text.main_text(plain, tree) == f"{long}\n\n{long}"


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "and", "th"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "ou", "é", "tion"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(20)), lang) for i in range(120) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(900, None, "en"), (901, "12 + 3", "en"), (902, "", None), (903, rows[0][1], None), (None, rows[1][1], "de")]
    docs = frame(spark, rows)
    from pyspark.sql import functions as F

    model = language_id.fit_language_model(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = {(r["doc_id"], r["lang"]): r for r in language_id.identify(docs, model, carry=("lang",)).collect()}
    assert [got[k]["lang_pred"] for k in [(900, "en"), (901, "en"), (902, None)]] == ["und"] * 3
    assert all(r["lang_pred"] == lang for (i, lang), r in got.items() if lang and i not in (900, 901))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[903, None]["lang_pred"] == "en"
    nothing = language_id.identify(docs, language_id.fit_language_model(docs.where("false")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_contamination_equals_brute_force(spark, texts):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(t):
        return pattern.findall((t or "").translate(ASCII_LOWER))

    items = [(1, texts[21][1][60:300]), (2, texts[3][1]), (3, "word"), (4, None), (5, "never seen at all"), (3, "another text zz"), (6, "a a"), (6, "a a")]
    docs = [*texts, (500, "a a a b", "en"), (None, "A word, a word", "en")]
    got = ids(tuple(r) for r in decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = []
    for i, t, _ in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            size = min(10, len(v))
            windows = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert got == ids(want)


def test_proximity_finds_terms_in_another_order(spark):
    scratch = Scratch(spark)
    bench = decontaminate.BenchmarkWindows(scratch, spark.createDataFrame([(1, "red fox jumps high")], "item_id long, text string"))
    docs = frame(spark, [(1, "red fox sees how fox jumps and jumps high", "en"), (2, "red fox here", "en")])
    index = decontaminate.build_index(scratch, docs, bench)
    assert [r["id"] for r in decontaminate.proximity_matches(scratch, index, bench, slack=6).collect()] == [1]
    assert decontaminate.phrase_matches(scratch, index, bench).count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("small", [8, 1])
def test_near_components_equal_brute_force(spark, texts, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    rows = [*texts, (None, texts[0][1], "en"), (None, None, "en")]
    sets = [shingles(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min([rows[k][0] for k in range(len(rows)) if label[k] == x and rows[k][0] is not None], default=None) for x in label}
    want = [(rows[k][0], len(sets[k]), least[label[k]], rows[k][0] == least[label[k]]) for k in range(len(rows))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in minhash.near_components(frame(spark, rows)).collect()), key=key) == sorted(want, key=key)


def test_signatures_miss_as_little_at_any_threshold():
    assert (minhash.bands_needed(85), minhash.least_agreeing(85)) == (20, 192)
    for percent in (80, 85, 90):
        agree = percent / 100 + (1 - percent / 100) / 16
        fewer = sum(math.comb(256, k) * agree**k * (1 - agree) ** (256 - k) for k in range(minhash.least_agreeing(percent)))
        assert fewer < 1e-5 and (1 - (percent / 100) ** 4) ** minhash.bands_needed(percent) < 1e-6
    with pytest.raises(ValueError):
        minhash.bands_needed(50)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (200, 201)]
    rng.shuffle(edges)
    got = minhash.connected(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert len(got) == 41 + 30 + 2


def test_lines_equal_brute_force(spark, texts):
    rng = random.Random(4)
    rows = [r for r in texts if r[0] not in (406,)]
    for i in range(30):
        words = rows[rng.randrange(20)][1].split(" ")[:14]
        words[rng.randrange(len(words))] = "zz"
        rows.append((600 + i, " ".join(words) + "\n\nEnd of it", "en"))
    rows.append((None, rows[0][1], "en"))
    earlier, want = [], {}
    for i, t, _ in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        kept = []
        for line in (t or "").split("\n"):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line.translate(ASCII_LOWER)) if w}
            gone = len(s) >= lines.LEAST_WORDS and any(10 * len(s & x) >= 8 * len(s | x) for x in earlier)
            if len(s) >= lines.LEAST_WORDS:
                earlier.append(s)
            if not gone:
                kept.append(line)
        want[i] = "\n".join(kept)
    got = lines.line_duplicates(frame(spark, rows), with_text=True).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == want[r["doc_id"]] if r["doc_id"] is not None else r["n_removed"] == 0 for r in got)


def test_short_lines_go_when_they_equal_an_earlier_one(spark):
    rows = [
        (1, "All rights reserved.\n今天天气很好我们去公园散步吧\nYes\nbuy now buy now buy now", "en"),
        (2, "ALL  rights reserved.\nYes\nnow buy now buy now buy\nown line here", "en"),
        (3, "今天天气很好我们去公园散步吧\nbuy now buy now buy now\nบรรทัดนี้ซ้ำกันทุกหน้า", "zh"), (4, "บรรทัดนี้ซ้ำกันทุกหน้า\nบรรทัดนี้ซ้ำกันทุกหน้า\n\n \nAll rights reserved!", "th"),
        (5, None, "en"), (None, "All rights reserved.", "en"), (6, "All rights reserved.", "en"),
    ]
    docs = frame(spark, rows)
    want = {
        1: rows[0][1], 2: "Yes\nnow buy now buy now buy\nown line here", 3: "บรรทัดนี้ซ้ำกันทุกหน้า", 4: "\n \nAll rights reserved!",
        None: "All rights reserved.",
    }
    got = {r["doc_id"]: r["text"] for r in lines.line_duplicates(docs, with_text=True, short_chars=lines.LEAST_CHARS).collect()}
    assert got == want | {5: "", 6: ""}
    # as the pipeline's stage calls it
    assert {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(docs).collect()} == want | {5: None}


def test_license_rules_follow_their_order(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, f"Text. {mit} One. Two! {notice}", "en"), (2, f"{notice} {mit}", "en"), (3, f"{mit} One. Two. Three. {notice}", "en")]
    rows += [(4, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "en"), (5, None, None), (6, "", "en"), (None, "All rights reserved.", "en")]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got[1] == (5, 2, 1, "MIT", "permissive")
    assert got[2][2:] == got[3][2:] == (0, "", "")
    assert got[4] == (2, 2, 2, "Apache-2.0,MIT", "permissive")
    assert got[5] == got[6] == (0, 0, 0, "", "")
    assert got[None] == (1, 1, 1, "All-Rights-Reserved", "proprietary")


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""


def test_wrapped_licenses_are_read_with_lines_joined(spark):
    def flat(text):
        return "\n".join(" ".join(block.replace("#", " ").split()) for block in re.split(r"\n[# ]*\n", text))

    texts = {
        1: (MIT, "MIT", 1), 2: (APACHE, "Apache-2.0", 2), 3: (BSD2, "BSD-2-Clause", 1), 4: (BSD3, "BSD-3-Clause", 1), 5: (GPL2, "GPL-2.0", 1),
        6: ("Some code.\nThis file is licensed under the MIT License\nand more", "MIT", 1), 7: ("x = 1 // SPDX-License-Identifier: MIT\n", "", 0),
        8: ("/*\n * SPDX-License-Identifier: LGPL-2.1-or-later\n */", "LGPL-2.1", 1), 9: (GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of"), "LGPL-2.1", 1),
        10: ("The text is available under CC BY-SA 4.0.", "CC-BY-SA-4.0", 1), 11: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 1),
        12: ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense", 1),
        13: (MIT.replace("MIT License", "Plain words") + APACHE, "Apache-2.0,MIT", 3), 14: ("Not a licensed thing; see under the tree.\n\n\n\n", "", 0),
    }
    rows = [(i, t, "en") for i, (t, _, _) in texts.items()] + [(100 + i, flat(t), "en") for i, (t, _, _) in texts.items() if i < 6]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {i: texts[i % 100][1:] for i, _, _ in rows}
    known = {r["doc_id"]: r["n_known"] for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (known[1], known[2], known[4], known[5]) == (known[101], known[102], known[104], known[105]) == (2, 4, 4, 2)


def test_quality_rules_equal_brute_force(spark, texts):
    rows = [*texts, (700, "one two three four five six " * 5, "en"), (701, "#a $b | % & <c> *\nsame line here\nsame line here\n \n ", "en"), (None, "x y", "en")]
    got = quality.quality_verdicts(frame(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        t = t or ""
        w, seen, again = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
    assert ids(tuple(r)[:7] for r in got) == ids(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_perplexity_is_modified_kneser_ney_and_rejects_noise(spark):
    rng = random.Random(6)
    parts = ["the", "ing", "and", "er", "th", "on"]
    rows = [(i, " ".join("".join(rng.choices(parts, k=2)) for _ in range(60)), "en") for i in range(150)]
    rows += [(900, " ".join("".join(rng.choices("qxzjkvwy", k=6)) for _ in range(60)), "en")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert not got[900]["kept"] and all(r["kept"] for i, r in got.items() if i != 900)
    model = quality.fit_perplexity(docs)
    # the probabilities of what has followed a context add up to one, less what is kept for the rest
    keys, p = model.keys[0], np.exp(model.log_probability[0].astype(float))
    totals = np.bincount(np.unique(keys >> 6, return_inverse=True)[1], p)
    assert (totals <= 1 + 1e-4).all() and totals.max() > 0.99


def test_log_perplexity_is_that_of_a_brute_force_model_of_whole_characters(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK_CHARS", 300)
    rng = random.Random(26)
    letters = "abcé üλж中文字🙂 7$\n"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([3, 60, 200]))), rng.choice(["en", "zh", None])) for i in range(60)] + [(90, "", "en"), (91, None, "fr")]
    grams = collections.defaultdict(collections.Counter)
    cut = {i: "\0\0\0" + re.sub("[ \t-\r]+", " ", (t or "").lower()) for i, t, _ in rows}
    for i, _, lang in rows:
        grams[lang or ""].update(cut[i][k - 3 : k + 1] for k in range(3, len(cut[i])))
    want = {}
    for lang, four in grams.items():
        orders = [four]
        for _ in range(3):
            orders.insert(0, collections.Counter(g[1:] for g in orders[0]))
        p = {}
        for n in orders:
            seen = [max(1, sum(v == k for v in n.values())) for k in (1, 2, 3, 4)]
            y = seen[0] / (seen[0] + 2 * seen[1])
            d = [min(max(k - (k + 1) * y * seen[k] / seen[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
            total, off = collections.Counter(), collections.Counter()
            for g, v in n.items():
                total[g[:-1]] += v
                off[g[:-1]] += d[min(v, 3) - 1]
            p.update({g: (v - d[min(v, 3) - 1]) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * (p[g[1:]] if len(g) > 1 else 1 / (len(n) + 1)) for g, v in n.items()})
        for i, _, one in rows:
            if (one or "") == lang and len(cut[i]) > 3:
                want[i] = -float(np.mean([np.log(p[cut[i][k - 3 : k + 1]]) for k in range(3, len(cut[i]))]))
    got = {r["doc_id"]: r["log_perplexity"] for r in quality.quality_verdicts(frame(spark, rows)).collect()}
    assert {i: v for i, v in got.items() if v is not None} == pytest.approx(want, abs=1e-5) and len(got) == len(rows)


def test_band_rejects_short_symbols_tables_and_gibberish(spark):
    rng = random.Random(16)
    parts = ["the", "ing", "and", "er", "th", "on"]

    def prose(n):
        return " ".join("".join(rng.choices(parts, k=2)) for _ in range(n))

    rows = [(i, prose(60), "en") for i in range(150)] + [(200 + i, prose(12), "en") for i in range(20)]
    rows += [(900, "$$$ %%% ### &&& *** <<< >>> $%$ %#% &*& #$# *%*", "en")]
    rows += [(901, " | ".join(f"{rng.randrange(10**4)}" for _ in range(14)), "en")]
    rows += [(902, " ".join("".join(rng.choices("qxzjkvwy", k=5)) for _ in range(12)), "en")]
    got = {r["doc_id"]: r for r in quality.quality_verdicts(frame(spark, rows)).collect()}
    planted = {900, 901, 902}
    assert not any(r["base_failed"] for r in got.values())
    assert not any(got[i]["kept"] for i in planted)
    assert sum(r["kept"] for i, r in got.items() if i not in planted) >= 166


EMPTY = {
    "suffixes": lambda d, s: suffixes.remove_repeats(d),
    "chunks": lambda d, s: chunks.chunk_duplicates(d),
    "minhash": lambda d, s: minhash.near_components(d),
    "lines": lambda d, s: lines.line_duplicates(d),
    "licenses": lambda d, s: licenses.scan_licenses(d),
    "quality": lambda d, s: quality.quality_verdicts(d),
    "contamination": lambda d, s: decontaminate.contamination(d, s.createDataFrame([], "item_id long, text string")),
    "language": lambda d, s: language_id.identify(d, language_id.fit_language_model(d)),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_give_empty_results(spark, name):
    assert EMPTY[name](frame(spark, []), spark).count() == 0


def test_long_lines_that_share_rare_words_are_not_all_compared(spark, monkeypatch):
    import random

    from caselens.llm.lines import LineJoin, line_duplicates

    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(2000)}" for _ in range(260)) for _ in range(60)]
    lines.append(" ".join([*lines[3].split()[:250], "other", "words"]))
    seen, confirmed = [], LineJoin.confirmed

    def counted(self, pairs):
        seen.append(pairs.count())
        return confirmed(self, pairs)

    monkeypatch.setattr(LineJoin, "confirmed", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_duplicates(docs).where("n_removed > 0").collect()}
    assert gone == {60}
    # nearly every two of these lines share a word of their prefixes
    assert sum(seen) < 60


def test_wide_rows_of_line_words_are_held_for_one_pass_at_a_time(spark, monkeypatch):
    from caselens.llm.lines import line_duplicates
    from caselens.llm.store import Scratch

    live, most, write, drop = set(), [0], Scratch.write, Scratch.drop

    def written(self, df):
        out = write(self, df)
        if {"word", "low"} <= set(df.columns):
            live.add(out._scratch_path)
            most[0] = max(most[0], len(live))
        return out

    def dropped(self, *tables):
        live.difference_update(t._scratch_path for t in tables)
        drop(self, *tables)

    monkeypatch.setattr(Scratch, "write", written)
    monkeypatch.setattr(Scratch, "drop", dropped)
    lines = [" ".join(f"w{(i * 7 + j) % 40}" for j in range(12)) for i in range(30)] + ["a b c d e f g h i j", "a b c d e f g h i x", "a b c d e f g h y j", "a b c d e f g h i j k"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in line_duplicates(docs).where("n_removed > 0").collect()}
    sets = [set(line.split()) for line in lines]
    assert gone == {i for i, s in enumerate(sets) if any(10 * len(s & e) >= 8 * len(s | e) for e in sets[:i])}
    assert most[0] == 1 and not live


def test_lines_that_share_single_words_do_not_meet(spark, monkeypatch):
    from caselens.llm.lines import line_duplicates
    from caselens.llm.store import Scratch

    rng = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    made = [" ".join(rng.sample(words, 40)) for _ in range(200)]
    made.append(" ".join([*made[7].split()[:38], "other", "one"]))
    met, write = [], Scratch.write

    def written(self, df):
        out = write(self, df)
        if {"word", "seq"} <= set(df.columns):
            met.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", written)
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert {r.doc_id for r in line_duplicates(docs).where("n_removed > 0").collect()} == {200}
    # every word is in dozens of lines, so that any prefix of single words meets nearly all of them
    assert met and sum(met) < 2 * len(made)


def test_lines_of_neighbouring_sizes_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    made = []
    for n in [*range(4, 26), 39, 40, 41, 79, 80, 200, 241]:
        base = rng.sample(words, n) if n <= 60 else [f"v{i}" for i in range(n)]
        for cut in range(0, n // 3 + 1, 1 if n < 30 else n // 9):
            made.append(base[cut:] + [f"x{rng.randrange(4)}" for _ in range(rng.randrange(2))])
            made.append([*base, *(f"y{j}" for j in range(cut))])
    # few words, which often fall into few parts
    made += [rng.sample(words[:9], rng.randrange(5, 9)) for _ in range(120)]
    rng.shuffle(made)
    sets = [set(s) for s in made]
    want = {i for i, s in enumerate(sets) if len(s) >= lines.LEAST_WORDS and any(len(e) >= lines.LEAST_WORDS and 10 * len(s & e) >= 8 * len(s | e) for e in sets[:i])}
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(made)], "doc_id long, text string")
    assert {r.doc_id for r in lines.line_duplicates(docs).where("n_removed > 0").collect()} == want
