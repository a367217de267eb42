"""Language, sentence and term queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as lang
from ..operators import language as op
from ..operators import terms as tm
from ..plans.match import find_terms
from ..session import pinned
from ..views import part_cases, part_catalogue, spread, sql_with, table
from .registry import query
from .sqltext import SPACE

_STRIP = f"^{SPACE}|{SPACE}$"


def _hits_sql(x: str, markers) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{m}') AS INT)" for m in markers) + ")"


def _locale_sql(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lang.ALIASES.items())
    codes = " ".join(f"WHEN '{c.lower()}' THEN '{c}'" for c in lang.PROFILES)
    folded = f"lower(replace({x}, '_', '-'))"
    return (
        f"CASE WHEN {folded} IN ('', 'auto') THEN NULL ELSE coalesce(CASE {folded} {whens} END, CASE {folded} {codes} END, "
        f"CASE split_part({folded}, '-', 1) {whens} END) END"
    )


_WORDS = "|".join(lang.ENGLISH_WORDS)
_TAGGED = f"""raw AS (SELECT doc_id, lang, regexp_replace(text, '{_STRIP}', '', 'g') AS c, {_locale_sql('lang')} AS hint FROM documents),
m AS (SELECT *, {_hits_sql('c', lang.CANTONESE)} AS ca, {_hits_sql('c', lang.SICHUAN)} AS si, {_hits_sql('c', lang.HENAN_STRONG)} * 2 + CASE WHEN {_hits_sql('c', lang.HENAN_WEAK)} >= 2 THEN {_hits_sql('c', lang.HENAN_WEAK)} ELSE 0 END AS he,
  len(regexp_extract_all(c, '{lang.HAN}')) AS han, len(regexp_extract_all(c, '[{lang.LATIN}]')) AS latin FROM raw),
tagged AS (SELECT doc_id, lang, CASE WHEN c = '' THEN coalesce(hint, 'zh-CN') WHEN ca > 0 AND ca >= si AND ca >= he THEN 'yue-CN' WHEN si > 0 AND si >= he THEN 'zh-CN-sichuan' WHEN he > 0 THEN 'zh-CN-henan'
  WHEN regexp_matches(c, '{lang.KANA}') THEN 'ja-JP' WHEN regexp_matches(c, '{lang.HANGUL}') THEN 'ko-KR'
  WHEN latin > 0 AND (han = 0 OR latin >= han * 2) THEN CASE WHEN regexp_matches(lower(c), '(?:^|[^{lang.LATIN}])(?:{_WORDS})(?:$|[^{lang.LATIN}])') OR hint IS NULL OR hint NOT IN ('en-US', 'ja-JP', 'ko-KR') THEN 'en-US' ELSE hint END
  WHEN han > 0 AND hint IN ('yue-CN', 'zh-CN-sichuan', 'zh-CN-henan', 'ja-JP') THEN hint WHEN han > 0 THEN 'zh-CN' ELSE coalesce(hint, 'zh-CN') END AS locale FROM m)"""


@query("locale_tagging", f"WITH {_TAGGED} SELECT doc_id, lang, locale FROM tagged")
def locale_tagging(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return op.tag_locale(docs, hint="lang").select("doc_id", "lang", "locale")


@query("locale_confusion", f"WITH {_TAGGED} SELECT lang, locale, count(*) AS n FROM tagged GROUP BY 1, 2")
def locale_confusion(spark, sf):
    return op.locale_confusion(locale_tagging(spark, sf), "lang")


_HINTS = "h AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '_US' WHEN 2 THEN 'ZH_' || CASE lang WHEN 'de' THEN 'hk' WHEN 'fr' THEN 'henan' ELSE 'Hans' END WHEN 3 THEN ' jp ' ELSE 'auto' END AS hint FROM documents)"
_PROVIDER = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lang.PROVIDER_TAGS.items())


@query("locale_canonical", f"""WITH {_HINTS}, l AS (SELECT *, {_locale_sql("trim(hint)")} AS locale FROM h)
SELECT doc_id, coalesce(locale, '') AS locale, coalesce(CASE replace(lower(trim(hint)), '-', '_') {_PROVIDER} END, '') AS provider, coalesce(locale, 'zh-CN') AS profile,
  coalesce(locale, 'zh-CN') IN ('zh-CN', 'yue-CN', 'zh-CN-sichuan', 'zh-CN-henan') AS chinese FROM l""")
def locale_canonical(spark, sf):
    d = F.col("doc_id") % 5
    region = F.when(F.col("lang") == "de", "hk").when(F.col("lang") == "fr", "henan").otherwise("Hans")
    hint = (
        F.when(d == 0, F.col("lang")).when(d == 1, F.concat(F.upper("lang"), F.lit("_US")))
        .when(d == 2, F.concat(F.lit("ZH_"), region)).when(d == 3, " jp ").otherwise("auto")
    )
    rows = op.canonical_locales(table(spark, sf, "documents").select("doc_id", hint.alias("hint")), "hint")
    return rows.select(
        "doc_id", F.coalesce("locale", F.lit("")).alias("locale"),
        F.coalesce("provider", F.lit("")).alias("provider"), "profile", "chinese",
    )


_CL = lang.CLOSERS.replace("'", "''")


def _marked_sql(x: str) -> str:
    mark, blank = "chr(64976)", SPACE[:-1]
    text = f"regexp_replace({x}, '(\\.{_CL}+)', '\\1' || {mark}, 'g')"
    text = f"regexp_replace({text}, '\\.({blank})', '.' || {mark} || '\\1', 'g')"
    text = f"regexp_replace({text}, '\\.$', '.' || {mark})"
    # a border after an abbreviation or initials is taken back
    text = f"regexp_replace({text}, '((?:^|{blank})(?i:{lang.ABBREVIATIONS})\\.{_CL}*)' || {mark}, '\\1', 'g')"
    text = f"regexp_replace({text}, '((?:^|{blank})(?i:[a-z]\\.){{2,8}}{_CL}*)' || {mark}, '\\1', 'g')"
    return f"regexp_replace({text}, '({lang.HARD}{_CL}*)', '\\1' || {mark}, 'g')"


_SENT = f"""parts AS (SELECT doc_id, string_split({_marked_sql('text')}, chr(64976)) AS p FROM documents),
s AS (SELECT doc_id, unnest(p[:-2]) AS raw, generate_subscripts(p[:-2], 1) AS o FROM parts),
t AS (SELECT doc_id, o, regexp_replace(raw, '{_STRIP}', '', 'g') AS sentence FROM s)"""


@query("sentence_table", f"""WITH {_SENT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS pos, sentence FROM t WHERE sentence <> ''""")
def sentence_table(spark, sf):
    return op.sentences(spread(table(spark, sf, "documents")), ["doc_id"])


_FIRST = _SENT.replace("doc_id", "conv_id, turn").replace("FROM documents", "FROM conversations")


@query("first_and_rest", f"""WITH {_FIRST},
g AS (SELECT conv_id, turn, list(sentence ORDER BY o) AS l FROM t WHERE sentence <> '' GROUP BY 1, 2)
SELECT p.conv_id, p.turn, coalesce(l[1], '') AS first,
  regexp_replace(CASE WHEN p.conv_id % 2 = 0 THEN array_to_string(coalesce(l[2:], []), '') ELSE array_to_string(coalesce(l[2:], []), ' ') END || p.p[-1], '{_STRIP}', '', 'g') AS rest
FROM parts p LEFT JOIN g ON g.conv_id = p.conv_id AND g.turn = p.turn""")
def first_and_rest(spark, sf):
    rows = table(spark, sf, "conversations").withColumn(
        "locale", F.when(F.col("conv_id") % 2 == 0, "ja-JP").otherwise("de")
    )
    return op.first_and_rest(rows, ["conv_id", "turn"], "text", "locale")


# --- terms -----------------------------------------------------------------------------

RUN = "[a-z ]+"
_VOCAB = """entry AS (SELECT title AS canonical, 'title' AS kind, ccl2023_category AS category, input_pos * 10 AS o FROM case_parts
  UNION ALL SELECT ccl2023_category, 'category', ccl2023_category, input_pos * 10 + 1 FROM case_parts
  UNION ALL SELECT unnest(string_split(entry_channels_raw, ';')), 'channel', ccl2023_category, input_pos * 10 + 2 FROM case_parts
  UNION ALL SELECT custom_subcategory, 'subcategory', ccl2023_category, input_pos * 10 + 3 FROM case_parts),
vocab AS (SELECT canonical, kind, arg_max(category, o) AS category, min(o) AS place FROM entry GROUP BY 1, 2
  UNION ALL SELECT t, 'common', '', 9000000000000000 + i FROM (SELECT unnest([%s]) AS t, generate_subscripts([%s], 1) AS i))""" % (
    ", ".join(f"'{t}'" for t in tm.COMMON_TERMS), ", ".join(f"'{t}'" for t in tm.COMMON_TERMS))


@query("term_vocabulary", sql_with("case_parts", "SELECT canonical, kind, category FROM vocab", _VOCAB))
def term_vocabulary(spark, sf):
    return tm.build_vocabulary(part_cases(spark, sf)).select("canonical", "kind", "category")


_CORRUPT = "replace(replace(title, 'in', 'an'), 'ge', 'je')"
_CANDS = f"""{_VOCAB},
forms AS (SELECT *, canonical AS form FROM vocab WHERE regexp_matches(canonical, '^[a-z ]+$')),
raws AS (SELECT DISTINCT {_CORRUPT} AS raw FROM case_parts),
k1 AS (SELECT raw, canonical, kind, category, place FROM raws JOIN forms ON form = raw),
k2 AS (SELECT raw, canonical, kind, category, place FROM raws JOIN forms ON length(form) = length(raw) AND left(form, 1) = left(raw, 1) WHERE raw NOT IN (SELECT raw FROM k1)),
cands AS (SELECT raw, canonical, arg_max(kind, place) AS kind, arg_max(category, place) AS category FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY 1, 2)"""


def _raws(spark, sf):
    title = F.replace(F.replace(F.col("title"), F.lit("in"), F.lit("an")), F.lit("ge"), F.lit("je"))
    return part_cases(spark, sf).select(title.alias("raw"))


@query("term_candidates", sql_with("case_parts", "SELECT raw, canonical, kind, category FROM cands", _CANDS))
def term_candidates(spark, sf):
    forms = tm.vocabulary_forms(tm.build_vocabulary(part_cases(spark, sf)), RUN)
    return tm.term_candidates(_raws(spark, sf), forms)


# one row per open pair of text ranges; each step takes the longest common block, the
# earliest on ties, and opens the ranges on both sides of it
_BLOCKS = """blk AS (SELECT raw AS a, canonical AS b, 1 AS al, length(raw) + 1 AS ah, 1 AS bl, length(canonical) + 1 AS bh, 0 AS size FROM cands
  UNION ALL SELECT a, b, CASE WHEN side = 1 THEN al ELSE m.i + m.k END, CASE WHEN side = 1 THEN m.i ELSE ah END, CASE WHEN side = 1 THEN bl ELSE m.j + m.k END, CASE WHEN side = 1 THEN m.j ELSE bh END, CASE WHEN side = 1 THEN m.k ELSE 0 END
  FROM (SELECT *, list_sort(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j:
      {'k': list_max(list_filter(range(0, least(ah - i, bh - j) + 1), lambda n: substr(a, i, n) = substr(b, j, n))), 'ni': -i, 'nj': -j, 'i': i, 'j': j}))))[-1] AS m
    FROM blk WHERE ah > al AND bh > bl), (SELECT unnest([1, 2]) AS side) WHERE m.k > 0),
ratio AS (SELECT a AS raw, b AS canonical, 2.0::DOUBLE * sum(size) / (length(a) + length(b)) AS s FROM blk GROUP BY a, b),
rated AS (SELECT raw, canonical, 0.52::DOUBLE * s + 0.48::DOUBLE * (len(list_filter(range(1, length(raw) + 1), lambda i: substr(raw, i, 1) = substr(canonical, i, 1))) / greatest(length(raw), length(canonical))::DOUBLE + s) / 2 AS base FROM ratio)"""
_RATIO = f"/*recursive*/ {_CANDS}, {_BLOCKS}"


@query("term_similarity", sql_with("case_parts", "SELECT raw, canonical, round(base, 6) AS base FROM rated", _RATIO))
def term_similarity(spark, sf):
    vocabulary = pinned(tm.build_vocabulary(part_catalogue(spark, sf)))
    candidates = tm.term_candidates(_raws(spark, sf), tm.vocabulary_forms(vocabulary, RUN))
    return tm.base_scores(candidates, vocabulary).select("raw", "canonical", F.round("base", 6).alias("base"))


_SHORT = "SELECT DISTINCT unnest(string_split(title, ' ')) AS form FROM case_parts UNION SELECT DISTINCT 'tion' FROM case_parts"
_SPAN = f"""forms AS ({_SHORT}),
cutup AS (SELECT doc_id, form, unnest(string_split(text, form)) AS part, generate_subscripts(string_split(text, form), 1) AS i, len(string_split(text, form)) AS n
  FROM documents, (SELECT form FROM forms UNION SELECT unnest(['ment', 'ring', 'atio', 'erou']))),
spot AS (SELECT doc_id, form, i, n, CAST(sum(length(part)) OVER (PARTITION BY doc_id, form ORDER BY i) + (i - 1) * length(form) AS INT) AS l FROM cutup),
hit AS (SELECT doc_id, l, l + length(form) AS r, form FROM spot WHERE i < n AND form IN (SELECT form FROM forms)),
win AS (SELECT doc_id, l AS start, form AS raw FROM spot WHERE i < n AND form IN ('ment', 'ring', 'atio', 'erou'))"""


def _short_forms(spark, sf):
    named = part_cases(spark, sf).select(F.explode("tags").alias("form")).distinct()
    return named.unionByName(named.select(F.lit("tion").alias("form")).distinct())


def _doc_windows(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    wanted = spark.createDataFrame([("ment",), ("ring",), ("atio",), ("erou",)], "term string")
    return find_terms(docs, ["doc_id"], "text", wanted).select(
        "doc_id", (F.col("pos") - 1).alias("start"), F.col("term").alias("raw")
    )


@query("vocabulary_places", """
WITH t AS (SELECT DISTINCT split_part(text, chr(10), 1) AS term FROM documents WHERE split_part(text, chr(10), 1) <> ''),
h AS (SELECT doc_id, term, instr(text, term) AS place FROM documents JOIN t ON contains(text, term))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(place) AS BIGINT) AS place_sum, CAST(max(length(term)) AS BIGINT) AS longest
FROM h GROUP BY doc_id""")
def vocabulary_places(spark, sf):
    """The first lines of all documents, where each occurs first in all documents."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    lines = docs.select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("term"))
    hits = find_terms(docs, ["doc_id"], "text", lines)
    each = hits.groupBy("doc_id", "term").agg(F.min("pos").alias("place"))
    return each.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("place").alias("place_sum"),
        F.max(F.length("term")).cast("bigint").alias("longest"),
    )


@query("span_exclusion", sql_with("case_parts", """
SELECT doc_id, start, raw FROM win w WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = w.doc_id AND w.start < h.r AND w.start + 4 > h.l)""", _SPAN))
def span_exclusion(spark, sf):
    exact = tm.exact_hits(spread(table(spark, sf, "documents")), ["doc_id"], "text", _short_forms(spark, sf))
    return tm.exclude_spans(_doc_windows(spark, sf), exact, ["doc_id"], 4)


_GREEDY = f"""/*recursive*/ {_SPAN},
allspans AS (SELECT doc_id, start, start + length(raw) AS fin, raw FROM win UNION ALL SELECT doc_id, l, r, form FROM hit),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, fin DESC, raw) AS rn FROM allspans),
walk AS (SELECT doc_id, start, fin, raw, rn, true AS kept, fin AS last_end FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.start, o.fin, o.raw, o.rn, o.start >= w.last_end, CASE WHEN o.start >= w.last_end THEN o.fin ELSE w.last_end END
  FROM walk w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)"""


@query("nonoverlap_spans", sql_with("case_parts", """SELECT doc_id, start, fin AS "end", raw FROM walk WHERE kept""", _GREEDY))
def nonoverlap_spans(spark, sf):
    windows = _doc_windows(spark, sf).select("doc_id", "start", (F.col("start") + F.length("raw")).alias("end"), "raw")
    hits = find_terms(spread(table(spark, sf, "documents")), ["doc_id"], "text", _short_forms(spark, sf), "form").select(
        "doc_id", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("term")).alias("end"),
        F.col("term").alias("raw"),
    )
    spans = windows.unionByName(hits).select(
        "doc_id",
        F.struct("start", "end", "raw", F.col("raw").alias("canonical"), F.lit(1.0).alias("score"), F.lit("").alias("reason")).alias("s"),
    )
    kept = spans.groupBy("doc_id").agg(tm.nonoverlap_spans(F.collect_list("s")).alias("k"))
    return kept.select("doc_id", F.explode("k").alias("e")).select("doc_id", "e.start", "e.end", "e.raw")


_CORRECT = f"""/*recursive*/ {_VOCAB},
forms AS (SELECT *, canonical AS form FROM vocab WHERE regexp_matches(canonical, '^[a-z ]+$')),
t AS (SELECT case_id, 'we sell 1 ' || {_CORRUPT} || ', 2 ' || title || ' and 3 wechot' AS text, ccl2023_category AS category, CASE WHEN victim_group = 'students' THEN title END AS ctx FROM case_parts),
spots AS (SELECT text, unnest(range(0, length(text))) AS p FROM (SELECT DISTINCT text FROM t)),
exact AS (SELECT text, p AS l, p + length(form) AS r FROM spots JOIN (SELECT DISTINCT form FROM forms) ON substr(text, p + 1, length(form)) = form),
win AS (SELECT text, p AS start, substr(text, p + 1, size) AS raw FROM spots, (SELECT DISTINCT length(form) AS size FROM forms) z
  WHERE size >= 2 AND p + size <= length(text) AND regexp_matches(substr(text, p + 1, size), '^[a-z ]+$')),
free AS (SELECT * FROM win w WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.text = w.text AND w.start < e.r AND w.start + length(w.raw) > e.l)),
cands AS (SELECT raw, canonical, arg_max(kind, place) AS kind, arg_max(category, place) AS category FROM (SELECT DISTINCT raw FROM free) JOIN forms
  ON length(form) = length(raw) AND left(form, 1) = left(raw, 1) GROUP BY 1, 2),
{_BLOCKS},
sc AS (SELECT t.case_id, start, f.raw, c.canonical, c.kind, t.category = c.category AS incat, coalesce(contains(ctx, c.canonical), false) AS inctx,
  least(1.0::DOUBLE, base + CASE WHEN t.category = c.category THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN coalesce(contains(ctx, c.canonical), false) THEN 0.12::DOUBLE ELSE 0 END) AS score
  FROM t JOIN free f USING (text) JOIN cands c ON c.raw = f.raw JOIN rated r ON r.raw = c.raw AND r.canonical = c.canonical),
pick AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(score) OVER w, 0) AS second FROM sc WINDOW w AS (PARTITION BY case_id, start, raw ORDER BY score DESC, canonical DESC)),
good AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY start, length(raw) DESC, score DESC) AS n FROM pick
  WHERE rn = 1 AND canonical <> raw AND score >= 0.88 AND score - second >= 0.12 AND (incat OR inctx OR kind IN ('common', 'category', 'channel'))),
walk AS (SELECT case_id, n, start, raw, canonical, score, incat, inctx, true AS kept, start + length(raw) AS fin FROM good WHERE n = 1
  UNION ALL SELECT g.case_id, g.n, g.start, g.raw, g.canonical, g.score, g.incat, g.inctx, g.start >= w.fin, CASE WHEN g.start >= w.fin THEN g.start + length(g.raw) ELSE w.fin END
  FROM walk w JOIN good g ON g.case_id = w.case_id AND g.n = w.n + 1),
prevs AS (SELECT *, coalesce(lag(fin) OVER (PARTITION BY case_id ORDER BY start), 0) AS prev FROM walk WHERE kept),
sp AS (SELECT p.case_id, string_agg(substr(text, prev + 1, start - prev) || canonical, '' ORDER BY start) AS head, max(fin) AS fin,
  string_agg(concat_ws(':', start, fin, raw, canonical, round(score, 6), CASE WHEN incat OR inctx THEN concat_ws('; ', CASE WHEN incat THEN 'category' END, CASE WHEN inctx THEN 'asr-context' END) ELSE 'vocabulary' END), '|' ORDER BY start) AS spans
  FROM prevs p JOIN t USING (case_id) GROUP BY 1)"""


@query("term_correction", sql_with("case_parts", """
SELECT case_id, text AS raw_text, CASE WHEN head IS NULL THEN text ELSE head || substr(text, fin + 1) END AS canonical_text, coalesce(spans, '') AS spans FROM t LEFT JOIN sp USING (case_id)""", _CORRECT))
def term_correction(spark, sf):
    cases = part_catalogue(spark, sf)
    title = F.replace(F.replace(F.col("title"), F.lit("in"), F.lit("an")), F.lit("ge"), F.lit("je"))
    texts = cases.select(
        "case_id",
        F.concat(F.lit("we sell 1 "), title, F.lit(", 2 "), "title", F.lit(" and 3 wechot")).alias("text"),
        F.col("ccl2023_category").alias("category"),
        F.when(F.col("victim_group") == "students", F.array("title"))
        .otherwise(F.array().cast("array<string>")).alias("context"),
    )
    fixed = tm.correct_terms(texts, tm.build_vocabulary(cases), ["case_id"], run=RUN)
    return fixed.select(
        "case_id", "raw_text", "canonical_text",
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["end"].cast("string"), s["raw"], s["canonical"],
            s["score"].cast("string"), s["reason"],
        )), "|"), F.lit("")).alias("spans"),
    )
