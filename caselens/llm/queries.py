"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The vocabulary file of the BPE queries, a parameter of the operator.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages, train_tree

    return extract_pages(table(spark, sf_dir, "pages"), train_tree(spark))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_language_model, held_out, identify

    docs = table(spark, sf_dir, "documents")
    out = F.col("held_out")
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    model = fit_language_model(marked.where(~out))
    return identify(marked, model, carry=("held_out",))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_components

    return near_components(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"))


@query
def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op7_substring_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunks import chunk_duplicates

    return chunk_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP5_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op5_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_OP5_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP5_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d, lens)),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_duplicates

    return line_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op8_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc_id, line, content, list_sort(list_distinct(list_filter(regexp_split_to_array(
  translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))) AS k FROM l),
c AS (SELECT k, min((doc_id, line)) AS at, row_number() OVER (ORDER BY min((doc_id, line))) AS c FROM s WHERE len(k) >= 5 GROUP BY k),
t AS (SELECT c, unnest(k) AS w, len(k) AS n FROM c),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
r AS (SELECT c, t.w, n, row_number() OVER (PARTITION BY c ORDER BY df, t.w) AS pos FROM t JOIN f ON t.w = f.w),
p AS (SELECT DISTINCT x.c AS later, y.c AS earlier FROM r x JOIN r y ON x.w = y.w AND x.c > y.c
  WHERE x.pos <= x.n - ceil(0.8 * x.n) + 1 AND y.pos <= y.n - ceil(0.8 * y.n) + 1 AND 10 * x.n >= 8 * y.n AND 10 * y.n >= 8 * x.n),
v AS (SELECT later, earlier, len(list_intersect(a.k, b.k)) AS m, len(a.k) + len(b.k) AS total FROM p JOIN c a ON a.c = later JOIN c b ON b.c = earlier),
gone AS (SELECT s.doc_id, s.line FROM s JOIN c ON s.k = c.k WHERE (s.doc_id, s.line) <> c.at OR c.c IN (SELECT later FROM v WHERE 10 * m >= 8 * (total - m))),
o AS (SELECT l.doc_id, l.line, content, gone.line IS NOT NULL AS g FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.line = gone.line),
d AS (SELECT doc_id, count(*) AS n_lines, sum(CAST(g AS INT)) AS n_removed, coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT g), '') AS kept FROM o GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(kept) AS BIGINT) AS n_kept_chars, sha256(kept) AS kept_sha256 FROM d
"""


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from .licenses import GAP, RULES, SENTENCES

    known = ", ".join(f"('{i}', '{s}')" for i, s in SENTENCES)
    steps = ", ".join(f"('{name}', '{lic}', '{kind}', {i}, '{s}', {len(ids)})" for name, lic, kind, ids in RULES for i, s in enumerate(ids))
    return rf"""
WITH RECURSIVE known(sid, sentence) AS (VALUES {known}), steps(rule, license, kind, step, sid, steps) AS (VALUES {steps}),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM s),
k AS (SELECT doc_id, pos, sid FROM e JOIN known USING (sentence)),
m AS (SELECT doc_id, pos, rule, license, kind, step, steps FROM k JOIN steps USING (sid) WHERE step = 0
  UNION SELECT m.doc_id, k.pos, m.rule, m.license, m.kind, n.step, m.steps FROM m JOIN steps n ON n.rule = m.rule AND n.step = m.step + 1
  JOIN k ON k.doc_id = m.doc_id AND k.sid = n.sid AND k.pos > m.pos AND k.pos <= m.pos + {GAP + 1}),
h AS (SELECT doc_id, count(*) AS n_matches, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds
  FROM m WHERE step = steps - 1 GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_known FROM k GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches,
  coalesce(licenses, '') AS licenses, coalesce(kinds, '') AS kinds
FROM s LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)
"""


ORACLES["op9_license_scan"] = _license_sql()


#: The vocabulary whose tokens are counted, a parameter of the operator.
COUNTED_VOCABULARY = "byte_bpe_50k.json"


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_machine import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED_VOCABULARY))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import run_table

    return run_table(table(spark, sf_dir, "documents"), periodic_tails=True)


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(table(spark, sf_dir, "documents"), shorten=31)
