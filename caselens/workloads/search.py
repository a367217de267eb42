"""Search, reranking and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import norm_query, requested_count, tokens
from ..operators import search as op
from ..views import convo, part_catalogue, part_cases, query_set, sql_with, table
from .registry import query
from .sqltext import s_any, s_count, s_norm, s_query, s_tokens_cte

CHANNELS = "lower(replace(entry_channels_raw, ';', ' '))"
_FIELDS = "\nUNION ALL ".join(
    f"SELECT case_id, '{name}' AS field, {op.FIELD_WEIGHTS[name]} AS w, {value} AS v FROM case_parts"
    for name, value in {
        "title": "lower(title)", "category": "ccl2023_category", "subcategory": "custom_subcategory",
        "method": "lower(title)", "channel": CHANNELS, "victim": "lower(victim_group)",
        "signal": "lower(risk_signals)", "summary": "lower(summary)", "tag": "lower(title)",
        "content": s_norm(
            "lower(concat_ws(' ', title, ccl2023_category, custom_subcategory, title, "
            "replace(entry_channels_raw, ';', ' '), title, victim_group, summary, risk_signals))"
        ),
    }.items()
)
PREPARED = f"""q0 AS (SELECT query_id, query, {s_query('query')} AS cleaned FROM query_set),
cats AS (SELECT DISTINCT ccl2023_category AS name FROM case_parts),
imp AS (SELECT query_id, name FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) AS rn
  FROM q0 JOIN cats ON contains(cleaned, name)) WHERE rn = 1),
prep AS (SELECT q0.query_id, query, cleaned, coalesce(name, '') AS implicit,
  CASE WHEN name IS NULL THEN cleaned ELSE trim(replace(cleaned, name, ' ')) END AS residual FROM q0 LEFT JOIN imp USING (query_id))"""
SCORED = f"""{PREPARED},
{s_tokens_cte("(SELECT query_id, " + s_query('residual') + " AS rq FROM prep)", "query_id", "rq")},
ntok AS (SELECT query_id, count(*) AS n FROM tok GROUP BY 1),
use_tok AS (SELECT t.query_id, token FROM tok t JOIN ntok USING (query_id) WHERE length(token) >= 2 OR n <= 1),
f AS ({_FIELDS}),
parts AS (SELECT query_id, case_id, CASE WHEN v = residual THEN w * 100 ELSE w * 62 END AS c FROM prep JOIN f ON residual <> '' AND contains(v, residual)
  UNION ALL SELECT query_id, case_id, CASE WHEN field = 'content' THEN w * 28 ELSE w * 42 END FROM use_tok JOIN f ON contains(v, token)),
lex AS (SELECT query_id, case_id, CAST(sum(c) AS DOUBLE) / 100 AS score FROM parts GROUP BY 1, 2),
pool AS (SELECT l.query_id, l.case_id, score, lower(title) AS t, title, custom_subcategory AS sub,
    CASE WHEN victim_group = '' THEN '未知人群' ELSE lower(victim_group) END AS victim, ccl2023_category AS cat
  FROM lex l JOIN prep USING (query_id) JOIN case_parts c ON c.case_id = l.case_id
  WHERE residual <> '' AND score >= 8 AND (implicit = '' OR contains(ccl2023_category, implicit))
  UNION ALL SELECT query_id, case_id, 0.0, lower(title), title, custom_subcategory,
    CASE WHEN victim_group = '' THEN '未知人群' ELSE lower(victim_group) END, ccl2023_category
  FROM prep JOIN case_parts ON residual = '' AND (implicit = '' OR contains(ccl2023_category, implicit))),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t, case_id) AS rank,
  count(*) OVER (PARTITION BY query_id) AS total FROM pool)"""
# one recursion step moves the preferred entry from ``rest`` to ``done``
FOLD = """/*recursive*/ heads AS (SELECT query_id, list({'rank': rank, 'score': score, 't': t, 'sub': sub, 'victim': victim, 'cat': cat, 'case_id': case_id} ORDER BY rank) AS l
  FROM rk WHERE rank <= 40 GROUP BY query_id),
fold AS (SELECT query_id, 1 AS step, len(l) AS n, l[1:1] AS done, l[2:] AS rest FROM heads
  UNION ALL SELECT query_id, step + 1, n, list_concat(done, list_filter(rest, lambda x: x.rank = pick)), list_filter(rest, lambda x: x.rank <> pick)
  FROM (SELECT *, list_sort(list_transform(list_filter(rest, lambda x: x.score >= rest[1].score - greatest(4.0, abs(rest[1].score) * 0.2)),
      lambda x: {'a': len(list_filter(done, lambda d: d.sub = x.sub)), 'b': len(list_filter(done, lambda d: d.victim = x.victim)),
        'c': len(list_filter(done, lambda d: d.cat = x.cat)), 's': -x.score, 't': x.t, 'rank': x.rank}))[1].rank AS pick
    FROM fold WHERE step < n)),
placed AS (SELECT query_id, e.case_id, e.score, i AS position FROM (SELECT query_id, unnest(done) AS e, generate_subscripts(done, 1) AS i FROM fold WHERE step = n)
  UNION ALL SELECT query_id, case_id, score, rank FROM rk WHERE rank > 40)"""


def _sql(body: str, extra: str = SCORED) -> str:
    return sql_with("query_set case_parts", body, extra)


def lexical_page(spark, sf):
    return op.search(query_set(spark, sf), part_catalogue(spark, sf), limit=10, diverse=False)


@query("lexical_search", _sql("""
SELECT query_id, rank AS position, case_id, score, total FROM rk WHERE rank <= 10"""))
def lexical_search(spark, sf):
    return lexical_page(spark, sf)


@query("diversity_rerank", _sql("""
SELECT query_id, position, p.case_id, p.score, total FROM placed p JOIN (SELECT DISTINCT query_id, total FROM rk) USING (query_id)
WHERE position <= 50""", SCORED.replace("q0 AS", "/*recursive*/ q0 AS", 1) + ",\n" + FOLD))
def diversity_rerank(spark, sf):
    return op.search(query_set(spark, sf), part_catalogue(spark, sf), limit=50)


@query("paged_results", _sql("""
SELECT query_id, rank AS position, case_id, score, total FROM rk WHERE rank > 25 AND rank <= 55"""))
def paged_results(spark, sf):
    return op.search(query_set(spark, sf), part_catalogue(spark, sf), offset=25, limit=30, diverse=False)


_BROWSE = """q0 AS (SELECT 1 AS query_id),
pool AS (SELECT 1 AS query_id, case_id, CAST(0 AS DOUBLE) AS score, lower(title) AS t, custom_subcategory AS sub,
    CASE WHEN victim_group = '' THEN '未知人群' ELSE lower(victim_group) END AS victim, ccl2023_category AS cat
  FROM case_parts WHERE risk_level = '低' AND contains(lower(entry_channels_raw), 'app')),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t, case_id) AS rank,
  count(*) OVER (PARTITION BY query_id) AS total FROM pool)"""


@query("catalogue_browse", _sql("""
SELECT p.query_id, position, p.case_id, p.score, total FROM placed p JOIN (SELECT DISTINCT query_id, total FROM rk) USING (query_id)
WHERE position <= 30""", _BROWSE.replace("q0 AS", "/*recursive*/ q0 AS", 1) + ",\n" + FOLD))
def catalogue_browse(spark, sf):
    blank = query_set(spark, sf).where(norm_query("query") == "").select(
        F.lit(1).alias("query_id"), F.lit("").alias("query")
    ).distinct()
    return op.search(blank, part_catalogue(spark, sf), risk_level="低", entry_channel="app", limit=30)


@query("implicit_category", _sql("SELECT query_id, implicit, residual FROM prep", PREPARED))
def implicit_category(spark, sf):
    names = op.category_vocabulary(part_catalogue(spark, sf))
    return op.prepare_queries(query_set(spark, sf), names).select("query_id", "implicit", "residual")


@query("category_vocab", sql_with("case_parts", """
SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS rank FROM (
  SELECT DISTINCT ccl2023_category AS name FROM case_parts UNION SELECT DISTINCT custom_subcategory FROM case_parts)"""))
def category_vocab(spark, sf):
    cases = part_catalogue(spark, sf)
    declared = cases.select(F.col("custom_subcategory").alias("name"))
    names = op.category_vocabulary(cases, declared)
    order = Window.orderBy(F.desc(F.length("name")), F.asc("name"))
    return names.select("name", F.row_number().over(order).alias("rank"))


@query("query_normalize", sql_with("query_set convo", f"""
SELECT CAST(query_id AS BIGINT) AS id, 0 AS turn, {s_query('query')} AS cleaned FROM query_set
UNION ALL SELECT conv_id, turn, {s_query('question')} FROM convo"""))
def query_normalize(spark, sf):
    listed = query_set(spark, sf).select(
        F.col("query_id").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("turn"),
        norm_query("query").alias("cleaned"),
    )
    asked = convo(spark, sf).select(F.col("conv_id").alias("id"), "turn", norm_query("question").alias("cleaned"))
    return listed.unionByName(asked)


_ASKED = """asked AS (SELECT 'q' || query_id AS id, query AS text FROM query_set
  UNION ALL SELECT 'c' || conv_id || '-' || turn, question FROM convo)"""


def _asked(spark, sf):
    listed = query_set(spark, sf).select(
        F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), F.col("query").alias("text")
    )
    turns = convo(spark, sf).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.col("question").alias("text"),
    )
    return listed.unionByName(turns)


@query("query_tokens", sql_with("query_set convo", "SELECT id, pos, token FROM tok",
    f"{_ASKED}, clean AS (SELECT id, {s_query('text')} AS c FROM asked), {s_tokens_cte('clean', 'id', 'c')}"))
def query_tokens(spark, sf):
    rows = _asked(spark, sf).select("id", F.posexplode(tokens(norm_query("text"))).alias("pos", "token"))
    return rows.withColumn("pos", F.col("pos") + 1)


@query("requested_count", sql_with("query_set convo", f"""
SELECT id, coalesce({s_count('text')}, 0) AS wanted FROM asked""", _ASKED))
def wanted_count(spark, sf):
    return _asked(spark, sf).select("id", F.coalesce(requested_count("text"), F.lit(0)).alias("wanted"))


_K = f"""{SCORED},
ctok AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, token FROM ct) GROUP BY 1),
kq AS (SELECT q0.query_id, CASE
    WHEN EXISTS (SELECT 1 FROM case_parts c WHERE contains(cleaned, lower(c.title)))
      AND NOT EXISTS (SELECT 1 FROM cats WHERE contains(cleaned, name)) AND {s_count('query')} IS NULL THEN 1
    WHEN {s_count('query')} IS NOT NULL THEN least(12, {s_count('query')} + 2)
    WHEN {s_any('query', op.BROAD_MARKERS)} THEN 12
    ELSE least(12, greatest(2, coalesce(n, 0) + 1)) END AS k FROM q0 LEFT JOIN ctok USING (query_id))"""
_K = _K.replace("ctok AS", s_tokens_cte("q0", "query_id", "cleaned", "ct") + ",\nctok AS", 1)


@query("adaptive_topk", _sql("""
SELECT query_id, CAST(k AS INT) AS k, rank AS position, case_id, score FROM kq JOIN rk USING (query_id) WHERE rank <= k""", _K))
def adaptive_topk(spark, sf):
    queries, cases = query_set(spark, sf), part_catalogue(spark, sf)
    widths = op.adaptive_k(queries, cases)
    page = op.search(queries, cases, limit=op.MAX_CANDIDATES, diverse=False)
    return page.join(widths, "query_id").where("position <= k").select(
        "query_id", "k", "position", "case_id", "score"
    )


_SCOPE_Q = """sq AS (SELECT 'p' || input_pos AS id, '有哪些' || ccl2023_category || title || '?' AS query FROM case_parts
  UNION ALL SELECT 'c' || input_pos, '有哪些 ' || ccl2023_category || '案例 ' || custom_subcategory FROM case_parts
  UNION ALL SELECT 'n' || input_pos, ccl2023_category FROM case_parts)"""


@query("scope_browse", sql_with("case_parts", f"""
SELECT id, {s_any('query', op.SCOPE_MARKERS)} AND {s_norm("txt")} = '' AS scope_browse
FROM walk WHERE i = (SELECT count(*) FROM names)""", f"""/*recursive*/ {_SCOPE_Q},
names AS (SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS i FROM (
  SELECT DISTINCT ccl2023_category AS name FROM case_parts UNION SELECT DISTINCT custom_subcategory FROM case_parts)),
walk AS (SELECT id, query, {s_query('query')} AS txt, CAST(0 AS BIGINT) AS i FROM sq
  UNION ALL SELECT id, query, replace(txt, name, ' '), names.i FROM walk JOIN names ON names.i = walk.i + 1)"""))
def scope_browse(spark, sf):
    cases = part_catalogue(spark, sf)
    names = op.category_vocabulary(cases, cases.select(F.col("custom_subcategory").alias("name")))
    pos = F.col("input_pos").cast("string")
    rows = cases.select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("p"), pos).alias("id"),
                         F.concat(F.lit("有哪些"), "ccl2023_category", "title", F.lit("?")).alias("query")),
                F.struct(F.concat(F.lit("c"), pos).alias("id"),
                         F.concat(F.lit("有哪些 "), "ccl2023_category", F.lit("案例 "), "custom_subcategory").alias("query")),
                F.struct(F.concat(F.lit("n"), pos).alias("id"), F.col("ccl2023_category").alias("query")),
            )
        )
    )
    return op.is_scope_browse(rows, names).select("id", "scope_browse")


@query("exploration_offset", sql_with("convo", f"""
SELECT conv_id, turn, CASE WHEN room = 0 THEN 0 ELSE 1 + CAST('0x' || substr(sha256(conv_id || chr(0) || turn || chr(0) || {s_query('question')}), 1, 15) AS BIGINT) % room END AS "offset"
FROM (SELECT *, greatest(turn * 100 + 9 - 12, 0) AS room FROM convo)"""))
def exploration(spark, sf):
    turns = convo(spark, sf).select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"),
        F.col("question").alias("query"), (F.col("turn") * 100 + 9).alias("total"), F.lit(12).alias("limit"),
    )
    return op.exploration_offset(turns).select(
        F.col("session_id").alias("conv_id"), F.col("turn_id").alias("turn"), "offset"
    )


@query("wraparound_pages", sql_with("case_parts", """
SELECT case_id, position, CASE WHEN position < total - 47 THEN position // 30 ELSE CAST(ceil((total - 47) / 30.0) AS BIGINT) + (position - (total - 47)) // 30 END AS page
FROM (SELECT case_id, total, (rn - 1 - 47 + total) % total AS position FROM (
  SELECT case_id, row_number() OVER (ORDER BY lower(title), case_id) AS rn, count(*) OVER () AS total FROM case_parts))"""))
def wraparound(spark, sf):
    rows = part_cases(spark, sf).select("case_id", F.lower("title").alias("_t"))
    return op.wraparound_pages(rows, [F.asc("_t"), F.asc("case_id")], start=47).select(
        "case_id", "position", "page"
    )


@query("keyed_merge", """
SELECT o_orderkey AS id, 'kept' AS origin, CAST(0 AS BIGINT) AS l_partkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT id, 'added', l_partkey FROM (SELECT l_orderkey AS id, l_partkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) WHERE rn = 1""")
def keyed_merge(spark, sf):
    existing = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"), F.lit(0).alias("l_linenumber"),
        F.lit(0).cast("bigint").alias("l_partkey"), F.lit("kept").alias("origin"),
    )
    incoming = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", F.lit("added").alias("origin")
    )
    return op.merge_by_id(existing, incoming, "id", ["l_linenumber", "l_partkey"]).select(
        "id", "origin", "l_partkey"
    )
