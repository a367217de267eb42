"""Embedding index and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dot, l2_normalize, rms
from ..operators import search as so
from ..operators import vectors as op
from ..operators.catalogue import with_embedding_text
from ..plans.scan import top_rows
from ..sources.index import index_meta, valid_vectors
from ..views import doc_cases, doc_catalogue, query_set, sql_with, table
from .catalogue import _EMBED
from .registry import query
from .search import FOLD, SCORED
from .sqltext import s_norm, s_query, s_tokens_cte

_VEC = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / norm) AS e, norm FROM n WHERE norm > 0)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query("index_load", f"""WITH {_VEC} SELECT vec_id, len(e) AS dims, round(norm, 6) AS norm,
  round(list_sum(list_transform(e, lambda x: x * x)), 6) AS unit FROM u""")
def index_load(spark, sf):
    raw = _vectors(spark, sf).withColumn("_n", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    return valid_vectors(raw, key="vec_id").select(
        "vec_id", F.size("embedding").alias("dims"), F.round("_n", 6).alias("norm"),
        F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("unit"),
    )


@query("vector_normalize", f"""WITH {_VEC} SELECT vec_id, i AS pos, round(x, 6) AS value FROM (
  SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u)""")
def vector_normalize(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", F.posexplode(l2_normalize("embedding")).alias("pos", "value"))
    return rows.select("vec_id", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))


@query("vector_dot", f"""WITH {_VEC} SELECT a.vec_id, round(list_sum(list_transform(generate_series(1, 40 + b.label), lambda i: a.e[i] * b.e[i])), 6) AS score
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def vector_dot(spark, sf):
    left = _vectors(spark, sf).select("vec_id", "embedding")
    right = _vectors(spark, sf).select(
        (F.col("vec_id") - 1).alias("vec_id"), F.slice("embedding", F.lit(1), 40 + F.col("label")).alias("other")
    )
    return left.join(right, "vec_id").select(
        "vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("score")
    )


@query("block_rms", f"WITH {_VEC} SELECT vec_id, round(norm / sqrt(len(e)), 6) AS rms FROM n")
def block_rms(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.round(rms("embedding"), 6).alias("rms"))


def _query_vectors(spark, sf):
    wanted = query_set(spark, sf).select("query_id", (F.col("query_id") - 1).cast("bigint").alias("vec_id"))
    return _vectors(spark, sf).join(wanted, "vec_id").select("query_id", F.col("embedding").alias("vector"))


_PAIRS = f"""{_VEC}, qv AS (SELECT query_id, e FROM query_set JOIN u ON vec_id = query_id - 1),
hit AS (SELECT query_id, vec_id, list_sum(list_transform(generate_series(1, len(u.e)), lambda i: u.e[i] * qv.e[i])) AS score FROM qv, u)"""


@query("vector_search", sql_with("query_set", """
SELECT query_id, vec_id, round(score, 6) AS score FROM hit WHERE score >= 0.15""", _PAIRS))
def vector_search(spark, sf):
    hits = op.vector_search(_query_vectors(spark, sf), _vectors(spark, sf), key="vec_id")
    return hits.withColumn("score", F.round("score", 6))


@query("vector_topk", sql_with("query_set", """
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hit WHERE score >= 0.15) WHERE rank <= 10""", _PAIRS))
def vector_topk(spark, sf):
    hits = op.vector_search(_query_vectors(spark, sf), _vectors(spark, sf), key="vec_id", k=10)
    return hits.withColumn("score", F.round("score", 6))


@query("vector_neighbours", f"""WITH {_VEC}, p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(generate_series(1, len(a.e)), lambda i: a.e[i] * b.e[i])) AS score FROM u a, u b WHERE a.vec_id <> b.vec_id)
SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM p WHERE score >= 0.15) WHERE rank <= 5""")
def vector_neighbours(spark, sf):
    """The five nearest others of every vector: all rows ask, against all rows."""
    vectors = _vectors(spark, sf)
    # a vector finds itself too, so one more is asked for; what rounds alike is ordered by id
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = op.vector_search(asked, vectors, key="vec_id", round_to=6, k=6).where("query_id <> vec_id").drop("rank")
    return top_rows(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], 5)


@query("vector_semi_join", """SELECT vec_id FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND vec_id IN (SELECT doc_id FROM labels)""")
def vector_semi_join(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "vec_id")
    known = table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    return op.semi_candidates(_vectors(spark, sf), docs.where("lang = 'en'"), known, "vec_id").select("vec_id")


def _items(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))


@query("index_missing", "SELECT doc_id AS vec_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def index_missing(spark, sf):
    return op.missing_items(_items(spark, sf), _vectors(spark, sf), "vec_id")


@query("index_coverage", """SELECT count(v) AS indexed, count(*) AS total, round(100.0 * count(v) / count(*), 1) AS percent
FROM documents LEFT JOIN (SELECT DISTINCT vec_id AS v FROM embeddings) ON v = doc_id""")
def index_coverage(spark, sf):
    return op.index_coverage(_items(spark, sf), _vectors(spark, sf), "vec_id")


@query("index_upsert", f"""WITH {_VEC} SELECT vec_id, CASE WHEN label = 1 THEN 'new' ELSE 'old' END AS origin,
  round(CASE WHEN label = 1 THEN e[len(e)] ELSE e[1] END, 6) AS first FROM v WHERE vec_id IN (SELECT doc_id FROM documents)""")
def index_upsert(spark, sf):
    old = _vectors(spark, sf).select("vec_id", "embedding", F.lit("old").alias("origin"))
    new = _vectors(spark, sf).where("label = 1").select(
        "vec_id", F.reverse("embedding").alias("embedding"), F.lit("new").alias("origin")
    )
    merged = op.upsert_index(old, new, _items(spark, sf), "vec_id")
    return merged.select(
        "vec_id", "origin", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first")
    )


@query("embedding_build", sql_with("doc_cases", """
SELECT case_id, cell, round(c / sqrt(sum(c * c) OVER (PARTITION BY case_id)), 6) AS value FROM (
  SELECT case_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS cell, CAST(count(*) AS DOUBLE) AS c FROM (
    SELECT case_id, unnest(regexp_extract_all(lower(embedding_text), '[\\p{L}\\p{N}_]+')) AS w FROM (
      SELECT case_id, CASE WHEN length(t) <= 1400 THEN t ELSE rtrim(replace(substr(m, 1, cut), chr(2), '-')) || '...' END AS embedding_text FROM cuts))
  GROUP BY 1, 2)""", _EMBED))
def embedding_build(spark, sf):
    texts = with_embedding_text(doc_cases(spark, sf))
    vectors = op.embed(texts, "case_id", "embedding_text").where("error IS NULL")
    cells = vectors.select("case_id", F.posexplode(l2_normalize("embedding")).alias("cell", "value"))
    return cells.where("value <> 0").select("case_id", "cell", F.round("value", 6).alias("value"))


@query("index_staleness", """SELECT 'same' AS probe, CASE WHEN n = m THEN 'fresh' ELSE 'other_dataset' END AS status
FROM (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents) AS m)
UNION ALL SELECT 'index', CASE WHEN n = m THEN 'fresh' ELSE 'other_dataset' END FROM (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM embeddings) AS m)
UNION ALL SELECT 'model', 'other_model' FROM (SELECT count(*) FROM documents)""")
def index_staleness(spark, sf):
    def lineage(name):
        return table(spark, sf, name).agg(F.count(F.lit(1)).alias("item_count")).select(
            F.lit(4).alias("schema_version"), F.lit("").alias("generated_at"), "item_count"
        )

    now = lineage("documents")
    built = index_meta(_vectors(spark, sf), now, model="hashed")
    other = index_meta(_vectors(spark, sf), lineage("embeddings"), model="hashed")
    probes = [("same", built, "hashed"), ("index", other, "hashed"), ("model", built, "another")]
    out = None
    for name, meta, model in probes:
        row = op.index_staleness(meta, now, model).select(F.lit(name).alias("probe"), "status")
        out = row if out is None else out.unionByName(row)
    return out


_DOC_FIELDS = "\nUNION ALL ".join(
    f"SELECT case_id, '{name}' AS field, {so.FIELD_WEIGHTS[name]} AS w, replace(lower({s_norm(value)}), 'ß', 'ss') AS v FROM dc"
    for name, value in {
        "title": "title", "category": "ccl2023_category", "subcategory": "custom_subcategory",
        "channel": "source_name || ' ' || lang", "victim": "victim_group", "signal": "risk_signals",
        "summary": "summary",
        "content": "concat_ws(' ', title, ccl2023_category, custom_subcategory, source_name, lang, victim_group, content)",
    }.items()
)
_lex = SCORED[: SCORED.index("pool AS")].rstrip().rstrip(",")
_lex = _lex[: _lex.index("f AS (")] + f"f AS ({_DOC_FIELDS}),\n" + _lex[_lex.index("parts AS ("):]
_lex = _lex.replace("ccl2023_category AS name FROM case_parts", "ccl2023_category AS name FROM doc_cases")
_HYBRID = f"""dc AS (SELECT doc_cases.*, lang FROM doc_cases JOIN documents ON doc_id = input_pos),
{_PAIRS},
{_lex},
cand AS (SELECT l.query_id, l.case_id, l.score FROM lex l JOIN prep USING (query_id) JOIN dc c ON c.case_id = l.case_id WHERE implicit = '' OR contains(ccl2023_category, implicit)),
best AS (SELECT query_id, max(score) AS lm FROM cand GROUP BY 1),
sem AS (SELECT h.query_id, 'FZ-' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS case_id, h.score FROM hit h JOIN prep USING (query_id) JOIN dc ON vec_id = input_pos
  WHERE h.score >= 0.15 AND residual <> '' AND (implicit = '' OR contains(ccl2023_category, implicit))
    AND h.query_id NOT IN (SELECT query_id FROM best WHERE lm >= 8)),
sb AS (SELECT query_id, max(score) AS sm FROM sem GROUP BY 1),
mixed AS (SELECT query_id, case_id, round(0.3::DOUBLE * coalesce(c.score, 0) / coalesce(nullif(lm, 0), 1) + 0.7::DOUBLE * coalesce(s.score, 0) / coalesce(nullif(sm, 0), 1), 6) AS score
  FROM (SELECT * FROM cand WHERE query_id IN (SELECT query_id FROM sb)) c FULL JOIN sem s USING (query_id, case_id) LEFT JOIN best USING (query_id) JOIN sb USING (query_id)),
final AS (SELECT query_id, case_id, score, 'hybrid' AS mode FROM mixed WHERE score >= 0.08
  UNION ALL SELECT query_id, case_id, score, 'lexical' FROM cand WHERE score >= 8 AND query_id NOT IN (SELECT query_id FROM sb))"""


@query("hybrid_search", sql_with("query_set doc_cases", """
SELECT query_id, case_id, score, mode, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM final) WHERE rank <= 30""",
    _HYBRID))
def hybrid_search(spark, sf):
    cases, vectors = doc_catalogue(spark, sf), _vectors(spark, sf).withColumnRenamed("vec_id", "input_pos")
    hits = op.vector_search(_query_vectors(spark, sf), vectors, key="input_pos")
    semantic = hits.join(cases.select("input_pos", "case_id"), "input_pos").select("query_id", "case_id", "score")
    blended = so.hybrid_search(query_set(spark, sf), cases, semantic)
    return top_rows(blended, ["query_id"], [F.desc("score"), F.asc("case_id")], 30)


# every question of the conversations asks, in part as a word, three words or nothing, with facets and pages of its own
_ASK = """CASE (conv_id + turn // 2) % 4 WHEN 0 THEN '' WHEN 1 THEN split_part(text, ' ', 1) WHEN 2 THEN regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+') ELSE text END"""
_FULL = f"""/*recursive*/ dc AS (SELECT doc_cases.*, lang FROM doc_cases JOIN documents ON doc_id = input_pos),
{_VEC},
req AS (SELECT conv_id * 100 + turn AS query_id, {_ASK} AS query, CASE conv_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE '' END AS category,
  CASE WHEN conv_id % 7 = 0 THEN '高' ELSE '' END AS risk, CASE WHEN conv_id % 6 = 0 THEN 'src1' ELSE '' END AS channel, CASE WHEN conv_id % 9 = 0 THEN 'short' ELSE '' END AS victim,
  (conv_id * 7 + turn) % 400 AS vec, CASE conv_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END AS lim, CAST(turn AS INT) AS off FROM conversations WHERE role = 'user'),
q0 AS (SELECT *, {s_query('query')} AS cleaned FROM req),
cats AS (SELECT DISTINCT ccl2023_category AS name FROM doc_cases WHERE ccl2023_category <> ''),
imp AS (SELECT query_id, name FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name) DESC, name) AS rn
  FROM q0 JOIN cats ON category = '' AND contains(cleaned, name)) WHERE rn = 1),
prep AS (SELECT q0.*, CASE WHEN category = '' THEN coalesce(name, '') ELSE category END AS cat,
  CASE WHEN name IS NULL THEN cleaned ELSE trim(replace(cleaned, name, ' ')) END AS residual FROM q0 LEFT JOIN imp USING (query_id)),
{s_tokens_cte("(SELECT query_id, " + s_query('residual') + " AS rq FROM prep)", "query_id", "rq")},
ntok AS (SELECT query_id, count(*) AS n FROM tok GROUP BY 1),
use_tok AS (SELECT t.query_id, token FROM tok t JOIN ntok USING (query_id) WHERE length(token) >= 2 OR n <= 1),
f AS ({_DOC_FIELDS}),
parts AS (SELECT query_id, case_id, CASE WHEN v = residual THEN w * 100 ELSE w * 62 END AS c FROM prep JOIN f ON residual <> '' AND contains(v, residual)
  UNION ALL SELECT query_id, case_id, CASE WHEN field = 'content' THEN w * 28 ELSE w * 42 END FROM use_tok JOIN f ON contains(v, token)),
lex AS (SELECT query_id, case_id, CAST(sum(c) AS DOUBLE) / 100 AS score FROM parts GROUP BY 1, 2),
scope AS (SELECT query_id, case_id, input_pos, residual, replace(lower(title), 'ß', 'ss') AS t, custom_subcategory AS sub,
    CASE WHEN victim_group = '' THEN '未知人群' ELSE lower(victim_group) END AS victim, ccl2023_category AS cat
  FROM prep JOIN dc ON (cat = '' OR contains(ccl2023_category, cat)) AND (risk = '' OR risk_level = risk)
    AND (channel = '' OR contains(lower(entry_channels_raw), channel)) AND (prep.victim = '' OR contains(lower(victim_group), prep.victim))),
cand AS (SELECT query_id, case_id, score FROM lex JOIN scope USING (query_id, case_id) WHERE residual <> ''),
best AS (SELECT query_id, max(score) AS lm FROM cand GROUP BY 1),
shut AS (SELECT query_id FROM best WHERE lm >= 8),
sem AS (SELECT s.query_id, case_id, list_sum(list_transform(generate_series(1, len(u.e)), lambda i: u.e[i] * x.e[i])) AS score
  FROM scope s JOIN prep USING (query_id) JOIN u ON u.vec_id = s.input_pos JOIN u x ON x.vec_id = prep.vec WHERE s.residual <> '' AND s.query_id NOT IN (SELECT query_id FROM shut)),
sem2 AS (SELECT * FROM sem WHERE score >= 0.15),
sb AS (SELECT query_id, max(score) AS sm FROM sem2 GROUP BY 1),
mixed AS (SELECT query_id, case_id, round(0.3::DOUBLE * coalesce(c.score, 0) / coalesce(nullif(lm, 0), 1) + 0.7::DOUBLE * coalesce(s.score, 0) / coalesce(nullif(sm, 0), 1), 6) AS score
  FROM (SELECT * FROM cand WHERE query_id IN (SELECT query_id FROM sb)) c FULL JOIN sem2 s USING (query_id, case_id) LEFT JOIN best USING (query_id) JOIN sb USING (query_id)),
hits AS (SELECT query_id, case_id, score, 'hybrid' AS mode FROM mixed WHERE score >= 0.08
  UNION ALL SELECT query_id, case_id, score, 'lexical' FROM cand WHERE score >= 8 AND query_id NOT IN (SELECT query_id FROM sb)
  UNION ALL SELECT query_id, case_id, 0.0::DOUBLE, 'browse' FROM scope WHERE residual = ''),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t, case_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total
  FROM hits JOIN scope USING (query_id, case_id)),
{FOLD.replace("/*recursive*/ ", "")}"""


@query("search_full", sql_with("doc_cases", """
SELECT p.query_id, p.position, p.case_id, p.score, m.mode, m.total FROM placed p JOIN (SELECT DISTINCT query_id, mode, total FROM rk) m USING (query_id) JOIN req r USING (query_id)
WHERE p.position > r.off AND p.position <= r.off + r.lim""", _FULL))
def search_full(spark, sf):
    """All questions of the conversations, each with its own facets and page, by text, by vector or by browsing."""
    ask = f"""CASE pmod(conv_id + turn div 2, 4) WHEN 0 THEN '' WHEN 1 THEN split_part(text, ' ', 1)
        WHEN 2 THEN regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+', 0) ELSE text END"""
    rows = table(spark, sf, "conversations").where("role = 'user'").selectExpr(
        "conv_id * 100 + turn AS query_id", f"{ask} AS query", "CASE conv_id % 5 WHEN 0 THEN ' en ' WHEN 1 THEN 'fr' END AS category",
        "CASE WHEN conv_id % 7 = 0 THEN '高' ELSE '' END AS risk_level", "CASE WHEN conv_id % 6 = 0 THEN 'SRC1' ELSE '' END AS entry_channel",
        "CASE WHEN conv_id % 9 = 0 THEN 'Short' END AS victim_group", "(conv_id * 7 + turn) % 400 AS vec_id",
        "CASE conv_id % 3 WHEN 0 THEN -5 WHEN 1 THEN 10 ELSE 500 END AS limit", "CAST(turn AS INT) AS offset",
    )
    asked = rows.join(_vectors(spark, sf).select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left")
    cases = doc_catalogue(spark, sf)
    vectors = _vectors(spark, sf).withColumnRenamed("vec_id", "input_pos").join(cases.select("input_pos", "case_id"), "input_pos").select("case_id", "embedding")
    return so.search_requests(asked, cases, vectors=vectors, service=True)
