"""Conversation jobs: routing, grounding, evidence, citations, history, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, casefold, line_text, norm
from ..plans.match import find_terms
from ..plans.scan import CHUNK_ROWS, Last, Sum, numbered, ordered_scan, top_rows
from ..session import pinned

# Limits, phrase lists and prompt texts.
MAX_QUESTION_CHARS = 4000
HISTORY_TURNS, CONTEXT_TURNS, ANSWER_CHARS = 20, 5, 500
EVIDENCE_CHARS, DIGEST_CHARS, DIGEST_CAP = 5200, 760, 6
RECENT_ITEMS, CONTEXT_TITLES, TITLE_CHARS = 8, 8, 200
TERM_BYTES, TERM_PREFIX = 1024, "utf-8;"
IGNORED_TURNS = 32
GREETING_TRIM = "。！!？?～~，,、；;：: ."
REPLY_TRIM = "。！？!?，,、；;：: "
GREETINGS = {
    "": ("你好", "您好", "嗨", "哈喽", "在吗"),
    "zh-CN-henan": ("恁好",),
    "en-US": ("hello", "hi", "hey", "good morning", "good afternoon"),
    "ja-JP": ("こんにちは", "もしもし", "おはよう", "こんばんは"),
    "ko-KR": ("안녕하세요", "안녕", "여보세요"),
}
CONTINUATIONS = (
    "嗯", "嗯嗯", "好", "好的", "行", "可以", "继续", "接着说", "然后呢", "中",
    "ok", "okay", "yes", "continue", "go on", "はい", "続けて", "네", "계속", "oui",
    "continuez", "sí", "continúa", "ja", "weiter", "да", "продолжайте", "نعم", "تابع",
    "हाँ", "जारी रखें", "ใช่", "ต่อเลย",
)
PAUSES = (
    "等一下", "等等", "先等一下", "停一下", "wait", "wait a moment", "hold on", "stop",
    "ちょっと待って", "잠깐만", "attendez", "espera", "warten", "подождите", "انتظر",
    "रुकिए", "รอก่อน",
)
DIRECT_TRANSFER = ("正在转账", "已经转账", "准备转账", "要我转账", "让我转账", "转账中")
SENSITIVE_ACTIONS = ("验证码", "共享屏幕", "远程控制", "屏幕共享", "陌生app")
SCREEN_ACTIONS = ("验证码", "共享屏幕", "远程控制", "屏幕共享")
TRANSFER_WORDS = ("转账",)
ACTIVE_CUES = (
    "对方", "让我", "要我", "叫我", "正在", "准备", "已经", "刚刚", "提供", "发给", "输入", "下载",
)
DOMAIN_TERMS = ("诈骗", "反诈", "风险", "转账", "验证码", "共享屏幕", "被骗", "诈骗案例")
FOREIGN_TERMS = {
    "en-US": ("fraud", "scam", "phishing", "transfer", "verification code"),
    "ja-JP": ("詐欺", "フィッシング", "送金", "認証コード"),
    "ko-KR": ("사기", "피싱", "송금", "인증번호"),
}
BROWSE_ACTIONS = ("推荐", "有哪些", "哪些", "列举", "浏览", "查找", "搜索", "找几个", "找一些")
BROWSE_OBJECTS = ("案例", "资料", "类别", "诈骗", "风险", "手法")
GLOSSES = {
    "en-US": (
        (("refund scam", "fake customer service"), "冒充客服"),
        (("investment scam", "fake investment"), "虚假投资理财"),
        (("task scam", "rebate scam"), "刷单返利"),
        (("impersonation scam", "police scam"), "冒充公检法"),
        (("phishing",), "网络钓鱼"),
    ),
    "ja-JP": (
        (("還付金詐欺", "偽カスタマーサービス"), "冒充客服"),
        (("投資詐欺",), "虚假投资理财"),
        (("フィッシング",), "网络钓鱼"),
    ),
    "ko-KR": (
        (("환불 사기", "가짜 고객센터"), "冒充客服"),
        (("투자 사기",), "虚假投资理财"),
        (("피싱",), "网络钓鱼"),
    ),
}
# locale: (title template, browse prompts, greeting prompts, safety question)
PROMPTS = {
    "zh-CN": ("%s有哪些风险信号？", ("按渠道继续筛选", "按类别继续浏览"),
              ("按诈骗类别浏览案例", "按风险等级筛选"), "遇到转账要求该怎么办？"),
    "zh-CN-sichuan": ("%s有哪些风险信号？", ("按渠道继续筛选", "按类别继续浏览"),
                      ("按诈骗类别浏览案例", "按风险等级筛选"), "遇到转账要求该怎么办？"),
    "zh-CN-henan": ("%s有啥风险信号？", ("按渠道接着筛选", "按类别接着看"),
                    ("按诈骗类别找案例", "按风险等级筛选"), "碰到转账要求咋办？"),
    "yue-CN": ("%s有咩风险信号？", ("按渠道继续筛选", "按类别继续睇"),
               ("按诈骗类别搵案例", "按风险等级筛选"), "遇到转账要求点算？"),
    "en-US": ("What are the warning signs in %s?", ("Filter by contact channel", "Browse by scam type"),
              ("Browse cases by scam type", "Filter by risk level"),
              "What should I do if someone asks me to transfer money?"),
    "ja-JP": ("%sの危険信号は何ですか？", ("接触経路で絞り込む", "詐欺類型で見る"),
              ("詐欺類型から事例を探す", "危険度で絞り込む"), "送金を求められたらどうすればよいですか？"),
    "ko-KR": ("%s의 위험 신호는 무엇인가요?", ("접촉 경로로 필터링", "사기 유형별 보기"),
              ("사기 유형별 사례 찾기", "위험 수준으로 필터링"), "송금을 요구받으면 어떻게 해야 하나요?"),
}
TERMINAL_TYPES = ("turn.completed", "turn.failed", "turn.cancelled")


# Fixed value: what a prompt says where the search found nothing.
NO_CANDIDATES = "未检索到匹配资料。涉及具体事实时请说明资料库暂无对应条目。"


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


# --- routing ---------------------------------------------------------------------------


def default_phrases(spark: SparkSession) -> DataFrame:
    """(kind, locale, phrase); locale '' applies everywhere."""
    rows = [("greeting", locale, p) for locale, ps in GREETINGS.items() for p in ps]
    rows += [("continuation", "", p) for p in CONTINUATIONS] + [("pause", "", p) for p in PAUSES]
    return spark.createDataFrame(rows, "kind string, locale string, phrase string")


def flag_incidents(
    turns: DataFrame, text: str = "question", *, direct: Sequence[str] = DIRECT_TRANSFER,
    sensitive: Sequence[str] = SENSITIVE_ACTIONS, cues: Sequence[str] = ACTIVE_CUES,
    screen: Sequence[str] = SCREEN_ACTIONS, transfer: Sequence[str] = TRANSFER_WORDS,
) -> DataFrame:
    """``active`` incident and the actions to show: screen, transfer, evidence."""
    folded = casefold(norm(text))
    active = contains_any(folded, direct) | (contains_any(folded, sensitive) & contains_any(folded, cues))
    actions = F.array_compact(F.array(
        F.when(contains_any(folded, screen), F.lit("screen")),
        F.when(contains_any(folded, transfer), F.lit("transfer")),
        F.lit("evidence"),
    ))
    empty = F.array().cast("array<string>")
    return turns.withColumn("active", active).withColumn(
        "actions", F.when(F.col("active"), actions).otherwise(empty)
    )


def route_turns(turns: DataFrame, phrases: DataFrame, text: str = "question", **incident) -> DataFrame:
    """``route`` per turn, first rule wins: empty, too_long, greeting, urgent, pause or
    continuation, retrieve. Phrases match the whole trimmed question, an equi-join."""
    whole = norm(text)
    flagged = flag_incidents(turns, text, **incident)
    if "locale" not in turns.columns:
        flagged = flagged.withColumn("locale", F.lit(""))
    keyed = flagged.withColumn("_greet", F.btrim(casefold(whole), F.lit(GREETING_TRIM))).withColumn(
        "_reply", F.btrim(F.lower(whole), F.lit(REPLY_TRIM))
    )
    greetings = phrases.where("kind = 'greeting'")
    anywhere = greetings.where("locale = ''").select(F.col("phrase").alias("_greet"), F.lit(1).alias("_g1")).distinct()
    local = greetings.where("locale <> ''").select(
        F.col("phrase").alias("_greet"), "locale", F.lit(1).alias("_g2")
    ).distinct()
    replies = phrases.where("kind <> 'greeting'").groupBy(F.col("phrase").alias("_reply")).agg(
        F.min("kind").alias("_mode")
    )
    joined = (
        keyed.join(anywhere, "_greet", "left").join(local, ["_greet", "locale"], "left")
        .join(replies, "_reply", "left")
    )
    route = (
        F.when(whole == "", "empty")
        .when(F.length(whole) > MAX_QUESTION_CHARS, "too_long")
        .when(F.col("_g1").isNotNull() | F.col("_g2").isNotNull(), "greeting")
        .when(F.col("active"), "urgent")
        .when(F.col("_mode").isNotNull(), F.col("_mode"))
        .otherwise("retrieve")
    )
    kept = [c for c in turns.columns]
    return joined.withColumn("route", route).select(*kept, "route")


# --- grounding -------------------------------------------------------------------------


def catalogue_anchors(cases: DataFrame) -> DataFrame:
    """Distinct (kind, anchor) of at least two characters."""
    def one(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("anchor"))

    named = F.concat(
        F.array("title", "custom_subcategory"), F.col("tags"), F.col("key_methods")
    )
    tall = cases.select(
        F.inline(
            F.concat(
                F.transform(named, lambda v: one("item_name", casefold(norm(v)))),
                F.array(one("category", casefold(norm("ccl2023_category")))),
                F.transform("entry_channels", lambda v: one("channel", casefold(norm(v)))),
            )
        )
    )
    return tall.where(F.length("anchor") >= 2).distinct()


def retrieval_basis(
    turns: DataFrame, anchors: DataFrame, text: str = "question", *,
    domain: Sequence[str] = DOMAIN_TERMS, foreign: dict[str, Sequence[str]] = FOREIGN_TERMS,
    actions: Sequence[str] = BROWSE_ACTIONS, objects: Sequence[str] = BROWSE_OBJECTS,
) -> DataFrame:
    """``basis``: the first signal that allows retrieval, or none. Of turns with a ``route``, a
    short reply (pause or continuation) is a conversation_reply whatever else it holds."""
    asked = turns.withColumn("_text", casefold(norm(text)))
    forms = asked.select("_text").distinct()
    order = F.when(F.col("kind") == "item_name", 1).when(F.col("kind") == "category", 2).otherwise(3)
    best_kind = pinned(anchors.groupBy("anchor").agg(F.min(order).alias("_p")))
    hit = (
        find_terms(forms, ["_text"], "_text", best_kind, "anchor", first_only=True)
        .join(best_kind.withColumnRenamed("anchor", "term"), "term")
        .groupBy("_text").agg(F.min("_p").alias("_p"))
    )
    folded, locale = F.col("_text"), (F.col("locale") if "locale" in turns.columns else F.lit(""))
    foreign_hit = F.lit(False)
    for code, terms in foreign.items():
        foreign_hit = foreign_hit | ((locale == code) & contains_any(folded, terms))
    category = norm("category") if "category" in turns.columns else F.lit("")
    short = F.col("route").isin("pause", "continuation") if "route" in turns.columns else F.lit(False)
    basis = (
        F.when(short, "conversation_reply")
        .when(category != "", "ui_category")
        .when(folded == "", "none")
        .when(F.col("_p") == 1, "item_name")
        .when(F.col("_p") == 2, "category")
        .when(F.col("_p") == 3, "channel")
        .when(contains_any(folded, domain), "fraud_domain")
        .when(foreign_hit, "multilingual_catalogue")
        .when(contains_any(folded, actions) & contains_any(folded, objects), "catalogue_browse")
        .otherwise("none")
    )
    return asked.join(hit, "_text", "left").withColumn("basis", basis).drop("_text", "_p")


def default_glosses(spark: SparkSession) -> DataFrame:
    rows = [
        (locale, order, phrase, canonical)
        for locale, entries in GLOSSES.items()
        for order, (phrases, canonical) in enumerate(entries)
        for phrase in phrases
    ]
    return spark.createDataFrame(rows, "locale string, ord int, phrase string, canonical string")


def translate_queries(turns: DataFrame, glosses: DataFrame, text: str = "question") -> DataFrame:
    """``canonical`` of the first listed gloss of the turn's locale found in the text; ''
    when there is none."""
    folded = turns.withColumn("_text", casefold(norm(text)))
    listed = glosses.withColumn("term", casefold("phrase"))
    forms = folded.select("_text").distinct()
    best = (
        find_terms(forms, ["_text"], "_text", listed, first_only=True)
        .join(listed.select("term", "locale", "ord", "canonical"), "term")
        .groupBy("_text", "locale").agg(F.min_by("canonical", "ord").alias("canonical"))
    )
    return folded.join(best, ["_text", "locale"], "left").withColumn(
        "canonical", F.coalesce("canonical", F.lit(""))
    ).drop("_text")


def localized_query(text: str = "question") -> Column:
    """Query to run, from ``canonical`` and ``basis``."""
    return (
        F.when(F.col("canonical") != "", F.col("canonical"))
        .when(F.col("basis") == "multilingual_catalogue", "")
        .otherwise(F.col(text))
    )


# --- evidence and answers --------------------------------------------------------------


def pack_evidence(
    candidates: DataFrame, keys: Sequence[str], rank: str = "rank", budget: int = EVIDENCE_CHARS
) -> DataFrame:
    """The first block always, later ones while the summed length stays in the budget.
    A key holds the few candidates of one turn."""
    running = Window.partitionBy(*keys).orderBy(rank)
    used = F.sum(F.length("block")).over(running.rowsBetween(Window.unboundedPreceding, 0))
    return (
        candidates.withColumn("used", used)
        .withColumn("_rn", F.row_number().over(running))
        .where((F.col("_rn") == 1) | (F.col("used") <= budget))
        .drop("_rn")
    )


def select_digest(
    ranked: DataFrame, keys: Sequence[str], rank: str = "rank", requested: Column | None = None,
    budget: int = DIGEST_CHARS, cap: int = DIGEST_CAP,
) -> DataFrame:
    """Entries of the short answer: by text budget, or by the number asked for.

    An entry costs the length of its summary, or of its ``content`` where the summary is empty.
    """
    wanted = F.lit(None).cast("int") if requested is None else requested
    first = top_rows(ranked.withColumn("_wanted", wanted), keys, [F.asc(rank)], cap, "_rn")
    said = F.col("summary")
    if "content" in ranked.columns:
        said = F.coalesce(F.nullif(said, F.lit("")), F.col("content"))
    cost = F.greatest(F.lit(80), F.least(F.length(norm(said)), F.lit(180)))
    running = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return (
        first.withColumn("spent", F.sum(cost).over(running))
        .where(
            F.when(F.col("_wanted").isNull(), (F.col("_rn") == 1) | (F.col("spent") <= budget))
            .otherwise(F.col("_rn") <= F.greatest(F.col("_wanted"), F.lit(1)))
        )
        .drop("_wanted", "_rn")
    )


def attribute_citations(
    answers: DataFrame, candidates: DataFrame, keys: Sequence[str], text: str = "answer"
) -> DataFrame:
    """(keys, ord, case_id): candidates whose title, or an alias no other candidate of the
    answer has, occurs in it, by first position then rank; the first candidate if none.
    ``candidates``: keys, rank, case_id, title, custom_subcategory, tags."""
    keys = list(keys)
    folded = candidates.select(
        *keys, "rank", "case_id",
        casefold(norm("title")).alias("_title"),
        F.array_distinct(F.filter(
            F.transform(F.concat(F.array("custom_subcategory"), F.col("tags")), lambda v: casefold(norm(v))),
            lambda v: F.length(v) >= 3,
        )).alias("_aliases"),
    )
    aliases = folded.select(*keys, "rank", "case_id", F.explode("_aliases").alias("name"))
    single = aliases.groupBy(*keys, "name").agg(
        F.min("rank").alias("rank"), F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("_n")
    ).where("_n = 1").drop("_n")
    titles = folded.where(F.length("_title") >= 2).select(*keys, F.col("_title").alias("name"), "rank", "case_id")
    texts = answers.select(*keys, casefold(norm(text)).alias("_text"))
    named = (
        titles.unionByName(single).join(texts, keys)
        .withColumn("_at", F.expr("locate(name, _text)"))
        .where("_at > 0")
        .groupBy(*keys, "rank", "case_id").agg(F.min("_at").alias("_at"))
    )
    first = folded.groupBy(*keys).agg(F.min(F.struct("rank", "case_id")).alias("_f")).join(
        texts.select(*keys), keys, "left_semi"
    )
    fallback = first.join(named.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.col("_f.rank").alias("rank"), F.col("_f.case_id").alias("case_id"), F.lit(0).alias("_at")
    )
    order = Window.partitionBy(*keys).orderBy("_at", "rank")
    return named.unionByName(fallback).select(
        *keys, F.row_number().over(order).alias("ord"), "case_id"
    )


def answer_confidence(answers: DataFrame, citations: DataFrame, keys: Sequence[str], text: str = "answer") -> DataFrame:
    cited = citations.groupBy(*keys).agg(F.count(F.lit(1)).alias("cited"))
    counted = answers.join(cited, list(keys), "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    return counted.withColumn(
        "confidence",
        F.when(F.col("cited") == 0, 0.2)
        .when(F.coalesce(F.col(text), F.lit("")) != "", 0.85).otherwise(0.4),
    )


def prompt_table(spark: SparkSession) -> DataFrame:
    rows = [(code, *parts) for code, parts in PROMPTS.items()]
    return spark.createDataFrame(
        rows, "locale string, template string, browse array<string>, opening array<string>, safety string"
    )


def followup_prompts(
    answers: DataFrame, citations: DataFrame, keys: Sequence[str], n: int = 3
) -> DataFrame:
    """(keys, pos, prompt). ``answers``: keys, locale; ``citations``: keys, ord, title."""
    keys = list(keys)
    once = (
        citations.select(*keys, "ord", norm("title").alias("title")).where("title <> ''")
        .groupBy(*keys, "title").agg(F.min("ord").alias("ord"))
    )
    heads = top_rows(once, keys, [F.asc("ord")], n).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("_heads")
    )
    cited = citations.select(*keys).distinct().withColumn("_cited", F.lit(True))
    table = F.broadcast(prompt_table(answers.sparkSession))
    known = F.when(F.col("locale").isin(list(PROMPTS)), F.col("locale")).otherwise("en-US")
    rows = (
        answers.withColumn("_code", known)
        .join(table.withColumnRenamed("locale", "_code"), "_code")
        .join(heads, keys, "left").join(cited, keys, "left")
    )
    made = F.transform(
        F.coalesce("_heads", F.array().cast("array<struct<rank:int,title:string>>")),
        lambda h: F.replace(F.col("template"), F.lit("%s"), h["title"]),
    )
    prompts = F.when(F.col("_cited"), F.slice(F.concat(made, F.col("browse")), 1, n)).otherwise(
        F.concat(F.col("opening"), F.array("safety"))
    )
    return rows.select(*keys, F.posexplode(prompts).alias("_p", "prompt")).select(
        *keys, (F.col("_p") + 1).alias("pos"), "prompt"
    )


# --- history ---------------------------------------------------------------------------


def bounded_history(turns: DataFrame, key: str, order: str, n: int = HISTORY_TURNS) -> DataFrame:
    """Newest ``n`` turns per key; ``back`` counts from 1, the newest."""
    return top_rows(turns, [key], [F.desc(order)], n, "back")


def context_history(turns: DataFrame, key: str, order: str) -> DataFrame:
    """History rows that go into the next prompt, answers cut."""
    recent = bounded_history(turns, key, order)
    return recent.withColumn("in_context", F.col("back") <= CONTEXT_TURNS).withColumn(
        "answer", F.substring("answer", 1, ANSWER_CHARS)
    )


def recent_evidence(history: DataFrame, known: DataFrame, key: str, order: str, n: int = RECENT_ITEMS) -> DataFrame:
    """Newest cited, known ids per session, each once: (key, rank, case_id)."""
    cited = history.select(key, F.col(order).alias("_turn"), F.posexplode("source_ids").alias("_i", "case_id"))
    newest = cited.groupBy(key, "case_id").agg(F.max(F.struct("_turn", "_i")).alias("_at"))
    held = newest.join(known.select("case_id"), "case_id", "left_semi")
    return top_rows(held, [key], [F.desc("_at")], n).select(key, "rank", "case_id")


def context_titles(n: int = CONTEXT_TITLES, width: int = TITLE_CHARS) -> Column:
    """Bounded recognition context from ``selected`` and ``visible`` title arrays."""
    named = F.filter(
        F.transform(F.concat("selected", "visible"), line_text), lambda title: title != ""
    )
    first = F.slice(F.array_distinct(named), 1, n)
    return F.transform(first, lambda title: F.substring(title, 1, width))


def byte_budget_terms(
    terms: DataFrame, keys: Sequence[str], order: str, text: str, max_bytes: int = TERM_BYTES
) -> DataFrame:
    """(keys, pos, term): distinct terms in order while they fit, one byte per separator.
    An oversized first term is cut at a character."""
    keys = list(keys)
    room = max_bytes - len(TERM_PREFIX.encode())
    parts = terms.select(
        *keys, F.col(order).alias("_o"), F.posexplode(F.split(text, "[|,，、;；\\r\\n\\t]+")).alias("_i", "_raw")
    ).withColumn("term", F.regexp_replace("_raw", SPACE_CLASS + "+", "")).where("term <> ''")
    once = parts.groupBy(*keys, "term").agg(F.min(F.struct("_o", "_i")).alias("_at"))
    # each term takes at least two bytes, so later ones can never fit
    first = top_rows(once, keys, [F.asc("_at")], room // 2 + 1, "pos")
    size = F.octet_length("term") + F.when(F.col("pos") > 1, 1).otherwise(0)
    running = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spent = first.withColumn("used", F.sum(size).over(running))
    fitting = F.array_max(F.filter(
        F.sequence(F.lit(0), F.least(F.length("term"), F.lit(room))),
        lambda i: F.octet_length(F.substring(F.col("term"), F.lit(1), i)) <= room,
    ))
    cut = F.when(F.col("used") > room, F.substring(F.col("term"), F.lit(1), fitting)).otherwise(F.col("term"))
    return spent.where((F.col("used") <= room) | (F.col("pos") == 1)).select(
        *keys, "pos", cut.alias("term")
    ).where("term <> ''")


def prompt_rows(
    turns: DataFrame, evidence: DataFrame, key: str, order: str, *, system: str, no_evidence: str,
    evidence_intro: str, continuation: str, pause: str, closing: str, no_candidates: str = NO_CANDIDATES,
) -> DataFrame:
    """(key, order, ord, role, content) of the grounded prompt of every turn.

    ``turns``: key, order, question, answer, mode, basis, and if some did not complete,
    ``completed``; those are no history. ``evidence``: key, order, context; a turn that looked
    for evidence and has none is told so. History reaches at most five turns forward, so each
    turn is copied to its next five instead of joining a conversation with itself.
    """
    done = F.coalesce(F.col("completed"), F.lit(False)) if "completed" in turns.columns else F.lit(True)
    before = Sum(done.cast("bigint"), inclusive=False)
    placed = ordered_scan(turns, [key], order, {"_n": before}).withColumn("_n", F.coalesce("_n", F.lit(0)) + 1)
    past = placed.where(done).select(
        key, F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + CONTEXT_TURNS)).alias("_for"),
        "_n", F.col("question").alias("_q"), F.substring("answer", 1, ANSWER_CHARS).alias("_a"),
    )
    now = placed.select(key, order, F.col("_n").alias("_for"))
    history = past.join(now, [key, "_for"]).withColumn("_back", F.col("_for") - F.col("_n"))
    at = 2 + (CONTEXT_TURNS - F.col("_back")) * 2

    def entry(ord_: Column | int, role: str, content: Column | str) -> Column:
        position = F.lit(ord_) if isinstance(ord_, int) else ord_
        body = F.lit(content) if isinstance(content, str) else content
        return F.struct(position.cast("int").alias("ord"), F.lit(role).alias("role"), body.alias("content"))

    said = history.select(
        key, order,
        F.inline(F.array(entry(at, "user", F.col("_q")), entry(at + 1, "assistant", F.col("_a")))),
    )
    grounded = turns.join(evidence, [key, order], "left")
    context = F.when(F.col("basis") == "none", F.lit(no_evidence)).otherwise(
        F.concat(F.lit(evidence_intro), F.coalesce("context", F.lit(no_candidates)))
    )
    note = F.when(F.col("mode") == "continuation", continuation).when(F.col("mode") == "pause", pause)
    fixed = grounded.select(
        key, order,
        F.inline(F.array(
            entry(1, "system", system),
            entry(20, "system", context),
            entry(21, "system", note),
            entry(22, "system", closing),
            entry(23, "user", F.col("question")),
        )),
    ).where("content IS NOT NULL")
    return fixed.unionByName(said)


# --- outcomes --------------------------------------------------------------------------


def number_events(events: DataFrame, keys: Sequence[str], order: str, start: int = 0) -> DataFrame:
    """``seq`` per turn from 0 (per connection: ``start=1``)."""
    return numbered(events, keys, order, "seq").withColumn("seq", F.col("seq") - 1 + start)


def turn_outcomes(events: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last terminal event per turn, whether there was exactly one, and whether the turn
    enters the history."""
    final = F.col("type").isin(list(TERMINAL_TYPES))
    return events.groupBy(*keys).agg(
        F.count(F.when(final, 1)).alias("terminals"),
        F.coalesce(F.max_by("type", F.when(final, F.col(order))), F.lit("")).alias("outcome"),
    ).withColumn("single", F.col("terminals") == 1).withColumn(
        "in_history", F.col("outcome") == "turn.completed"
    )


def owned_events(
    events: DataFrame, key: str, order: str, turn: str = "turn_id", remembered: int = IGNORED_TURNS
) -> DataFrame:
    """``accepted``: the event names the session's current turn and that turn is not among
    the last ``remembered`` cancelled ones."""
    cancels = events.where("type = 'turn.cancelled'").groupBy(key, turn).agg(F.min(order).alias("_cancel_at"))
    first = events.join(cancels, [key, turn], "left").withColumn(
        "_first_cancel", F.coalesce(F.col("_cancel_at") == F.col(order), F.lit(False)).cast("bigint")
    )
    scanned = ordered_scan(
        first, [key], order,
        {
            "_current": Last(F.when(F.col("type") == "turn.started", F.col(turn)), inclusive=True),
            "_cancels": Sum(F.col("_first_cancel"), inclusive=False),
        },
    ).withColumn("_cancels", F.coalesce("_cancels", F.lit(0)))
    numbers = scanned.where("_first_cancel = 1").select(key, turn, (F.col("_cancels") + 1).alias("_number"))
    joined = scanned.join(numbers, [key, turn], "left")
    ignored = (
        F.coalesce(F.col("_cancel_at") < F.col(order), F.lit(False))
        & (F.col("_number") > F.col("_cancels") - remembered)
    )
    current = F.coalesce(F.col("_current") == F.col(turn), F.lit(False))
    return joined.withColumn("accepted", current & ~ignored).drop(
        "_cancel_at", "_first_cancel", "_current", "_cancels", "_number"
    )


def joined_text(order: str, text: str, sep: str) -> Column:
    """Aggregate: the non-NULL texts in order, NULL if there are none."""
    listed = F.array_sort(F.collect_list(
        F.when(F.col(text).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    ))
    return F.when(F.count(F.col(text)) > 0, F.array_join(F.transform(listed, lambda x: x["t"]), sep))


def order_run(order: str, rows: int) -> Column:
    return F.expr(f"`{order}` div {int(rows)}")


def assemble_text(
    pieces: DataFrame, keys: Sequence[str], order: str, text: str, sep: str = "", name: str = "text",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One text per key, pieces in the integer ``order``. Runs of up to ``rows`` order values
    are joined first, so a busy key is not sorted in one task; the finished text is one
    message and has to fit in a cell."""
    runs = pieces.groupBy(*keys, order_run(order, rows).alias("_run")).agg(
        joined_text(order, text, sep).alias("_part")
    )
    return runs.groupBy(*keys).agg(
        F.coalesce(joined_text("_run", "_part", sep), F.lit("")).alias(name)
    )
