from pyspark.sql import functions as F

from caselens.operators import turns as op
from caselens.operators.assist import grounded_turns
from caselens.operators.catalogue import normalize_cases, with_search_text
from caselens.operators.turns import NO_CANDIDATES


def test_routing(spark):
    rows = [
        (1, "  \n ", ""), (2, "问" * 4001, ""), (3, "你好。", "zh-CN"), (4, "Hello!", "en-US"), (5, "Hello!", "ja-JP"),
        (6, "对方让我共享屏幕，还要我把验证码发给他。", "zh-CN"), (7, "验证码是什么？", "zh-CN"), (8, "好的。", "zh-CN"),
        (9, "Hold on", "en-US"), (10, "我已经转账了", "zh-CN"), (11, "刷单返利类", "zh-CN"),
    ]
    turns = spark.createDataFrame(rows, "id int, question string, locale string")
    routes = {r.id: r.route for r in op.route_turns(turns, op.default_phrases(spark)).collect()}
    assert routes == {
        1: "empty", 2: "too_long", 3: "greeting", 4: "greeting", 5: "retrieve", 6: "urgent", 7: "retrieve",
        8: "continuation", 9: "pause", 10: "urgent", 11: "retrieve",
    }
    flags = {r.id: r.actions for r in op.flag_incidents(turns).collect()}
    assert flags[6] == ["screen", "evidence"] and flags[10] == ["transfer", "evidence"] and flags[7] == []


def cases(spark):
    raw = spark.createDataFrame(
        [
            ("a", "客服退款共享屏幕案例", "冒充客服", "冒充电商物流客服类", ["微信"], []),
            ("b", "刷单垫资案例", "刷单返利", "刷单返利类", ["电话"], ["共用标签"]),
            ("c", "安全账户转账案例", "冒充公检法", "冒充公检法及政府机关类", [], ["共用标签"]),
        ],
        "case_id string, title string, custom_subcategory string, ccl2023_category string, "
        "entry_channels array<string>, tags array<string>",
    )
    return normalize_cases(raw)


def test_citations_follow_the_answer(spark):
    candidates = cases(spark).crossJoin(spark.range(4).withColumnRenamed("id", "turn")).withColumn(
        "rank", F.expr("ascii(case_id) - 96")
    ).where("turn < 3")
    answers = spark.createDataFrame(
        [(0, "先看看刷单垫资案例，再比较客服退款共享屏幕案例。"), (1, "没有点名具体案例。"), (2, "共用标签 和 冒充公检法"), (3, "无候选")],
        "turn bigint, answer string",
    )
    cites = op.attribute_citations(answers, candidates, ["turn"])
    got = {}
    for r in cites.orderBy("turn", "ord").collect():
        got.setdefault(r.turn, []).append(r.case_id)
    # an alias two candidates share does not count
    assert got == {0: ["b", "a"], 1: ["a"], 2: ["c"]}
    sure = {r.turn: r.confidence for r in op.answer_confidence(answers, cites, ["turn"]).collect()}
    assert sure == {0: 0.85, 1: 0.85, 2: 0.85, 3: 0.2}

    located = answers.select("turn", F.lit("zh-CN").alias("locale"))
    titled = cites.join(cases(spark).select("case_id", "title"), "case_id")
    prompts = {}
    for r in op.followup_prompts(located, titled, ["turn"]).orderBy("turn", "pos").collect():
        prompts.setdefault(r.turn, []).append(r.prompt)
    assert prompts[0] == ["刷单垫资案例有哪些风险信号？", "客服退款共享屏幕案例有哪些风险信号？", "按渠道继续筛选"]
    assert prompts[1] == ["客服退款共享屏幕案例有哪些风险信号？", "按渠道继续筛选", "按类别继续浏览"]
    assert prompts[3] == ["按诈骗类别浏览案例", "按风险等级筛选", "遇到转账要求该怎么办？"]


def test_retrieval_basis_order(spark):
    anchors = op.catalogue_anchors(cases(spark))
    rows = [
        (1, "随便", "某类别", "zh-CN", "ui_category"), (2, "说说刷单返利吧", "", "zh-CN", "item_name"),
        (3, "冒充电商物流客服类怎么样", "", "zh-CN", "category"), (4, "微信上有人加我", "", "zh-CN", "channel"),
        (5, "我被骗了", "", "zh-CN", "fraud_domain"), (6, "is this a scam", "", "en-US", "multilingual_catalogue"),
        (7, "is this a scam", "", "ja-JP", "none"), (8, "推荐一些资料", "", "zh-CN", "catalogue_browse"),
        (9, "今天天气", "", "zh-CN", "none"), (10, "", "", "zh-CN", "none"),
    ]
    turns = spark.createDataFrame(rows, "id int, question string, category string, locale string, want string")
    for r in op.retrieval_basis(turns, anchors).collect():
        assert r.basis == r.want, r


def test_gloss_first_listed_wins(spark):
    turns = spark.createDataFrame(
        [(1, "Is this a rebate scam or an Investment Scam?", "en-US"), (2, "phishing", "ja-JP"), (3, "フィッシング", "ja-JP")],
        "id int, question string, locale string",
    )
    rows = op.translate_queries(turns, op.default_glosses(spark)).withColumn("basis", F.lit("none"))
    got = {r.id: r.q for r in rows.select("id", op.localized_query().alias("q")).collect()}
    assert got == {1: "虚假投资理财", 2: "phishing", 3: "网络钓鱼"}


def test_digest_sizes(spark):
    rows = [(q, i, ("长" * 180 if q != 2 else "短" * 20)) for q in (1, 2, 3) for i in range(1, 9)]
    ranked = spark.createDataFrame(rows, "q int, rank int, summary string")
    wanted = F.when(F.col("q") == 3, 2)
    got = op.select_digest(ranked, ["q"], requested=wanted).groupBy("q").count().collect()
    assert {r.q: r["count"] for r in got} == {1: 4, 2: 6, 3: 2}


def test_digest_counts_the_content_of_entries_without_summary(spark):
    rows = [(1, i, "", "文" * 170) for i in range(1, 9)] + [(2, i, "短", "文" * 170) for i in range(1, 9)]
    ranked = spark.createDataFrame(rows, "q int, rank int, summary string, content string")
    got = op.select_digest(ranked, ["q"]).groupBy("q").count().collect()
    assert {r.q: r["count"] for r in got} == {1: 4, 2: 6}


def test_evidence_budget(spark):
    rows = [(1, 1, "x" * 6000), (1, 2, "y"), (2, 1, "a" * 3000), (2, 2, "b" * 2200), (2, 3, "c")]
    packed = op.pack_evidence(spark.createDataFrame(rows, "t int, rank int, block string"), ["t"])
    assert sorted((r.t, r.rank) for r in packed.collect()) == [(1, 1), (2, 1), (2, 2)]


def test_history_is_bounded(spark):
    turns = spark.createDataFrame([("s", i, "q", "a" * 600) for i in range(30)], "s string, turn int, question string, answer string")
    rows = op.context_history(turns, "s", "turn").orderBy("back").collect()
    assert [r.turn for r in rows] == list(range(29, 9, -1))
    assert [r.in_context for r in rows].count(True) == 5 and len(rows[0].answer) == 500
    assert [r.turn for r in op.bounded_history(turns.where("turn < 3"), "s", "turn", 2).orderBy("turn").collect()] == [1, 2]


def test_recent_evidence_newest_first(spark):
    history = spark.createDataFrame(
        [("s", 1, ["a", "b"]), ("s", 2, ["zz", "c", "a"]), ("s", 3, [])], "s string, turn int, source_ids array<string>"
    )
    rows = op.recent_evidence(history, cases(spark), "s", "turn", 2).orderBy("rank").collect()
    assert [r.case_id for r in rows] == ["a", "c"]


def test_context_titles(spark):
    rows = spark.createDataFrame([(["  A ", ""], ["A", "B" * 300] + [f"t{i}" for i in range(10)])], "selected array<string>, visible array<string>")
    titles = rows.select(op.context_titles().alias("t")).first().t
    assert titles == ["A", "B" * 200, "t0", "t1", "t2", "t3", "t4", "t5"]


def test_byte_budget(spark):
    terms = spark.createDataFrame(
        [(1, 1, "词" * 1000), (1, 2, "x"), (2, 1, "a b|a b、c"), (2, 2, "c;" + "d" * 1013), (2, 3, "e")], "k int, o int, t string"
    )
    got = {}
    for r in op.byte_budget_terms(terms, ["k"], "o", "t").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.term)
    assert got[1] == ["词" * 339]
    assert got[2] == ["ab", "c", "d" * 1013]
    assert len("|".join(got[2]).encode()) + 6 <= 1024


def test_prompt_rows(spark):
    turns = spark.createDataFrame(
        [("s", i, f"q{i}", "a" * 600, "pause" if i == 7 else None, "none" if i == 7 else "item_name") for i in range(8)],
        "s string, turn bigint, question string, answer string, mode string, basis string",
    )
    evidence = spark.createDataFrame([("s", 6, "BLOCK")], "s string, turn bigint, context string")
    rows = op.prompt_rows(
        turns, evidence, "s", "turn", system="S", no_evidence="N", evidence_intro="E:", continuation="C", pause="P", closing="Z"
    ).where("turn >= 6").orderBy("turn", "ord").collect()
    last = [(r.role, r.content[:9]) for r in rows if r.turn == 7]
    assert last[0] == ("system", "S") and last[-1] == ("user", "q7")
    assert [c for role, c in last[1:11] if role == "user"] == ["q2", "q3", "q4", "q5", "q6"]
    assert last[11:14] == [("system", "N"), ("system", "P"), ("system", "Z")]
    assert ("system", "E:BLOCK") in [(r.role, r.content) for r in rows if r.turn == 6]


def test_outcomes_and_ownership(spark):
    events = spark.createDataFrame(
        [
            ("s", 1, 1, "turn.started"), ("s", 1, 2, "response.text.delta"), ("s", 1, 3, "turn.completed"),
            ("s", 2, 4, "turn.started"), ("s", 1, 5, "response.text.delta"), ("s", 2, 6, "turn.cancelled"),
            ("s", 2, 7, "response.text.delta"), ("s", 3, 8, "turn.started"), ("s", 3, 9, "turn.failed"), ("s", 3, 10, "turn.cancelled"),
        ],
        "session_id string, turn_id int, pos bigint, type string",
    )
    done = {r.turn_id: (r.outcome, r.single, r.in_history) for r in op.turn_outcomes(events, ["session_id", "turn_id"], "pos").collect()}
    assert done == {1: ("turn.completed", True, True), 2: ("turn.cancelled", True, False), 3: ("turn.cancelled", False, False)}
    owned = {r.pos: r.accepted for r in op.owned_events(events, "session_id", "pos").collect()}
    assert [p for p, ok in owned.items() if not ok] and sorted(p for p, ok in owned.items() if not ok) == [5, 7]
    seqs = op.number_events(events, ["session_id", "turn_id"], "pos").where("turn_id = 2").orderBy("pos").collect()
    assert [r.seq for r in seqs] == [0, 1, 2]


def test_only_the_last_cancelled_turns_are_remembered(spark):
    rows = [("s", i, i, "turn.cancelled") for i in range(1, 41)] + [("s", 100, 1000, "turn.started")]
    rows += [("s", 100, 1001, "response.text.delta")]
    rows = [("s", 100, 0, "turn.started"), ("s", 100, 1, "turn.cancelled")] + [("s", i, i, "turn.cancelled") for i in range(2, 60)]
    rows += [("s", 100, 500, "response.text.delta")]
    events = spark.createDataFrame(rows, "session_id string, turn_id int, pos bigint, type string")
    last = op.owned_events(events, "session_id", "pos").where("pos = 500").first()
    assert last.accepted
    last = op.owned_events(events, "session_id", "pos", remembered=100).where("pos = 500").first()
    assert not last.accepted


def test_text_assembly_in_runs(spark):
    rows = [("a", i, f"t{i}") for i in range(25)] + [("b", 3, None), ("c", 1, ""), ("c", 9, "x")]
    pieces = spark.createDataFrame(rows, "k string, n bigint, t string").repartition(3)
    want = {"a": " ".join(f"t{i}" for i in range(25)), "b": "", "c": " x"}
    for size in (4, 1 << 20):
        got = {r.k: r.text for r in op.assemble_text(pieces, ["k"], "n", "t", " ", rows=size).collect()}
        assert got == want


def test_whole_turns_are_grounded_in_what_the_search_finds(spark):
    rows = [
        ("FZ-001", "冒充客服退款并诱导共享屏幕", "冒充电商物流客服类", "电话", "网购用户"), ("FZ-002", "刷单返利后要求垫资", "刷单返利类", "微信", "学生"),
        *[(f"FZ-{i:03d}", f"贷款骗局第{i}种", "贷款类", "短信", "上班族") for i in range(10, 40)],
    ]
    raw = spark.createDataFrame(
        [(i, t, c, "高", [ch], v, f"{t}的摘要", "信号", "建议", "来源") for i, t, c, ch, v in rows],
        "case_id string, title string, ccl2023_category string, risk_level string, entry_channels array<string>, victim_group string, summary string, risk_signals string, prevention_advice string, source_name string",
    )
    cases = with_search_text(normalize_cases(raw)).cache()
    turns = [
        (1, "你好", "你好。", "", True), (2, "冒充客服退款并诱导共享屏幕是怎么回事", "这是骗局。", "", True), (3, "好的。", "还有……", "", False), (4, "今天天气如何", "……", "", True),
        (5, "贷款类有哪些案例", "一些。", "", True), (6, "", "", "贷款类", False), (7, "刷单返利类", "……", "贷款类", True), (8, "x" * 5000, "", "", False),
    ]
    asked = spark.createDataFrame([("s", *t) for t in turns], "sid string, n bigint, question string, answer string, category string, completed boolean")
    texts = {"system": "S", "no_evidence": "N", "evidence_intro": "E:", "continuation": "C", "pause": "P", "closing": "Z"}
    candidates, prompts = grounded_turns(asked, cases, "sid", "n", texts)
    got = {}
    for r in candidates.orderBy("n", "rank").collect():
        got.setdefault(r.n, []).append((r.rank, r.case_id, r.total))
    assert got[2][0][:2] == (1, "FZ-001") and 1 not in got and 3 not in got and 4 not in got and 8 not in got and 6 not in got
    # a named scope larger than a page is shown from a place that session and turn choose
    assert [r[0] for r in got[5]] == list(range(1, len(got[5]) + 1)) and len(got[5]) == 12 and got[5][0][2] == 30
    whole, _ = grounded_turns(asked.where("n = 5").withColumn("n", F.lit(77)), cases, "sid", "n", texts)
    assert [r.case_id for r in whole.orderBy("rank").collect()] != [c for _, c, _ in got[5]]
    assert 7 not in got
    said = {}
    for r in prompts.orderBy("n", "ord").collect():
        said.setdefault(r.n, []).append((r.role, r.content))
    assert set(said) == {2, 3, 4, 5, 7}
    assert ("system", "N") in said[4] and ("system", "E:" + NO_CANDIDATES) in said[7] and ("system", "E:" + NO_CANDIDATES) in said[3]
    assert any(c.startswith("E:[FZ-001]") for _, c in said[2])
    # the turn that did not complete is no history, the greeting is
    assert [c for r, c in said[5] if r == "user"] == ["你好", "冒充客服退款并诱导共享屏幕是怎么回事", "今天天气如何", "贷款类有哪些案例"]
