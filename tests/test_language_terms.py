import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from caselens.functions import language as lang
from caselens.operators import language as lop
from caselens.operators import terms as tm
from caselens.operators.catalogue import normalize_cases


def test_locale_hints(spark):
    want = {
        "zh_Hans": "zh-CN", "ZH-hk": "yue-CN", "zh_henan": "zh-CN-henan", "jp": "ja-JP", "fr-FR": None, "auto": None,
        "xx-Unknown": None, "ko-KR": "ko-KR", "": None,
    }
    rows = spark.createDataFrame([(h,) for h in want], "h string").select("h", lang.canonical_locale("h").alias("l"))
    assert {r.h: r.l for r in rows.collect()} == want
    want = {"zh_cn": "zh-CN", "en": "en-US", "JA-jp": "ja-JP", "ko": "ko-KR", "yue": "yue-CN", "unknown": None}
    rows = spark.createDataFrame([(h,) for h in want], "h string").select("h", lang.provider_locale("h").alias("l"))
    assert {r.h: r.l for r in rows.collect()} == want
    flags = spark.createDataFrame([("yue-CN",), ("en-US",), ("xx",)], "h string").select("h", lang.is_chinese("h").alias("c"))
    assert {r.h: r.c for r in flags.collect()} == {"yue-CN": True, "en-US": False, "xx": True}


def test_preferred_locales(spark):
    rows = spark.createDataFrame([(["zh_hans_cn", "EN-us", "zh-Hans-CN", "not a tag", "ja", "ko"],), ([],)], "t array<string>")
    got = [r.p for r in rows.select(lang.preferred_locales("t").alias("p")).collect()]
    assert got == [["zh-Hans-CN", "en-US", "ja"], ["zh-CN"]]


def test_text_decides_the_locale(spark):
    rows = [
        ("この無形文化遺産を紹介して", "en-US", "ja-JP"), ("佢嘕传统手艺有咩特色？", "zh-CN", "yue-CN"),
        ("这个手艺好巴适，咋个做的？", None, "zh-CN-sichuan"), ("恁看看这个手艺中不中？", None, "zh-CN-henan"),
        ("河南话呢", None, "zh-CN-henan"), ("Tell me about this heritage project", "zh-CN", "en-US"),
        ("곤곡이라는 전통 예술을 소개해 주세요", None, "ko-KR"), ("昆曲", "ja-JP", "ja-JP"), ("昆曲", None, "zh-CN"),
        ("  ", "ko", "ko-KR"), ("123", None, "zh-CN"), ("bonjour", "ja", "ja-JP"), ("the bonjour", "ja", "en-US"),
        ("昆曲昆曲 ab", None, "zh-CN"), ("昆 abcd", None, "en-US"),
    ]
    df = spark.createDataFrame(rows, "text string, hint string, want string")
    for r in df.select("*", lang.detect_locale("text", F.col("hint")).alias("got")).collect():
        assert r.got == r.want, r
    guess = df.select(lang.speech_locale("text").alias("g")).collect()
    assert [r.g for r in guess[:3]] == ["ja-JP", "zh-CN", "zh-CN"]


def test_sentences(spark):
    rows = [
        (1, "第一句。第二句。第三句。尾巴。", "zh-CN", "第一句。", "第二句。第三句。尾巴。"),
        (2, "没有标点的回答", "zh-CN", "", "没有标点的回答"),
        (3, "The first sentence. The second sentence. A third sentence.", "en-US", "The first sentence.", "The second sentence. A third sentence."),
        (4, "The value is 3.14 and Dr. Zhang used e.g. paper cutting. Next.", "en-US", "The value is 3.14 and Dr. Zhang used e.g. paper cutting.", "Next."),
        (5, "She said “Hello.” Then left.", "en-US", "She said “Hello.”", "Then left."),
        (6, "One! two?! three", "en", "One!", "two? ! three"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, locale string, first string, rest string")
    got = {r.id: (r.first, r.rest) for r in lop.first_and_rest(df.drop("first", "rest"), ["id"], "text", "locale").collect()}
    for id_, _t, _l, first, rest in rows:
        # the unfinished tail follows the joined sentences as it stands
        assert got[id_][0] == first and got[id_][1].replace(" ", "") == rest.replace(" ", ""), id_


def kb(spark):
    raw = spark.createDataFrame(
        [
            (1, "1", "刷单返利后要求垫资", "刷单返利类", "刷单返利", ["微信"], ["小额返利"], ["刷单返利"]),
            (2, "2", "冒充公检法要求转入安全账户", "冒充公检法及政府机关类", "冒充公检法", ["电话"], ["安全账户"], ["公检法"]),
        ],
        "input_pos bigint, case_id string, title string, ccl2023_category string, custom_subcategory string, "
        "entry_channels array<string>, key_methods array<string>, tags array<string>",
    )
    return tm.build_vocabulary(normalize_cases(raw).join(raw.select("case_id", "input_pos"), "case_id"))


def test_term_correction_follows_its_own_thresholds(spark):
    vocabulary = kb(spark)
    loose = tm.correct_terms(spark.createDataFrame([(1, "刷单反里")], "id int, text string"), vocabulary, ["id"], min_score=0.3, margin=0.0)
    strict = tm.correct_terms(spark.createDataFrame([(1, "刷单反里")], "id int, text string"), vocabulary, ["id"])
    assert loose.first().canonical_text == "刷单返利" and strict.first().canonical_text == "刷单反里"


def test_term_correction_examples(spark):
    rows = [
        (1, "这是刷单反利骗局吗？", "刷单返利类", ["这是刷单返利骗局吗", "这是刷单反利骗局吗"], "zh", "这是刷单返利骗局吗？"),
        (2, "对方让我共享屏幕，还要验证码。", "", [], "zh", "对方让我共享屏幕，还要验证码。"),
        (3, "我刚刚睡醒，想先喝杯水。", "", [], "zh", "我刚刚睡醒，想先喝杯水。"),
        (4, "今天返利活动结束了。", "", ["今天返利活动结束了。", "今天刷单返利活动结束了"], "zh", "今天返利活动结束了。"),
        (5, "刷单反利詐欺について教えてください。", "刷单返利类", ["刷单返利詐欺"], "ja", "刷单反利詐欺について教えてください。"),
    ]
    texts = spark.createDataFrame(rows, "id int, text string, category string, context array<string>, language string, want string")
    # sounds: a stand-in for a phonetic key, where the two characters sound the same
    sound = lambda text: F.translate(text, "反", "返")
    got = {r.id: r for r in tm.correct_terms(texts.drop("want"), kb(spark), ["id"], key_fn=sound).collect()}
    for id_, *_rest, want in rows:
        assert got[id_].canonical_text == want
    assert [s.canonical for s in got[1].spans] == ["刷单返利"] and got[2].spans is None


def test_sounds_are_compared_by_syllable_where_the_key_is_a_list(spark):
    spoken = {"重提": "chong ti", "传递": "chuan di", "传地": "chuan di", "船提": "chuan ti"}
    said = F.create_map(*[F.lit(x) for pair in spoken.items() for x in pair])
    pairs = spark.createDataFrame([("重提", "传递", "title", ""), ("传地", "传递", "title", ""), ("船提", "传递", "title", "")], "raw string, canonical string, kind string, category string")
    entries = spark.createDataFrame([("传递", "title", ["传递"])], "canonical string, kind string, forms array<string>")
    by_list = {r.raw: r.base for r in tm.base_scores(pairs, entries, lambda t: F.split(F.element_at(said, t), " ")).collect()}
    by_text = {r.raw: r.base for r in tm.base_scores(pairs, entries, lambda t: F.element_at(said, t)).collect()}
    shape = {"重提": 0.0, "传地": 0.48 * 0.5, "船提": 0.0}
    assert by_list == {"重提": 0.0, "传地": 0.52 + shape["传地"], "船提": 0.52 * 0.5}
    assert by_text["重提"] == pytest.approx(0.52 * SequenceMatcher(None, "chong ti", "chuan di").ratio()) and by_text["重提"] > 0.2
    # an equal list of syllables makes a candidate
    forms = tm.vocabulary_forms(entries.selectExpr("canonical", "kind", "'' AS category", "forms", "struct(1L AS _o, 0 AS slot) AS place"))
    found = tm.term_candidates(pairs.select("raw"), forms, lambda t: F.split(F.element_at(said, t), " ")).collect()
    assert {r.raw for r in found if r.canonical == "传递"} == {"传地"}


def brute(text, category, context, entries):
    forms = [f for e in entries for f in e["forms"] if re.fullmatch("[a-d]+", f)]
    exact = [(p, p + len(f)) for f in forms for p in range(len(text)) if text.startswith(f, p)]
    found = []
    for run in re.finditer("[a-d]+", text):
        for size in sorted(set(map(len, forms))):
            for start in range(run.start(), run.end() - size + 1):
                raw = text[start : start + size]
                if size < 2 or any(start < r and start + size > l for l, r in exact):
                    continue
                pool = {e["canonical"]: e for e in entries if any(re.fullmatch("[a-d]+", f) and len(f) == size and f[0] == raw[0] for f in e["forms"])}
                scored = []
                for e in pool.values():
                    def parts(f):
                        ratio = SequenceMatcher(None, raw, f).ratio()
                        same = sum(x == y for x, y in zip(raw, f)) / max(len(raw), len(f))
                        return (same + ratio) / 2, ratio
                    shape, sound = max((parts(f) for f in e["forms"]), key=sum)
                    why = [n for n, ok in (("category", category and category == e["category"]), ("asr-context", any(f in v for v in context for f in e["forms"]))) if ok]
                    scored.append((min(1.0, 0.52 * sound + 0.48 * shape + 0.10 * ("category" in why) + 0.12 * ("asr-context" in why)), e, why))
                if not scored:
                    continue
                scored.sort(key=lambda s: -s[0])
                best, second = scored[0], scored[1][0] if len(scored) > 1 else 0.0
                if best[1]["canonical"] != raw and best[0] >= 0.88 and best[0] - second >= 0.12 and (best[2] or best[1]["kind"] in tm.TRUSTED_KINDS):
                    found.append((start, start + size, best[1]["canonical"], best[0]))
    kept = []
    for s in sorted(found, key=lambda s: (s[0], s[0] - s[1], -s[3])):
        if all(s[0] >= k[1] or s[1] <= k[0] for k in kept):
            kept.append(s)
    out, at = "", 0
    for s in sorted(kept):
        out, at = out + text[at : s[0]] + s[2], s[1]
    return out + text[at:]


def test_term_correction_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    titles = sorted({word(rng.choice([6, 8, 9])) for _ in range(30)})
    entries = [
        {"canonical": t, "kind": rng.choice(["title", "channel"]), "category": rng.choice("xy"), "forms": [t], "place": i}
        for i, t in enumerate(titles)
    ]
    vocabulary = spark.createDataFrame(
        [(e["canonical"], e["kind"], e["category"], e["forms"], (e["place"], 0)) for e in entries],
        "canonical string, kind string, category string, forms array<string>, place struct<_o:int,slot:int>",
    )
    texts = []
    for i in range(60):
        body = []
        for _ in range(4):
            t = list(rng.choice(titles))
            if rng.random() < 0.8:
                t[rng.randrange(1, len(t))] = rng.choice("abcd")
            body.append("".join(t))
        texts.append((i, rng.choice([" ", "", "。"]).join(body), rng.choice("xyz"), [rng.choice(titles)]))
    df = spark.createDataFrame(texts, "id int, text string, category string, context array<string>")
    got = {r.id: r.canonical_text for r in tm.correct_terms(df, vocabulary, ["id"], run="[a-d]+").collect()}
    want = {i: brute(t, c, x, entries) for i, t, c, x in texts}
    assert got == want
    assert any(want[i] != t for i, t, _c, _x in texts)


def test_kept_spans_never_overlap(spark):
    rng = random.Random(9)
    spans = [(a := rng.randrange(60), a + rng.randint(1, 9), rng.random()) for _ in range(50)]
    df = spark.createDataFrame([(1, s, e, "r", "c", x, "") for s, e, x in spans], "id int, start int, end int, raw string, canonical string, score double, reason string")
    kept = df.groupBy("id").agg(tm.nonoverlap_spans(F.collect_list(F.struct("start", "end", "raw", "canonical", "score", "reason"))).alias("k")).first().k
    want = []
    for s in sorted(spans, key=lambda s: (s[0], -(s[1] - s[0]), -s[2])):
        if all(s[0] >= w[1] or s[1] <= w[0] for w in want):
            want.append(s)
    assert [(k.start, k.end, k.score) for k in kept] == want
