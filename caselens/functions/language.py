"""Locale and dialect expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, casefold, strip

# Supported locales, aliases and marker words.
DEFAULT_LOCALE = "zh-CN"
# code: (recognition language, is dialect)
PROFILES = {
    "zh-CN": ("zh", False), "yue-CN": ("zh", True), "zh-CN-sichuan": ("zh", True),
    "zh-CN-henan": ("zh", True), "en-US": ("en", False), "ja-JP": ("ja", False), "ko-KR": ("ko", False),
}
ALIASES = {
    "zh": "zh-CN", "zh-cn": "zh-CN", "zh-hans": "zh-CN", "zh-sg": "zh-CN", "cmn": "zh-CN",
    "yue": "yue-CN", "yue-cn": "yue-CN", "yue-hk": "yue-CN", "zh-hk": "yue-CN",
    "zh-cn-sichuan": "zh-CN-sichuan", "zh-sichuan": "zh-CN-sichuan", "sichuan": "zh-CN-sichuan",
    "zh-cn-henan": "zh-CN-henan", "zh-henan": "zh-CN-henan", "henan": "zh-CN-henan",
    "en": "en-US", "ja": "ja-JP", "jp": "ja-JP", "ko": "ko-KR", "kr": "ko-KR",
}
PROVIDER_TAGS = {
    "zh": "zh-CN", "cn": "zh-CN", "zh_cn": "zh-CN", "cn_cbm": "zh-CN",
    "yue": "yue-CN", "yue_cn": "yue-CN", "yue_hk": "yue-CN", "en": "en-US",
    "ja": "ja-JP", "jp": "ja-JP", "ja_jp": "ja-JP", "ko": "ko-KR", "kr": "ko-KR", "ko_kr": "ko-KR",
}
CANTONESE = ("唔", "冇", "喺", "佢", "咩", "嘅", "啲", "嚟", "乜", "噉", "咗", "睇下", "点解")
SICHUAN = ("啥子", "咋个", "巴适", "要得", "莫得", "摆龙门阵", "雄起", "安逸得很", "瓜娃子")
HENAN_STRONG = ("河南话", "豫语", "中不中", "弄啥嘞", "弄啥咧", "可得劲", "喷空", "木牛", "恁好")
HENAN_WEAK = ("恁", "俺", "得劲", "咋恁", "啥嘞", "咋弄")
ENGLISH_WORDS = (
    "hello", "thanks", "english", "heritage", "history", "what", "which", "tell", "about",
    "the", "and", "is", "are",
)
KANA, HANGUL = r"[\x{3040}-\x{30ff}]", r"[\x{ac00}-\x{d7af}]"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
LATIN = r"A-Za-zÀ-ÖØ-öø-ÿ"
HAN_HINTS = ("yue-CN", "zh-CN-sichuan", "zh-CN-henan", "ja-JP")
LATIN_HINTS = ("en-US", "ja-JP", "ko-KR")
_WIDE = "".join(chr(c) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_NARROW = "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B)])


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def canonical_locale(hint: Column | str) -> Column:
    """Supported locale of a hint: alias, then exact code, then primary subtag; else NULL."""
    column = F.col(hint) if isinstance(hint, str) else hint
    folded = casefold(F.replace(strip(column), F.lit("_"), F.lit("-")))
    aliases = _table(ALIASES)
    codes = _table({code.lower(): code for code in PROFILES})
    found = F.coalesce(
        F.try_element_at(aliases, folded),
        F.try_element_at(codes, folded),
        F.try_element_at(aliases, F.substring_index(folded, "-", 1)),
    )
    return F.when(~folded.isin("", "auto"), found)


def provider_locale(tag: Column | str) -> Column:
    column = F.col(tag) if isinstance(tag, str) else tag
    key = F.replace(casefold(strip(column)), F.lit("-"), F.lit("_"))
    return F.try_element_at(_table(PROVIDER_TAGS), key)


def profile_code(locale: Column | str) -> Column:
    """Profile of a hint, the default where it names none."""
    return F.coalesce(canonical_locale(locale), F.lit(DEFAULT_LOCALE))


def is_chinese(locale: Column | str) -> Column:
    return profile_code(locale).isin([c for c, (lang, _) in PROFILES.items() if lang == "zh"])


def canonical_tag(tag: Column | str) -> Column:
    """Letter case of a well-formed language tag: language lower, script title, region
    upper; '' for anything else."""
    column = F.col(tag) if isinstance(tag, str) else tag
    text = F.replace(strip(column), F.lit("_"), F.lit("-"))
    parts = F.transform(
        F.split(F.lower(text), "-"),
        lambda part, i: F.when(i == 0, part)
        .when(part.rlike("^[a-z]{4}$"), F.initcap(part))
        .when(part.rlike("^[a-z]{2}$"), F.upper(part))
        .otherwise(part),
    )
    formed = text.rlike("^[A-Za-z]{2,3}([-][A-Za-z0-9]{2,8})*$") & (F.length(text) <= 64)
    return F.when(formed, F.array_join(parts, "-")).otherwise("")


def preferred_locales(tags: Column | str, n: int = 3) -> Column:
    """First distinct usable tags of a preference list, or the default."""
    column = F.col(tags) if isinstance(tags, str) else tags
    named = F.array_distinct(F.filter(F.transform(column, canonical_tag), lambda t: t != ""))
    return F.when(F.size(named) > 0, F.slice(named, 1, n)).otherwise(F.array(F.lit(DEFAULT_LOCALE)))


def _hits(text: Column, markers: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for marker in markers:
        total = total + text.contains(marker).cast("int")
    return total


def detect_locale(text: Column | str, hint: Column | None = None) -> Column:
    """Locale of a text: dialect markers, then script, then letters; the hint only breaks
    ties."""
    content = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    hinted = F.lit(None).cast("string") if hint is None else canonical_locale(hint)
    cantonese, sichuan = _hits(content, CANTONESE), _hits(content, SICHUAN)
    weak = _hits(content, HENAN_WEAK)
    henan = _hits(content, HENAN_STRONG) * 2 + F.when(weak >= 2, weak).otherwise(0)
    dialect = (
        F.when((cantonese > 0) & (cantonese >= sichuan) & (cantonese >= henan), "yue-CN")
        .when((sichuan > 0) & (sichuan >= henan), "zh-CN-sichuan")
        .when(henan > 0, "zh-CN-henan")
    )
    words = F.lower(F.translate(content, _WIDE, _NARROW))
    english = words.rlike(f"(?:^|[^{LATIN}])(?:{'|'.join(ENGLISH_WORDS)})(?:$|[^{LATIN}])")
    # English words only matter where the hint names another language of the Latin branch
    by_letters = F.when(
        F.coalesce(hinted.isin([c for c in LATIN_HINTS if c != "en-US"]), F.lit(False)),
        F.when(english, "en-US").otherwise(hinted),
    ).otherwise("en-US")
    # every dialect marker is Han, so texts without Han skip the marker and count passes
    has_han, has_latin = content.rlike(HAN), content.rlike(f"[{LATIN}]")
    mostly_latin = F.regexp_count(content, F.lit(f"[{LATIN}]")) >= 2 * F.regexp_count(content, F.lit(HAN))
    by_script = F.when(content.rlike(KANA), "ja-JP").when(content.rlike(HANGUL), "ko-KR")
    han_hint = F.coalesce(hinted.isin(list(HAN_HINTS)), F.lit(False))
    return F.when(
        has_han,
        F.coalesce(
            dialect, by_script,
            F.when(has_latin & mostly_latin, by_letters).when(han_hint, hinted).otherwise("zh-CN"),
        ),
    ).otherwise(
        F.coalesce(by_script, F.when(has_latin, by_letters), hinted, F.lit(DEFAULT_LOCALE))
    )


def speech_locale(text: Column | str) -> Column:
    """Script-only guess for read-out text."""
    column = F.col(text) if isinstance(text, str) else text
    return (
        F.when(column.rlike(KANA), "ja-JP").when(column.rlike(HANGUL), "ko-KR")
        .when(column.rlike(r"[\x{3400}-\x{9fff}]"), "zh-CN").otherwise("en-US")
    )


# Sentence borders. A stop counts unless it ends an abbreviation or initials; it must be
# followed by a blank, a closing mark or the end.
MARK = "\ufdd0"
CLOSERS = r"[\"'”’)\]】》]"
HARD = r"[。！!？?；;\n]"
ABBREVIATIONS = "mr|mrs|ms|dr|prof|sr|jr|st|vs|etc"
_BLANK = SPACE_CLASS
# the stop comes first, so the look-behinds run only at stops
SENTENCE_END = (
    rf"(?:{HARD}|\.(?=\z|{_BLANK}|{CLOSERS})(?<!(?:^|{_BLANK})(?iu:{ABBREVIATIONS})\.)"
    rf"(?<!(?:^|{_BLANK})(?iu:[a-z]\.){{2,8}})){CLOSERS}*"
)


def sentence_parts(text: Column | str) -> Column:
    """Pieces between borders; the last piece is the unfinished rest."""
    column = F.col(text) if isinstance(text, str) else text
    return F.split(F.regexp_replace(F.coalesce(column, F.lit("")), SENTENCE_END, "$0" + MARK), MARK)


def completed_sentences(parts: Column) -> Column:
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.filter(F.transform(whole, strip), lambda s: s != "")


def rest_of_text(done: Column, parts: Column, locale: Column) -> Column:
    """What follows the first sentence, joined without blanks in zh, yue, ja and ko."""
    tail = F.slice(done, F.lit(2), F.greatest(F.size(done) - 1, F.lit(0)))
    close = F.lower(locale).rlike("^(?:zh|yue|ja|ko)(?:-|$)")
    joined = F.when(close, F.array_join(tail, "")).otherwise(F.array_join(tail, " "))
    return strip(F.concat(joined, F.element_at(parts, -1)))
