"""Text normalisation, query cleaning and tokens as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these exact lists and patterns.
SPACE_CLASS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
QUERY_PUNCTUATION = "？?！!。.，,、；;：:（）()[]【】{} \t\r\n"
QUERY_FILLERS = (
    "请介绍", "介绍一下", "有哪些", "有那些", "有什么", "想了解", "值得了解",
    "我想知道", "讲讲", "说说", "搜索", "查找", "找一下", "推荐", "诈骗案例",
    "反诈案例", "案例资料", "案例", "资料", "一下", "的", "请问",
)
COUNT_PHRASE = r"(?:\p{Nd}{1,2}|[一二两三四五六七八九十]+) *(?:个|项|种|类)"
COUNT_NUMERAL = r"([0-9]{1,2}|[一二两三四五六七八九十])[\s\p{Z}]*(?:个|项|种|类)"
COUNT_ENGLISH = (
    r"(?i)(?:^|[^\p{L}\p{N}_])([0-9]{1,2})[\s\p{Z}]*"
    r"(?:projects?|items?|types?|traditions?|examples?)(?:$|[^\p{L}\p{N}_])"
)
NUMERALS = {
    "一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
}
WORD = r"[\p{L}\p{N}_]+"
HYPHEN_BREAK = r"(?<=[\p{L}\p{N}_][\p{L}_])-(?=[\p{L}\p{N}_]+[\p{L}_])"
HAN_WORD = r"^[\x{4e00}-\x{9fff}]+$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row; an expression named twice inside
    a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(text: Column | str) -> Column:
    """Collapse every run of white space to one blank and trim."""
    column = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), SPACE_CLASS + "+", " "))


def casefold(text: Column | str) -> Column:
    """Lower case plus the letters whose folded form differs from it."""
    column = F.col(text) if isinstance(text, str) else text
    return F.replace(F.translate(F.lower(column), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def strip(text: Column | str) -> Column:
    """Trim every kind of white space; NULL becomes ''."""
    column = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.coalesce(column, F.lit("")), F.lit(SPACES))


def line_text(text: Column | str) -> Column:
    """Unix line ends, trimmed, inner white space kept."""
    column = F.col(text) if isinstance(text, str) else text
    unix = F.regexp_replace(F.coalesce(column, F.lit("")), "\r\n?", "\n")
    return strip(unix)


def multi_values(text: Column | str) -> Column:
    """Split on either semicolon; trimmed, no blanks, first occurrence kept."""
    column = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.coalesce(column, F.lit("")), "[;；]")
    return F.array_distinct(F.filter(F.transform(parts, line_text), lambda part: part != ""))


def norm_query(text: Column | str) -> Column:
    cleaned = F.btrim(casefold(norm(text)), F.lit(QUERY_PUNCTUATION))
    # in listed order; a fold keeps the plan small
    cleaned = F.aggregate(
        F.array(*[F.lit(filler) for filler in QUERY_FILLERS]), cleaned,
        lambda left, filler: F.replace(left, filler, F.lit(" ")),
    )
    cleaned = F.regexp_replace(cleaned, COUNT_PHRASE, " ")
    cleaned = F.regexp_replace(cleaned, SPACE_CLASS + "+", " ")
    return F.btrim(cleaned, F.lit(QUERY_PUNCTUATION))


def tokens(cleaned: Column | str) -> Column:
    """Words of an already cleaned query; long Han words add their character pairs."""
    column = F.col(cleaned) if isinstance(cleaned, str) else cleaned

    def expand(word: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2))
        )
        is_long_han = word.rlike(HAN_WORD) & (F.length(word) > 2)
        return F.when(is_long_han, F.concat(F.array(word), pairs)).otherwise(F.array(word))

    words = F.regexp_extract_all(column, F.lit(f"({WORD})"), 1)
    return F.array_distinct(F.flatten(F.transform(words, expand)))


def requested_count(question: Column | str) -> Column:
    """How many entries the question asks for; NULL when it names no number."""
    column = F.col(question) if isinstance(question, str) else question
    found = F.regexp_extract(column, COUNT_NUMERAL, 1)
    found = F.when(found != "", found).otherwise(F.regexp_extract(column, COUNT_ENGLISH, 1))
    numerals = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    return F.when(found.rlike("^[0-9]+$"), found.cast("int")).otherwise(
        F.try_element_at(numerals, found)
    )


def has_speech(text: Column | str) -> Column:
    """At least one letter or digit; punctuation alone is noise."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).rlike(r"[\p{L}\p{N}]")


def shorten(text: Column | str, width: int, placeholder: str = "...") -> Column:
    """Cut normalised text to ``width`` at the last blank, or after the last hyphen inside
    a word; a chunk that does not fit is left out whole."""
    column = F.col(text) if isinstance(text, str) else text
    room = width - len(placeholder)
    mark = "\u0002"
    marked = F.regexp_replace(column, HYPHEN_BREAK, mark)

    def last_index(prefix: Column, sought: str) -> Column:
        back = F.locate(sought, F.reverse(prefix))
        return F.when(back > 0, F.length(prefix) + 1 - back).otherwise(0)

    by_blank = last_index(F.substring(marked, 1, room + 1), " ") - 1
    by_hyphen = last_index(F.substring(marked, 1, room), mark)
    cut = F.greatest(by_blank, by_hyphen, F.lit(0))
    head = F.rtrim(F.translate(F.substring(marked, F.lit(1), cut), mark, "-"))
    return F.when(F.length(column) <= width, column).otherwise(F.concat(head, F.lit(placeholder)))
