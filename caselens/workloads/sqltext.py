"""SQL text of the column expressions, for the twin queries."""

from __future__ import annotations

from ..functions.text import (
    COUNT_ENGLISH, COUNT_NUMERAL, COUNT_PHRASE, HAN_WORD, NUMERALS, QUERY_FILLERS,
    QUERY_PUNCTUATION, WORD,
)

SPACE = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"


def s_norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'))"


def s_fold(x: str) -> str:
    return f"replace(translate(lower({x}), 'ςſ', 'σs'), 'ß', 'ss')"


_PUNCT = "'" + QUERY_PUNCTUATION.replace("\t", "").replace("\r", "").replace("\n", "") + \
    "' || chr(9) || chr(10) || chr(13)"


def s_query(x: str) -> str:
    text = f"trim({s_fold(s_norm(x))}, {_PUNCT})"
    for filler in QUERY_FILLERS:
        text = f"replace({text}, '{filler}', ' ')"
    text = f"regexp_replace({text}, '{COUNT_PHRASE}', ' ', 'g')"
    text = f"regexp_replace({text}, '{SPACE}', ' ', 'g')"
    return f"trim({text}, {_PUNCT})"


def s_tokens_cte(source: str, key: str, text: str, name: str = "tok") -> str:
    """CTE text giving (key, pos, token): ordered distinct words plus Han pairs."""
    return f"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all({text}, '{WORD}')) AS w,
    generate_subscripts(regexp_extract_all({text}, '{WORD}'), 1) AS wi FROM {source}),
{name}_x AS (SELECT {key}, wi, 0 AS pi, w AS token FROM {name}_w
    UNION ALL SELECT {key}, wi, pi, substr(w, pi, 2) FROM (SELECT {key}, wi, w, unnest(range(1, length(w))) AS pi
        FROM {name}_w WHERE regexp_matches(w, '{HAN_WORD}') AND length(w) > 2)),
{name} AS (SELECT {key}, token, row_number() OVER (PARTITION BY {key} ORDER BY min(wi * 100000 + pi)) AS pos
    FROM {name}_x GROUP BY {key}, token)"""


def s_count(x: str) -> str:
    first = f"regexp_extract({x}, '{COUNT_NUMERAL}', 1)"
    second = f"regexp_extract({x}, '{COUNT_ENGLISH}', 1)"
    found = f"CASE WHEN {first} <> '' THEN {first} ELSE {second} END"
    numerals = " ".join(f"WHEN '{k}' THEN {v}" for k, v in NUMERALS.items())
    return (
        f"CASE WHEN regexp_matches({found}, '^[0-9]+$') THEN CAST({found} AS INT) "
        f"ELSE CASE {found} {numerals} END END"
    )


def s_any(x: str, phrases: tuple[str, ...] | list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"
