"""Quality rules: repetition rules, and perplexity bands of a modified Kneser-Ney model for each language."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesets import BYTE_VALUES, blocks, prefix_hash, row_of, span_hash, spans
from .store import Scratch
from .words import windows, words_of

#: Characters of an n-gram, and bits of a character.
ORDER = 4
UNIT_BITS = 21
#: Characters of texts whose n-grams meet the model together.
CHUNK_CHARS = 16 << 20
#: More groups than this are not languages; the fit stops instead of filling the driver.
MAX_LANGUAGES = 1000
#: Half width of a band in standard deviations. Of the texts of sf0.1 that are labelled as good, 0.6 % lie outside.
WIDTH = 2.5
#: Base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 10, 5, 20
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
#: Texts are scored in runs of about so many bytes.
RUN_BYTES = 2 << 20


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row."""
    n = len(offsets) - 1
    words = words_of(data, offsets, lower=False)

    def by_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = np.concatenate(([0], np.cumsum(~_CONTINUATION[data])))
    # words in windows that the row has twice or more
    at, value = windows(words, WINDOW)
    order = np.lexsort((value, words.row[at]))
    row, value, at = words.row[at][order], value[order], at[order]
    begin = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))) if len(row) else np.zeros(0, np.int64)
    times = np.diff(np.append(begin, len(row)))
    repeated = at[np.repeat(times > 1, times)]
    covered = np.zeros(len(words.value) + 1, np.int64)
    np.add.at(covered, repeated, 1)
    np.add.at(covered, repeated + WINDOW, -1)
    covered = np.cumsum(covered)[:-1] > 0
    # lines with a word that equal an earlier one of the row
    start, end = spans(data != 0x0A, offsets)
    line_row = row_of(offsets, start)
    line = span_hash(prefix_hash(BYTE_VALUES[data]), start, end)
    inside = np.searchsorted(words.start, start)
    has_word = np.append(words.start, len(data))[inside] < end
    line_row, line = line_row[has_word], line[has_word]
    order = np.lexsort((line, line_row))
    line_row, line = line_row[order], line[order]
    again = (line_row[1:] == line_row[:-1]) & (line[1:] == line[:-1])
    return {
        "n_words": words.count,
        "word_chars": np.bincount(words.row, chars[words.end] - chars[words.start], minlength=n).astype(np.int64),
        "n_symbols": by_row(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_row[1:][again], minlength=n),
        "n_repeat_words": np.bincount(words.row[covered], minlength=n),
    }


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every character of the lower-cased texts those before it, the newest lowest, itself, and its row.

    White space of any length is one space. ORDER - 1 beginnings, as character 0, stand before a text.
    """
    pad = "\0" * (ORDER - 1)
    joined = pad + pad.join(t.replace("\0", " ") for t in texts).lower()
    unit = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    unit = np.where((unit >= 0x09) & (unit <= 0x0D), np.uint32(0x20), unit)
    keep = np.ones(len(unit), bool)
    keep[1:] = (unit[1:] != 0x20) | (unit[:-1] != 0x20)
    unit = unit[keep].astype(np.int64)
    context = np.zeros(len(unit), np.int64)
    for i in range(1, ORDER):
        context[i:] |= unit[:-i] << (UNIT_BITS * (i - 1))
    row = np.cumsum(unit == 0) // (ORDER - 1) - 1
    at = unit > 0
    return context[at], unit[at], row[at]


def _joint(contexts: np.ndarray, context: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """A number for each n-gram whose context is among the sorted ``contexts``, in their order."""
    return np.searchsorted(contexts, context) << UNIT_BITS | unit


def _distinct(context: np.ndarray, unit: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams once each, and how often they come, or the sum of their ``n``."""
    contexts, at = np.unique(context, return_inverse=True)
    gram, back = np.unique(at << UNIT_BITS | unit, return_inverse=True)
    times = np.bincount(back, n, len(gram)).astype(np.int64)
    return contexts[gram >> UNIT_BITS], gram & ((1 << UNIT_BITS) - 1), times


@dataclass(frozen=True)
class PerplexityModel:
    #: (lang, context, unit, log_probability) of every n-gram seen.
    table: DataFrame
    languages: tuple[str, ...]

    @functools.cached_property
    def _by_language(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for one in self.languages:
            got = self.table.where(F.col("lang") == one).select("context", "unit", "log_probability").toArrow()
            context, unit, log = (got[c].to_numpy() for c in got.column_names)
            key = _joint(np.unique(context), context, unit)
            order = np.argsort(key)
            out.append((key[order], log[order]))
        return out

    @property
    def keys(self) -> tuple[np.ndarray, ...]:
        """By language, for a look at a small model: a sorted number for each n-gram, the context's place above UNIT_BITS of the unit."""
        return tuple(keys for keys, _ in self._by_language)

    @property
    def log_probability(self) -> tuple[np.ndarray, ...]:
        """The log probabilities of ``keys``."""
        return tuple(logs for _, logs in self._by_language)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(chunk, id, lang, t): the texts dealt by hash to chunks of about CHUNK_CHARS characters. A null language is ''."""
    total = docs.agg(F.sum(F.length(text_col).cast("bigint"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64(id_col, text_col), F.lit(-(-total // CHUNK_CHARS) or 1))
    return docs.select(chunk.alias("chunk"), F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("t"))


def count_grams(texts: DataFrame) -> DataFrame:
    """(chunk, lang, context, unit, n): how often each language has each n-gram in a chunk of chunked() texts."""

    def run(group: pa.Table) -> pa.Table:
        found: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in group.combine_chunks().to_batches():
            langs = batch.column(1).to_pylist()
            for lo, hi, _, _ in blocks(batch.column(2), RUN_BYTES):
                for lang in sorted(set(langs[lo:hi])):
                    mine = [i for i in range(lo, hi) if langs[i] == lang]
                    context, unit, _ = _grams([t or "" for t in batch.column(2).take(pa.array(mine)).to_pylist()])
                    found.setdefault(lang, []).append(_distinct(context, unit))
        chunk, out = group["chunk"][0].as_py(), []
        for lang, parts in found.items():
            context, unit, n = _distinct(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            out.append(pa.table({"chunk": pa.repeat(chunk, len(n)), "lang": pa.repeat(lang, len(n)), "context": context, "unit": unit, "n": n}))
        return pa.concat_tables(out)

    return texts.select("chunk", "lang", "t").groupBy("chunk").applyInArrow(run, "chunk long, lang string, context long, unit long, n long")


def fit_perplexity(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> PerplexityModel:
    """Modified Kneser-Ney over the characters of all rows, with discounts for counts 1, 2 and 3 or more at every order and language."""
    return _fitted(count_grams(chunked(docs, text_col, text_col, lang_col)), Scratch(docs.sparkSession))


def _fitted(counts: DataFrame, scratch: Scratch) -> PerplexityModel:
    """The model of count_grams() rows.

    For the lower orders Spark counts how many different characters come before. The model
    stays a table; the driver gets the names of the languages.
    """
    tables = [scratch.write(counts.groupBy("lang", "context", "unit").agg(F.sum("n").alias("n")))]
    languages = sorted(r["lang"] for r in tables[0].select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for m in range(ORDER - 1, 0, -1):
        tables.insert(0, scratch.write(tables[0].groupBy("lang", _cut(m).alias("context"), "unit").agg(F.count("*").alias("n"))))
    known = None
    for m, table in enumerate(tables, 1):
        known = _interpolated(table, m, known)
    known = scratch.write(known.select("lang", "context", "unit", F.log("p").cast("float").alias("log_probability")))
    return PerplexityModel(known, tuple(languages))


def _cut(m: int) -> Column:
    """The context of an n-gram of ``m`` characters."""
    return F.col("context").bitwiseAND(F.lit((1 << UNIT_BITS * (m - 1)) - 1).cast("long"))


def _interpolated(table: DataFrame, m: int, lower: DataFrame | None) -> DataFrame:
    """(lang, context, unit, p) of the n-grams of one order, p interpolated with that of the order below."""
    seen = [F.greatest(F.lit(1.0), F.sum((F.col("n") == k).cast("double"))) for k in (1, 2, 3, 4)]
    y = seen[0] / (seen[0] + 2 * seen[1])
    discounts = [F.least(F.greatest(k - (k + 1) * y * seen[k] / seen[k - 1], F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)]
    # a row for each of at most MAX_LANGUAGES languages
    by_language = F.broadcast(table.groupBy("lang").agg(*discounts, (1.0 / (F.count("*") + 1)).alias("even")))
    same = Window.partitionBy("lang", "context")
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = table.join(by_language, "lang").withColumn("off", off)
    rows = rows.withColumn("total", F.sum("n").over(same)).withColumn("weight", F.sum("off").over(same) / F.col("total"))
    if lower is None:
        rows = rows.withColumn("base", F.col("even"))
    else:
        below = lower.select("lang", F.col("context").alias("below"), "unit", F.col("p").alias("base"))
        rows = rows.withColumn("below", _cut(m - 1)).join(below, ["lang", "below", "unit"])
    return rows.select("lang", "context", "unit", ((F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * F.col("base")).alias("p"))


def score_texts(texts: DataFrame, counts: DataFrame, model: PerplexityModel) -> DataFrame:
    """Columns: id, lang ('' for null), the base counts, n_scored and log_probability and its sum of squares.

    ``texts`` are chunked() ones and ``counts`` their count_grams(): each chunk is sent the
    probabilities of its own n-grams. One that the model hasn't seen gets the least of its
    language; a language that it doesn't know is not scored.
    """
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    least = F.broadcast(model.table.groupBy("lang").agg(F.min("log_probability").alias("least")))
    priced = counts.join(model.table, ["lang", "context", "unit"], "left").join(least, "lang")
    priced = priced.select("chunk", "lang", "context", "unit", F.coalesce("log_probability", "least").alias("log"))
    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "lang", *base, "n_scored", "log_sum", "log_squares"]

    def run(group: pa.Table, prices: pa.Table) -> pa.Table:
        langs = prices["lang"].combine_chunks().dictionary_encode()
        which = langs.indices.to_numpy()
        context, unit, log = (prices[c].to_numpy() for c in ("context", "unit", "log"))
        known = {}
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = which == i
            contexts = np.unique(context[own])
            gram = _joint(contexts, context[own], unit[own])
            order = np.argsort(gram)
            known[lang] = contexts, gram[order], log[own][order].astype(np.float64)
        out = []
        for batch in group.combine_chunks().to_batches():
            for lo, hi, data, offsets in blocks(batch.column(3), RUN_BYTES):
                got = base_counts(data, offsets)
                part = batch.slice(lo, hi - lo)
                lang = np.array(part.column(2).to_pylist(), object)
                n, total, squares = np.zeros(hi - lo, np.int64), np.zeros(hi - lo), np.zeros(hi - lo)
                for one in sorted(set(lang) & set(known)):
                    mine = np.flatnonzero(lang == one)
                    contexts, gram, logs = known[one]
                    before, last, row = _grams([t or "" for t in part.column(3).take(pa.array(mine)).to_pylist()])
                    value = logs[np.searchsorted(gram, _joint(contexts, before, last))]
                    n[mine] = np.bincount(row, minlength=len(mine))
                    total[mine] = np.bincount(row, value, minlength=len(mine))
                    squares[mine] = np.bincount(row, value * value, minlength=len(mine))
                out.append(pa.RecordBatch.from_arrays([part.column(1), part.column(2), *(pa.array(got[c], pa.int64()) for c in base), pa.array(n), pa.array(total), pa.array(squares)], names=names))
        return pa.Table.from_batches(out)

    numbers = ", ".join(f"{c} long" for c in (*base, "n_scored"))
    return texts.groupBy("chunk").cogroup(priced.groupBy("chunk")).applyInArrow(run, f"id {kind}, lang string, {numbers}, log_sum double, log_squares double")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity, band_low, band_high.

    A document fails the base rules with under 10 words, or when over 20 % of its words are
    in 5-word windows that it has twice. Otherwise it is kept if its mean log-perplexity a
    character lies in the band of its language. The band's middle is the median over the
    documents that pass the base rules. Its half width is WIDTH standard deviations: the
    spread between documents (from the median absolute deviation), and for a text of n
    characters the spread of one character divided by n, as short texts vary more.

    A null text has no words. A null language is a group of its own. Repeated rows and null
    ids stay rows of their own; an empty table gives an empty one; other columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    texts = chunked(docs, id_col, text_col, lang_col)
    counts = scratch.write(count_grams(texts))
    scored = score_texts(texts, counts, _fitted(counts, scratch))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("log_perplexity", -F.col("log_sum") / F.nullif(F.col("n_scored"), F.lit(0)))
    scored = scratch.write(scored)
    passed = scored.where("NOT base_failed AND log_perplexity IS NOT NULL")
    middle = passed.groupBy("lang").agg(
        F.percentile_approx("log_perplexity", 0.5, 100_000).alias("middle"),
        (F.sum("log_squares") / F.nullif(F.sum("n_scored"), F.lit(0)) - F.pow(F.sum("log_sum") / F.nullif(F.sum("n_scored"), F.lit(0)), 2)).alias("char_variance"),
    )
    middle = scratch.write(middle)
    off = passed.join(F.broadcast(middle), "lang").groupBy("lang").agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 100_000).alias("deviation"))
    # a row for each of at most MAX_LANGUAGES languages, as the fit has checked
    bands = middle.join(off, "lang")
    half = WIDTH * F.sqrt(F.pow(1.4826 * F.col("deviation"), 2) + F.greatest(F.col("char_variance"), F.lit(0.0)) / F.nullif(F.col("n_scored"), F.lit(0)))
    out = scored.join(F.broadcast(bands), "lang", "left").withColumn("half", half)
    inside = F.abs(F.col("log_perplexity") - F.col("middle")) <= F.col("half")
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "log_perplexity",
        (F.col("middle") - F.col("half")).alias("band_low"), (F.col("middle") + F.col("half")).alias("band_high"),
    )
