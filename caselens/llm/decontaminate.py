"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch

#: Consecutive words of a benchmark item that count as contamination; a shorter item is one window.
WINDOW = 10
#: A table of the benchmark is broadcast up to so many rows, counted first; beyond it the joins shuffle.
BROADCAST_ROWS = 500_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _small(table: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns asked for, marked for broadcast if the table's rows, which are counted, are few enough."""
    out = table.select(*columns) if columns else table
    return F.broadcast(out) if table.count() <= BROADCAST_ROWS else out


class BenchmarkWindows:
    """The benchmark's words by place, and the windows they form."""

    def __init__(self, scratch: Scratch, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW):
        # equal rows are one item; texts that share an id are items of their own under one id
        items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
        items = items.distinct().withColumn("item", F.xxhash64("item_id", "w")).withColumn("length", F.least(F.lit(window), F.size("w")))
        self.window = window
        self.words = _small(scratch.write(items.select("item", "item_id", "length", F.size("w").alias("n"), F.posexplode("w").alias("p", "word"))))
        ends = F.least(F.col("p"), F.col("n") - F.col("length"))
        begins = F.greatest(F.lit(0), F.col("p") - F.col("length") + 1)
        self.windows = _small(scratch.write(self.words.select("item", "length", "p", "word", F.explode(F.sequence(begins, ends)).alias("window"))))
        pairs = items.select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("x"))
        self.pairs = scratch.write(pairs.select("x.a", "x.b").distinct())
        self.terms = _small(scratch.write(self.words.groupBy("word").agg((F.min("n") == 1).alias("lone"))))


def build_index(scratch: Scratch, docs: DataFrame, bench: BenchmarkWindows, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (word, id, version, pos) of benchmark terms in all documents, written in runs sorted by word.

    A posting is stored if the word before or after it also neighbours the term in an item,
    or an item is that word alone: no window holds any other. Each document also has one
    posting of the empty word at the place behind its last word, its length.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"), F.concat(words(F.col(text_col)), F.array(F.lit(""))).alias("w"))
    token = read.select("id", "version", "w", F.posexplode("w").alias("pos", "word"))
    token = token.select("id", "version", "pos", "word", F.when(F.col("pos") > 0, F.get("w", F.col("pos") - 1)).alias("before"), F.get("w", F.col("pos") + 1).alias("behind"))
    length = F.col("word") == ""
    terms = bench.terms.select("word", "lone").union(bench.terms.sparkSession.createDataFrame([("", True)], "word string, lone boolean"))
    kept = token.join(_small(scratch.write(terms)), "word")
    after = _small(bench.pairs, F.col("a").alias("word"), F.col("b").alias("behind"), F.lit(True).alias("follows"))
    ahead = _small(bench.pairs, F.col("b").alias("word"), F.col("a").alias("before"), F.lit(True).alias("precedes"))
    kept = kept.join(after, ["word", "behind"], "left").join(ahead, ["word", "before"], "left")
    kept = kept.where(length | F.col("lone") | F.col("follows").isNotNull() | F.col("precedes").isNotNull())
    return scratch.write(kept.select("word", "id", "version", "pos").sortWithinPartitions("word", "id", "pos"))


def phrase_matches(scratch: Scratch, index: DataFrame, bench: BenchmarkWindows) -> DataFrame:
    """Occurrences (id, version, item_id, start, end) of whole windows in documents, end exclusive.

    Every window is looked up by its rarest term. A posting of that term fixes where the item
    would lie; there the postings of the other terms, moved by their places in the item, must
    all be found.
    """
    postings = index.where("word <> ''")
    frequency = postings.groupBy("word").agg(F.count("*").alias("n"))
    frequency = frequency.join(bench.terms.select("word"), "word")
    counted = bench.windows.join(frequency, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("item", "window").agg(F.min_by(F.struct("p", "word"), F.struct("n", "p")).alias("key"), F.min("n").alias("n"))
    rarest = _small(scratch.write(rarest.where("n > 0").select("item", "window", "key.p", "key.word")))
    at = postings.join(rarest, "word").select("id", "version", "item", "window", (F.col("pos") - F.col("p")).alias("shift"))
    at = at.where(F.col("shift") + F.col("window") >= 0)
    places = scratch.write(at.groupBy("id", "version", "item", "shift").agg(F.collect_set("window").alias("windows")))
    wanted = places.join(bench.words, "item").where(F.exists("windows", lambda w: (w <= F.col("p")) & (F.col("p") < w + F.col("length"))))
    wanted = wanted.select("id", "version", "item", "item_id", "length", "shift", "windows", "p", "word", (F.col("shift") + F.col("p")).alias("pos"))
    x, y = wanted.alias("x"), postings.distinct().alias("y")
    same = F.expr("x.word = y.word AND x.pos = y.pos AND x.version = y.version AND x.id <=> y.id")
    found = x.join(y, same).select("x.*").groupBy("id", "version", "item", "item_id", "length", "shift").agg(F.collect_set("p").alias("ps"), F.first("windows").alias("windows"))
    whole = F.filter("windows", lambda w: F.size(F.array_intersect("ps", F.sequence(w, w + F.col("length") - 1))) == F.col("length"))
    hit = found.select("id", "version", "item_id", "length", "shift", F.explode(whole).alias("window"))
    return hit.select("id", "version", "item_id", (F.col("shift") + F.col("window")).alias("start"), (F.col("shift") + F.col("window") + F.col("length")).alias("end"))


def proximity_matches(scratch: Scratch, index: DataFrame, bench: BenchmarkWindows, slack: int = 5) -> DataFrame:
    """Documents that hold all stored terms of a window within the window's length plus ``slack`` words, in any order.

    Columns id, version, item_id, window, near. The rarest term's postings are looked up, and
    at each of them the different terms of the window within reach are counted; near is
    whether all are there. Terms are found where build_index() stores them: beside a word that
    neighbours them in an item.
    """
    postings = index.where("word <> ''").distinct()
    frequency = postings.groupBy("word").agg(F.count("*").alias("n"))
    counted = bench.windows.join(frequency, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("item", "window").agg(F.min_by("word", F.struct("n", "p")).alias("key"), F.min("n").alias("n"), F.countDistinct("word").alias("terms"))
    anchor = postings.join(rarest.where("n > 0"), F.col("word") == F.col("key")).select("id", "version", F.col("pos").alias("at"), "item", "window", "terms")
    wanted = anchor.join(bench.windows.select("item", "window", "word", "length").distinct(), ["item", "window"])
    x, y = wanted.alias("x"), postings.alias("y")
    near = F.expr(f"x.word = y.word AND x.version = y.version AND x.id <=> y.id AND abs(x.at - y.pos) < x.length + {slack}")
    seen = x.join(y, near).groupBy("x.id", "x.version", "x.item", "x.window", "x.at", "x.terms").agg(F.countDistinct("x.word").alias("found"))
    names = bench.words.select("item", "item_id").distinct()
    return seen.where("found = terms").join(names, "item").select("id", "version", "item_id", "window", F.lit(True).alias("near")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated.

    items_sha256 is of the item ids with an occurring window, sorted as strings and joined by
    commas; of the empty string if there are none. Null and empty texts have no words. A null
    item id counts as no item, though its words are hit. Equal rows are reported alike, each
    on its own row, and so are rows with a null id; different texts of one id are kept apart.
    Empty tables give an empty result, an empty benchmark hits nothing; other columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    bench = BenchmarkWindows(scratch, benchmark, item_col)
    index = build_index(scratch, docs, bench, id_col, text_col)
    hits = scratch.write(phrase_matches(scratch, index, bench))
    words_hit = hits.select("id", "version", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().groupBy("id", "version").agg(F.count("*").alias("n_hit"))
    items = hits.groupBy("id", "version").agg(F.collect_set("item_id").alias("items"))
    documents = index.where("word = ''").select("id", "version", F.col("pos").cast("long").alias("n_words"))
    x, y, z = documents.alias("x"), words_hit.alias("y"), items.alias("z")
    out = x.join(y, F.expr("x.id <=> y.id AND x.version = y.version"), "left").join(z, F.expr("x.id <=> z.id AND x.version = z.version"), "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("x.id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(names), ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
