"""Line duplicates by an exact set-similarity join of lines, in DataFrame operations alone."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .minhash import _marked, _perhaps
from .store import Scratch

#: Lines with Jaccard of at least PERCENT / 100 between their word sets are duplicates.
PERCENT = 80
#: A line of fewer different words is too short to judge by its words.
LEAST_WORDS = 5
#: Where such lines are compared whole, those of fewer characters, without needless space, stay: "Yes", "}", "* * *".
LEAST_CHARS = 10
#: Sets of fewer words are told apart by 128 bits alone; larger ones by all their parts too.
WIDE = 192
#: Bits of a part's number and of the hash of its words in a token; above them stands how long these words are, the longest first.
PART_BITS, HASH_BITS, LONGEST = 20, 36, 127

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_words(line: Column) -> Column:
    """Words of a line, separated by white space, A-Z lower-cased."""
    # lower() is quick, and does the same where no other letter has a lower case
    others = line.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]")
    quick = F.when((F.octet_length(line) == F.length(line)) | ~others, F.lower(line))
    folded = quick.otherwise(F.translate(line, _UPPER, _LOWER))
    # splitting at one character is quick
    rare = functools.reduce(Column.__or__, (F.contains(line, F.lit(c)) for c in "\t\n\x0b\f\r"))
    return F.array_remove(F.when(rare, F.split(folded, r"[\x20\x09-\x0D]+")).otherwise(F.split(folded, " ")), "")


def _least(c: str) -> str:
    """The fewest words of a size class; its largest sets have one word less than twice as many."""
    return f"shiftleft({LEAST_WORDS}, {c})"


def _class(n: str) -> str:
    return f"(length(bin({n} div {LEAST_WORDS})) - 1)"


def _parts(c: str) -> str:
    """Into so many parts the words are dealt by hash: enough that more of them have words than two similar sets of the class can differ in."""
    return f"(({_least(c)} + 1) div 2 + 2)"


def _differing(x: str, y: str) -> str:
    """Words that are in one alone of two similar sets of so many words, at most."""
    return f"(({100 - PERCENT} * ({x} + {y})) div {100 + PERCENT})"


#: The size class a line is dealt in, its own or, as a guest, the next one.
_IN = f"({_class('n')} + guest)"
#: Words of a similar set that the line meets in that class, at most.
_MET = f"if(guest = 1, 100 * n div {PERCENT}, least(100 * n div {PERCENT}, 2 * {_least(_class('n'))} - 1))"
#: Two similar sets share one of so many first tokens of each, in any order that all sets have in common.
_FIRST_TOKENS = f"({_differing('n', _MET)} + 1)"

#: Whether sets x and y can be similar, by their lengths and by how many words they can share at most (bits that differ
#: are words of one of the two alone, and so is a word at least of parts that differ).
_POSSIBLE = f"""100 * x.n >= {PERCENT} * y.n AND 100 * y.n >= {PERCENT} * x.n
  AND bit_count(x.low ^ y.low) + bit_count(x.high ^ y.high) <= {_differing("x.n", "y.n")}
  AND (x.wide IS NULL OR y.wide IS NULL OR {_class("x.n")} <> {_class("y.n")}
    OR size(array_intersect(x.wide, y.wide)) >= greatest(size(x.wide), size(y.wide)) - {_differing("x.n", "y.n")})"""

#: Whether a shared token is the first that x and y share, as far as the two tokens before it tell. A pair always
#: passes at its first one; one that shares several tokens in a row is made once for them.
_FIRST_MEETING = " AND ".join(f"NOT (x.before{i} <=> y.before{j} AND x.before{i} IS NOT NULL)" for i in (1, 2) for j in (1, 2))


def _version(text: Column) -> Column:
    """30 bits that tell apart texts which share an id; with a line's number they are its place."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x3FFFFFFF))


def _place() -> Column:
    """A line of one of the texts of an id."""
    return (F.shiftleft("version", 32) + F.col("line")).alias("place")


@contextmanager
def _lists_in_memory(spark: SparkSession) -> Iterator[None]:
    """Tokens are gathered by line in memory: a task has as many lists as lines, and a list is no longer than its line."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 20))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineJoin:
    """The lines of documents, their classes of equal word sets, and which of them come later than a similar one.

    The words of a line are dealt by hash into so many parts that a similar line has one of
    them, at least, with the same words. A part with its words is a token, and lines that
    share one of the first tokens of each are compared. A token mostly stands for several
    words, the longest come first, and few lines share one by chance.

    With ``short_chars``, lines of fewer than LEAST_WORDS different words are copies if they
    equal an earlier one, A-Z lower-cased and white space of any length as one space, and
    have at least so many characters then. This holds for any script, spaced or not.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, short_chars: int | None = None):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark)
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.read = docs.select(F.col(id_col).alias("id"), _version(text).alias("version"), text.alias("text"))
        with _lists_in_memory(self.spark):
            dealt = self.scratch.write(self._dealt(short_chars))
        own = dealt.where("guest = 0")
        alike = own.groupBy("n", "h1", "h2").agg(F.min("seq").alias("lead"), F.count("*").alias("many"))
        #: The lines to be judged by their numbers (seq), which are in the order of the lines.
        self.lines = self.scratch.write(own.select("id", "version", "line", "seq"))
        #: The other lines of every class of equal word sets, and the first of each.
        self.copies = self.scratch.write(own.select("n", "h1", "h2", "seq").join(alike.where("many > 1"), ["n", "h1", "h2"]).where("seq <> lead").select("seq"))
        first = dealt.where(F.col("n") >= LEAST_WORDS).join(self.copies, "seq", "left_anti")
        #: A row for each class, and one more (guest) where it can be similar to lines of the next size class.
        self.classes = self.scratch.write(first.select("seq", "guest", "n", "low", "high", "wide", "tokens"))
        self.scratch.drop(dealt)

    def _dealt(self, short_chars: int | None) -> DataFrame:
        """(id, version, line, seq, guest, n, h1, h2, low, high, wide, tokens) of the lines to be judged."""
        # rows with one id and one text are one document; what follows stays in the tasks that have its documents
        named = self.read.where("id IS NOT NULL").repartitionByRange("id", "version")
        ordered = named.groupBy("id", "version").agg(F.first("text").alias("text")).sortWithinPartitions("id", "version")
        each = ordered.select("id", "version", F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "content"))
        said = line_words(F.col("content"))
        short = F.array().cast("array<string>")
        if short_chars is not None:
            squeezed = F.array_join(said, " ")
            short = F.when((F.length("content") >= short_chars) & (F.length(squeezed) >= short_chars), F.array(squeezed)).otherwise(short)
        different = F.array_distinct(said)
        kept = each.select("id", "version", "line", F.monotonically_increasing_id().alias("seq"), F.size(different).alias("n"), F.when(F.size(different) >= LEAST_WORDS, different).otherwise(short).alias("words"))
        guests = F.expr(f"if(100 * n div {PERCENT} >= 2 * {_least(_class('n'))} AND n >= {LEAST_WORDS}, array(0, 1), array(0))")
        dealt = kept.select("id", "version", "seq", "line", "n", F.explode(guests).alias("guest"), "words")
        # what holds for a line is made before its words are rows
        tagged = dealt.select("id", "version", "seq", F.expr("(CAST(n AS BIGINT) << 33) | (CAST(line AS BIGINT) << 1) | guest").alias("tag"), F.expr(_parts(_IN)).alias("m"), "words")
        parts = tagged.select("id", "version", "seq", "tag", "m", F.explode("words").alias("w"))
        hashed = parts.select("id", "version", "seq", "tag", "m", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"), F.octet_length("w").alias("size"))
        bit = F.expr("shiftleft(1L, CAST(g & 63 AS INT))")
        by_part = hashed.groupBy("id", "version", "seq", "tag", F.pmod("h", "m").alias("part")).agg(
            F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.sum("size").alias("size"),
            # each bit set if an odd number of words has it by their hash, so that they tell many words apart as well as few
            F.bit_xor(F.when(F.expr("g & 64 = 0"), bit).otherwise(F.lit(0).cast("bigint"))).alias("low"), F.bit_xor(F.when(F.expr("g & 64 <> 0"), bit).otherwise(F.lit(0).cast("bigint"))).alias("high"),
        )
        token = F.expr(f"shiftleft({LONGEST} - least(size, {LONGEST}), {PART_BITS + HASH_BITS}) | shiftleft(part, {HASH_BITS}) | (shiftrightunsigned(h, {64 - HASH_BITS}))")
        by_line = by_part.groupBy("id", "version", "seq", "tag").agg(*(F.bit_xor(c).alias(c) for c in ("h", "g", "low", "high")), F.collect_list(token).alias("tokens"))
        untagged = by_line.select(
            "id", "version", F.expr("CAST((tag >> 1) & 4294967295L AS INT)").alias("line"), "seq", F.expr("CAST(tag & 1 AS INT)").alias("guest"), F.expr("CAST(tag >> 33 AS INT)").alias("n"),
            F.col("h").alias("h1"), F.col("g").alias("h2"), "low", "high", F.sort_array("tokens").alias("tokens"),
        )
        # the parts without words come last in the order of tokens
        held = f"transform(tokens, t -> shiftright(t, {HASH_BITS}) & {(1 << PART_BITS) - 1})"
        empty = f"transform(array_except(sequence(0L, {_parts(_IN)} - 1L), {held}), p -> shiftleft({LONGEST}L, {PART_BITS + HASH_BITS}) | shiftleft(p, {HASH_BITS}))"
        tokens = F.expr(f"if(size(tokens) >= {_FIRST_TOKENS}, slice(tokens, 1, {_FIRST_TOKENS}), concat(tokens, slice({empty}, 1, {_FIRST_TOKENS} - size(tokens))))")
        return untagged.select(
            "id", "version", "line", "seq", "guest", "n", "h1", "h2", "low", "high", F.when((F.col("n") >= WIDE) & (F.col("guest") == 0), F.col("tokens")).alias("wide"),
            F.when(F.col("n") >= LEAST_WORDS, tokens).alias("tokens"),
        )

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (later, earlier) of numbers of classes whose whole word sets are similar enough."""
        pairs = self.scratch.write(pairs)
        wanted = pairs.select(F.col("later").alias("seq")).union(pairs.select("earlier")).distinct()
        named = self.scratch.write(self.lines.select("seq", F.struct("id", _place()).alias("id")).join(wanted, "seq"))
        each = self.read.select("id", "version", F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "content"))
        # most lines are left where they are before their places are compared
        cut = _perhaps(each.select(F.struct("id", _place()).alias("id"), "content"), self.scratch.write(_marked(named)))
        chosen = cut.join(named, "id").groupBy("seq").agg(F.first("content").alias("content"))
        words = F.array_distinct(F.transform(line_words(F.col("content")), lambda w: F.xxhash64(w)))
        sets = self.scratch.write(chosen.select("seq", words.alias("k")))
        both = pairs.join(sets.toDF("later", "k1"), "later").join(sets.toDF("earlier", "k2"), "earlier")
        shared = F.size(F.array_intersect("k1", "k2"))
        found = self.scratch.write(both.where(100 * shared >= PERCENT * (F.size("k1") + F.size("k2") - shared)).select("later", "earlier"))
        self.scratch.drop(pairs, named, sets)
        return found

    def _meetings(self) -> DataFrame:
        """(word, seq, before1, before2, lead, last, nth, more) of the classes that share a token with earlier ones, the first (lead) and the last of them; before1 and before2: their own tokens that stand before it; more: others come later."""
        tokens = self.classes.select("seq", F.expr(_IN).alias("c"), "tokens", F.posexplode("tokens").alias("pos", "token"))
        tokens = tokens.select(F.xxhash64("c", "token").alias("word"), "seq", *(F.get("tokens", F.col("pos") - i).alias(f"before{i}") for i in (1, 2)))
        order = Window.partitionBy("word").orderBy("seq")
        lead = F.first("seq").over(order.rowsBetween(Window.unboundedPreceding, 0))
        placed = tokens.select(
            "word", "seq", "before1", "before2", lead.alias("lead"), F.lag("seq").over(order).alias("last"), F.row_number().over(order).alias("nth"), F.lead("seq").over(order).isNotNull().alias("more")
        )
        return self.scratch.write(placed.where("nth > 1"))

    def repeated(self) -> DataFrame:
        """(id, version, line) of all lines that an earlier line is similar to.

        Lines with the same word set are one class, led by its first line. Classes that share a
        token meet. Each is compared with the first and the last of the earlier ones that it meets
        at a token; one that this doesn't decide is compared with all that the filters leave.
        """
        about = self.classes.where("guest = 0").select("seq", "n", "low", "high", "wide")
        found = self._meetings()
        pairs = found.select("seq", F.explode(F.array("lead", "last")).alias("earlier")).where("seq > earlier").distinct().alias("p")
        with_x = pairs.join(about.alias("x"), F.expr("p.seq = x.seq"))
        near = with_x.join(about.alias("y"), F.expr(f"p.earlier = y.seq AND {_POSSIBLE}"))
        links = self.confirmed(near.select(F.col("p.seq").alias("later"), F.col("p.earlier").alias("earlier")))
        decided = links.select(F.col("later").alias("seq")).distinct()
        crowded = found.where("nth > 2 OR more").join(about, "seq")
        block = self.scratch.write(crowded.select("word", *about.columns, "nth", "last", "before1", "before2"))
        self.scratch.drop(found)
        x, y = block.where("nth > 2").join(decided, "seq", "left_anti").alias("x"), block.alias("y")
        met = x.join(y, F.expr(f"x.word = y.word AND x.seq > y.seq AND x.last <> y.seq AND {_POSSIBLE} AND {_FIRST_MEETING}"))
        more = self.confirmed(met.select(F.col("x.seq").alias("later"), F.col("y.seq").alias("earlier")).distinct())
        self.scratch.drop(block)
        later = decided.union(more.select(F.col("later").alias("seq"))).union(self.copies).distinct()
        found = self.scratch.write(self.lines.join(later, "seq", "left_semi").select("id", "version", "line"))
        self.scratch.drop(self.lines, self.copies, self.classes, links, more)
        return found


def _without(text: Column, gone: Column) -> Column:
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_chars: int | None = LEAST_CHARS) -> DataFrame:
    """The documents, all columns, without the lines that line_duplicates() removes; one whose words all go is dropped.

    The cases are those of line_duplicates(), with exact copies of short lines removed too; a null text stays null.
    """
    join = LineJoin(docs, id_col, text_col, short_chars)
    gone = join.repeated().groupBy("id", "version").agg(F.collect_set("line").alias("gone")).select(F.struct("id", "version", "gone").alias("__gone"))
    own = _version(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    met = docs.join(gone, (docs[id_col] == F.col("__gone.id")) & (own == F.col("__gone.version")), "left")
    kept = _without(docs[text_col], F.col("__gone.gone"))
    left = F.col("__gone").isNull() | kept.rlike(r"[^\x20\x09-\x0D]")
    return met.where(left).select(*(kept.alias(c) if c == text_col else docs[c] for c in docs.columns))


def line_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, short_chars: int | None = None
) -> DataFrame:
    """One row per document: id, n_lines, n_removed, n_kept_chars, kept_sha256 of the lines left, and with ``with_text`` those lines as text.

    A line goes if an earlier line, of a smaller id or above it in its document, has a word
    set with a Jaccard of at least PERCENT / 100 to its own; lines are judged on the input.
    Lines of fewer than LEAST_WORDS different words stay; with ``short_chars`` only the first
    of those that are equal, and those of fewer characters. Equal lines tie to the first. A
    null text is one empty line. Rows with one id and one text are one document and are
    reported alike; different texts of one id are ordered by a hash. Rows with a null id stay
    whole and remove nothing elsewhere. An empty table gives an empty one; other columns are
    left out.
    """
    join = LineJoin(docs, id_col, text_col, short_chars)
    gone = join.repeated().groupBy("id", "version").agg(F.collect_set("line").alias("gone"))
    found = join.read.join(gone, ["id", "version"], "left")
    out = found.select("id", "text", "gone", _without(F.col("text"), F.col("gone")).alias("kept"))
    return out.select(
        F.col("id").alias(id_col), F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.length("kept").cast("long").alias("n_kept_chars"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), *([F.col("kept").alias(text_col)] if with_text else []),
    )
