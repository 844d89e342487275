"""Which dictionary phrases occur in which texts, as an equality join.

Every phrase has an anchor: of some of its runs of up to three words the one that the fewest phrases of the dictionary
hold. Phrases go by number, their words are sent only where they are compared. A filter, as big as the dictionary needs up to MOST_BITS, says which words begin an anchor and which runs may be one, so a text gives only
its runs that the filter lets through, each with up to CONTEXT words to both sides. These rows meet the
dictionary by anchor and are checked where they are; only pairs of a phrase that is longer than that, and
agrees with all the words around the anchor, are checked against the whole text. Nothing compares every text
with every phrase, and no other run is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import col
from tidemark.functions.text import bound, contains_phrase
from tidemark.session import written

ANCHOR_WORDS = 3
#: Runs of a phrase that are counted to find a rare one, least by hash and so the same of phrases that share them. Any run of
#: a phrase may be its anchor: the choice decides how much is compared, never what is found.
CANDIDATES = 8
#: Words that a run carries to both sides.
CONTEXT = 32
#: Shortest phrase that counts, in characters.
LEAST_CHARS = 5
#: Least and most bits of a membership filter (16 KiB and 1 MiB), bits for each value, and places of a value. A filter that is
#: too small for its dictionary lets more runs through, never fewer.
FILTER_BITS = 1 << 17
MOST_BITS = 1 << 23
BITS_EACH = 16
PLACES = 3


class Membership:
    """A test that holds for every value of a column, and for few others.

    Its bits are a scalar subquery over one written row, so they are in no plan and in no plan's text, which the driver keeps. A
    subquery cannot stand inside a lambda, or beside one: there `bits` are selected as a column before and given.
    """

    def __init__(self, values: DataFrame, hashed: Column):
        self.size, wanted = FILTER_BITS, min(MOST_BITS, BITS_EACH * values.count())
        while self.size < wanted:
            self.size *= 2
        places = values.select(F.explode(F.array(*[self._place(hashed, k) for k in range(PLACES)])).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), self._bit(F.col("at")))
        told = places.select((self._word(F.col("at")) - 1).cast("long").alias("word"), bit.alias("bits"))
        every = values.sparkSession.range(self.size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = told.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        # At most MOST_BITS / 64 words.
        self.bits = written(words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("bits"))).scalar()

    def _place(self, hashed: Column, k: int) -> Column:
        return F.shiftrightunsigned(hashed, 20 * k).bitwiseAND(F.lit(self.size - 1).cast("long"))

    @staticmethod
    def _word(at: Column) -> Column:
        return F.shiftright(at, 6).cast("int") + 1

    @staticmethod
    def _bit(at: Column) -> Column:
        return at.bitwiseAND(F.lit(63).cast("long")).cast("int")

    def hashed(self, value: Column, bits: Column) -> Column:
        """The test of a value that is hashed already."""
        at = [self._place(value, k) for k in range(PLACES)]
        return reduce(lambda a, b: a & b, [F.getbit(F.element_at(bits, self._word(x)), self._bit(x)) == 1 for x in at])

    def __call__(self, value: Column, bits: Column | None = None) -> Column:
        return self.hashed(F.xxhash64(value), self.bits if bits is None else bits)


def membership(values: DataFrame, column: str) -> Membership:
    return Membership(values, F.xxhash64(column))


def numbered(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(phrase, phrase_id): the distinct phrases that count, written once."""
    return written(phrases.select(phrase).where(F.length(phrase) >= LEAST_CHARS).distinct().withColumn("phrase_id", F.monotonically_increasing_id()))


def run_hash(words: Column, i: Column, n: int) -> Column:
    """A hash of the run of up to n words at i, without putting their texts together."""
    return F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(n)])


def anchored(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """(phrase_id, phrase, anchor, local, whole): a rare run of each phrase, the phrase's words around it, and whether these are
    all. Phrases without a `phrase_id` are given one."""

    def width(words: Column) -> Column:
        return F.least(F.size(words), F.lit(ANCHOR_WORDS))

    def runs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - width(words) + 1),
                           lambda i: F.struct(run_hash(words, i, ANCHOR_WORDS).alias("run"), i.alias("at")))
        return F.slice(F.array_sort(each), 1, CANDIDATES)

    known = phrases if "phrase_id" in phrases.columns else written(phrases.select(phrase).distinct().withColumn("phrase_id", F.monotonically_increasing_id()))
    words = F.split(col(phrase), " ")
    each = written(known.select("phrase_id", F.inline(bound(words, runs))))
    counted = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counted, "run").groupBy("phrase_id").agg(F.min_by("at", F.struct("n", "at")).alias("at"))
    first = F.greatest(F.col("at") - CONTEXT, F.lit(1))
    last = F.least(F.col("at") + CONTEXT, F.size(words))
    return known.join(rarest, "phrase_id").select(
        "phrase_id", phrase, F.array_join(F.slice(words, F.col("at"), width(words)), " ").alias("anchor"),
        F.array_join(F.slice(words, first, last - first + 1), " ").alias("local"), ((first == 1) & (last == F.size(words))).alias("whole"))


def phrase_hits(texts: DataFrame, keys: Sequence[str], text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Distinct (text keys, phrase) pairs where the phrase stands at token boundaries."""
    known = numbered(phrases, phrase)
    return numbered_hits(texts, keys, text, known, phrase).join(known, "phrase_id").select(*keys, phrase)


def numbered_hits(texts: DataFrame, keys: Sequence[str], text: str, phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Distinct (text keys, phrase_id) pairs where a phrase of `numbered` stands at token boundaries.

    The texts are read twice, the second time only those that may hold a phrase longer than a run carries.
    """
    # Written once: the filters and the join read it.
    known = written(anchored(phrases, phrase).drop(phrase))
    parts = F.split("anchor", " ")
    begins = membership(known.select(parts[0].alias("word")), "word")
    is_anchor = Membership(known, run_hash(parts, F.lit(1), ANCHOR_WORDS))

    def runs(given: Column) -> Column:
        words = given["words"]
        size = F.size(words)

        def around(i: Column) -> Column:
            first = F.greatest(i - CONTEXT, F.lit(1))
            return F.array_join(F.slice(words, first, i - first + CONTEXT + 1), " ")

        def found(i: Column) -> Column:
            # A run as one text, for texts are told apart at little cost: words of the run, words before it, and all of them.
            tests = [F.when((i + (n - 1) <= size) & is_anchor.hashed(run_hash(words, i, n), given["anchors"]), F.lit(n)) for n in range(1, ANCHOR_WORDS + 1)]
            before = F.lpad(F.least(i - 1, F.lit(CONTEXT)).cast("string"), 4, "0")
            return F.transform(F.array_compact(F.array(*tests)), lambda n: F.concat(n.cast("string"), before, around(i)))

        starts = F.filter(F.sequence(F.lit(1), size), lambda i: begins(F.element_at(words, i), given["begins"]))
        return F.array_distinct(F.flatten(F.transform(starts, found)))

    # Bits are a column for analysis only: they are not copied into rows.
    bits = texts.where(F.length(text) > 0).select(*keys, F.col(text).alias("_words"), begins.bits.alias("_begins"), is_anchor.bits.alias("_anchors"))
    given = F.struct(F.split("_words", " ").alias("words"), F.col("_begins").alias("begins"), F.col("_anchors").alias("anchors"))
    # The outer form, so that no filter on the number of runs works them out a second time.
    rows = bits.select(*keys, bound(given, runs).alias("_runs")).select(*keys, F.explode_outer("_runs").alias("_run")).where("_run IS NOT NULL")
    rows = rows.select(*keys, F.substring("_run", 1, 1).cast("int").alias("_n"), F.substring("_run", 2, 4).cast("int").alias("_before"), F.expr("substring(_run, 6)").alias("_around"))
    rows = rows.select(*keys, F.array_join(F.slice(F.split("_around", " "), F.col("_before") + 1, F.col("_n")), " ").alias("_anchor"), "_around")
    possible = rows.join(known.select("phrase_id", "local", "whole", F.col("anchor").alias("_anchor")), "_anchor").where(contains_phrase("_around", "local"))
    pairs = written(possible.select(*keys, "phrase_id", "whole").distinct())
    long = pairs.where(~F.col("whole")).drop("whole")
    key = F.xxhash64(*keys)
    asked = membership(long.select(key.alias("key")), "key")
    whole_texts = texts.where(asked(key)).select(*keys, F.col(text).alias("_whole_text"))
    longer = long.join(phrases.select("phrase_id", phrase), "phrase_id").join(whole_texts, list(keys)).where(contains_phrase("_whole_text", phrase))
    return pairs.where("whole").select(*keys, "phrase_id").unionByName(longer.select(*keys, "phrase_id").distinct())
