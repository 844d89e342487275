"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

All measures of a text are columns of one projection; the verdict is one boolean expression made
from the threshold table. Nothing is shuffled: every text is judged where it lies.

Defined results: null and empty texts have no words, every measure is 0 and they are not kept;
ratios with no denominator are null and break no bound; repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she "
    "der die das und ist von zu mit den für nicht ein eine auf im dem des sich auch als "
    "le la les de et un une du des est que qui dans pour par sur au avec pas ne "
    "el los las y en un una que es por con para del se no lo su al"
).split()

#: (measure, least, most). stop_ratio counts one word more than it finds, so short texts may have none.
#: None leaves that side open. A measure outside its bounds rejects.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_length", 2.0, 15.0),
    ("symbol_ratio", None, 0.10),
    ("shout_ratio", None, 0.30),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.50),
    ("digit_ratio", None, 0.50),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _count_chars(text: Column, chars: str) -> Column:
    """Characters of `text` that are one of `chars`."""
    without = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)
    return F.length(text) - F.length(without)


def _covered(steps: DataFrame) -> DataFrame:
    """Adds `starts`: places of the windows of REPEAT_WINDOW words that occur at least twice in their text.

    Equal windows become neighbours once (hash, place) pairs are sorted; they are then confirmed word
    by word, so equal hashes of other words do not count. Only texts with equal hashes are sorted. Each
    list is a column of its own, so that it is made once a row.
    """
    n = REPEAT_WINDOW
    words = F.col("words")
    empty = F.array().cast("array<bigint>")
    hashes = F.when(F.size(words) < n, empty).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)])))
    steps = steps.withColumn("hashes", hashes)
    keyed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("key"), i.alias("i"))))
    steps = steps.withColumn("keyed", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), keyed))
    steps = steps.withColumn("twins", _with_equal_neighbour("keyed"))
    named = F.sort_array(F.transform("twins", lambda i: F.struct(F.slice(words, i + 1, n).alias("key"), i.alias("i"))))
    steps = steps.withColumn("named", named)
    return steps.withColumn("starts", F.sort_array(_with_equal_neighbour("named")))


def _with_equal_neighbour(column: str) -> Column:
    """`i` of the entries of a sorted list of (key, i) whose key is that of the entry before or after."""
    def i_if_equal(x: Column, j: Column) -> Column:
        before, after = F.get(column, j - 1)["key"], F.get(column, j + 1)["key"]
        return F.when(F.coalesce(before == x["key"], F.lit(False)) | F.coalesce(after == x["key"], F.lit(False)), x["i"])

    return F.filter(F.transform(column, i_if_equal), lambda i: i.isNotNull())


def _union_length(starts: Column, width: int) -> Column:
    """Words in the union of ranges of `width` words that begin at the sorted `starts`."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + width - F.greatest(s["end"], i)).alias("n"), (i + width).alias("end")),
        lambda s: s["n"])


def compiled(thresholds) -> Column:
    """The table as one boolean expression over the measures."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            out = out & F.coalesce(F.col(name) >= least, F.lit(True))
        if most is not None:
            out = out & F.coalesce(F.col(name) <= most, F.lit(True))
    return out


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def _whole(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns by way of a one-row generator, which keeps filters on them from being written out
    over the list expressions below (each would be repeated wherever it is used)."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def _measured(rows: DataFrame) -> DataFrame:
    """(row, text) -> row with the counts and ratios of its whole text."""
    text = F.col("text")
    steps = rows.select(
        "row", F.coalesce(text.cast("string"), F.lit("")).alias("text")).select(
        "row", "text", _words(text).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"))
    words = F.col("words")
    counted = _whole(_covered(steps), [
        F.col("row"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_union_length(F.col("starts"), REPEAT_WINDOW), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop"),
        F.size(F.filter(words, lambda w: F.endswith(w, F.lit("!!")))).alias("n_shout"),
        _count_chars(text, "0123456789").alias("n_digits"),
    ])
    return counted.select(
        "*",
        _ratio("word_chars", "n_words").alias("mean_word_length"),
        _ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        _ratio("n_shout", "n_words").alias("shout_ratio"),
        F.when(F.col("n_words") > 0, (F.col("n_stop") + 1) / F.col("n_words")).alias("stop_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_digits", "word_chars").alias("digit_ratio"),
    )


def _judged(rows: DataFrame, thresholds) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return _measured(rows).select("*", failed.alias("base_failed"), (~failed & compiled(thresholds)).alias("kept"))


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(doc_id, text) -> doc_id, the base counts, `base_failed` and `kept`."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _judged(rows, thresholds).select(F.col("row.doc_id").alias("doc_id"), *counts, "base_failed", "kept")


def keep(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    A row travels through the projection as one struct, so no column name can clash.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return _judged(rows, thresholds).where("kept").select("row.*")
