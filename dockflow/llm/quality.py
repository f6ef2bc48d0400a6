"""Quality rules: one table of thresholds compiled into one Spark projection. No user functions, no shuffle.

Words are runs of characters other than blank and 0x09 to 0x0D. Counts of a text: words, code points in words, symbol
characters, lines that repeat an earlier line, and words inside three-word windows that the text holds twice or more.

Repeated windows are found by sorting the text's own window hashes, so time is n log n in the words of one text and
memory is one text's. Only texts with a repeated hash pay for the second sort that keeps positions.

Defined results: NULL and empty texts have no words; all counts are 0 and the base rule fails. Ratios of texts without
words are 0. Repeated rows are judged alike; rows without an id are judged like any other. Texts of any length are
read whole. An empty table gives no rows. Working columns live in one struct, so no column of the input can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"

# Common words of the languages in the corpus, lower case.
STOP_WORDS = (
    "the of and to in a is that it was for on are as with be by this from or an at not but have he his they you "
    "le la les de des du et un une en que qui dans pour par sur est au aux avec ce il elle pas plus "
    "der die das und den dem von zu mit ein eine ist im auf für nicht sich als auch es an werden "
    "el los las y es una por con para del se lo como más su al o este"
).split()


@dataclass(frozen=True)
class Threshold:
    """Texts whose metric lies outside [low, high] are rejected."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics are SQL over n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words.
THRESHOLDS = (
    Threshold("word_length", "word_chars / n_words", 2.0, 15.0),
    Threshold("symbol_share", "n_symbols / word_chars", None, 0.03),
    Threshold("stop_word_share", "n_stop_words / n_words", 0.05, None),
    Threshold("repeated_line_share", "n_dup_lines / n_lines", None, 0.5),
)


def _windows(n: Column, hashes: Column) -> Column:
    """One hash for each three-word window; NULL below three words."""
    at = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), at))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Key (and the columns in `keep`, packed into the struct `row`) beside the counts of each text."""
    packed = F.struct(*[F.col(c) for c in keep]) if keep else F.col(key)
    one = docs.select(
        packed.alias("row"),
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    two = one.select(
        "row",
        F.size("words").alias("n_words"),
        F.array_join("words", "").alias("joined"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    three = two.select(
        "row", "n_words", "n_stop_words", "n_lines", "n_dup_lines",
        F.length("joined").alias("word_chars"),
        F.length(F.regexp_replace("joined", NOT_SYMBOLS, "")).alias("n_symbols"),
        _windows(F.col("n_words"), F.col("hashes")).alias("grams"),
    )
    # (hash, position) in order; only texts in which some hash repeats need it.
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    four = three.withColumn(
        "placed", F.when(repeats, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ).drop("grams")
    same = lambda p, i: (p["h"] == F.get("placed", i - 1)["h"]) | (p["h"] == F.get("placed", i + 1)["h"])
    five = four.withColumn(
        "starts", F.sort_array(F.transform(F.filter("placed", lambda p, i: F.coalesce(same(p, i), F.lit(False))), lambda p: p["i"]))
    ).drop("placed")
    steps = F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda total, step: total + step)
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_stop_words", "n_lines")
    return five.select("row", *[long(F.col(c)).alias(c) for c in names], long(covered).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """True where every threshold holds; a ratio with denominator 0 counts as 0."""
    kept = F.lit(True)
    for t in thresholds:
        over, under = t.metric.split(" / ")
        value = F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under)), F.lit(0.0))
        if t.low is not None:
            kept = kept & (value >= t.low)
        if t.high is not None:
            kept = kept & (value <= t.high)
    return kept


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """Counts, base rule and verdict of every row.

    To keep rows by their verdict use `keep_good`, or write this table first: a filter put on it directly is pushed below
    the counts and makes the plan very large.
    """
    rows = counted(docs, key, text).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(thresholds)).withColumnRenamed("row", key)


def keep_good(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows that pass, all columns as they were."""
    # A filter would be pushed below the counts and every count written out again wherever it is used; one that
    # depends on the row's number stays above them.
    rows = counted(docs, text, text, keep=docs.columns).select(
        "row", (~base_failed() & verdict(thresholds)).alias("good"), F.monotonically_increasing_id().alias("number")
    )
    rows = rows.where(F.col("good") & (F.col("number") >= 0))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
