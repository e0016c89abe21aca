"""Market-text helpers: shouting, sentences, keyword buckets, digests and filing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The digest's sections in the order in which they are printed, and keywords of three of them, in the order
# in which they are tried; what has none belongs to the first section.
SECTIONS = ("thesis", "flows", "economics", "price")
BUCKETS = {
    "flows": (
        "bought", "sold", "buying", "selling", "flow", "flows", "positioning", "position", "hedge", "hedging", "inflow", "outflow",
        "demand", "offer", "bid", "real money", "hedge fund", "hf ", "corporates", "corp ",
    ),
    "economics": (
        "cpi", "inflation", "gdp", "rate decision", "hike", "cut", "policy rate", "unemployment", "payroll", "pmi", "retail sales", "central bank",
        "meeting", "data", "release", "forecast", "consensus", "expected",
    ),
    "price": ("closed", "close", "trading", "traded", "level", "resistance", "support", "high", "low", "spot", "range", "bps", "bp)", "%", "pips"),
}
#: Sentences that a section of a digest has at most, and what it says without any.
MOST, NOTHING = 5, "- Nothing filed."
EDGES = r"^[ \t\r]+|[ \t\r]+$"


def letters(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}]", "")


def shouty(x: Column) -> Column:
    """At least ten letters, over four fifths of them upper-case."""
    n = F.length(letters(x))
    return (n >= 10) & (F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) > 0.8 * n)


def sentences(df: DataFrame, text: str) -> DataFrame:
    """One row per sentence, with line and place: lines end after a stop before a capital or a brace; one with a bar stays whole.

    Currency marks in braces and a leading bullet are taken out.
    """
    lines = df.select("*", F.posexplode(F.split(text, "\n")).alias("line", "__line"))
    parts = F.when(F.col("__line").contains("|"), F.array("__line")).otherwise(F.split("__line", r"(?<=[.!?])[ \t]+(?=[A-Z{])"))
    rows = lines.select("*", F.posexplode(parts).alias("place", "__s")).drop("__line")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("__s", EDGES, ""), r"\{[A-Za-z^0-9]{1,3}\}", ""), "^[*\\-•][ \\t]*", "")
    return rows.withColumn("sentence", F.regexp_replace(bare, EDGES, "")).filter("sentence <> ''").drop("__s")


def bucket(sentence: Column) -> Column:
    """The first section of which the sentence holds a keyword, inside words too."""
    low = F.lower(sentence)
    found = None
    for name, words in BUCKETS.items():
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise(SECTIONS[0])


def digest(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, n_sentences and lines of every section of each key: its first different sentences, a line each."""
    s = sentences(df.select(key, text), text).groupBy(key, "sentence").agg(F.min(F.struct("line", "place")).alias("at"))
    s = s.withColumn("bucket", bucket(F.col("sentence")))
    n = F.row_number().over(W.partitionBy(key, "bucket").orderBy("at"))
    s = s.withColumn("n", n).groupBy(key, "bucket").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sort_array(F.collect_list(F.when(F.col("n") <= MOST, F.struct("n", F.concat(F.lit("- "), "sentence").alias("x"))))).alias("first"),
    )
    every = df.select(key).distinct().withColumn("bucket", F.explode(F.array(*map(F.lit, SECTIONS))))
    lines = F.array_join(F.transform("first", lambda r: r["x"]), "\n")
    return every.join(s, [key, "bucket"], "left").select(key, "bucket", F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"), F.coalesce(lines, F.lit(NOTHING)).alias("lines"))


def filed(submissions: DataFrame, closed: DataFrame, day: str, text: str, forced: Column) -> DataFrame:
    """Submissions that are not blank, with status and late: on a closed day only where it allows late ones, or if they are forced.

    `closed` has the day and allowed, one row for each closed day.
    """
    marks = closed.select(F.col(day).alias("__day"), F.col("allowed").alias("__allowed"))
    rows = submissions.filter(F.trim(text) != "").join(marks, F.col(day) == F.col("__day"), "left")
    late = F.col("__day").isNotNull()
    return rows.filter(~late | F.col("__allowed") | forced).withColumns({"status": F.when(late, "closed").otherwise("open"), "late": late}).drop("__day", "__allowed")
