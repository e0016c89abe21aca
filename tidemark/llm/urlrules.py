"""URL rules: each rule is filed under its rarest literal token, and a URL runs only the rules its own tokens fetch.

A rule is (verdict, host, path).  It fits its host and every subdomain of it, when the URL's path starts with the rule's
path; of the rules that fit, the longest one wins.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and gets the default verdict;
repeated rows are judged alike; an empty table gives an empty result; other columns are kept, whatever their names, but
those that are added replace columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens of a URL and of a rule: runs of what is neither a separator of hosts nor one of paths.
SEPARATORS = r"[./_\-]+"
#: A rule book of at most so many rules goes into the plan as a literal map; a larger one is a table that is joined.
INLINE_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """For `host + path` of a URL."""
        return "^(?:[^/]*\\.)?" + re.escape(self.host) + re.escape(self.path)

    def tokens(self) -> list[str]:
        """Literal tokens that a fitting URL is sure to hold whole: of the path, those that a separator ends."""
        whole = self.host + self.path
        parts = [p for p in re.split(SEPARATORS, whole) if p]
        if parts and self.path and not re.search(SEPARATORS + "$", whole):
            parts = parts[:-1]
        return parts


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def token_counts(df: DataFrame, address: str, tokens: Sequence[str]) -> dict[str, int]:
    """How many URLs hold each token of the rules; as many rows come back as there are such tokens."""
    held = F.array_intersect(F.split(F.col(address), SEPARATORS), F.array(*map(F.lit, tokens)))
    return dict(df.select(F.explode(held).alias("token")).groupBy("token").count().collect())


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """Adds host, path, rule and verdict; columns of these names are replaced."""
    df = df.drop("host", "path", "rule", "verdict")
    host, path = parts(F.col(url))
    df = df.withColumn("host", host).withColumn("path", path)
    if not rules:
        return df.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    address = F.concat("host", "path")
    every = sorted({t for r in rules for t in r.tokens()})
    counts = Counter(token_counts(df.select(address.alias("__a")), "__a", every)) if every else Counter()
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens(), key=lambda t: (counts[t], -len(t), t), default=""), []).append(r)
    tokens = F.array_union(F.array_distinct(F.split(address, SEPARATORS)), F.array(F.lit("")))
    if len(rules) <= inline:
        rule = lambda r: F.struct(*(F.lit(v).alias(k) for k, v in (("size", len(r.name)), ("rule", r.name), ("verdict", r.verdict), ("pattern", r.pattern))))
        index = F.create_map(*(x for t, rs in filed.items() for x in (F.lit(t), F.array(*map(rule, rs)))))
        nothing = F.array().cast("array<struct<size:int,rule:string,verdict:string,pattern:string>>")
        fetched = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), nothing)))
        best = F.array_max(F.filter(fetched, lambda r: F.regexp_like(address, r["pattern"])))
        found = df.withColumn("__best", best)
    else:
        keep, own = df.columns, "__"
        # The book's columns have names that no column of the table begins with.
        while any(c.startswith(own) for c in keep):
            own += "_"
        book = df.sparkSession.createDataFrame(
            [(t, len(r.name), r.name, r.verdict, r.pattern) for t, rs in filed.items() for r in rs],
            ", ".join(f"{own}{c}" for c in ("token string", "size int", "rule string", "verdict string", "pattern string")),
        )
        best = F.struct(*(F.col(own + c).alias(c) for c in ("size", "rule", "verdict", "pattern")))
        key = df.withColumn(own + "row", F.struct(F.monotonically_increasing_id(), F.spark_partition_id()))
        hits = key.select(*keep, own + "row", F.explode(tokens).alias(own + "token"), address.alias(own + "at")).join(book, own + "token", "left")
        fits = F.when(F.regexp_like(own + "at", F.col(own + "pattern")), best)
        found = hits.groupBy(own + "row").agg(*(F.first(c).alias(c) for c in keep), F.max(fits).alias("__best")).drop(own + "row")
    return (
        found.withColumn("rule", F.col("__best.rule"))
        .withColumn("verdict", F.coalesce("__best.verdict", F.lit(default)))
        .drop("__best")
    )
