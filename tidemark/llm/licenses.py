"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

With Spark SQL functions only.  Templates are texts, several for a licence: its short notices, its header and its full
text.  What is compared with them is each line of a file, each paragraph (lines without a blank one between them, so a
header may be wrapped anywhere; a line of comment marks alone is blank), and the file as a whole.  A unit's vector holds
the counts of its tokens times idf, where idf comes from the licences (a token that none has weighs as the rarest).  A
unit whose cosine to a template reaches `least` must share tokens that hold `least` squared of the template's squared
length (Cauchy-Schwarz).  So it has one of any tokens that hold the rest: units without any of the longest such words are
passed over by one pattern; it has as many of the template's tokens as it takes at least to hold that much; and tokens
that some template has hold `least` squared of its own squared length, however rarely the others are repeated.  Units
that fail one of these go before anything is exploded, and nothing is lost by it.

A file whose words are for `share` or more in units of one kind that reach it is a licence file, and so is one that has such
a unit and a name that says so (`NAMED`), as whole licences are longer than the parts of them that are templates.  Its
directory and all below have its licence, unless they have one that is nearer or the file has its own.  Of a directory's
licence files the one with the highest score counts, then the smallest licence name.  A phrase that stands in texts of any
licence (`WEAK`) names a file's licence only where nothing else does, and that of a directory
only if the file is a licence file by both its words and its name.

Defined results: a null text or one without such a unit has no licence of its own; a null path has no directory and
inherits nothing; equal (key, text) rows get the same result; the columns license, score, origin and origin_dir replace
those of these names; an empty table gives an empty result; no group holds a directory's files, only sums and maxima.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import cache, reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN = r"[^a-z0-9.\-]+|\.+(?![a-z0-9])|-+(?![a-z0-9])"
#: A blank line, or one of comment marks alone.
BLANK = r"\n[ \t\r#*/;%-]*\n"
LEAST, SHARE = 0.8, 0.1
#: Words of templates that any text has, and that are cues only where no others are enough.
COMMON = {"a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "other", "that", "the", "this", "to", "under", "with", "you", "your"}
#: Names of licence files, without their directory.
NAMED = r"(?i)^(licen[cs]es?|copying|copyright|notice|unlicense)([._-].*)?$"
#: Licences whose template stands in texts of others.
WEAK = ("Proprietary",)
ADDED = ("license", "score", "origin", "origin_dir")


@cache
def standard() -> dict[str, tuple[str, ...]]:
    """The templates beside this file, by SPDX name: parts of a file that ---- ends; and the tag line of each whose name is no plain word.

    A plain word (MIT is a German one) would make every line of that word alone a licence.
    """
    found = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        parts = [t.strip() for t in path.read_text().split("\n----\n")]
        found[path.stem] = (*parts, *([] if path.stem.isalpha() else [f"SPDX-License-Identifier: {path.stem}"]))
    return found


def tokens(text: str) -> list[str]:
    return [t for t in re.split(TOKEN, text.lower()) if t]


class Templates:
    """Weights of templates: idf by token, unit vectors by (licence, number), words of which a unit needs one, and tokens of which it needs so many."""

    def __init__(self, texts: Mapping[str, str | Sequence[str]], least: float = LEAST):
        texts = {k: (t,) if isinstance(t, str) else tuple(t) for k, t in texts.items()}
        counts = {(k, i): Counter(tokens(t)) for k, parts in texts.items() for i, t in enumerate(parts)}
        df = Counter(t for k, parts in texts.items() for t in set().union(*(tokens(p) for p in parts)))
        self.idf = {t: 1 + math.log((1 + len(texts)) / (1 + n)) for t, n in df.items()}
        self.rare = 1 + math.log(1 + len(texts))
        self.unit: dict[tuple[str, int], dict[str, float]] = {}
        cues: set[str] = set()
        self.needs: list[tuple[list[str], int]] = []
        for k, c in counts.items():
            v = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.unit[k] = {t: x / norm for t, x in v.items()}
            enough = (least * 0.999) ** 2
            rest = 1.0
            for t, x in sorted(self.unit[k].items(), key=lambda e: (e[0] in COMMON, e[0] not in cues, max(0, 6 - len(e[0])), -e[1], e[0])):
                if rest < enough:
                    break
                cues.add(t)
                rest -= x * x
            most, held = 0, 0.0
            for x in sorted(self.unit[k].values(), reverse=True):
                if held >= enough:
                    break
                most, held = most + 1, held + x * x
            self.needs.append((sorted(self.unit[k]), most))
        self.cues = sorted(cues)


def any_of(words: Sequence[str]) -> str:
    """A pattern for one of the words, which share their beginnings, so that a text is tried once at each place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    rest = by.pop("", None) is not None
    parts = [re.escape(c) + any_of(tails) for c, tails in sorted(by.items())]
    body = parts[0] if len(parts) == 1 and not rest else f"(?:{'|'.join(parts)})" if parts else ""
    return f"(?:{body})?" if rest and body else body


def line_tokens(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), TOKEN), lambda t: t != "")


def own(files: DataFrame, key: str, text: str, templates: Mapping[str, str | Sequence[str]] | None = None, least: float = LEAST) -> DataFrame:
    """key, text hash, licence, score and licence_words of each (key, text) that has a unit with a licence."""
    model = Templates(templates or standard(), least)
    spark = files.sparkSession
    cue = rf"(?s)(?<![a-z0-9]){any_of(model.cues)}(?![a-z0-9])"
    held = files.filter(F.lower(text).rlike(cue)).select(F.col(key).alias("__k"), F.xxhash64(text).alias("__t"), F.col(text).alias("__x"))
    paragraphs = F.split("__x", BLANK)
    many = F.size(paragraphs) > 1
    units = F.concat(
        F.transform(F.split("__x", "\n"), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("x"))),
        F.transform(F.filter(paragraphs, lambda x: x.contains("\n")), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("x"))),
        F.when(many, F.array(F.struct(F.lit(2).alias("kind"), F.col("__x").alias("x")))).otherwise(F.array().cast("array<struct<kind:int,x:string>>")),
    )
    found = (
        held.select("__k", "__t", F.posexplode(units).alias("__unit", "__u"))
        .select("__k", "__t", "__unit", F.col("__u.kind").alias("__kind"), F.col("__u.x").alias("__l"))
        .filter(F.lower("__l").rlike(cue))
    )
    unit = ["__k", "__t", "__unit", "__kind", "__n"]
    # As generated columns, tokens are made once for each unit, and not again for each condition on them.
    vocabulary = F.array(*map(F.lit, sorted(model.idf)))
    found = found.select("*", F.explode(F.array(line_tokens(F.col("__l")))).alias("__ts"))
    found = found.select("*", F.explode(F.array(F.array_intersect("__ts", vocabulary))).alias("__vs"))
    idf = F.create_map(*(F.lit(x) for e in model.idf.items() for x in e))
    own_part = F.aggregate("__vs", F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter("__ts", lambda t: t == v)) * idf[v], F.lit(2.0)))
    others = F.size(F.array_distinct("__ts")) - F.size("__vs")
    enough = (least * 0.999) ** 2
    found = found.filter((F.size("__vs") > 0) & (own_part * (1 - enough) >= enough * model.rare**2 * others))
    near = [F.size(F.array_intersect("__vs", F.array(*map(F.lit, words)))) >= most for words, most in model.needs]
    found = found.filter(reduce(or_, near)).withColumn("__n", F.regexp_count("__l", F.lit(r"[^\x20\x09-\x0D]+")))
    table = [(t, model.idf[t], [(k, i, u[t]) for (k, i), u in model.unit.items() if t in u]) for t in model.idf]
    weights = spark.createDataFrame(table, "__w string, __idf double, __by array<struct<k:string,i:int,u:double>>")
    counted = found.select(*unit, F.explode("__ts").alias("__w")).groupBy(*unit, "__w").agg(F.count(F.lit(1)).alias("__tf"))
    weighed = counted.join(F.broadcast(weights), "__w", "left").withColumn("__x", F.col("__tf") * F.coalesce("__idf", F.lit(model.rare)))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("__x") * F.col("__x"))).alias("__norm"), F.flatten(F.collect_list(F.transform("__by", lambda b: F.struct(b["k"].alias("k"), b["i"].alias("i"), (b["u"] * F.col("__x")).alias("d"))))).alias("__d"))
    cosines = norms.select(*unit, "__norm", F.explode("__d").alias("__e")).groupBy(*unit, F.col("__e.k").alias("license"), F.col("__e.i").alias("__i")).agg((F.sum("__e.d") / F.first("__norm")).alias("score"))
    # Scores are compared to six places, so that the order of summing decides nothing.
    ranked = F.struct(F.col("license").isin(*WEAK).alias("weak"), (-F.col("score")).alias("s"), F.col("license").alias("k"))
    best = cosines.withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6).filter(F.col("score") >= least).groupBy(*unit).agg(F.min(ranked).alias("__best"))
    kinds = best.groupBy("__k", "__t", "__kind").agg(F.min("__best").alias("__best"), F.sum("__n").alias("__n"))
    whole = kinds.groupBy("__k", "__t").agg(F.min("__best").alias("__best"), F.max("__n").alias("__words"))
    return whole.select("__k", "__t", F.col("__best.k").alias("__license"), (-F.col("__best.s")).alias("__score"), "__words")


def directory(path: Column) -> Column:
    """All before the last slash; null where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path", templates: Mapping[str, str | Sequence[str]] | None = None, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """Columns of files but the text, and license, score, origin (own, inherited or none) and origin_dir."""
    if {key, text, path} & {*ADDED}:
        raise ValueError(f"none of {', '.join(ADDED)} can name the key, the text or the path")
    files = files.drop(*ADDED)
    kept = [c for c in files.columns if c != text]
    found = own(files, key, text, templates, least).withColumnsRenamed({"__t": "__t2"})
    words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    marked = (
        files.select(*kept, F.xxhash64(text).alias("__t"), words.alias("__all"), directory(F.col(path)).alias("__dir"))
        .join(found, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__t") == F.col("__t2")), "left")
        .drop("__k", "__t", "__t2")
    )
    named, much = F.regexp_replace(path, "^.*/", "").rlike(NAMED), F.col("__words") >= share * F.col("__all")
    holds = (
        marked.filter("__license is not null and __dir is not null")
        .filter(F.when(F.col("__license").isin(*WEAK), named & much).otherwise(named | much))
        .groupBy("__dir")
        .agg(F.min(F.struct((-F.col("__score")).alias("s"), F.col("__license").alias("k"))).alias("__h"))
        .select(F.col("__dir").alias("__up"), F.col("__h.k").alias("k"), (-F.col("__h.s")).alias("s"))
    )
    # Every directory with all above it; the deepest of those that hold a licence is the nearest.
    parts = F.split("__dir", "/")
    above = (
        marked.select("__dir").filter("__dir is not null").distinct()
        .withColumn("__depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
        .withColumn("__up", F.array_join(F.slice(parts, F.lit(1), F.col("__depth")), "/"))
    )
    nearest = (
        above.join(holds, "__up")
        .groupBy(F.col("__dir").alias("__of"))
        .agg(F.max(F.struct("__depth", "__up", "k", "s")).alias("__near"))
    )
    out = marked.join(nearest, F.col("__dir") == F.col("__of"), "left")
    is_own, near = F.col("__license").isNotNull(), F.col("__near")
    return out.select(
        *kept,
        F.coalesce("__license", near["k"]).alias("license"),
        F.coalesce("__score", near["s"]).alias("score"),
        F.when(is_own, "own").when(near.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~is_own, near["__up"]).alias("origin_dir"),
    )
