"""Quality rules with thresholds that each language and source sets for itself.

Every document gets base measures.  For those that pass the base rules, each measure becomes a rate in thousandths, and its
distribution per (lang, source) is held as a mergeable quantile sketch: counts over a log-linear grid of whole numbers (exact
up to 127, then 64 steps for every doubling, a relative error below 1/64).  Such sketches add up, over tasks as well as over
sources, so a group with few documents takes the sketch of its language, and a small language that of all.  The counts have
partial sums before the shuffle, whatever share of the rows one source holds.

A measure rejects a document outside Tukey's far fences, Q1 - 3 IQR and Q3 + 3 IQR, and at the same time further from the
quartile than a fixed slack, without which a group of equal values would reject the slightest deviation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stage

SYMBOLS = "#*$%&|<>"
MARKS = "!?;:|/\\{}[]=+@^~_"
MIN_WORDS = 50
#: Documents from which on a group's own quartiles are used.
OWN_GROUP = 200
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rate in thousandths; ``low`` and ``high`` are the slacks below Q1 and above Q3 (None: that side rejects nothing)."""
    name: str
    top: str
    bottom: str
    low: int | None
    high: int | None


RULES = (Rule("symbols", "n_symbols", "n_words", None, 200), Rule("dup_lines", "n_dup_lines", "n_lines", None, 550), Rule("repeats", "n_repeat_words", "n_words", None, 450),
         Rule("word_length", "word_chars", "n_words", 2000, 3000), Rule("capitals", "n_capitals", "word_chars", None, 300), Rule("marks", "n_marks", "n_words", None, 700))
_COUNTS = (*BASE, "n_lines", "n_capitals", "n_marks")
_BLANK = " \t\n\v\f\r"


def _repeat_words(w: list[bytes]) -> int:
    if len(w) < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in w], np.int64)
    two = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
    three, at, count = np.unique(two[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(len(w), bool)
    often = np.flatnonzero(count[at] > 1)
    for k in range(3):
        hit[often + k] = True
    return int(hit.sum())


def measures(text: str) -> tuple[int, ...]:
    """The counts of ``_COUNTS`` for one text."""
    w = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    ink = len(text) - sum(map(text.count, _BLANK))
    capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (len(w), ink, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(w), len(lines), capitals, sum(map(text.count, MARKS)))


def _measured(batches):
    for batch in batches:
        got = np.array([measures(t or "") for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(_COUNTS))
        cols = [batch.column(i) for i in range(3)] + [pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", *_COUNTS])


def _bucket(v: Column) -> Column:
    """Lower end of the grid step that holds the whole number ``v``."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    power = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return v - v % power


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Q1 and Q3 of every sketch (rows of keys, rule, bucket, n): the first steps that reach a quarter and three quarters."""
    order = Window.partitionBy(*keys, "rule").orderBy("bucket")
    all_of = Window.partitionBy(*keys, "rule")
    run = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(all_of))
    return run.groupBy(*keys, "rule").agg(F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
                                          F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"), F.max("total").alias("total"))


def _fences(q: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: an array of (lowest, highest) in the order of RULES."""
    low = F.coalesce(*[F.when(F.col("rule") == i, F.col("q1") - F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(r.low))) for i, r in enumerate(RULES) if r.low is not None])
    high = F.coalesce(*[F.when(F.col("rule") == i, F.col("q3") + F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(r.high))) for i, r in enumerate(RULES) if r.high is not None])
    rows = q.select(*keys, "rule", "total", low.alias("lo"), high.alias("hi"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rule", "lo", "hi"))).alias("fence"), F.max("total").alias("total"))


def rated(docs: DataFrame) -> DataFrame:
    """Base measures and the verdict on the base rules, one row per document."""
    cols = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))).select("doc_id", "lang", "source", "text")
    m = cols.mapInArrow(_measured, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return m.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and the names of the rules that rejected: one row per input row.

    A null text has no words and fails the base rules.  A null lang or source is a group like any other.  Repeated rows count as
    often as they occur.  A group without documents that pass the base rules sets no thresholds; its language or all
    documents do.  Extra columns are ignored; an empty table gives an empty result.
    """
    m = stage(rated(docs))
    rates = [F.floor(F.col(r.top) * 1000 / F.col(r.bottom)) for r in RULES]
    good = m.where("NOT base_failed").select("lang", "source", F.posexplode(F.array(*rates)).alias("rule", "rate"))
    sketch = stage(good.groupBy("lang", "source", "rule", _bucket(F.col("rate")).alias("bucket")).agg(F.count("*").alias("n")))
    by_lang = sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    own = _fences(_quartiles(sketch, ["lang", "source"]), ["lang", "source"]).where(f"total >= {OWN_GROUP}")
    lang = _fences(_quartiles(by_lang, ["lang"]), ["lang"]).where(f"total >= {OWN_GROUP}")
    top = _fences(_quartiles(whole, ["one"]), ["one"])
    groups = sketch.select("lang", "source").distinct().withColumn("one", F.lit(1)).alias("g")
    fences = stage(groups.join(own.select(F.col("lang").alias("l1"), F.col("source").alias("s1"), F.col("fence").alias("f1")), F.expr("lang <=> l1 AND source <=> s1"), "left")
                   .join(lang.select(F.col("lang").alias("l2"), F.col("fence").alias("f2")), F.expr("lang <=> l2"), "left")
                   .join(top.select("one", F.col("fence").alias("f3")), "one", "left")
                   .select(F.col("lang").alias("gl"), F.col("source").alias("gs"), F.coalesce("f1", "f2", "f3").alias("fence")))
    joined = m.join(fences, F.expr("lang <=> gl AND source <=> gs"), "left")
    broken = F.array_compact(F.array(*[F.when((rates[i] < F.col("fence")[i]["lo"]) | (rates[i] > F.col("fence")[i]["hi"]), F.lit(r.name)) for i, r in enumerate(RULES)]))
    return (joined.withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken))
            .select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by"))
