"""How five filters take work from each other, over all 120 orders in which they can run.

A document is reduced to the set of filters that it fails, and documents to counts per part and set: everything after the
first aggregation works on at most 32 rows per part.  In the orders sorted by their letters (rank = Lehmer code), the orders
that start with given letters are an interval of ranks.  A set is removed at step k by exactly those orders whose first
k - 1 letters are outside the set and whose k-th is inside; so each set adds its count at the first rank of some intervals
and takes it off after their last.  Running sums over the ranks then give what every step of every order removes.

Nulls: a null text is empty, a null lang the part of the empty string; a row without doc_id has no smaller and no larger
one, so it is never a copy of an earlier text.  Equal doc_ids are not smaller than each other.  A document labelled more than
once is good or toxic if any of its labels says so; labels without doc_id label nothing.  An empty table has no parts and gives
no rows.  Only doc_id, text and lang are read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPACE = r"[\x20\x09-\x0D]+"
#: Failure conditions over words and text; E, the copy of an earlier text, follows from the table.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, r"[#$%&*|]"


def lehmer_rank(order: str) -> int:
    """Place of a permutation of the filters among all, sorted by letters."""
    rank, rest = 0, sorted(FILTERS)
    for c in order:
        k = rest.index(c)
        rest.pop(k)
        rank += k * factorial(len(rest))
    return rank


def intervals(spark: SparkSession) -> DataFrame:
    """mask, step, lo, hi: the orders of rank lo <= r < hi remove a document with this mask at this step."""
    rows = []
    for step in range(1, len(FILTERS) + 1):
        for head in permutations(FILTERS, step):
            lo = lehmer_rank("".join([*head, *sorted(set(FILTERS) - set(head))]))
            bits = [1 << FILTERS.index(c) for c in head]
            rows += [(m, step, lo, lo + factorial(len(FILTERS) - step)) for m in range(1, 1 << len(FILTERS)) if m & bits[-1] and not m & sum(bits[:-1])]
    return spark.createDataFrame(rows, "mask int, step int, lo int, hi int")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit 0 for A to bit 4 for E), n, good, toxic: counts of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = base.select("doc_id", "part", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    n = F.size("words")
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n,
             100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("text"), F.col("text").rlike(MARKS)]
    own = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = split.select("doc_id", "part", F.sha2("text", 256).alias("digest"), own.cast("int").alias("own")).groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    # copies are counted before they meet: per text only the smallest id and the rows under it are told apart
    texts = rows.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    first = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("kept", F.col("no_id") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    ways = F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    each = texts.select("part", "good", "toxic", ways.alias("w")).select("part", "good", "toxic", "w.mask", "w.n").where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = masks(docs, labels)
    steps = counts.join(F.broadcast(intervals(docs.sparkSession)), "mask")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign"))))
    what = ["n", "good", "toxic"]
    change = steps.withColumn("end", ends).groupBy("part", "step", F.col("end.rank").alias("rank")).agg(*[F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in what])
    own = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("n")).otherwise(0)).alias(f"fails{k}") for k in range(len(FILTERS))]
    only = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)).alias(f"only{k}") for k in range(len(FILTERS))]
    parts = counts.groupBy("part").agg(F.sum("n").alias("all"), *own, *only)
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    order = F.array(*[F.lit(o) for o in ORDERS])[F.col("rank")]
    grid = grid.join(change, ["part", "step", "rank"], "left").withColumn("filter_order", order).withColumn("letter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    along = Window.partitionBy("part", "step").orderBy("rank")
    sums = grid.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(along) for c in what})
    at = F.ascii("letter") - ord(FILTERS[0])
    pick = lambda stem: F.array(*[F.col(f"{stem}{k}") for k in range(len(FILTERS))])[at]
    return sums.select(
        "part", "filter_order", "step", (F.col("all") - F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step"))).alias("kept"), F.col("n").alias("removed"),
        (pick("fails") - F.col("n")).alias("redundant"), pick("only").alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))
