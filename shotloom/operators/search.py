"""Attribute search and vector search over a library of shots.

Queries are few and the library is large.  Queries are therefore bound into one scan of
the library as literals; a larger set of queries is served in several scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.maths import strings
from . import cells

QUERIES_PER_SCAN = 256
VECTORS_PER_SCAN = 1024


@dataclass(frozen=True)
class Criterion:
    attribute: str
    op: str                    # ==, prefix, >, <, flag
    value: object = True
    description: str = ""
    negated: bool = False

    def describe(self) -> str:
        return ("not " if self.negated else "") + self.description


@dataclass(frozen=True)
class Query:
    query_id: str
    criteria: Sequence[Criterion] = field(default_factory=tuple)
    sort_by: str | None = None
    sort_desc: bool = True
    limit: int = 10


def usable_shots(shots: DataFrame, include_brief: bool = True) -> DataFrame:
    """Drop rejected shots, and on request those for brief use.  A missing verdict is usable."""
    h = F.coalesce(F.col("handling"), F.lit(""))
    d = shots.filter(h != "reject")
    return d if include_brief else d.filter(h != "use_briefly")


def where(shots: DataFrame, predicate: Column) -> DataFrame:
    return shots.filter(predicate)


def passes(c: Criterion, types: dict[str, str]) -> Column:
    """Whether a row meets a criterion; a missing measure fails it and so meets its negation."""
    if c.attribute not in types:
        ok = F.lit(False)
    else:
        v, kind = F.col(c.attribute), types[c.attribute]
        text = v.cast("string")
        if c.op == "flag":
            ok = v if kind == "boolean" else (text != "") if kind == "string" else v > 0
        elif c.op == "==":
            ok = text == str(c.value)
        elif c.op == "prefix":
            ok = text.startswith(str(c.value))
        elif c.op == ">":
            ok = v.try_cast("double") > float(c.value)
        elif c.op == "<":
            ok = v.try_cast("double") < float(c.value)
        else:
            ok = F.lit(False)
        ok = F.coalesce(ok, F.lit(False))
    return ~ok if c.negated else ok


def _inert_expr(c: Criterion, types: dict[str, str]) -> Column:
    if c.op == "flag":
        return F.lit(False)
    if c.attribute not in types:
        return F.lit(True)
    text = F.col(c.attribute).cast("string")
    return F.coalesce(F.bool_and(F.coalesce(text, F.lit("unknown")) == "unknown"), F.lit(True))


def inert_criteria(shots: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """Criteria no usable shot was ever measured for: (query_id, criterion)."""
    types = dict(shots.dtypes)
    pool = usable_shots(shots)
    todo = [(q, c) for q in queries for c in q.criteria]
    flags = [F.struct(F.lit(q.query_id).alias("query_id"), F.lit(c.describe()).alias("criterion"), _inert_expr(c, types).alias("inert"))
             for q, c in todo]
    return pool.agg(F.array(*flags).alias("f")).select(F.inline("f")).filter("inert").select("query_id", "criterion")


def search(shots: DataFrame, queries: Sequence[Query], key: str = "shot_id") -> DataFrame:
    """Best shots per query by the share of criteria met, then by the wanted order.

    Shots meeting nothing are left out.  Every hit names what it met and what it missed.
    Ties follow ``key``.
    """
    out = None
    for at in range(0, len(queries), QUERIES_PER_SCAN):
        part = _search(shots, queries[at:at + QUERIES_PER_SCAN], key)
        out = part if out is None else out.unionByName(part)
    return out


def _tried(shots: DataFrame, queries: Sequence[Query], key: str, keep: Sequence[str] = (), inert: set | None = None) -> tuple[DataFrame, Column]:
    """Every shot that meets something of a query, with its score, and the queries' names as a constant."""
    types = dict(shots.dtypes)
    pool = usable_shots(shots)
    if inert is None:
        # One row of flags, as many as there are criteria in these queries.
        inert = {(r.query_id, r.criterion) for r in inert_criteria(shots, queries).collect()}
    # Per query only a number, a flag per criterion and the order value travel through the
    # ranking; names are looked up for the few rows that stay.
    tries, labels = [], []
    for i, q in enumerate(queries):
        live = [c for c in q.criteria if (q.query_id, c.describe()) not in inert]
        met = F.array(*[F.coalesce(passes(c, types), F.lit(False)) for c in live]).cast("array<boolean>")
        by = q.sort_by or "technical_quality"
        rank = F.coalesce(F.col(by).cast("double"), F.lit(0.0)) if by in types else F.lit(0.0)
        rank = rank if q.sort_by is None or q.sort_desc else -rank
        tries.append(F.struct(F.lit(i).alias("q"), met.alias("met"), F.lit(q.limit).alias("top"), rank.alias("order_value")))
        labels.append(F.struct(F.lit(q.query_id).alias("id"), strings(c.describe() for c in live).alias("names")))
    d = pool.select(key, *keep, F.explode(F.array(*tries)).alias("h")).select(key, *keep, "h.*")
    hits, of = F.size(F.filter("met", lambda m: m)), F.size("met")
    d = d.withColumn("score", F.when(of == 0, 1.0).otherwise(hits / of.cast("double"))).filter("score > 0")
    return d, F.array(*labels)


def matches(shots: DataFrame, queries: Sequence[Query], key: str = "shot_id", keep: Sequence[str] = (), inert: set | None = None) -> DataFrame:
    """(query_id, key, keep..., score, order_value) of every shot that meets something, not ranked and not cut.

    ``inert``: the (query_id, criterion) pairs of ``inert_criteria``, where they are known already.
    """
    out = None
    for at in range(0, len(queries), QUERIES_PER_SCAN):
        d, labels = _tried(shots, queries[at:at + QUERIES_PER_SCAN], key, keep, inert)
        part = d.select(F.get(labels, F.col("q"))["id"].alias("query_id"), key, *keep, "score", "order_value")
        out = part if out is None else out.unionByName(part)
    return out


def _search(shots: DataFrame, queries: Sequence[Query], key: str) -> DataFrame:
    d, labels = _tried(shots, queries, key)
    w = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("order_value").desc(), F.col(key))
    most = max(q.limit for q in queries)
    d = d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).filter(F.col("rank") <= F.col("top"))
    d = d.withColumn("_l", F.get(labels, F.col("q")))

    def named(hit):
        return F.filter(F.col("_l.names"), lambda n, b: F.get("met", b) == hit)

    return d.select(F.col("_l.id").alias("query_id"), "rank", key, "score", "order_value", named(True).alias("matched"), named(False).alias("unmet"))


def bind(criteria: DataFrame, sorts: DataFrame | None = None, per_scan: int = QUERIES_PER_SCAN) -> Iterator[list[Query]]:
    """Parsed queries (long criteria table) as groups of at most ``per_scan`` bound queries."""
    total = criteria.select("query_id").distinct().count()
    groups = max(1, -(-total // per_scan))
    for g in range(groups):
        pick = F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g
        rows = criteria.filter(pick).orderBy("query_id", "ord").collect()
        order = {} if sorts is None else {r.query_id: r for r in sorts.filter(pick).collect()}
        by_id: dict[str, list] = {}
        for r in rows:
            by_id.setdefault(r.query_id, []).append(Criterion(r.attribute, r.op, r.value, r.description, r.negated))
        yield [Query(str(k), tuple(v), getattr(order.get(k), "sort_by", None), getattr(order.get(k), "sort_desc", True)) for k, v in by_id.items()]


def _query_groups(queries: DataFrame, vec: str, per_scan: int) -> Iterator[tuple[list, np.ndarray, list]]:
    n = queries.count()
    groups = max(1, -(-n // per_scan))
    for g in range(groups):
        d = queries if groups == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        rows = d.orderBy("query_id").collect()
        if rows:
            yield [r["query_id"] for r in rows], np.asarray([r["vector"] for r in rows], float), [r["exclude"] for r in rows]


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding",
                normalize_stored: bool = False, per_scan: int = VECTORS_PER_SCAN) -> DataFrame:
    """The ``k`` stored vectors with the largest dot product with each normalised query, by one scan per group of queries.

    For few queries and a library that is searched once; ``cells`` keeps an index for many.  ``queries`` has (query_id,
    vector, exclude), exclude being one key to skip or null.  A bounded group of query vectors travels to the scan; a task
    keeps the best ``k`` of each query over all its batches.  Similarities are compared at nine decimals, ties by key.
    """
    types = dict(vectors.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, {key} {types[key]}, similarity double"
    src = vectors.filter(F.col(vec).isNotNull()).select(key, vec)
    out = None
    for ids, mat, skip in _query_groups(cells.prepare(queries, vec), vec, per_scan):

        def best(batches, ids=ids, mat=mat, skip=skip):
            held = cells._Best(k)
            for pdf in batches:
                if len(pdf):
                    m = cells._matrix(pdf[vec])
                    cells.score_group(held, cells._unit(m) if normalize_stored else m, pdf[key].to_numpy(), ids, mat, skip)
            if held.found:
                yield held.rows(key)

        part = src.mapInPandas(best, schema)
        out = part if out is None else out.unionByName(part)
    return cells.top(out, k, key)


def find_similar(vectors: DataFrame, ids: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding", index: cells.Index | None = None) -> DataFrame:
    """Nearest stored vectors of the stored vectors named in ``ids``, themselves left out.

    With an ``index`` any number of them; without, by scans, which suit a few.
    """
    q = vectors.join(ids, key, "left_semi").select(F.col(key).alias("query_id"), vec, F.col(key).alias("exclude"))
    return vector_topk(vectors, q, k, key, vec) if index is None else cells.search(index, q, k, key, vec)[0]


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "shot_id",
                    vec: str = "semantic_embedding", index: cells.Index | None = None) -> DataFrame:
    """Cosine search over externally computed vectors; refuses a library without any."""
    return cells.search(index or cells.build(vectors, key, vec, unit=True), queries, k, key, vec)[0]


def recall_at_k(results: DataFrame, truth: DataFrame, key: str = "shot_id", enough: float = 0.5) -> DataFrame:
    """Share of the expected keys each query returned, and whether it is enough."""
    hit = results.select("query_id", key).distinct().withColumn("_hit", F.lit(1.0))
    d = truth.select("query_id", key).distinct().join(hit, ["query_id", key], "left")
    r = d.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
    return r.withColumn("passed", F.col("recall") >= enough)


def negation_leaks(positive: DataFrame, negative: DataFrame, key: str = "shot_id") -> DataFrame:
    """Keys that both a query and its negation returned; must be empty."""
    return positive.select(key).intersect(negative.select(key))
