"""Exact vector search over cells.

A coarse quantiser is fitted on a bounded sample (``SAMPLE``), every vector is assigned to its nearest centre, and the vectors of
a cell are stored in packed blocks of ``ROWS``.  A query first looks into the cells whose centres are most like it, which fixes a
floor for its k-th best similarity.  No vector of a cell can be more like a unit query q than ``q . centre + radius``, so cells
under the floor are left out and the answer stays that of a full scan.

The driver holds centres, sizes and radii of at most ``MOST_CELLS`` cells.  Hot cells are dealt into parts of bounded size, and
queries meet a part in groups, so a product never has more than ``ROWS x GROUP`` numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import stage

SAMPLE = 16_384         # vectors that the centres are fitted on, those with the smallest hashes of their keys
MOST_CELLS = 1024
ROUNDS = 6              # of moving centres to the mean of their vectors
ROWS = 1024             # vectors per stored block
PART_ROWS = 16_384      # vectors of a cell per part
GROUP = 256             # queries that meet a part together, on average
HELD = 100_000          # queries whose best hits a task keeps before it passes them on
SLACK = 1e-8            # similarities are compared at nine decimals

c = F.col


@dataclass(frozen=True)
class Index:
    """Cells of a library: packed blocks (cell, part, names, data) and what the driver knows of each cell."""

    blocks: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    unit: bool          # stored vectors were brought to length one


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n == 0, 1.0, n)[:, None]


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _nearest(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.argmin((centres * centres).sum(1)[None, :] - 2 * m @ centres.T, axis=1)
    return near, np.linalg.norm(m - centres[near], axis=1)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows of the sample; a centre without vectors stays where it is."""
    centres = np.unique(sample[np.linspace(0, len(sample) - 1, cells).astype(int)], axis=0)
    for _ in range(rounds):
        near, _ = _nearest(sample, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", unit: bool = False, cells: int | None = None,
          sample: int = SAMPLE, part_rows: int = PART_ROWS) -> Index:
    """Assign every vector to a cell.  Rows without a vector are left out; ``unit`` stores vectors at length one."""
    types = dict(vectors.dtypes)
    src = vectors.filter(c(vec).isNotNull()).select(key, vec)
    picked = src.orderBy(F.xxhash64(key), key).limit(sample).toPandas()
    if not len(picked):
        raise ValueError("no vectors to search; compute them first")
    fitted = _matrix(picked[vec])
    fitted = _unit(fitted) if unit else fitted
    count = src.count()
    centres = fit_centres(fitted, int(min(MOST_CELLS, len(fitted), cells or max(1, round(count ** 0.5)))))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf[vec])
                m = _unit(m) if unit else m
                near, far = _nearest(m, centres)
                yield pd.DataFrame({key: pdf[key], "cell": near.astype(np.int32), "far": far, "data": [x.tobytes() for x in m]})

    placed = stage(src.mapInPandas(assign, f"{key} {types[key]}, cell int, far double, data binary"))
    n, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        n[r["cell"]], radius[r["cell"]] = r["n"], r["far"] * (1 + 1e-12) + 1e-12
    parts = np.maximum(1, -(-n // part_rows))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64(key, "data"), F.get(F.lit(parts.tolist()), c("cell"))).cast("int"))

    def pack(batches):
        for at, names, rows in _runs(batches, ["cell", "part"], key, "data", ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                                              pa.array([b"".join(rows.to_pylist())], pa.binary())], ["cell", "part", "names", "data"])

    blocks = (dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", key).select("cell", "part", key, "data")
                   .mapInArrow(pack, f"cell int, part int, names array<{types[key]}>, data binary"))
    return Index(stage(blocks), centres, n, radius, parts, unit)


def _runs(batches, by: list[str], names: str, data: str, most: int):
    """Rows sorted by ``by``, as pieces of at most ``most`` rows of one value of it."""
    now, held, size = None, [], 0
    for batch in batches:
        codes = np.stack([batch.column(b).to_numpy() for b in by], axis=1)
        cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist(), len(codes)]
        for lo, hi in zip(cuts, cuts[1:]):
            while lo < hi:
                at = tuple(codes[lo].tolist())
                if held and (at != now or size == most):
                    yield now, _joined(held, names), _joined(held, data)
                    held, size = [], 0
                now, take = at, min(hi - lo, most - size)
                held.append(batch.slice(lo, take))
                size, lo = size + take, lo + take
    if held:
        yield now, _joined(held, names), _joined(held, data)


def _joined(held: list, name: str) -> pa.Array:
    return pa.concat_arrays([b.column(name) for b in held])


class _Best:
    """The best ``k`` hits of many queries, over all batches that a task sees."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query, sims: np.ndarray, names: np.ndarray) -> None:
        if query in self.found:
            s, n = self.found[query]
            if len(s) == self.k and len(sims) and sims.max() < s[-1]:
                return
            sims, names = np.concatenate([s, sims]), np.concatenate([n, names])
        if len(sims) > self.k:
            edge = np.partition(sims, len(sims) - self.k)[len(sims) - self.k]
            sims, names = sims[sims >= edge], names[sims >= edge]
        first = np.lexsort((names, -sims))[:self.k]
        self.found[query] = sims[first], names[first]

    def rows(self, key: str) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.repeat(list(self.found), [len(s) for s, _ in self.found.values()]),
                            key: np.concatenate([n for _, n in self.found.values()]), "similarity": np.concatenate([s for s, _ in self.found.values()])})
        self.found = {}
        return out


def score_group(best: _Best, data: np.ndarray, names: np.ndarray, queries, mat: np.ndarray, skip) -> None:
    """Similarities of a block of vectors to a group of queries, at nine decimals, without a query's excluded key."""
    sims = np.round(data @ mat.T, 9) + 0.0
    for j, (query, no) in enumerate(zip(queries, skip)):
        s = sims[:, j]
        if no is not None and no == no:
            ok = names != no
            best.add(query, s[ok], names[ok])
        else:
            best.add(query, s, names)


def _hits(index: Index, visits: DataFrame, n_queries: int, k: int, key: str, types: dict) -> DataFrame:
    """Best hits of every query in the cells that it visits: (query_id, cell, vector, exclude) against the stored blocks."""
    groups = max(1, -(-n_queries // GROUP))
    each = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(F.lit(index.parts.tolist()), c("cell")).cast("int") - 1)))
    bound = each.groupBy("cell", "part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).agg(F.collect_list(F.struct("query_id", "exclude", "vector")).alias("qs"))
    # queries times visited cells grow past any broadcast, which would pass through the driver
    meet = index.blocks.join(bound.hint("merge"), ["cell", "part"]).select("names", "data", c("qs.query_id").alias("ids"), c("qs.exclude").alias("skip"), c("qs.vector").alias("vectors"))
    width = index.centres.shape[1]

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for names, data, ids, skip, vectors in zip(*(batch.column(x) for x in ("names", "data", "ids", "skip", "vectors"))):
                flat = vectors.values.flatten() if isinstance(vectors.values, pa.ListArray) else vectors.values
                score_group(best, np.frombuffer(data.as_buffer(), float).reshape(-1, width), np.asarray(names.values.to_pylist()), ids.as_py(),
                            flat.to_numpy(zero_copy_only=False).reshape(-1, width), skip.as_py())
            if len(best.found) >= HELD:
                yield pa.RecordBatch.from_pandas(best.rows(key), preserve_index=False)
        if best.found:
            yield pa.RecordBatch.from_pandas(best.rows(key), preserve_index=False)
    return meet.mapInArrow(run, f"query_id {types['query_id']}, {key} {types[key]}, similarity double")


def top(hits: DataFrame, k: int, key: str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(c("similarity").desc(), c(key))
    return hits.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)


def plan_visits(index: Index, q: DataFrame, k: int, types: dict, floors: DataFrame | None = None) -> DataFrame:
    """(query_id, cell, vector, exclude): without ``floors`` the cells most like a query, enough for ``k`` hits; with ``floors``
    (query_id, floor) every other cell that can hold a hit of at least that similarity."""
    centres, sizes, radii = index.centres, index.sizes, index.radii
    d, only_first = q if floors is None else q.join(floors, "query_id", "left"), floors is None

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            m = _matrix(pdf["vector"])
            like = m @ centres.T
            order = np.argsort(-like, axis=1, kind="stable")
            got = np.cumsum(sizes[order], axis=1)
            first = np.zeros(like.shape, bool)
            # one hit more than asked for, as one may be excluded
            np.put_along_axis(first, order, np.concatenate([np.zeros((len(m), 1)), got[:, :-1]], axis=1) < k + 1, axis=1)
            if only_first:
                go = first
            else:
                floor = np.nan_to_num(pdf["floor"].to_numpy(float), nan=-np.inf)
                go = ~first & (like + radii[None, :] + SLACK >= floor[:, None])
            row, cell = np.nonzero(go & (sizes > 0)[None, :])
            if len(row):
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[row], "cell": cell.astype(np.int32), "vector": list(m[row]), "exclude": pdf["exclude"].to_numpy()[row]})
    return d.mapInPandas(run, f"query_id {types['query_id']}, cell int, vector array<double>, exclude {types['exclude']}")


def prepare(queries: DataFrame, vec: str) -> DataFrame:
    """Queries (query_id, vector, exclude) at length one; rows without a vector are left out."""
    v = c(vec).cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return queries.filter(c(vec).isNotNull()).select("query_id", F.when(length == 0, v).otherwise(F.transform(v, lambda x: x / length)).alias("vector"), "exclude")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The ``k`` stored vectors most like each query, ranked, ties by key; and per query what was visited.

    ``queries`` has (query_id, vector, exclude); its number is not bounded.  The second table has query_id, cells_visited,
    cells_total, vectors_visited, vectors_total.
    """
    spark = queries.sparkSession
    q = stage(prepare(queries, vec))
    types = {**dict(q.dtypes), **{key: dict(index.blocks.dtypes)["names"][6:-1]}}
    n = q.count()
    near = stage(plan_visits(index, q, k, types))
    first = stage(top(_hits(index, near, n, k, key, types), k, key))
    floors = first.filter(c("rank") == k).select("query_id", c("similarity").alias("floor"))
    others = stage(plan_visits(index, q, k, types, floors))
    hits = top(first.drop("rank").unionByName(_hits(index, others, n, k, key, types)), k, key)
    sizes = F.get(F.lit(index.sizes.tolist()), c("cell"))
    seen = near.unionByName(others).groupBy("query_id").agg(F.count("*").alias("cells_visited"), F.sum(sizes).alias("vectors_visited"))
    seen = q.select("query_id").join(seen, "query_id", "left").select(
        "query_id", F.coalesce("cells_visited", F.lit(0)).alias("cells_visited"), F.lit(int((index.sizes > 0).sum())).cast("long").alias("cells_total"),
        F.coalesce("vectors_visited", F.lit(0)).alias("vectors_visited"), F.lit(int(index.sizes.sum())).cast("long").alias("vectors_total"))
    return hits, seen


def save(index: Index, folder: str) -> None:
    """Write an index to a folder of its own, cells last: a folder without ``cells`` is a build that did not end."""
    index.blocks.write.parquet(f"{folder}/blocks")
    spark = index.blocks.sparkSession
    rows = [(k, m.tolist(), int(n), float(r), int(p), index.unit) for k, (m, n, r, p) in enumerate(zip(index.centres, index.sizes, index.radii, index.parts))]
    spark.createDataFrame(rows, "cell int, centre array<double>, n long, radius double, parts int, unit boolean").coalesce(1).write.parquet(f"{folder}/cells")


def load(spark: SparkSession, folder: str) -> Index:
    rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    take = lambda name, kind: np.array([r[name] for r in rows], kind)
    return Index(spark.read.parquet(f"{folder}/blocks"), take("centre", float), take("n", np.int64), take("radius", float), take("parts", np.int64), rows[0]["unit"])
