"""Near-duplicate texts: b-bit MinHash signatures joined by multi-index Hamming search, links confirmed on full sets.

A signature has ``CHUNKS * WIDTH`` components of 16 bits.  Two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` components have, by pigeonhole, a chunk with at most ``ERRORS`` differing components.  Every
way of leaving out ``ERRORS`` components of a chunk is a key (chunk, left-out set, remaining components: 54 bits, exact), so
all pairs within that distance meet under an equal key.  At a similarity of 0.75 a pair that shares no key at all has a
probability of about 1e-7.

Only connected components are asked for, so a group of copies is never expanded into pairs:
1. texts with equal shingle sets count once (the smallest id stands for them);
2. under every key the members meet two centres (its smallest and its largest id): a linear number of pairs;
3. pairs that are close by size and by a 64-bit sketch are confirmed on full sets, and confirmed links are joined up;
4. keys whose members still belong to several components compare members of the other components with all members, so no
   pair across components goes untested.  Heavily edited copies would make this quadratic; but a shingle that no other member
   of these keys has lies in the union of any pair and in no intersection, so their numbers bound the similarity, and such
   copies fall out before the comparison.  What is left is compared by a finer signature of 512 components.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import release, spread, stage, texts
from .vocab import make_room

SHINGLE = 5
SIMILARITY_PERCENT = 75
CHUNKS, WIDTH, ERRORS = 12, 4, 1
#: Sketches of 64 one-bit minima differ in 8 places at a similarity of 0.75; 26 is seven standard deviations away.
SKETCH_BITS = 26
#: Longs of the fine signature.  Of its 1024 components 192 differ at a similarity of 0.75, with a deviation of 12.5; FINE_BITS
#: is seven standard deviations away, as for the sketch.
FINE, FINE_BITS = 32, 280
#: Bytes of shingle sets up to which they are broadcast.
BROADCAST_BYTES = 24 << 20
_PATTERNS = list(combinations(range(WIDTH), WIDTH - ERRORS))
_A = A.mix(np.arange(CHUNKS * WIDTH, dtype=A.U)) | A.U(1)
_B = A.mix(np.arange(CHUNKS * WIDTH, dtype=A.U) + A.U(1 << 20))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, one after the other, and their numbers."""
    h, first = A.words(data, offsets, lower=True)
    five = A.windows(h, SHINGLE, 5)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(five[a:b - SHINGLE + 1]))
        elif b > a:
            sets.append(A.mix(reduce(lambda x, y: A.mix(x ^ y), np.split(h[a:b], b - a)) ^ A.U(b - a)))
        else:
            sets.append(np.empty(0, A.U))
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def _signatures(batches):
    make_room()
    for batch in batches:
        for i, j, data, offsets in A.steps(batch, "text"):
            flat, n = shingle_sets(data, offsets)
            full = np.flatnonzero(n)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])[full].astype(np.int64)
            ends = starts + n[full]
            minima = np.zeros((len(full), len(_A)), A.U)
            with np.errstate(over="ignore"):
                for k in range(len(_A) if len(full) else 0):
                    minima[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
            spreaded = A.mix(minima)
            part = spreaded & A.U(0xFFFF)
            bits = np.zeros(len(full), A.U)
            for k in range(64):      # of 48 minima, 16 give a second bit
                bits |= ((spreaded[:, k % len(_A)] >> A.U(40 + k // len(_A))) & A.U(1)) << A.U(k)
            keys = np.empty((len(full), CHUNKS * len(_PATTERNS)), A.U)
            at = 0
            for c in range(CHUNKS):
                for p in _PATTERNS:
                    keys[:, at] = reduce(lambda x, w: (x << A.U(16)) | part[:, c * WIDTH + w], p, np.full(len(full), at, A.U))
                    at += 1
            ids = [None] * (j - i)
            one, two = A.mix(flat), A.mix(flat ^ A.U(0xABCDEF))
            key_lists, sketch = [None] * (j - i), [0] * (j - i)
            with np.errstate(over="ignore"):
                for r, d in enumerate(full.tolist()):
                    a, b = starts[r], ends[r]
                    ids[d] = np.array([one[a:b].sum(), two[a:b].sum()], A.U).tobytes()
                    key_lists[d], sketch[d] = A.signed(keys[r]), int(A.signed(bits[r:r + 1])[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], pa.array(n), pa.array(ids, pa.binary()), pa.array(sketch, pa.int64()),
                 pa.array(key_lists, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "sketch", "keys"])


def _shingle_rows(batches):
    make_room()
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in A.steps(batch, "text"):
            flat, n = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], n), pa.int64()), pa.array(A.signed(flat))], ["id", "shingle"])


def _fine_signatures(batches):
    """Minima of two bits each, 32 to a long."""
    make_room()
    a = A.mix(np.arange(32 * FINE, dtype=A.U) + A.U(7 << 20)) | A.U(1)
    b = A.mix(a)
    for batch in batches:
        for i, j, data, offsets in A.steps(batch, "text"):
            flat, n = shingle_sets(data, offsets)
            full = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            out = np.zeros((FINE, len(full)), A.U)
            with np.errstate(over="ignore"):
                for k in range(32 * FINE if len(full) else 0):
                    out[k // 32] |= (A.mix(np.minimum.reduceat(flat * a[k] + b[k], starts)) & A.U(3)) << A.U(2 * (k % 32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(full)), *(pa.array(A.signed(f)) for f in out)], ["id", *(f"f{k}" for k in range(FINE))])


def _sets(batches):
    make_room()
    for batch in batches:
        for i, j, data, offsets in A.steps(batch, "text"):
            flat, n = shingle_sets(data, offsets)
            cut = np.split(flat, np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array([s.tobytes() for s in cut], pa.binary())], ["doc_id", "members"])


def confirm(batches):
    make_room()
    for batch in batches:
        a, b = batch.column("members_a"), batch.column("members_b")
        keep = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), A.U), np.frombuffer(y.as_buffer(), A.U)
            both = np.concatenate([x, y])
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            keep.append(100 * same >= SIMILARITY_PERCENT * (len(x) + len(y) - same))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached over ``links`` (a, b).

    Rounds of contraction: every component takes its smallest neighbour, chains are shortened by doubling, and links are
    renamed, until none is left between different components.
    """
    edges = stage(links.select("a", "b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    label = stage(nodes.withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("up")))
        while True:
            higher = parent.select(F.col("x").alias("up"), F.col("up").alias("top"))
            shorter = stage(parent.join(higher, "up").select("x", F.col("top").alias("up")))
            moved = not parent.withColumnRenamed("up", "old").join(shorter, "x").where("old <> up").isEmpty()
            release(parent)
            parent = shorter
            if not moved:
                break
        old = (edges, label, parent)
        up = parent.select(F.col("x").alias("component"), "up")
        label = stage(label.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        edges = stage(edges.join(parent.select(F.col("x").alias("a"), F.col("up").alias("ua")), "a")
                      .join(parent.select(F.col("x").alias("b"), F.col("up").alias("ub")), "b")
                      .where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct())
        release(*old)
    release(edges)
    return label


def _close(rows: DataFrame) -> DataFrame:
    """Pairs of members that can still be similar by size and by sketch."""
    return (rows.where("a <> b").where(f"100 * least(n_a, n_b) >= {SIMILARITY_PERCENT} * greatest(n_a, n_b)")
            .where(f"bit_count(s_a ^ s_b) <= {SKETCH_BITS}")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = stage(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets, "doc_id long, members binary"))
    # many pairs among few documents: their sets go to all tasks if they are small, else pairs and sets are shuffled
    size = sets.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    held = F.broadcast(sets) if size <= BROADCAST_BYTES else sets
    both = (pairs.join(held.select(F.col("doc_id").alias("a"), F.col("members").alias("members_a")), "a")
            .join(held.select(F.col("doc_id").alias("b"), F.col("members").alias("members_b")), "b"))
    links = stage(both.mapInArrow(confirm, "a long, b long"))
    release(sets)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Null, empty or blank texts have no shingles and are linked with nothing.  Texts of one to four words have one shingle,
    the whole sequence.  Rows that share a doc_id count as one document, whose text is that of any of its equal rows (of
    differing texts the one with the smallest set fingerprint is compared); a row without doc_id is a component of its own
    (component_id null, kept true).  Extra columns are ignored; an empty table gives an empty result.
    """
    docs = texts(docs)
    sign = stage(spread(docs).mapInArrow(_signatures, "doc_id long, n_shingles long, set_id binary, sketch long, keys array<long>"))
    full = sign.where("doc_id IS NOT NULL AND n_shingles > 0")
    # one document per set: the smallest id stands for the others
    sets = stage(full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
    rep = full.join(sets.select("set_id", F.col("rep").alias("doc_id")), ["set_id", "doc_id"]).dropDuplicates(["doc_id", "set_id"])
    rows = stage(rep.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"), F.col("sketch").alias("s")))
    member = F.struct("id", "n", "s")
    ends = rows.groupBy("key").agg(F.min(member).alias("lo"), F.max(member).alias("hi")).where("lo.id < hi.id")
    shared = stage(rows.join(ends, "key"))
    release(rows)
    star = [shared.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"), F.col(f"{c}.id").alias("b"), F.col(f"{c}.n").alias("n_b"), F.col(f"{c}.s").alias("s_b"))
            for c in ("lo", "hi")]
    pairs = stage(_close(star[0].union(star[1])))
    links = _confirmed(pairs, docs)
    label = components(links)
    # keys that still join several components: the members outside the largest one meet all others
    named = (shared.select("key", "id", "n", "s").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
             .withColumn("component", F.coalesce("component", "id")))
    named = stage(named)
    release(shared)
    most = (named.groupBy("key", "component").agg(F.count("*").alias("c"))
            .groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
            .select("key", F.col("m.component").alias("main")))
    open_rows = stage(named.join(most, "key"))
    release(named)
    # shingles that one member of the open keys has alone
    members = docs.join(open_rows.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    alone = (members.mapInArrow(_shingle_rows, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m = 1")
             .groupBy("id").agg(F.count("*").cast("int").alias("u")))
    likely = stage(open_rows.join(alone, "id", "left").withColumn("u", F.coalesce("u", F.lit(0))).where(f"100 * (n - u) >= {SIMILARITY_PERCENT} * n"))
    close_up = stage(members.mapInArrow(_fine_signatures, "id long, " + ", ".join(f"f{k} long" for k in range(FINE))))
    fine = likely.join(close_up, "id").join(rep.select(F.col("doc_id").alias("id"), "keys").dropDuplicates(["id"]), "id")
    x = fine.where("component <> main").select("key", *[F.col(c).alias(a) for c, a in (("id", "a"), ("n", "n_a"), ("s", "s_a"), ("u", "u_a"), ("component", "c_a"))], *[F.col(f"f{k}").alias(f"x{k}") for k in range(FINE)], F.col("keys").alias("keys_a"))
    y = fine.select("key", *[F.col(c).alias(a) for c, a in (("id", "b"), ("n", "n_b"), ("s", "s_b"), ("u", "u_b"), ("component", "c_b"))], *[F.col(f"f{k}").alias(f"y{k}") for k in range(FINE)], F.col("keys").alias("keys_b"), "main")
    bound = f"100 * least(n_a - u_a, n_b - u_b) >= {SIMILARITY_PERCENT} * greatest(n_a + u_b, n_b + u_a)"
    # a pair under several keys is made under the smallest of them only
    apart = " + ".join(f"bit_count(((x{k} ^ y{k}) | shiftright(x{k} ^ y{k}, 1)) & 6148914691236517205L)" for k in range(FINE))
    rest = stage(_close(x.join(y, "key").where("c_a <> c_b AND (c_b = main OR a < b)").where(bound).where(f"{apart} <= {FINE_BITS}")
                        .where("array_min(array_intersect(keys_a, keys_b)) = key")).join(pairs, ["a", "b"], "left_anti"))
    more = _confirmed(rest, docs)
    release(open_rows, likely, close_up, rest, pairs, label)
    # all links, and from every document with a repeated set to the one that stands for it
    final = components(links.union(more))
    release(links, more)
    return (sign.select("doc_id", "n_shingles", "set_id")
            .join(sets.select("set_id", "rep"), "set_id", "left")
            .join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
