"""Token ids in grammar-compressed shards (Re-Pair) with random access by document.

Documents go to ranges of doc_id; each task writes its range, sorted, as shards of about ``SHARD_IDS`` ids.  A shard replaces
frequent pairs of neighbouring ids by nonterminals, round after round, until no pair is left that pays for its rule; pairs never
reach over the end of a document, so a document is a slice of the compressed sequence and can be expanded alone.

Layout of a shard (little-endian): 8 bytes ``RPAIR001``; unsigned 32-bit: size of the vocabulary V, rules R, documents D,
symbols S; then R rules as two 32-bit symbols (rule r is symbol V + r and refers to smaller symbols only), R expansion
lengths (32-bit), D + 1 offsets of the documents in the symbols (64-bit), D + 1 offsets in ids (64-bit), and the S symbols
as 16-bit integers, or 32-bit ones where V + R exceeds 65,536.  Shards are rows of a Parquet table
(shard, base, n_ids, docs, data), written by Spark's committer, so that lost tasks leave no half-written files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .bpe_codec import TOKENIZER, Codec
from .common import release, stage, texts
from .vocab import default_path, library, resident, slices

END_ID = 1
MAGIC = b"RPAIR001"
SHARD_IDS = 1 << 20
PER_ROUND = 5000      # the most frequent pairs of a round; the others come in later rounds, over what these left
MIN_COUNT = 7         # a rule takes 12 bytes and saves 2 at every place


# --- the grammar ---

def _frequent_pairs(seq: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (left << 32 | right) of the most frequent inner pairs, the places of all their occurrences, and which pair each is.

    Hashed counts single out the few pairs that can be frequent; only these are counted exactly.
    """
    left, right = seq[:-1], seq[1:]
    slot = ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(14)
    heavy = np.flatnonzero((np.bincount(slot[inner], minlength=1 << 18) >= MIN_COUNT)[slot] & inner)
    code, which, count = np.unique(left[heavy].astype(np.uint64) << np.uint64(32) | right[heavy], return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(count >= MIN_COUNT)
    if len(chosen) > PER_ROUND:
        chosen = np.sort(chosen[np.argsort(-count[chosen], kind="stable")[:PER_ROUND]])
    number = np.full(len(code), -1)
    number[chosen] = np.arange(len(chosen))
    which = number[which]
    hit = which >= 0
    return code[chosen], heavy[hit], which[hit]


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> bytes:
    """A shard from the ids of its documents (``ends``: end of each document in ``ids``)."""
    seq = ids.astype(np.uint32)
    inner = np.ones(max(0, len(seq) - 1), bool)
    inner[ends[ends < len(seq)] - 1] = False
    rules, stop = [], ends.copy()
    while len(seq) > 1:
        code, at, k = _frequent_pairs(seq, inner)
        # of overlapping pairs, every second one from the left of each run of neighbours
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1] + 1
        run = np.flatnonzero(head)
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, k = at[place % 2 == 0], k[place % 2 == 0]
        if not len(at):
            break
        used, k = np.unique(k, return_inverse=True)
        first = vocabulary + sum(map(len, rules))
        rules.append(np.stack([code[used] >> np.uint64(32), code[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        seq = seq.copy()
        seq[at] = first + k
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        stop = before[stop]
        seq = seq[keep]
        inner = np.ones(max(0, len(seq) - 1), bool)
        inner[stop[stop < len(seq)] - 1] = False
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    size = np.ones(vocabulary + len(table), np.uint32)
    at = vocabulary
    for r in rules:
        size[at:at + len(r)] = size[r[:, 0]] + size[r[:, 1]]
        at += len(r)
    wide = "<u4" if vocabulary + len(table) > 1 << 16 else "<u2"
    offsets = np.concatenate([[0], stop]).astype("<i8"), np.concatenate([[0], ends]).astype("<i8")
    return b"".join([MAGIC, struct.pack("<4I", vocabulary, len(table), len(ends), len(seq)), table.astype("<u4").tobytes(), size[vocabulary:].astype("<u4").tobytes(),
                     offsets[0].tobytes(), offsets[1].tobytes(), seq.astype(wide).tobytes()])


class Shard:
    """Random access to one shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.vocabulary, rules, docs, symbols = struct.unpack_from("<4I", data, 8)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.in_symbols, self.in_ids = take("<i8", docs + 1), take("<i8", docs + 1)
        self.symbols = take("<u4" if self.vocabulary + rules > 1 << 16 else "<u2", symbols)
        # what every rule expands to, one after the other
        self.size = np.concatenate([np.ones(self.vocabulary, np.int64), self.lengths])
        self.start = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if rules else np.empty(0, np.int64)
        flat = np.concatenate([self.rules[:, 0]]) if rules else np.empty(0, np.uint32)
        self.flat = self._unfold(np.arange(self.vocabulary, self.vocabulary + rules)) if len(flat) else flat

    def _unfold(self, seq: np.ndarray) -> np.ndarray:
        while True:
            big = seq >= self.vocabulary
            if not big.any():
                return seq.astype(np.uint32)
            n = 1 + big
            out = np.repeat(seq, n)
            first = (np.cumsum(n) - n)[big]
            out[first], out[first + 1] = self.rules[seq[big] - self.vocabulary].T
            seq = out

    def __len__(self) -> int:
        return len(self.in_ids) - 1

    def ids(self, doc: int | None = None) -> np.ndarray:
        """Ids of one document by its number, or of all."""
        s = self.symbols[self.in_symbols[doc]:self.in_symbols[doc + 1]] if doc is not None else self.symbols
        s = s.astype(np.int64)
        n = self.size[s]
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        plain = s < self.vocabulary
        out[begin[plain]] = s[plain]
        big = np.flatnonzero(~plain)
        if len(big):
            m = n[big]
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            out[np.repeat(begin[big], m) + inside] = self.flat[np.repeat(self.start[s[big] - self.vocabulary], m) + inside]
        return out


# --- writing and reading ---

class LibraryCodec(Codec):
    """Words that are not remembered are encoded by the tokenizers library itself."""

    pieces, piece_bytes = 600_000, None

    def __init__(self, path: str):
        super().__init__(path)
        self.library = library(path).model

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [[t.id for t in self.library.tokenize(w)] for w in words]


def _write(path: str, shard_ids: int):
    def run(batches):
        c = resident(("library codec", path), lambda: LibraryCodec(path))
        held, names, sizes, total = [], [], [], 0

        def shard():
            n = np.concatenate(sizes)
            data = compress(np.concatenate(held), np.cumsum(n), c.size)
            return pa.RecordBatch.from_arrays(
                [pa.array([names[0]], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["first_doc", "n_ids", "docs", "data"])
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for start, part in slices(batch, limit=shard_ids):
                ids, offsets = c.encode(part)
                held.append(np.insert(ids, offsets[1:], END_ID))
                names += docs[start:start + len(part)]
                sizes.append(np.diff(offsets) + 1)
                total += len(held[-1])
                if total >= shard_ids:
                    yield shard()
                    held, names, sizes, total = [], [], [], 0
        if held:
            yield shard()
    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts, append id 1 to each, and write shards in ascending doc_id order to ``folder``.

    A null text has the end id alone.  Equal doc_ids follow each other in an order fixed by their text; rows without doc_id
    come first.  Extra columns are not stored.
    """
    path = path or default_path(TOKENIZER)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_write(path, shard_ids), "first_doc long, n_ids long, docs array<long>, data binary")
    raw = stage(rows.withColumn("task", F.spark_partition_id()).withColumn("part", F.monotonically_increasing_id()))
    # ids before every shard: sums over the tasks' totals, then within each task; both only see numbers of shards
    task = raw.groupBy("task").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("task")) - F.col("n")).select("task", "before")
    in_task = Window.partitionBy("task").orderBy("part")
    base = raw.select("task", "part", "n_ids").withColumn("within", F.sum("n_ids").over(in_task) - F.col("n_ids")).join(task, "task")
    base = base.select("part", (F.col("before") + F.col("within")).alias("base"))
    base.write.parquet(f"{folder}/bases")
    raw.select("part", "n_ids", "docs", "data").write.option("compression", "none").parquet(f"{folder}/shards")
    release(raw)


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: every document of the written shards."""
    def run(batches):
        for batch in batches:
            for base, names, data in zip(batch.column("base").to_pylist(), batch.column("docs"), batch.column("data")):
                s = Shard(data.as_py())
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(base + s.in_ids[:-1]), pa.ListArray.from_arrays(pa.array(s.in_ids.astype(np.int32)), pa.array(s.ids().astype(np.int32)))],
                    ["doc_id", "start", "ids"])
    shards, bases = spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/bases")
    return shards.join(F.broadcast(bases) if bases.count() <= 1_000_000 else bases, "part").select("base", "docs", "data").mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_document(shard: bytes, number: int) -> np.ndarray:
    """Ids of one document of a shard without expanding the others."""
    return Shard(shard).ids(number)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written under the checkpoint folder."""
    import uuid
    folder = f"{checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path)

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch.column("ids")]
            n = [len(x) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return read_token_files(docs.sparkSession, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
