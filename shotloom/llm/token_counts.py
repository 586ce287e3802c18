"""Token counts of whole texts by a two-tier lookup on the map side; no pre-token is ever shuffled.

In this vocabulary no piece holds a space sign after another character, so a text falls into pre-tokens that each begin with
one space sign or a run of them, and the token count of the text is the sum over its pre-tokens.  (This is checked when the
vocabulary is read; with any other vocabulary whole texts are encoded.)
1. A table of frequent pre-tokens and their lengths is counted on a bounded sample of documents (``SAMPLE_DOCS``), cut to
   ``TABLE_SIZE`` entries of at most ``KEY_BYTES`` bytes and broadcast: a few MB whatever the size of the corpus.  It only
   saves time; results never depend on it.
2. Pre-tokens that are not in the table are encoded by the library, a batch at a time, and remembered in a bounded cache per
   worker.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, texts
from .vocab import PieceCache, default_path, slices

MODEL = "piece_bpe_32k.model"
SAMPLE_DOCS = 20_000
TABLE_SIZE = 50_000
KEY_BYTES = 48
LIMIT = 4096
_RUNS = re.compile(b" *[^ ]+| +$")


@functools.cache
def processor(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def splits_at_spaces(path: str) -> bool:
    """No piece has a space sign behind another character, spaces are kept as they are, and one is put in front."""
    p = processor(path)
    return (not any("▁" in x.lstrip("▁") for x in map(p.id_to_piece, range(p.get_piece_size())) if not x.startswith("<"))
            and p.encode("a  b ", out_type=str) == ["▁a", "▁", "▁b", "▁"])


def pre_tokens(text: bytes) -> list[bytes]:
    """Pre-tokens without their first space sign; the library puts one in front of every text, so also of each of these."""
    text = text.replace("▁".encode(), b" ")
    if b"  " not in text and not text.startswith(b" ") and not text.endswith(b" "):
        return text.split(b" ") if text else []
    text = b" " + text
    return [m[1:] for m in _RUNS.findall(text)]


class Counts:
    def __init__(self, path: str):
        self.p = processor(path)
        self.whole = not splits_at_spaces(path)
        self.cache = PieceCache(self._encode, 600_000)

    def _encode(self, pieces: list[bytes]) -> list[int]:
        # a pre-token of a single space sign is an empty text to the library, which gives that no token
        return [len(x) or (not self.whole) for x in self.p.encode([x.decode() for x in pieces], num_threads=1)]

    def count(self, texts: pa.Array, table: dict[bytes, int]) -> np.ndarray:
        """Tokens of every text."""
        if self.whole:
            return np.array([len(x) for x in self.p.encode(texts.to_pylist(), num_threads=1)], np.int64)
        plain = pc.replace_substring(texts, "▁", " ")
        odd = pc.or_(pc.or_(pc.match_substring(plain, "  "), pc.starts_with(plain, " ")), pc.ends_with(plain, " ")).to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        # texts with single spaces only are cut by Arrow, others by the general rule
        for rows, lists in ((np.flatnonzero(~odd), pc.split_pattern(plain.filter(pa.array(~odd)).cast(pa.large_binary()), b" ")),
                            (np.flatnonzero(odd), pa.array([pre_tokens(t.encode()) for t in plain.filter(pa.array(odd)).to_pylist()], pa.large_list(pa.large_binary())))):
            kinds = lists.flatten().cast(pa.large_binary()).dictionary_encode()
            pieces = kinds.dictionary.to_pylist()
            size = [table.get(p) for p in pieces]
            rare = [k for k, v in enumerate(size) if v is None]
            for k, v in zip(rare, self.cache.values([pieces[k] for k in rare])):
                size[k] = v
            total = np.append(0, np.cumsum(np.array(size, np.int64)[kinds.indices.to_numpy()]) if pieces else [])
            cut = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
            out[rows] = np.diff(total[cut])
        return out


@functools.cache
def counts(path: str) -> Counts:
    """One per worker, so that its cache outlives a task."""
    return Counts(path)


def frequent(docs: DataFrame, path: str) -> dict[bytes, int]:
    """Lengths of the most frequent pre-tokens of at most about ``SAMPLE_DOCS`` documents, picked by a hash of the text."""
    n = docs.count()
    if not n or not splits_at_spaces(path):
        return {}
    share = min(1.0, SAMPLE_DOCS / n)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                seen.update(p for p in pre_tokens((t.as_py() or "").encode()) if len(p) <= KEY_BYTES)
                if len(seen) > 8 * TABLE_SIZE:
                    seen = Counter(dict(heapq.nlargest(TABLE_SIZE, seen.items(), key=lambda x: x[1])))
        top = heapq.nlargest(TABLE_SIZE // 5, seen.items(), key=lambda x: (x[1], x[0]))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], ["piece", "n"])

    top = sample.select("text").mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(TABLE_SIZE)
    pieces = [bytes(r.piece) for r in top.select("piece").collect()]
    return dict(zip(pieces, Counts(path)._encode(pieces)))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    Null and empty texts have 0 bytes and 0 tokens.  Rows are independent, so repeated rows and missing ids need no rule.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    path = path or default_path(MODEL)
    docs = texts(docs)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))

    def run(batches):
        c = counts(path)
        for batch in batches:
            for start, part in slices(batch):
                size = pc.binary_length(part)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(part)), size.cast(pa.int64()), pa.array(c.count(part, table.value))], ["doc_id", "n_bytes", "n_tokens"])

    return spread(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
