"""Removal of repeated passages: every word covered by a window of 50 words that also starts in a document with a smaller id.

Texts are parsed by recompression.  A round names runs of equal symbols and then pairs of neighbours, where a symbol's own
bits say whether it may be the left or the right half of a pair.  A name is a fingerprint of the parts it stands for, so the
same run or pair gets the same name in every task without a table of names being shuffled.  Equal substrings are cut alike
but for a few symbols at either border; ``_Parse`` follows, for every window, which symbols cannot depend on what lies
outside it.  From these a window takes the one with the smallest name as its anchor; equal windows have equal anchors.

1. (anchor, document) rows, one for about 20 words, are counted: only anchors in two documents or more are of interest;
2. neighbouring windows under one such anchor form a stretch, named by two fingerprints of all its words.  The smallest
   document of every stretch is an aggregate with partial sums, so a passage that a third of all documents share is no hot
   group.  A stretch that a smaller document has is repeated as a whole;
3. where an anchor has differing stretches, the windows of each stretch's first document are compared one by one, by anchor and
   window fingerprint (two independent 64-bit names);
4. repeated stretches and windows come back as positions, and their words are left out.

A window too repetitive to have an anchor (long runs) is its own anchor, so no window is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import release, spread, stage, texts

WINDOW = 50
ROUNDS = 6
#: Rounds that also name runs; elsewhere equal neighbours simply stay apart.
RUN_ROUNDS = (0, 3)


def _anchors(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window inside one text: its first word's index, its text, and its anchor."""
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(max(0, n - size + 1))
    start = start[doc[start] == doc[start + size - 1]] if len(start) else start
    if not len(start):
        return start, start, np.empty(0, A.U)
    sym, of = h, doc
    lo, hi = np.arange(n + 1), np.arange(n + 1)      # by word: first safe symbol of what starts here, end of what ends here
    for level in range(ROUNDS):
        if level in RUN_ROUNDS:
            head = np.ones(len(sym), bool)
            head[1:] = (sym[1:] != sym[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(head)
            length = np.diff(np.append(at, len(sym)))
            new = np.append(np.cumsum(head) - 1, len(at))
            # the first and the last run may go on outside the window
            lo = np.minimum(new[lo] + 1, len(at))
            hi = new[np.maximum(hi - 1, 0)]
            sym = np.where(length > 1, A.mix(sym[at] ^ A.mix(length.astype(A.U))), sym[at])
            of = of[at]
        right = (A.mix(sym ^ A.U(level + 1)) >> A.U(63)).astype(bool)
        pair = ~right[:-1] & right[1:] & (of[:-1] == of[1:])
        stays = np.ones(len(sym), bool)
        stays[1:] = ~pair
        at = np.flatnonzero(stays)
        new = np.append(np.cumsum(stays) - 1, len(at))
        edge = np.append(right, False)
        lo = new[np.minimum(lo + edge[lo], len(sym))]
        last = np.maximum(hi - 1, 0)
        hi = np.where(hi > 0, new[np.maximum(last - ~right[last], 0)] + 1, 0)
        with np.errstate(over="ignore"):
            named = A.mix(sym[:-1] * A.U(0xD6E8FEB86659FD93) + A.mix(sym[1:] ^ A.U(0x5851F42D4C957F2D)))
        sym = sym.copy()
        sym[:-1][pair] = named[pair]
        sym, of = sym[at], of[at]
    a, b = lo[start], hi[start + size]
    span = b - a
    anchor = A.mix(A.windows(h, size, 77)[start])
    some = np.flatnonzero(span > 0)
    if len(some):
        table = [A.mix(sym)]
        for k in range(int(span.max()).bit_length() - 1):
            t = table[-1]
            table.append(np.minimum(t[:-(1 << k)], t[1 << k:]) if len(t) > (1 << k) else t)
        level = np.frexp(span[some].astype(float))[1] - 1
        for k in np.unique(level).tolist():
            s = some[level == k]
            anchor[s] = np.minimum(table[k][a[s]], table[k][b[s] - (1 << k)])
    return start, doc[start], anchor


def _seen(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, offsets in A.steps(batch, "text"):
                _, doc, anchor = _anchors(*A.words(data, offsets), size)
                new = np.ones(len(doc), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(anchor[new])), pa.array(ids[i:][doc[new]], pa.int64())], ["anchor", "doc_id"])
    return run


def _stretches(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            shared = batch.column("anchors").cast(pa.large_list(pa.int64()))
            cut = shared.offsets.to_numpy()
            flat = shared.values.to_numpy()
            for i, j, data, offsets in A.steps(batch, "text"):
                h, first = A.words(data, offsets)
                start, doc, anchor = _anchors(h, first, size)
                keep = np.zeros(len(start), bool)
                part = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    s = slice(part[d], part[d + 1])
                    keep[s] = np.isin(A.signed(anchor[s]), flat[cut[i + d]:cut[i + d + 1]])
                start, doc, anchor = start[keep], doc[keep], anchor[keep]
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(start)))
                a, d = start[head], doc[head]
                names = [A.signed(A.spans(h, a, a + n - 1 + size, salt)) for salt in (1, 2)]
                window = A.signed(A.windows(h, size, 3)[start]) if len(start) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(A.signed(anchor[head])), *map(pa.array, names), pa.array(ids[i:][d], pa.int64()), pa.array((a - first[d]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.append(head, len(start)).astype(np.int32)), pa.array(window))], ["anchor", "one", "two", "doc_id", "place", "n", "windows"])
    return run


def _cut(size: int):
    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                w = (text.as_py() or "").encode().split()
                hit = np.zeros(len(w) + 1, np.int32)
                if places.is_valid:
                    p, q = (places.values.field(k).to_numpy() for k in (0, 1))
                    fits = p + q + size - 1 <= len(w)
                    np.add.at(hit, p[fits], 1)
                    np.add.at(hit, p[fits] + q[fits] + size - 1, -1)
                covered = np.cumsum(hit[:-1]) > 0
                m = int(covered.sum())
                n.append(len(w))
                gone.append(m)
                kept.append((b" ".join(w[x] for x in np.flatnonzero(~covered).tolist()) if m else b" ".join(w)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, places): runs (place, n) of windows, by the number of their first word, that also start in a smaller document."""
    docs = spread(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    seen = stage(docs.mapInArrow(_seen(size), "anchor long, doc_id long"))
    shared = seen.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    per_doc = stage(seen.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    release(seen)
    rows = stage(docs.join(per_doc, "doc_id").mapInArrow(_stretches(size), "anchor long, one long, two long, doc_id long, place int, n int, windows array<long>"))
    release(per_doc)
    name = ["anchor", "one", "two"]
    firsts = stage(rows.groupBy(*name).agg(F.min("doc_id").alias("lo")))
    several = firsts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor", F.lit(True).alias("open"))
    known = stage(rows.join(firsts.join(several, "anchor", "left"), name).where("doc_id > lo OR open")
                  .select("anchor", "doc_id", "place", "n", F.when(F.col("doc_id") == F.col("lo"), F.col("windows")).alias("windows")))
    release(rows, firsts)
    single = known.where("windows IS NOT NULL").select("anchor", "doc_id", "place", F.posexplode("windows").alias("k", "window"))
    least = single.groupBy("anchor", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "window", "lo")
    found = single.join(least, ["anchor", "window"]).where("doc_id > lo").select("doc_id", (F.col("place") + F.col("k")).alias("place"), F.lit(1).alias("n"))
    whole = known.where("windows IS NULL").select("doc_id", "place", "n")
    out = stage(whole.union(found).groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("places")))
    release(known)
    return out


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), one row per input row.

    Null and blank texts have no words; texts shorter than a window keep all words.  Windows are judged on the input, so what
    is removed from one document still counts as seen.  Rows that share a doc_id are one document: none is smaller than the
    other, and a window that a smaller document has at a place of either is removed at that place where it fits; rows without
    doc_id keep all words.  Extra columns are ignored; an empty table gives an empty result.
    """
    docs = texts(docs)
    return docs.join(repeated_windows(docs, size), "doc_id", "left").mapInArrow(_cut(size), "doc_id long, n_words long, n_removed long, kept_text string")
