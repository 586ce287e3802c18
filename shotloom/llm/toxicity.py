"""Toxicity scores from a learned lexicon, matched through Levenshtein automata, with the context of every hit.

1. Lexicon.  From a bounded sample of labelled training rows (``TRAIN_DOCS``, picked by a hash of the id), words and word
   beginnings that are much more frequent in toxic than in other documents become terms (at most ``TERMS``); a beginning
   matches inflected forms, a whole word is taken besides its beginning and matches misspelled forms.
2. Matching.  The terms form a trie.  The trie and the Levenshtein automata of its terms are walked together: a state is the
   set of (trie node, edits so far), and states are made as words need them.  As most words leave the trie after two or three
   letters, one dictionary step per letter is enough, and misspelled terms are found with the exact ones.
3. Context.  A hit inside quotation marks or close to a word of reporting counts as quoted.  Counts of plain and quoted,
   exact and misspelled hits, and their densities, are the inputs of a logistic regression, fitted on the same sample.
Labels, lang, source and doc_id are never inputs.  Rows whose crc32(doc_id as text) mod 4 is 2 are held out from all fitting.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, spread, stage
from .vocab import resident, slices

TRAIN_DOCS = 12_000
TERMS = 400
#: A term occurs in so many toxic documents of the sample, and in so large a share of them.
MIN_SUPPORT, MIN_SHARE = 6, 0.01
MIN_LOG_ODDS = 4.0
THRESHOLD = 0.3
#: Letters of a term below which it is matched exactly.
FUZZY_FROM = 5
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTES = "\"“”„«»‹›「」"
REPORTING = frozenset("said says quoted quote quotes wrote called term word slur sagte zitat zitiert wort dit mot citation dijo palabra cita".split())
NEAR = 6
FEATURES = 8


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Matcher:
    """Lazily built automaton of a trie of terms under Levenshtein distance 1.  Terms ending in ``*`` match beginnings.

    ``wide`` also counts two neighbours swapped as one error, and allows the error in the first letter.
    """
    terms: list[str]
    nodes: list[dict] = field(default_factory=lambda: [{}])
    final: dict[int, tuple[bool, bool]] = field(default_factory=dict)   # node -> (is a whole term, is a beginning)
    states: list[dict] = field(default_factory=list)
    names: dict[frozenset, int] = field(default_factory=dict)
    keys: list[frozenset] = field(default_factory=list)
    hits: list[int] = field(default_factory=list)
    #: States are dropped and built anew beyond this number, so unusual letters cannot fill the memory.
    limit: int = 20_000
    wide: bool = False

    def __post_init__(self):
        # nodes on the way to a term that may be misspelled, and nodes deep enough to end one
        self.fuzzy, self.deep = ({0} if self.wide else set()), set()
        for t in self.terms:
            word, stem, at = t.rstrip("*"), t.endswith("*"), 0
            for k, ch in enumerate(word):
                if ch not in self.nodes[at]:
                    self.nodes[at][ch] = len(self.nodes)
                    self.nodes.append({})
                at = self.nodes[at][ch]
                if len(word) >= FUZZY_FROM:
                    self.fuzzy.add(at)
                    if k + 1 >= FUZZY_FROM:
                        self.deep.add(at)
            whole, begin = self.final.get(at, (False, False))
            self.final[at] = (whole or not stem, begin or stem)
        self.reset()

    def reset(self):
        self.states, self.names, self.keys, self.hits = [], {}, [], []
        self.start = self._state({(0, 0)})

    def _ends(self, node: int, edits: int, begin: int) -> bool:
        """Whether a whole term (0) or a beginning (1) ends at ``node``; short ones end without edits only."""
        return self.final.get(node, (False, False))[begin] and (not edits or node in self.deep)

    def _state(self, items: set[tuple]) -> int:
        """Number of a set of (node, edits), closed under skipping a letter of the term.

        Negative nodes are marks: a beginning was matched with so many edits, whatever follows.  Pairs (node, letter) in place
        of a node are half a swap: that letter leads to the node.
        """
        todo, best = list(items), {}
        while todo:
            node, edits = todo.pop()
            if best.get(node, 9) <= edits:
                continue
            best[node] = edits
            if not isinstance(node, tuple) and node >= 0:
                if self._ends(node, edits, 1):
                    todo.append((-1, edits))
                if edits == 0 and (node or self.wide):
                    todo += [(n, 1) for n in self.nodes[node].values() if n in self.fuzzy]
        key = frozenset(best.items())
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append({})
            self.keys.append(key)
            whole = min((e for n, e in best.items() if not isinstance(n, tuple) and (n < 0 or self._ends(n, e, 0))), default=None)
            self.hits.append(0 if whole is None else 2 - whole)
        return self.names[key]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, edits in self.keys[state]:
            if isinstance(node, tuple):
                if node[1] == ch:
                    out.add((node[0], edits))
                continue
            if node < 0:
                out.add((node, edits))
                continue
            to = self.nodes[node].get(ch)
            if to is not None:
                out.add((to, edits))
            if edits == 0 and (node or self.wide):      # else the first letter must be right
                out |= {(n, 1) for n in self.nodes[node].values() if n in self.fuzzy}
                if node in self.fuzzy:
                    out.add((node, 1))
            if edits == 0 and self.wide:
                swaps = ((self.nodes[n].get(ch), first) for first, n in self.nodes[node].items() if first != ch)
                out |= {((n, first), 1) for n, first in swaps if n in self.fuzzy}
        return self._state(out) if out else -1

    def match(self, word: str) -> int:
        """2: a term, 1: a term with one letter wrong, missing or too many (or a swap, if ``wide``), 0: none."""
        at, states = self.start, self.states
        for ch in word:
            to = states[at].get(ch)
            if to is None:
                if len(states) > self.limit:
                    self.reset()
                    return self.match(word)
                to = states[at][ch] = self._step(at, ch)
            if to < 0:
                return 0
            at = to
        return self.hits[at]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str, matcher: Matcher) -> list[float]:
    """Log counts of plain/quoted x exact/misspelled hits, distinct terms hit, hits per 100 words, any plain hit, a constant."""
    low = text.lower()
    known: dict[str, int] = {}
    for w in set(_WORD.findall(low)):
        if m := matcher.match(w):
            known[w] = m
    count = [0, 0, 0, 0]
    n = 1
    if known:
        spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
        n = len(spans)
        for k, (w, a, b) in enumerate(spans):
            if m := known.get(w):
                near = spans[max(0, k - NEAR):k + NEAR + 1]
                left, right = low[near[0][1]:a], low[b:near[-1][2] + 1]
                quoted = any(q in left for q in _QUOTES) and any(q in right for q in _QUOTES) or any(x in REPORTING for x, _, _ in near)
                count[2 * quoted + (m == 1)] += 1
    total = sum(count)
    return [*map(math.log1p, count), math.log1p(len(known)), math.log1p(100 * total / n), float(count[0] + count[1] > 0), 1.0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps with an L2 term."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """Lexicon and weights from at most about ``bound`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").dropDuplicates(["doc_id"])
    known = known.where(~held_out(F.col("doc_id")))
    n = known.count()
    share = min(1.0, bound / max(n, 1))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sizes = {r.toxic: r["count"] for r in few.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model([], np.array([0.0] * (FEATURES - 1) + [-3.0]))
    # the sample is bounded, so its ids go to the texts and not the texts to the ids
    held = F.broadcast(few) if pos + neg <= 2 * bound else few
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(held, "doc_id"))

    # words and beginnings per document are counted in tasks; only frequent ones come back
    def count(batches):
        for batch in batches:
            both = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = {w for w in tokens(text) if 3 <= len(w) <= 30}
                both[label].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
            terms = [*both[0], *both[1]]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([0] * len(both[0]) + [*both[1].values()], pa.int64()),
                                              pa.array([*both[0].values()] + [0] * len(both[1]), pa.int64())], ["term", "t", "f"])
    odds = F.log((F.col("t") + 0.5) / (pos + 1)) - F.log((F.col("f") + 0.5) / (neg + 1))
    terms = (rows.mapInArrow(count, "term string, t long, f long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
             .where(f"t >= {max(MIN_SUPPORT, MIN_SHARE * pos)}").withColumn("odds", odds).where(f"odds >= {MIN_LOG_ODDS}").orderBy(F.desc("odds"), F.col("term").endswith("*"), "term").limit(20 * TERMS))
    chosen = choose([r.term for r in terms.select("term").collect()])
    got = rows.mapInArrow(_features(Model(chosen, np.zeros(FEATURES)), ("doc_id", "toxic")), "doc_id long, toxic int, x array<double>").select("toxic", "x").collect()
    release(rows)
    if not got:
        return Model([], np.array([0.0] * (FEATURES - 1) + [-3.0]))
    return Model(chosen, fit(np.array([r.x for r in got]), np.array([r.toxic for r in got], float)))


def choose(ranked: list[str]) -> list[str]:
    """The first ``TERMS`` terms, without beginnings of which a shorter one is taken already.

    Of words, only those too short to be misspelled are left out for their beginning: it matches the longer ones just as they
    are, and not misspelled.
    """
    chosen: list[str] = []
    seen: set[str] = set()
    for t in ranked:
        word = t.rstrip("*")
        if (t == word and len(word) >= FUZZY_FROM) or not any(word[:k] + "*" in seen for k in STEMS if k <= len(word)):
            chosen.append(t)
            seen.add(t)
        if len(chosen) == TERMS:
            break
    return chosen


def _features(model: Model, carry: tuple[str, ...], score: bool = False):
    terms, weights = model.terms, model.weights

    def run(batches):
        m = resident(("matcher", *terms), lambda: Matcher(list(terms), wide=True))
        for batch in batches:
            x = [features(t.as_py() or "", m) for t in batch.column("text")]
            if score:
                z = np.array(x).reshape(-1, FEATURES) @ weights
                last = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            else:
                last = pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), last], [*carry, "score" if score else "x"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Null and empty texts have no hits and get the score of a text without hits.  A doc_id labelled twice takes one of its
    labels; rows without doc_id are scored and never learned from.  Without labels of both classes every score is low.  Extra
    columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels, bound)
    cols = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    got = cols.mapInArrow(_features(model, ("doc_id",), True), "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns, without the rows whose score reaches the threshold."""
    terms, weights, names = model.terms, model.weights, docs.columns

    def run(batches):
        score = _features(Model(terms, weights), ("text",), True)
        for whole in batches:
            for lo, part in slices(whole):
                batch = whole.slice(lo, len(part))
                got = next(score(iter([pa.RecordBatch.from_arrays([part], ["text"])])))
                yield batch.filter(pa.compute.less(got.column("score"), THRESHOLD)).select(names)
    return docs.mapInArrow(run, docs.schema)
