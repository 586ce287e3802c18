"""BPE encoding and decoding by speculation and verification.

White space always ends a token, so the pieces between white space are encoded one by one and remembered in a bounded cache
per worker.  Pieces that are not remembered go through three steps, a batch at a time:
1. speculate: one longest-match scan over all words of the batch proposes tokens;
2. verify: a proposal is the exact result if and only if every token is the result of merging its own characters and every
   two neighbours are compatible, that is, merging the characters of both gives these two tokens.  All adjacent pairs of the
   batch are looked up as arrays; a pair not met before is merged once and remembered;
3. only words with an incompatible pair are merged exactly, by rank.
Decoding turns ids back into their tokens, joined by one space.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, texts
from .vocab import PieceCache, default_path, gather, resident, slices

TOKENIZER = "word_bpe_49k.json"
_END = "\uffff"
#: White space as the Unicode property has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Slots for pairs whose compatibility a worker remembers (8 bytes each); a new pair takes the place of another one.
PAIR_SLOTS = 1 << 20
#: Bytes that remembered pieces and words may take in a worker.
PIECE_BYTES, WORD_BYTES = 88 << 20, 56 << 20
#: Bytes of text encoded at a time.
SLICE_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain)))
    return [letters[b] for b in range(256)]


class Codec:
    #: Pieces that a worker remembers, per generation of its cache, and bytes for them in all.
    pieces, piece_bytes = 400_000, PIECE_BYTES

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.path = path
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.size = len(self.tokens)
        self.letters_of = pa.array(self.tokens, pa.string())
        self.whole: dict[int, bool] = {}
        self.fits = np.zeros(PAIR_SLOTS, np.uint64)      # pair + 1 and its verdict in the lowest bit
        self.failed = self.tried = 0
        self.cache = PieceCache(self.encode_pieces, self.pieces, self.piece_bytes)
        self.word_cache = PieceCache(self._word_ids, 250_000, WORD_BYTES)

    @functools.cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {tuple(m): r for r, m in enumerate(json.load(open(self.path, encoding="utf-8"))["model"]["merges"])}

    def symbols(self, i: int) -> list[str]:
        """The single letters that a token is merged from; the last letter of a word carries the suffix."""
        t = self.tokens[i]
        plain = t.removesuffix(self.suffix)
        return [*plain[:-1], plain[-1] + self.suffix] if plain != t and plain else [*plain]

    @functools.cached_property
    def scan(self):
        """The vocabulary for longest-match scans; a token that ends a word ends in _END."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for i in self.ids.values():
            if not (letters := self.symbols(i)):
                continue
            ends = letters[-1].endswith(self.suffix)
            out.add_word("".join(letters).removesuffix(self.suffix) + _END * ends, (i, len(letters) + ends))
        out.make_automaton()
        return out

    def merge(self, parts: list[str]) -> list[str]:
        """Exact merging: always the pair of lowest rank, the leftmost of equal ones."""
        if len(parts) <= 64:
            get, none = self.ranks.get, 1 << 40
            parts = list(parts)
            rank = [get(p, none) for p in zip(parts, parts[1:])]
            while rank and (low := min(rank)) < none:
                k = rank.index(low)
                parts[k] += parts.pop(k + 1)
                del rank[k]
                if k:
                    rank[k - 1] = get((parts[k - 1], parts[k]), none)
                if k < len(rank):
                    rank[k] = get((parts[k], parts[k + 1]), none)
            return parts
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        parts, alive = list(parts), [True] * len(parts)
        heap = [(r, k, p) for k, p in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, (a, b) = heapq.heappop(heap)
            n = right[k]
            if not alive[k] or n >= len(parts) or parts[k] != a or parts[n] != b:
                continue
            parts[k], alive[n], right[k] = a + b, False, right[n]
            if right[n] < len(parts):
                left[right[n]] = k
            for i, j in ((left[k], k), (k, right[k])):
                if i >= 0 and j < len(parts) and (r := self.ranks.get((parts[i], parts[j]))) is not None:
                    heapq.heappush(heap, (r, i, (parts[i], parts[j])))
        return [p for p, on in zip(parts, alive) if on]

    def _is_whole(self, i: int) -> bool:
        if i not in self.whole:
            self.whole[i] = len(self.merge(self.symbols(i))) == 1
        return self.whole[i]

    def _fit(self, code: int) -> bool:
        a, b = divmod(code, self.size)
        return self.merge(self.symbols(a) + self.symbols(b)) == ["".join(self.symbols(a)), "".join(self.symbols(b))]

    def compatible(self, code: np.ndarray) -> np.ndarray:
        """For pairs a * size + b of neighbours: may they stand side by side?"""
        kinds, at = np.unique(code, return_inverse=True)
        kinds = kinds.astype(np.uint64)
        slot = (kinds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (PAIR_SLOTS.bit_length() - 1))
        held = self.fits[slot]
        new = np.flatnonzero(held >> np.uint64(1) != kinds + np.uint64(1))
        found = (kinds[new] + np.uint64(1)) << np.uint64(1) | np.fromiter(map(self._fit, kinds[new].tolist()), np.uint64, len(new))
        held[new] = self.fits[slot[new]] = found
        return (held & np.uint64(1)).astype(bool)[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words given in byte-level letters."""
        found = list(self.scan.iter_long(_END.join(words) + _END)) if words else []
        last = np.array([e for e, _ in found], np.int64)
        ids = np.array([v[0] for _, v in found], np.int64)
        size = np.array([v[1] for _, v in found], np.int64)
        ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64))
        of = np.searchsorted(ends, last, "right")
        covered = np.bincount(of, size, len(words)).astype(np.int64) == np.diff(ends, prepend=0)
        good = covered
        if len(ids):
            inside = of[:-1] == of[1:]
            fit = self.compatible(ids[:-1][inside] * self.size + ids[1:][inside])
            good[of[:-1][inside][~fit]] = False
            single = np.flatnonzero(np.bincount(of, minlength=len(words)) == 1)
            first = np.searchsorted(of, single)
            for w, i in zip(single.tolist(), ids[first].tolist()):
                if not self._is_whole(i):
                    good[w] = False
        cut = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        flat = ids.tolist()
        out = []
        for k, (w, fine) in enumerate(zip(words, good.tolist())):
            out.append(flat[cut[k]:cut[k + 1]] if fine else [self.ids[t] for t in self.merge([*w[:-1], w[-1] + self.suffix])])
        self.tried += len(words)
        self.failed += int((~good).sum())
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        return [np.array(i, "<u4").tobytes() for i in self.encode_words(words)]

    def words_of(self, piece: str) -> list[str | int]:
        """Words of a piece in byte-level letters, and ids of special tokens written out in it."""
        if piece.isascii():      # most pieces: letters, perhaps with one mark behind
            low = piece.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha():
                return [low[:-1], low[-1]]
        out: list[str | int] = []
        for part in self.specials.split(piece) if self.specials and "<|" in piece else [piece]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                out += self.word.findall(part.lower())
                continue
            # the library lowers character by character, without the rule for a sigma at the end of a word
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += [w.encode().decode("latin-1").translate(self.letters) for w in self.word.findall(low)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of every piece as little-endian 32-bit integers."""
        split = [self.words_of(p.decode()) for p in pieces]
        kinds = list({w for ws in split for w in ws if isinstance(w, str)})
        ids = dict(zip(kinds, self.word_cache.values(kinds)))
        return [b"".join([ids[w] if isinstance(w, str) else np.array([w], "<u4").tobytes() for w in ws]) for ws in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and where each text's ids begin (with the end)."""
        # upper case and a mark between a letter and white space make no difference to the words, but many more pieces
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\pL)([.,;:!?])(\s)", r"\1 \2\3")
        return gather(pc.ascii_split_whitespace(texts), self.cache.values)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts from ids: the tokens joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.letters_of.take(pa.array(ids))), " ")


def codec(path: str) -> Codec:
    """One codec per worker, so that its caches outlive a task."""
    return resident(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of token ids), decoded (text from these ids): one row per input row.

    Null and empty texts have no ids and decode to the empty text.  Extra columns are ignored; rows are independent, so
    repeated rows and missing ids need no rule; an empty table gives an empty result.
    """
    path = path or default_path(TOKENIZER)

    def run(batches):
        c = codec(path)
        for batch in batches:
            for start, part in slices(batch, limit=SLICE_BYTES):
                ids, offsets = c.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(part)), lists, c.decode(ids, offsets)], ["doc_id", "ids", "decoded"])

    return spread(texts(docs)).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 of ``encode``'s result."""
    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            sha = [hashlib.sha256(x.values.to_numpy().astype("<u4").tobytes()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), batch.column("decoded")],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded"])
    got = encode(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded string")
    return got.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
