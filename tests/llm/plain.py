"""Plain versions of the operators, one text at a time, and small fixtures."""

import collections
import hashlib
import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns named like the operators' own.
CLASH = "n_words long, key string, words string, place int, kept boolean, component_id long, score double, seed long, id long, places string, rules string"
CLASH_ROW = (None, "k", None, 7, None, 3, 0.5, None, 4, "p", None)


def corpus(n=60, seed=3):
    """(doc_id, text): prose over a small vocabulary with copies, near copies, shared passages, runs, and odd texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8))) for _ in range(400)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, base, line = prose(60), prose(300), prose(14)
    out = []
    for i in range(n):
        kind = i % 6
        w = prose(r.randint(0, 200))
        if kind == 1:
            w[len(w) // 2:len(w) // 2] = passage
        elif kind == 2:
            w = [x if r.random() > 0.02 else "edit" for x in base]
        elif kind == 3 and out:
            w = [x for x in WORDS.findall(r.choice(out)[1] or "")]
        elif kind == 4:
            w = w[:30] + line + w[30:] + ["ha"] * r.choice([0, 3, 49, 50, 51, 120])
        text = ""
        for k, x in enumerate(w):
            text += x + ("\n" if k % 17 == 16 else " " if k % 5 else "  ")
        out.append((i * 3, text))
    out += [(1001, None), (1002, ""), (1003, " \n\t "), (1004, "one"), (1005, "One"), (1006, "one two three four"), (1007, " ".join(prose(30_000))), (1008, out[2][1].upper()), (1009, "a\n\na\nb"),
            (1010, "x" * 70_000)]
    return out


def frame(spark, rows, extra=True):
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, *CLASH_ROW) for r in rows], "doc_id long, text string, " + CLASH)


def repeats(rows, size=50):
    """doc_id -> (n_words, n_removed, kept text)."""
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORDS.findall(t or "")
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j:j + size]), i)
    for i, t in rows:
        w = WORDS.findall(t or "")
        hit = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j:j + size])] < i:
                hit[j:j + size] = [True] * size
        out[i] = (len(w), sum(hit), " ".join(x for x, h in zip(w, hit) if not h))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    at = collections.defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k:k + 3])].append(k)
    again = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def shingles(words, n=5):
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(rows):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(WORDS.findall(lower(t))) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def leaks(rows, items, span=8, masks=((0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 5, 7), (0, 2, 3, 5, 6, 7)), window=13):
    """(doc_id, item_id) -> (best, size)."""
    words = lambda t: re.sub(r"[^\w\s]|_", "", (t or "").lower()).split()
    out = {}
    for d, t in rows:
        w = words(t)
        for i, x in items:
            v = words(x)
            size = min(len(v), window)
            best = 0
            for p in range(len(w) - span + 1):
                for q in range(len(v) - span + 1):
                    if any(all(w[p + k] == v[q + k] for k in m) for m in masks):
                        for s in range(max(q + span - size, 0), min(q, len(v) - size) + 1):
                            best = max(best, sum(0 <= j + p - q < len(w) and w[j + p - q] == v[j] for j in range(s, s + size)))
            if best and 100 * best >= 75 * size:
                out[d, i] = (best, size)
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """Counts, hash and spans of the base rules."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
    return (*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(",".join(spans).encode()).hexdigest(), spans)


def without_lines(rows):
    """doc_id -> (text, n_lines, n_removed)."""
    seen, known, where, out = [], set(), collections.defaultdict(list), {}
    for i, t in sorted(rows):
        keep, n, gone = [], 0, 0
        for line in (t or "").split("\n"):
            w = [x for x in re.split(r"[ \t\v\f\r]+", lower(line)) if x]
            if not w:
                keep.append(line)
                continue
            n += 1
            s = shingles(w)
            shared = collections.Counter(k for h in s for k in where[h])
            if any(100 * v >= 75 * (len(s) + len(seen[k]) - v) for k, v in shared.items()):
                gone += 1
            else:
                keep.append(line)
            if s not in known:
                known.add(s)
                for h in s:
                    where[h].append(len(seen))
                seen.append(s)
        out[i] = ("\n".join(keep) if t is not None else None, n, gone)
    return out
