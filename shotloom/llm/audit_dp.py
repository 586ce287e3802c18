"""The cheapest repair of a conversation, by a program over rows whose edit sequences share their beginnings.

States are what the repaired sequence ends with so far: nothing, a system, a user or an assistant turn.  After every row each
state has one best sequence of edits: the cheapest, and of those the least by letters.  Sequences are nodes that point to the
sequence without its last letter, so all states share what they have in common.  Each node has its ancestors at distances 1, 2,
4 … and a rolling hash of its letters; two sequences of equal cost are compared by a search for their longest common prefix over
these ancestors.  Unequal hashes prove unequal letters; equal ones are confirmed by walking back to a common node.

Edits are written before the row that they precede, so every sequence for given rows ends with the letter of the last row.
None is then a proper beginning of another, and a smaller beginning stays smaller whatever follows: choosing per state is exact,
and so is composing pieces of a conversation (``compose``) from costs and from the order of the sequences alone.
"""

from __future__ import annotations

from functools import cmp_to_key

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
FINE, CUT_SHORT, MUST_GO = 0, 1, 2      # what a row's first fault asks for
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FAR = 1 << 60
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Edits:
    """Edit sequences as nodes of a tree; node 0 is the empty one."""

    __slots__ = ("parent", "letter", "depth", "hash", "up", "base")

    def __init__(self, base: int = _BASE):
        self.parent, self.letter, self.depth, self.hash, self.up, self.base = [0], [""], [0], [0], [()], base

    def add(self, node: int, letter: str) -> int:
        up, all_up = [node], self.up
        k = 0
        while len(all_up[up[k]]) > k:
            up.append(all_up[up[k]][k])
            k += 1
        self.parent.append(node)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % _MOD)
        all_up.append(tuple(up))
        return len(self.parent) - 1

    def ancestor(self, node: int, depth: int) -> int:
        gap = self.depth[node] - depth
        while gap:
            k = gap.bit_length() - 1
            node = self.up[node][k]
            gap -= 1 << k
        return node

    def compare(self, x: int, y: int) -> int:
        """-1, 0 or 1 as the letters of x come before, equal or come after those of y."""
        if x == y:
            return 0
        depth, hashes, up = self.depth, self.hash, self.up
        short = min(depth[x], depth[y])
        a, b = self.ancestor(x, short), self.ancestor(y, short)
        if hashes[a] != hashes[b]:
            for k in range(short.bit_length(), -1, -1):
                if len(up[a]) > k and len(up[b]) > k and hashes[up[a][k]] != hashes[up[b][k]]:
                    a, b = up[a][k], up[b][k]
            differ, p, q = (a, b), self.parent[a], self.parent[b]
        else:
            differ, p, q = None, a, b
        while p != q:       # equal hashes so far: confirmed letter by letter, back to a shared node
            if self.letter[p] != self.letter[q]:
                differ = (p, q)
            p, q = self.parent[p], self.parent[q]
        if differ is None:
            return (depth[x] > depth[y]) - (depth[x] < depth[y])
        return -1 if self.letter[differ[0]] < self.letter[differ[1]] else 1

    def letters(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


def _least(edits: Edits, options: list) -> tuple:
    """The cheapest of (cost, node, letter), of those the least by letters, with its letter added."""
    low = min(o[0] for o in options)
    if low >= FAR:
        return FAR, 0
    best = None
    for cost, node, letter in options:
        if cost == low:
            node = edits.add(node, letter) if letter else node
            if best is None or edits.compare(node, best) < 0:
                best = node
    return low, best


def closed(edits: Edits, best: list) -> list:
    """Per state the best sequence that may end with inserted turns."""
    user = _least(edits, [(*best[USER], ""), *((best[s][0] + COST[INSERT], best[s][1], INSERT) for s in (START, SYSTEM, ASSISTANT))])
    assistant = _least(edits, [(*best[ASSISTANT], ""), (user[0] + COST[INSERT], user[1], INSERT)])
    return [best[START], best[SYSTEM], user, assistant]


def walk(rows, entry: int = START):
    """Edits, and per state the (cost, node) after all ``rows`` of (role initial, fault), from the state ``entry``."""
    edits = Edits()
    best = [(0, 0) if s == entry else (FAR, 0) for s in STATES]
    for initial, fault in rows:
        start, system, user, assistant = closed(edits, best)
        gone = COST[DELETE]
        if fault == MUST_GO:
            best = [_least(edits, [(c + gone, n, DELETE)]) for c, n in (start, system, user, assistant)]
            continue
        extra = TRUNCATED if fault == CUT_SHORT else 0
        own = INITIAL.get(initial)
        as_user = (KEEP if own == USER else REROLE)
        as_assistant = (KEEP if own == ASSISTANT else REROLE)
        cu, ca = COST[as_user] + extra, COST[as_assistant] + extra
        best = [
            _least(edits, [(start[0] + gone, start[1], DELETE)]),
            _least(edits, [(system[0] + gone, system[1], DELETE), *([(start[0] + extra, start[1], KEEP)] if own == SYSTEM else [])]),
            _least(edits, [(user[0] + gone, user[1], DELETE), *((s[0] + cu, s[1], as_user) for s in (start, system, assistant))]),
            _least(edits, [(assistant[0] + gone, assistant[1], DELETE), (user[0] + ca, user[1], as_assistant)])]
    return edits, best


def repair(rows) -> tuple[int, str]:
    """Cost and letters of the cheapest edits that give ``(s?(ua)+)?``, ties by letters."""
    edits, best = walk(rows)
    last = closed(edits, best)
    cost, node = _least(edits, [(*last[START], ""), (*last[ASSISTANT], "")])
    return cost, edits.letters(node)


# --- pieces of one conversation ---
# A piece is summed up as 32 numbers: cost[entry][exit], then the place of each exit's letters among those of its entry.

def summary(rows) -> list[int]:
    rows = list(rows)
    costs, ranks = [], []
    for entry in STATES:
        edits, best = walk(rows, entry)
        order = sorted((s for s in STATES if best[s][0] < FAR), key=cmp_to_key(lambda a, b: edits.compare(best[a][1], best[b][1])))
        costs += [min(best[s][0], FAR) for s in STATES]
        ranks += [order.index(s) if s in order else 4 for s in STATES]
    return costs + ranks


def _advance(front: list, piece) -> list:
    """(cost, rank) per state before a piece -> (cost, rank, state before) per state after it."""
    found = []
    for x in STATES:
        found.append(min(((c + piece[4 * m + x], r, m) for m, (c, r) in enumerate(front) if c < FAR and piece[4 * m + x] < FAR), default=(FAR, 4, 0)))
    order = sorted((x for x in STATES if found[x][0] < FAR), key=lambda x: (found[x][1], piece[16 + 4 * found[x][2] + x]))
    return [(c, order.index(x) if x in order else 4, m) for x, (c, _, m) in enumerate(found)]


def compose(pieces) -> list[int]:
    """The summary of consecutive pieces."""
    fronts = [[(0, 0) if s == e else (FAR, 4) for s in STATES] for e in STATES]
    for p in pieces:
        fronts = [[(c, r) for c, r, _ in _advance(f, p)] for f in fronts]
    return [c for f in fronts for c, _ in f] + [r for f in fronts for _, r in f]


def final_exit(total) -> int:
    """The state after all rows with which the whole conversation, begun at START, ends best."""
    more = {START: 0, ASSISTANT: 0, USER: COST[INSERT], SYSTEM: 2 * COST[INSERT]}
    return min(STATES, key=lambda x: (total[x] + more[x], total[16 + x]))


def route(pieces, entry: int, leave: int) -> list[tuple[int, int]]:
    """(entry, exit) of every piece on the best way from ``entry`` to ``leave``."""
    front, back = [(0, 0) if s == entry else (FAR, 4) for s in STATES], []
    for p in pieces:
        step = _advance(front, p)
        back.append([m for _, _, m in step])
        front = [(c, r) for c, r, _ in step]
    out = []
    for m in reversed(back):
        out.append((m[leave], leave))
        leave = m[leave]
    return out[::-1]


def piece_letters(rows, entry: int, leave: int, last: bool) -> list[str]:
    """Per row the letters of its edits; the last row of a conversation also has those of turns inserted at the end."""
    edits, best = walk(rows, entry)
    text = edits.letters(best[leave][1])
    out, held = [], ""
    for c in text:
        held += c
        if c != INSERT:
            out.append(held)
            held = ""
    if last and leave in (USER, SYSTEM):
        out[-1] += INSERT if leave == USER else 2 * INSERT
    return out
