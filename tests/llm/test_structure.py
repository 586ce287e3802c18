"""Conversation repair, filter audit and sharding against plain versions, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from plain import CLASH, CLASH_ROW, WORDS, corpus, frame

from shotloom.llm import audit_dp, conversation_repair, filter_audit, oracles, sharding

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
FOLLOW = {"": "u", "s": "u", "u": "a", "a": "u"}


# --- conversations ---

def cheapest(rows):
    """(cost, letters, repaired lines) over whole lists: every prefix keeps its edits as a string and its lines as a tuple."""
    def inserts(found):
        out = dict(found)
        for _ in range(2):
            for s, (c, a, t) in list(out.items()):
                new = (c + 3, a + "I", t + (("user:" if FOLLOW[s] == "u" else "assistant:"),))
                if FOLLOW[s] not in out or new < out[FOLLOW[s]]:
                    out[FOLLOW[s]] = new
        return out
    found = {"": (0, "", ())}
    for role, text, fault in rows:
        new = collections.defaultdict(list)
        for s, (c, a, t) in inserts(found).items():
            new[s].append((c + 4, a + "D", t))
            if fault == 2:
                continue
            more = 3 * (fault == 1)
            i = role[:1]
            if i in ("s", "u", "a") and s + i in ("s", "u", "su", "ua", "au"):
                new[i].append((c + more, a + "K", t + (f"{role}:{text}",)))
            new[FOLLOW[s]].append((c + 3 + more, a + "R", t + (f"{'user' if FOLLOW[s] == 'u' else 'assistant'}:{text}",)))
        found = {s: min(v) for s, v in new.items()}
    return min(v for s, v in inserts(found).items() if s in ("", "a"))


def plain_repair(rows):
    after = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        after[conv]
        sp = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        text, role = sp(text), sp(role)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, got in after.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64]))
        seen, marked, n = set(), [], collections.Counter()
        for _, role, text in got:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            name = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            n[name] += 1
            marked.append((role, text, {"truncated": 1, "": 0}.get(name, 2)))
        n["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        turns = [t for t, *_ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(marked)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(seed=5, n=150):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "a b c.", "", " \t", "So?", "x" * 70 + ".", "x" * 70, "é…", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    rows = []
    for c in range(n):
        size = r.choice([1, 2, 3, 4, 6, 9, 30]) if c else 400
        for t in range(size):
            turn = r.choice([t, t, t, t + 3, None]) if c % 3 == 0 else t
            role = r.choice(roles) if c % 2 else ("user", "assistant")[t % 2]
            rows.append((c if c != 7 else None, turn, role, r.choice(texts) if r.random() < 0.4 else f"word {r.randint(0, 9999)}."))
    return rows + [(900, 1, "user", "y" * 300_000 + "?"), (901, None, None, None)] + [(902, 0, "user", "same.")] * 9


@pytest.fixture(scope="module")
def conversations(spark):
    rows = talk()
    return rows, spark.createDataFrame([(*r, "k", 1, None, 3, True) for r in rows], "conv_id long, turn long, role string, text string, piece string, pos int, fault string, k int, lost boolean")


@pytest.mark.parametrize("piece, fan", [(4096, 2048), (8, 2), (1, 3)])
def test_conversations(conversations, piece, fan):
    rows, df = conversations
    got = conversation_repair.repair(conversation_repair.damage(df), piece, fan).collect()
    expected = plain_repair(rows)
    assert len(got) == len(expected)
    assert {r.conv_id: tuple(r[c] for c in COUNTS) for r in got} == expected
    assert {len(v) for v in expected.values()} == {8} and any(v[6] == "" for v in expected.values()) and any("I" in v[6] and "R" in v[6] for v in expected.values())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(conversation_repair.damage(empty)).isEmpty()


def test_edit_sequences_compare_like_strings():
    r = random.Random(2)
    for base in (1_000_003, 1, 0):      # bases 1 and 0 make hashes collide: letters decide all the same
        edits = audit_dp.Edits(base)
        nodes = [0]
        for _ in range(400):
            nodes.append(edits.add(r.choice(nodes[-12:]), r.choice("DIK")))
        for _ in range(3000):
            x, y = r.choice(nodes), r.choice(nodes)
            a, b = edits.letters(x), edits.letters(y)
            assert edits.compare(x, y) == (a > b) - (a < b) and len(a) == edits.depth[x]


def test_repair_against_all_edit_sequences():
    r = random.Random(4)
    for _ in range(40):
        rows = [(r.choice("suaaux"), r.choice([0, 0, 1, 2])) for _ in range(r.randint(0, 2))]
        best = None
        for slots in itertools.product(range(3), repeat=len(rows) + 1):
            for ops in itertools.product("KRD", repeat=len(rows)):
                for choice in itertools.product("ua", repeat=sum(slots) + ops.count("R")):
                    pick, roles, cost, ok = iter(choice), "", 0, True
                    for n, (op, (i, f)) in zip(slots, zip(ops, rows)):
                        roles += "".join(next(pick) for _ in range(n))
                        ok &= op == "D" or f != 2
                        cost += {"K": 0, "R": 3, "D": 4}[op] + 3 * n + 3 * (f == 1 and op != "D")
                        roles += "" if op == "D" else i if op == "K" else next(pick)
                    roles += "".join(next(pick) for _ in range(slots[-1]))
                    if ok and re.fullmatch("(s?(ua)+)?", roles):
                        text = "".join("I" * n + op for n, op in zip(slots, ops)) + "I" * slots[-1]
                        best = min(best or (999,), (cost + 3 * slots[-1], text))
        assert audit_dp.repair(rows) == best


# --- filters ---

def plain_audit(rows, labels):
    labels = [x for x in labels if x[0] is not None]
    good, toxic, least = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}, {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = collections.defaultdict(list)
    for d, t, lang in rows:
        t = t or ""
        w = WORDS.findall(t)
        bad = "".join(c for c, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t), d is not None and d > least[t])) if f)
        docs[lang or ""].append((bad, d in good, d in toxic))
    out, total = {}, collections.Counter()
    for part, ds in docs.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = ds
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                total[part, c] += len(gone)
                out[part, order, k] = [len(left), len(gone), sum(c in x[0] for x in ds) - len(gone), sum(x[0] == c for x in ds), sum(x[1] for x in gone), sum(x[2] for x in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDIT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filters(spark):
    r = random.Random(8)
    odd = [None, "", "A B C", "a a a a # a", "word " * 250, " ".join(f"w{k}" for k in range(250)), "ABC " * 80, "x" * 50_000, " ".join(f"W{k}" for k in range(300)), "\x1c\x85 \xa0"]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in corpus()] + [(2000 + k, r.choice(odd), r.choice(["en", None, "fr"])) for k in range(120)]
    rows += [rows[3], rows[3], (2001, rows[61][1], "en"), (None, "A B C", "en"), (None, "A B C", "en"), (1, "A B C", "de"), (1, "a a a a # a", "de")]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1, None])) for d, *_ in rows if r.random() < 0.5] + [(None, 1, 1), (1, 0, 0), (1, 1, 0)]
    clash = "mask int, rank string, n long, good int, digest string, step int"
    docs = spark.createDataFrame([(*x, 1, "r", 2, 3, "d", 4) for x in rows], "doc_id long, text string, lang string, " + clash)
    marks = spark.createDataFrame([(*x, "en", "t") for x in labels], "doc_id long, quality int, toxic int, lang string, text string")
    got = filter_audit.audit(docs, marks).collect()
    assert {(x.part, x.filter_order, x.step): tuple(x[c] for c in AUDIT) for x in got} == plain_audit(rows, labels)
    assert len(got) == 600 * 4
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text", "lang").toPandas())
    con.register("l", marks.toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) doc_id, text, lang FROM d; CREATE VIEW labels AS SELECT CAST(doc_id AS BIGINT) doc_id, CAST(quality AS INT) quality, CAST(toxic AS INT) toxic FROM l")
    check = con.execute(f"SELECT part, filter_order, step, {', '.join(AUDIT)} FROM ({oracles.FILTERS})").fetchall()
    assert sorted(check) == sorted((x.part, x.filter_order, x.step, *(x[c] for c in AUDIT)) for x in got)


def test_filters_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty()


def test_ranks():
    assert [filter_audit.lehmer_rank(o) for o in filter_audit.ORDERS] == list(range(120)) and filter_audit.ORDERS == sorted(filter_audit.ORDERS)


def test_intervals_remove_every_set_once(spark):
    hit = collections.Counter()
    for x in filter_audit.intervals(spark).collect():
        for rank in range(x.lo, x.hi):
            hit[x.mask, rank] += 1
            order = filter_audit.ORDERS[rank]
            assert x.step == min(order.index(c) + 1 for k, c in enumerate("ABCDE") if x.mask >> k & 1)
    assert len(hit) == 31 * 120 and set(hit.values()) == {1}


# --- shards ---

def check_shards(rows, got, n):
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.size, x.text_crc32) for x in got) == sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    shards = collections.defaultdict(list)
    for x in got:
        shards[x.shard].append(x.slot)
        assert x.law == "rows" and x.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    sizes = [len(shards.get(k, [])) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1 and set(shards) <= set(range(n))


@pytest.mark.parametrize("bucket_bytes", [1 << 12, 1 << 24])
def test_shards(spark, tmp_path, bucket_bytes):
    rows = corpus() + [(5000, "again")] * 60 + [(6000 + k, "copy") for k in range(60)] + [(None, None), (None, "x"), (None, "x")]
    docs = frame(spark, rows).withColumnsRenamed({"key": "shard", "place": "slot", "seed": "record"})
    got = sharding.shards(docs, f"{tmp_path}/a", bucket_bytes=bucket_bytes).collect()
    check_shards(rows, got, 8)
    back = sharding.read_shards(spark, f"{tmp_path}/a", docs.schema)
    assert back.schema["record"].dataType == docs.schema and back.select("record.slot").distinct().collect()[0][0] == CLASH_ROW[3] and CLASH
    again = sharding.shards(docs.repartition(7), bucket_bytes=bucket_bytes).collect()
    place = lambda rs: {x.doc_id: (x.shard, x.slot) for x in rs if x.doc_id is not None and x.doc_id != 5000}
    assert {k: v[0] for k, v in place(got).items()}.keys() == place(again).keys()
    check_shards(rows, again, 8)


def test_same_seed_same_order_whatever_the_layout(spark):
    docs = frame(spark, corpus())
    a, b, c = (sorted((x.doc_id, x.shard, x.slot) for x in sharding.shards(d, seed=s, bucket_bytes=4096).collect()) for d, s in ((docs, 1), (docs.repartition(9), 1), (docs, 2)))
    assert a == b != c


def test_few_and_no_rows_to_shard(spark):
    for n in (0, 1, 3):
        rows = [(k, "t" * k) for k in range(n)]
        check_shards(rows, sharding.shards(frame(spark, rows)).collect(), 8)


def test_permutations_are_uniform():
    seen = collections.Counter(tuple(sharding.fisher_yates(4, 9, b)) for b in range(24_000))
    assert len(seen) == 24 and all(800 < v < 1200 for v in seen.values())
    shard, slot = sharding.places(np.arange(29), 29, 8)
    assert sorted(np.bincount(shard).tolist()) == [3] * 3 + [4] * 5 and all(slot[shard == s].tolist() == list(range((shard == s).sum())) for s in range(8))
