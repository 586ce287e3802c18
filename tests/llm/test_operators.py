"""Every operator against its plain version on small fixtures, with nulls, empty and long texts, ties, and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from plain import CLASH, corpus, frame, groups, leaks, measures, repeats, secrets, without_lines

from shotloom.llm import bpe_codec, decontamination, line_dedup, near_dedup, quality_rules, secret_scan, substring_dedup, token_counts, token_files, toxicity, vocab

ROWS = corpus()
ODD = ["<|endoftext|>abc x<|startoftext|> y", "ΑΣ ΣΑΣ İstanbul é ﬁ １２３ x\xa0y\x1cz\x85q", "$" * 300 + " " + "ab" * 200, "日本語 😀😀 it's WE'LL <|endof", "a  b ", "   x  \n  y▁▁z<s>  ", " ", "  "]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("size", [5, 50])
def test_repeated_passages(docs, size):
    assert by_id(substring_dedup.remove_repeats(docs, size), "n_words", "n_removed", "kept_text") == repeats(ROWS, size)


def test_repeats_without_id_or_doubled(spark):
    long = " ".join(f"w{k}" for k in range(60))
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, [(1, long), (1, long), (None, long), (2, long)])).select("doc_id", "n_removed").collect()]
    assert sorted(got, key=str) == [(1, 0), (1, 0), (2, 60), (None, 0)]


def test_base_measures(docs, spark):
    rows = frame(spark, ROWS).selectExpr("doc_id", "text", "if(doc_id % 2 = 0, null, 'en') lang", "if(doc_id % 4 = 0, null, 's') source")
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(rows).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        m = measures(t)
        assert tuple(got[i][c] for c in quality_rules.BASE) == m
        assert got[i].base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (got[i].base_failed and got[i].kept)


def test_thresholds_follow_their_group(spark):
    # in source a a symbol in every word is normal, in source b it is not
    text = lambda k, mark: " ".join(f"w{k}x{j}{mark}" for j in range(60))
    rows = [(k, text(k, "#" if k < 300 else ""), "en", "a" if k < 300 else "b") for k in range(600)] + [(900, text(900, "#"), "en", "b"), (901, text(901, "#"), "en", "a")]
    got = by_id(quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "kept")
    assert not got.pop(900)[0] and all(v[0] for v in got.values())


def test_quantile_grid(spark):
    from pyspark.sql import functions as F
    r = spark.range(0, 100_000, 37).select("id", quality_rules._bucket(F.col("id")).alias("b")).collect()
    assert all(x.b <= x.id and (x.b == x.id if x.id < 128 else (x.id - x.b) * 64 <= x.id) for x in r)
    assert [x.b for x in r] == sorted(x.b for x in r)


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    w = item.split()
    rows = [(1, "before " + item + " after"), (2, "noise " + " ".join(x if k % 6 != 3 else "other" for k, x in enumerate(w))), (3, " ".join(w[:7])), (4, " ".join(reversed(w))), (5, item.upper().replace(" ", ", ")),
            (6, None), (7, ""), (8, " ".join(x if k % 2 else "q" for k, x in enumerate(w))), (9, item + " " + item), (10, "x " * 3000 + " ".join(w[2:16]))]
    items = [(1, item), (2, None), (3, ""), (4, "too short to tell"), (5, "rho sigma tau upsilon phi chi psi omega end")]
    got = decontamination.contaminated(frame(spark, rows), spark.createDataFrame([(*i, "k") for i in items], "item_id long, text string, doc_id string"))
    expected = leaks(rows, items)
    assert {(r.doc_id, r.item_id): (r.best, r.size) for r in got.collect()} == expected
    assert {d for d, _ in expected} >= {1, 2, 5, 9, 10} and not {d for d, _ in expected} & {3, 4, 6, 7, 8}
    assert decontamination.contaminated(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).isEmpty()


def test_leaks_beyond_the_broadcast_bound(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(20))
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    got = decontamination.contaminated(frame(spark, [(1, item), (2, "none")]), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 7, 13, 13)]


def test_leaks_of_a_large_benchmark_move_no_words(spark, monkeypatch):
    # 40 items under 30 ids each: equal items are compared once, and what exceeds the bound takes further scans, not a shuffle of words
    items = [(100 * c + i, " ".join(f"w{i}x{k}" for k in range(16))) for i in range(40) for c in range(30)]
    rows = [(k, "before " + items[30 * k][1] + " after") for k in range(40)] + [(99, "none of it")]
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 600)
    got = decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((d, 100 * c + d, 13, 13) for d in range(40) for c in range(30))
    seen = []
    monkeypatch.setattr(decontamination, "_found", lambda d, seeds, items, f=decontamination._found: seen.append((seeds.count(), items.count(), f(d, seeds, items)._jdf.queryExecution().optimizedPlan().toString())) or f(d, seeds, items))
    decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert len(seen) == 3 and sum(n for _, n, _ in seen) == 40 and max(s for s, _, _ in seen) < 1200 and all(plan.count("strategy=broadcast") == 2 for _, _, plan in seen)


def test_codec_equals_the_library(spark):
    rows = ROWS + [(2000 + k, t) for k, t in enumerate(ODD)]
    path = vocab.default_path(bpe_codec.TOKENIZER)
    lib = vocab.library(path)
    got = {r.doc_id: r for r in bpe_codec.encode(frame(spark, rows)).collect()}
    sums = {r.doc_id: r for r in bpe_codec.digests(frame(spark, rows)).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded) == (ids, text)
        assert tuple(sums[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_long_words_merge_alike():
    c = bpe_codec.codec(vocab.default_path(bpe_codec.TOKENIZER))
    for w in ("abab" * 40, "the" * 60, "a" * 200):
        parts = [*w[:-1], w[-1] + c.suffix]
        short, c2 = list(parts), []
        while True:      # the rule itself: lowest rank, leftmost
            ranked = [(c.ranks[p], k) for k, p in enumerate(zip(short, short[1:])) if p in c.ranks]
            if not ranked:
                break
            k = min(ranked)[1]
            short[k:k + 2] = [short[k] + short[k + 1]]
        assert c.merge(parts) == short


def test_token_counts(spark):
    rows = ROWS + [(2000 + k, t) for k, t in enumerate(ODD)]
    p = token_counts.processor(vocab.default_path(token_counts.MODEL))
    got = by_id(token_counts.token_counts(frame(spark, rows)), "n_bytes", "n_tokens", "over_limit")
    assert got == {i: (len((t or "").encode()), n := len(p.encode(t or "")), n > 4096) for i, t in rows}


def test_near_duplicates(docs):
    got = by_id(near_dedup.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert got == {i: (n, c, c == i) for i, (n, c) in groups(ROWS).items()}


def test_near_duplicates_without_id_or_doubled(spark):
    t = "a b c d e f g h"
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(frame(spark, [(None, t), (4, t), (4, t), (2, t.upper()), (9, None)])).collect()), key=str)
    assert got == sorted([(2, 4, 2, True), (4, 4, 2, False), (4, 4, 2, False), (9, 0, 9, True), (None, 4, None, True)], key=str)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


SECRET_ROWS = [(1, "é password= 'hunter22' TOKEN:abcdef secret: token: abcdefgh api_key=short"), (2, "AKIA" + "A1" * 8 + " AKIASHORT xAKIAAKIA" + "B" * 16), (3, "deadbeef" * 3 + " " + "abc" * 9 + "g0123456789abcdef01234567"), (4, None),
               (5, ""), (6, "ghp_" + "a1B2" * 9 + " xoxb-1234567890-abc -----BEGIN RSA PRIVATE KEY----- ignore"), (7, "x" * 50_000 + " passwd = 1234567"), (8, "ApiKey\"='abcdef'=="), (9, "token=a😀 token=\U0001F600token=abcdef"), (None, "secret=abcdefgh")]


def test_secrets(spark):
    got = {r.doc_id: r for r in secret_scan.secrets(frame(spark, SECRET_ROWS)).collect()}
    assert len(got) == len(SECRET_ROWS)
    for i, t in SECRET_ROWS:
        a, b, c, sha, spans = secrets(t)
        assert tuple(got[i])[1:5] == (a, b, c, sha)
        assert set(spans) <= set(got[i].spans.split(",")) if spans else True
    assert {x.split(":")[0] for x in got[6].spans.split(",")} == {"forge", "chat", "pem"}


def test_trigram_queries():
    q = secret_scan.query_of
    assert q("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]] and q("[0-9a-f]{24,}") == []
    assert q("api_?key") == [[frozenset({"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})]]


def test_a_shard_is_compressed_to_the_end():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 49_000, 300)
    ids = np.concatenate([np.append(passage, 1) for _ in range(40)] + [np.full(5000, 7), rng.integers(0, 50, 4000)])
    ends = np.append(np.arange(1, 41) * 301, [17_040, len(ids)])
    shard = token_files.Shard(token_files.compress(ids, ends, 49_408))
    assert (shard.ids() == ids).all() and all((shard.ids(k) == ids[a:b]).all() for k, (a, b) in enumerate(zip([0, *ends], ends)))
    # a symbol may stand for far more than the eight ids of three rounds, and no pair within a document still pays for a rule
    assert shard.lengths.max() > 100
    pairs = {}
    for a, b in zip(shard.in_symbols, shard.in_symbols[1:]):
        s = shard.symbols[a:b].tolist()
        for p in zip(s, s[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    assert max(pairs.values()) < token_files.MIN_COUNT


def test_token_files(spark):
    rows = ROWS + [(2000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id")]
    lib = vocab.library(vocab.default_path(token_files.TOKENIZER))
    got = by_id(token_files.round_trip(frame(spark, rows)), "start", "n_tokens", "ids_crc32")
    at = 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_give_single_documents():
    r = np.random.default_rng(1)
    for n in (1, 2, 5000):
        ids = r.choice(20, n, p=np.arange(1, 21) / 210).astype(np.uint32)
        ids[::7] = 1
        ends = np.unique(np.append(r.integers(1, n + 1, 9), n))
        shard = token_files.Shard(token_files.compress(ids, ends, 49_408))
        assert (shard.ids() == ids).all()
        for d, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            assert (shard.ids(d) == ids[a:b]).all()
    assert len(shard.symbols) < n


def test_toxicity(spark):
    plain = lambda k: " ".join(f"word{(k * 7 + j) % 90}" for j in range(40))
    rows = [(k, plain(k) + (" you blockhead and nitwit" if k % 5 == 0 else "")) for k in range(800)]
    rows += [(5000, plain(1) + " you blockhaed blockhea"), (5001, None), (5002, ""), (None, plain(3)), (5003, plain(2) + " nitwits"), (5004, "blockhead " * 20_000)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0), 9) for k in range(800)] + [(None, 1, 9), (3, 0, 9), (5001, None, 9)], "doc_id long, toxic int, text int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for k in range(800):
        assert got[k].predicted == int(k % 5 == 0) and got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    assert got[5000].predicted == got[5003].predicted == got[5004].predicted == 1
    assert got[5001].score == got[5002].score == got[None].score < 0.3


def test_levenshtein_matches():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    r = np.random.default_rng(5)
    terms = ["moron", "idiot", "abcab", "cab"]
    m = toxicity.Matcher(list(terms))
    for _ in range(4000):
        base = list(terms[r.integers(4)])
        for _ in range(r.integers(0, 3)):
            k = r.integers(1, len(base) + 1)
            base[k:k + r.integers(0, 2)] = ["abcdiomnrt"[x] for x in r.integers(0, 10, r.integers(0, 2))]
        w = "".join(base)
        best = min((distance(w, t) for t in terms if w and (t[0] == w[0]) and (len(t) >= 5 or w == t)), default=9)
        assert m.match(w) == {0: 2, 1: 1}.get(int(best), 0), w


def test_quotation_is_told_from_abuse():
    m = toxicity.Matcher(["moron"])
    plain, quoted = toxicity.features("you are a moron", m), toxicity.features('they shouted "you moron" at us', m)
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0


def test_lines(docs):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == without_lines(ROWS)
    assert set(c.split()[0] for c in CLASH.split(", ")) <= set(line_dedup.dedup_lines(docs).columns)


def test_line_pairs_go_on_by_the_number_of_shared_prefix_tokens(spark):
    r = np.random.default_rng(5)
    base = r.choice(400, 48, replace=False)
    sets = [set(np.where(r.random(48) < share, r.choice(np.arange(400, 9000), 48, replace=False), base).tolist()) for share in (0, 0.02, 0.05, 0.08, 0.1, 0.3, 0.6, 0.9) for _ in range(6)]
    sets += [set(list(s)[:k]) for s, k in zip(sets, (47, 40, 37, 36, 30, 12))]
    prefix = [sorted(s)[:len(s) - (len(s) * 75 + 99) // 100 + 1] for s in sets]
    rows = [(a, len(sets[a]), prefix[a].index(t), b, len(sets[b]), prefix[b].index(t)) for a in range(len(sets)) for b in range(a + 1, len(sets)) for t in set(prefix[a]) & set(prefix[b])]
    pairs = line_dedup._possible(spark.createDataFrame(rows, "a long, n_a int, i_a int, b long, n_b int, i_b int"))
    got = {(x.a, x.b) for x in line_dedup._likely(pairs).collect()}
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert alike and alike <= got
    assert len(got) < pairs.select("a", "b").distinct().count()


def test_lines_without_id(spark):
    t = "a b c d e f g"
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, [(None, t), (1, t), (2, t + "\nx"), (None, None)])).collect()), key=str)
    assert got == sorted([(None, t), (1, t), (2, "x"), (None, None)], key=str)


@pytest.mark.parametrize("run", [substring_dedup.remove_repeats, bpe_codec.digests, token_counts.token_counts, near_dedup.near_duplicates, secret_scan.secrets, token_files.round_trip, line_dedup.dedup_lines,
                                 lambda d: quality_rules.quality_verdicts(d.selectExpr("doc_id", "text", "key lang", "key source")),
                                 lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "1 toxic")), lambda d: decontamination.contaminated(d, d.selectExpr("doc_id item_id", "text"))])
def test_empty_tables(nothing, run):
    assert run(nothing).isEmpty()


def test_misspelled_beginnings_of_a_trained_model(spark):
    plain = lambda k: " ".join(f"word{(k * 7 + j) % 90}" for j in range(40))
    rows = [(k, plain(k) + (" you blockhead and nitwit" if k % 5 == 0 else "")) for k in range(400)]
    wrong = ["bolckhead", "blokchead", "bockhead", "blackhead", "lockhead", "plockhead", "ntiwit", "intwit"]
    rows += [(1000 + k, plain(k) + f" you {w} {w}") for k, w in enumerate(wrong)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels)
    assert {"blockhead", "nitwit", "bloc*", "nitw*"} <= set(model.terms)
    m = toxicity.Matcher(list(model.terms), wide=True)
    assert [m.match(w) for w in [*wrong, "blockhead", "blocks", "blohcs", "bolck", "head"]] == [1] * len(wrong) + [2, 2, 0, 0, 0]


def test_swaps_and_first_letters():
    def near(a, t):
        """Whether one letter wrong, missing or too many, or one swap of neighbours, turns ``t`` into ``a``."""
        cut = {t[:k] + t[k + 1:] for k in range(len(t))}
        return a in cut or t in {a[:k] + a[k + 1:] for k in range(len(a))} or (len(a) == len(t) and sum(x != y for x, y in zip(a, t)) == 1) \
            or a in {t[:k] + t[k + 1] + t[k] + t[k + 2:] for k in range(len(t) - 1)}

    r = np.random.default_rng(7)
    terms = ["moron", "idiot", "abcab", "cab", "caba*"]
    m = toxicity.Matcher(list(terms), wide=True)
    for _ in range(4000):
        base = list(terms[r.integers(4)])
        for _ in range(r.integers(0, 3)):
            k = r.integers(0, len(base) + 1)
            if r.integers(2):
                base[k:k + 2] = base[k:k + 2][::-1]
            else:
                base[k:k + r.integers(0, 2)] = ["abcdiomnrt"[x] for x in r.integers(0, 10, r.integers(0, 2))]
        w = "".join(base)
        exact = w in terms or w.startswith("caba")
        assert m.match(w) == (2 if exact else int(any(near(w, t) for t in terms[:3]))), w


def test_every_window_at_the_bar_has_a_seed():
    from itertools import combinations
    for n in range(decontamination.SHORT, decontamination.WINDOW + 1):
        for k in range(n * (100 - decontamination.PERCENT) // 100 + 1):
            for gone in combinations(range(n), k):
                assert any(not {p + j for j in mask} & set(gone) for mask in decontamination.MASKS for p in range(n - mask[-1])), (n, gone)
    assert decontamination.SPAN == min(mask[-1] for mask in decontamination.MASKS) + 1


def test_leaks_at_all_alignments(spark):
    r = np.random.default_rng(11)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(n))) for i, n in enumerate([1, 2, 4, 5, 7, 8, 8, 9, 10, 11, 12, 13, 13, 15, 15, 15, 20, 30])]
    rows = []
    for i, t in items * 8:
        w = t.split()
        for k in r.choice(len(w), min(len(w), int(r.integers(0, 5))), replace=False):
            w[k] = "other"
        cut = int(r.integers(0, 3)) if len(w) > 7 else 0
        rows.append((len(rows), " ".join(["before"] * int(r.integers(0, 3)) + w[cut:] + ["after"] * int(r.integers(0, 3)))))
    rows += [(len(rows) + k, t) for k, (_, t) in enumerate(items)]
    expected = {}
    for d, t in rows:
        w = t.split()
        for i, x in items:
            v = x.split()
            size = min(len(v), 13)
            same = lambda s, j: sum(0 <= s + k < len(w) and w[s + k] == v[k] for k in range(j, j + size))
            best = max(same(s, j) for s in range(-len(v), len(w)) for j in range(len(v) - size + 1))
            if (100 * best >= 75 * size if size >= 8 else best == size and (size >= 5 or len(w) == size)):
                expected[d, i] = (best, size)
    got = decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): (x.best, x.size) for x in got.collect()} == expected
    assert {i for _, i in expected} == {i for i, _ in items}
