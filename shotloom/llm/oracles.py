"""Check SQL (DuckDB) for the operators that SQL can express: plain definitions, without signatures, seeds' hashes or filters."""

from __future__ import annotations

from . import decontamination as D
from . import quality_rules as Q
from . import secret_scan as S

#: Seeds of the check SQL for leaks: fewer than the operator's, so it may report fewer pairs.
SPAN = 8
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 5, 7), (0, 2, 3, 5, 6, 7))
WORD = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
hashed AS (SELECT doc_id, list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' '))) AS hs FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM hashed),
firsts AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE doc_id > lo),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
left_over AS (SELECT word.doc_id, count(gone.p) AS n, string_agg(x, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS t FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN left_over USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORD}) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a)
SELECT doc_id, CAST(any_value(len(sh)) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept FROM s JOIN reach USING (doc_id) GROUP BY doc_id"""

LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, place, line, regexp_extract_all({LOWER.format("line")}, '[^ \t\x0B\f\r]+') AS ws FROM l),
s AS (SELECT doc_id, place, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [array_to_string(ws, ' ')] END) AS sh FROM w WHERE len(ws) > 0),
e AS (SELECT doc_id, place, len(sh) AS n, unnest(sh) AS x FROM s),
gone AS (SELECT DISTINCT doc_id, place, true AS gone FROM (SELECT b.doc_id, b.place FROM e a JOIN e b ON a.x = b.x AND (a.doc_id, a.place) < (b.doc_id, b.place)
    GROUP BY a.doc_id, a.place, b.doc_id, b.place HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))))
SELECT d.doc_id, count(CASE WHEN len(ws) > 0 THEN 1 END) AS n_lines, count(gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (gone IS NULL AND line IS NOT NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN gone USING (doc_id, place) GROUP BY d.doc_id"""


def _leaks() -> str:
    def words(t: str) -> str:
        return rf"regexp_extract_all(regexp_replace(lower({t}), '[\p{{P}}\p{{S}}]+', '', 'g'), {WORD})"

    def seeds(name: str) -> str:
        one = "list_concat(" + ", ".join(f"list_transform(range(1, len(ws) - {SPAN - 2}), lambda i: {{'s': '{m} ' || " + " || ' ' || ".join(f"ws[i + {k}]" for k in mask) + ", 'at': i})"
                                         for m, mask in enumerate(MASKS)) + ")"
        return f"SELECT {name}, unnest({one}, recursive := true) FROM {name}s WHERE len(ws) >= {SPAN}"
    return f"""
WITH doc_ids AS (SELECT doc_id, {words("text")} AS ws FROM documents WHERE text IS NOT NULL),
item_ids AS (SELECT item_id, {words("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
d AS ({seeds("doc_id")}), b AS ({seeds("item_id")}),
hits AS (SELECT DISTINCT doc_id, item_id, d.at - b.at AS shift, b.at AS q FROM d JOIN b USING (s)),
tried AS (SELECT doc_id, item_id, shift, least(len(i.ws), {D.WINDOW}) AS size, i.ws AS iw, x.ws AS dw,
    unnest(range(greatest(q + {SPAN} - least(len(i.ws), {D.WINDOW}), 1), least(q, len(i.ws) - least(len(i.ws), {D.WINDOW}) + 1) + 1)) AS a FROM hits JOIN item_ids i USING (item_id) JOIN doc_ids x USING (doc_id)),
scored AS (SELECT doc_id, item_id, size, len(list_filter(range(a, a + size), lambda k: k + shift >= 1 AND dw[k + shift] = iw[k])) AS best FROM tried)
SELECT doc_id, item_id, CAST(max(best) AS BIGINT) AS best, CAST(max(size) AS BIGINT) AS size FROM scored WHERE 100 * best >= {D.PERCENT} * size GROUP BY 1, 2"""


def _secrets() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    lists = []
    for r, rule in enumerate(S.RULES):
        p = quote(rule.pattern)
        before = f"list_sum(list_transform(regexp_split_to_array(text, {p})[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(regexp_extract_all(text, {p})[1:i - 1], lambda g: length(g))), 0)"
        lists.append(f"list_transform(list_filter(range(1, len(regexp_extract_all(text, {p})) + 1), lambda i: length(regexp_extract_all(text, {p}, {rule.group})[i]) >= {rule.least}), "
                     f"lambda i: {{'s': CAST({before} AS BIGINT), 'r': {r}, 'k': '{rule.kind}', 'e': CAST({before} + length(regexp_extract_all(text, {p})[i]) AS BIGINT)}})")
    name = "list_transform({}, lambda x: x.k || ':' || x.s || ':' || x.e)"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda x: x.r = {r})) AS BIGINT) AS n_{rule.kind}" for r, rule in enumerate(S.BASE))
    base = name.format(f"list_filter(f, lambda x: x.r < {len(S.BASE)})")
    return f"""
SELECT doc_id, {counts}, sha256(coalesce(array_to_string({base}, ','), '')) AS base_sha256, coalesce(array_to_string({name.format("f")}, ','), '') AS spans
FROM (SELECT doc_id, list_sort(list_concat({", ".join(lists)})) AS f FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


def _quality() -> str:
    inside = lambda chars: "[" + "".join("\\" + c for c in chars) + "]"
    count = lambda pattern: f"length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{pattern}', '', 'g'))"
    rates = ", ".join(f"{{'rule': {i}, 'rate': {r.top} * 1000 // {r.bottom}}}" for i, r in enumerate(Q.RULES))
    fence = lambda side: "CASE rule " + " ".join(
        f"WHEN {i} THEN " + (f"q1 - greatest(3 * (q3 - q1), {r.low})" if side == "lo" else f"q3 + greatest(3 * (q3 - q1), {r.high})")
        for i, r in enumerate(Q.RULES) if (r.low if side == "lo" else r.high) is not None) + " END"

    def quartiles(source: str, keys: str) -> str:
        return f"""SELECT {keys}, rule, total, {fence("lo")} AS lo, {fence("hi")} AS hi FROM (SELECT {keys}, rule, any_value(total) AS total, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1,
            min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, rule) AS total FROM {source}) GROUP BY {keys}, rule)"""
    names = "[" + ", ".join(f"'{r.name}'" for r in Q.RULES) + "]"
    return rf"""
WITH w AS (SELECT doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORD})) AS ls FROM documents),
tri AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS t, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM often) GROUP BY 1),
m AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {count(inside(Q.SYMBOLS))} AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, {count("[A-Z]")} AS n_capitals, {count(inside(Q.MARKS))} AS n_marks FROM w LEFT JOIN again USING (doc_id)),
f AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
r AS (SELECT doc_id, lang, source, unnest([{rates}], recursive := true) FROM f WHERE NOT base_failed),
sk AS (SELECT lang, source, rule, CAST(rate - rate % (1::BIGINT << greatest(length(ltrim(bin(rate), '0')) - 7, 0)) AS BIGINT) AS bucket, count(*) AS n FROM r GROUP BY ALL),
sl AS (SELECT lang, rule, bucket, sum(n) AS n FROM sk GROUP BY ALL), sa AS (SELECT 1 AS one, rule, bucket, sum(n) AS n FROM sk GROUP BY ALL),
own AS ({quartiles("sk", "lang, source")}), bylang AS ({quartiles("sl", "lang")}), whole AS ({quartiles("sa", "one")}),
broken AS (SELECT r.doc_id, list({names}[r.rule + 1] ORDER BY r.rule) AS bad FROM r LEFT JOIN own o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source AND r.rule = o.rule AND o.total >= {Q.OWN_GROUP}
    LEFT JOIN bylang b ON r.lang IS NOT DISTINCT FROM b.lang AND r.rule = b.rule AND b.total >= {Q.OWN_GROUP} JOIN whole a ON r.rule = a.rule
    WHERE rate < CASE WHEN o.rule IS NOT NULL THEN o.lo WHEN b.rule IS NOT NULL THEN b.lo ELSE a.lo END OR rate > CASE WHEN o.rule IS NOT NULL THEN o.hi WHEN b.rule IS NOT NULL THEN b.hi ELSE a.hi END GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad IS NULL AS kept, coalesce(array_to_string(bad, ','), '') AS rejected_by FROM f LEFT JOIN broken USING (doc_id)"""


#: Every document against every order: no intervals, no sums over ranks.
FILTERS = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
early AS (SELECT t, min(doc_id) AS lo FROM w GROUP BY 1),
mark AS (SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > lo THEN 'E' END) AS bad
    FROM w JOIN early USING (t) LEFT JOIN mark USING (doc_id)),
c AS (SELECT part, bad, good, toxic, count(*) AS n FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT c.*, filter_order, CASE WHEN bad = '' THEN 6 ELSE list_min(list_transform(string_split(bad, ''), lambda x: instr(filter_order, x))) END AS gone FROM c, o),
g AS (SELECT part, s.filter_order, s.step, s.filter_order[s.step] AS x, sum(CASE WHEN gone > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < s.step AND contains(bad, s.filter_order[s.step]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad = s.filter_order[s.step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = s.step AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = s.step AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM r JOIN s ON r.filter_order = s.filter_order GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g"""


ORACLES = {"op1_substring_dedup": REPEATS, "op2_quality_rules": _quality(), "op3_decontamination": _leaks(), "op6_near_dedup": NEAR, "op7_secret_scan": _secrets(), "op10_line_dedup": LINES, "op12_filter_audit": FILTERS}
