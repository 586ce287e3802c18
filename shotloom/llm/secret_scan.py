"""Secret scans over a trigram index, in DataFrame functions only.

Every rule's regular expression is turned into a Boolean query of trigrams that any match must contain: clauses that all have
to hold, each a choice between sets of trigrams.  The trigrams of all queries are indexed (lower case) as postings
(trigram, doc_id); the postings are intersected per rule, and only candidates are scanned with that rule's expression.  A
rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, texts

#: A choice of so many strings at most is followed; a larger one counts as "anything".
CHOICES = 32


@dataclass(frozen=True)
class Rule:
    """``least``: letters that the match, or its group ``group``, needs; shorter matches are dropped after matching."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        Rule("access", r"AKIA[A-Z0-9]+", 0, 20), Rule("hex", r"[0-9a-f]{24,}", 0, 24))
ADDED = (Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"), Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"), Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
         Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"))
RULES = BASE + ADDED


def _strings(op, arg) -> list[str] | None:
    """All strings (lower case) that one element of a pattern can stand for, if these are few."""
    if op is C.LITERAL:
        return [chr(arg).lower()]
    if op is C.IN:
        out = []
        for o, a in arg:
            if o is C.LITERAL:
                out.append(chr(a).lower())
            elif o is C.RANGE and a[1] - a[0] < CHOICES:
                out += [chr(c).lower() for c in range(a[0], a[1] + 1)]
            else:
                return None
        out = sorted(set(out))
        return out if len(out) <= 8 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        out = [s for p in parts for s in p or ()]
        return out if all(p is not None for p in parts) and len(out) <= CHOICES else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner + [""] * (arg[0] == 0)
    return None


def _sequence(items) -> list[str] | None:
    out = [""]
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > CHOICES:
            return None
        out = [a + b for a, b in product(out, more)]
    return out


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k:k + 3] for k in range(len(text) - 2))


def query_of(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that every match satisfies: of each, one set of trigrams is contained whole.  Empty: nothing is mandatory."""
    clauses, run = [], [""]

    def close():
        if all(len(s) >= 3 for s in run):
            clauses.append(sorted({trigrams(s) for s in run}, key=sorted))
    for op, arg in parser.parse(pattern):
        more = _strings(op, arg)
        if more is not None and len(run) * len(more) <= CHOICES:
            run = [a + b for a, b in product(run, more)]
            continue
        close()
        run = more if more is not None else [""]
    close()
    return clauses


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the leftmost matches that do not overlap."""
    pattern = F.lit(rule.pattern)
    found, kept = F.regexp_extract_all(text, pattern, 0), F.regexp_extract_all(text, pattern, rule.group)
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast("array<struct<s:int,e:int>>")
    walk = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), kept.alias("k")), F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                                F.when(F.length(x["k"]) >= rule.least, F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("s"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e")))))
                                .otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), walk).otherwise(none)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): for every document the numbers of the indexed rules whose queries its postings satisfy."""
    terms = [(r, c, a, t, len(tri)) for r, rule in enumerate(rules) for c, clause in enumerate(query_of(rule.pattern)) for a, tri in enumerate(clause) for t in sorted(tri)]
    spark = docs.sparkSession
    wanted = sorted({t[3] for t in terms})
    low = docs.where("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    postings = low.select("doc_id", F.explode(present).alias("trigram")).distinct()
    plan = spark.createDataFrame(terms, "rule int, clause int, choice int, trigram string, need int")
    clauses = spark.createDataFrame([(r, len(query_of(rule.pattern))) for r, rule in enumerate(rules)], "rule int, clauses int")
    met = (postings.join(plan, "trigram").groupBy("doc_id", "rule", "clause", "choice").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
           .groupBy("doc_id", "rule").agg(F.count_distinct("clause").alias("met")).join(clauses, "rule").where("met = clauses"))
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found (array of kind, start, end by start, then by the order of the rules): one row per input row.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans.  Rows that share a doc_id share candidates but
    are scanned each on its own text; rows without doc_id are scanned with every rule.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    docs = spread(texts(docs)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = [r for r, rule in enumerate(rules) if query_of(rule.pattern)]
    joined = docs.join(candidates(docs, rules), "doc_id", "left")
    spans = []
    for r, rule in enumerate(rules):
        hits = _matches(F.col("text"), rule)
        if r in indexed:
            open_to = F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", r), F.lit(False))
            hits = F.when(open_to, hits).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        spans.append(_named(hits, r, rule.kind))
    return joined.select("doc_id", F.sort_array(F.concat(*spans)).alias("found"))


def _named(hits: Column, number: int, kind: str) -> Column:
    return F.transform(hits, lambda x: F.struct(x["s"].alias("start"), F.lit(number).alias("rule"), F.lit(kind).alias("kind"), x["e"].alias("end")))


def _count(found: Column, number: int) -> Column:
    return F.size(F.filter(found, lambda x: x["rule"] == number)).cast("long")


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of ``scan`` with the base and the added rules."""
    got = scan(docs).withColumn("base", F.filter("found", lambda x: x["rule"] < len(BASE)))
    number = [_count(F.col("base"), r).alias(f"n_{rule.kind}") for r, rule in enumerate(BASE)]
    return got.select("doc_id", *number, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
