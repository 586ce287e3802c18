"""Requests, briefs and editing notes turned into criteria, knobs and directives."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import clip, lookup, strings
from ..rules import words as D
from ..rules.planning import BIAS_RANGE, KNOBS

c = F.col


def padded(text: Column) -> Column:
    """Lower-case text without outer white space, one blank at either end."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", ""), F.lit(" "))


def vocabulary() -> list[tuple]:
    """(kind, phrase, attribute, op, value, description) in matching order: six vocabularies, longest phrase first."""
    def longest(m):
        return sorted(m.items(), key=lambda kv: -len(kv[0]))

    rows = [("sort", p, a, "desc" if down else "asc", "", "") for p, (a, down) in longest(D.SORT_TERMS)]
    rows += [("is", p, "camera_movement", "prefix" if v in ("pan", "tilt") else "==", v, f"camera movement is {v.replace('_', ' ')}") for p, v in longest(D.CAMERA_TERMS)]
    rows += [("is", p, "shot_size", "==", v, f"shot size is {v.replace('_', ' ')}") for p, v in longest(D.SIZE_TERMS)]
    rows += [("is", p, v, "flag", "True", f"contains {v}") for p, v in longest(D.FLAG_TERMS)]
    rows += [("is", p, a, op, str(v), d) for m in (D.QUALITY_TERMS, D.SCALAR_TERMS) for p, (a, op, v, d) in longest(m)]
    return rows


def negated_before(prefix: Column, words=D.QUERY_NEGATIONS, literal: bool = False) -> Column:
    """Whether the clause that ``prefix`` ends in holds a negation.

    ``literal`` also accepts a negation that is only the end of a longer word.
    """
    clause = F.regexp_replace(prefix, r"(?s)^.*(,|;| and )", " ")
    any_of = "|".join(re.escape(w) for w in words)
    return clause.rlike(f"({any_of})" if literal else rf"(^|[^\p{{L}}\p{{N}}])({any_of})")


def parse_query(df: DataFrame, key: str = "query_id", text: str = "text", literal: bool = False) -> DataFrame:
    """Accepted phrases of each text: array ``hits`` (ord, kind, attribute, op, value, description, s0, s1, negated) and ``padded``.

    Each phrase counts at its first delimited place only, and no letter is used twice:
    earlier vocabulary entries take precedence.
    """
    names = ("ord", "kind", "phrase", "attribute", "op", "value", "description")
    terms = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, (i, *row))]) for i, row in enumerate(vocabulary())])
    d = df.select(key, padded(c(text)).alias("padded"))
    t = c("padded")
    near = F.filter(terms, lambda v: t.contains(F.concat(F.lit(" "), v["phrase"])))
    d = d.withColumn("_h", F.transform(near, lambda v: F.struct(
        *[v[n].alias(n) for n in names],
        *[F.nullif(F.instr(t, F.concat(F.lit(" "), v["phrase"], F.lit(stop))), F.lit(0)).alias(f"p{k}") for k, stop in enumerate((" ", ",", ".", ";"))])))
    d = d.withColumn("_h", F.filter(F.transform("_h", lambda v: F.struct(
        *[v[n].alias(n) for n in names], (F.coalesce(*[v[f"p{k}"] for k in range(4)]) + 1).alias("s0"))), lambda v: v["s0"].isNotNull()))
    d = d.withColumn("_h", F.transform("_h", lambda v: F.struct(*[v[n].alias(n) for n in (*names, "s0")], (v["s0"] + F.length(v["phrase"])).alias("s1"))))
    d = d.withColumn("_h", F.aggregate("_h", F.slice("_h", 1, 0), lambda acc, h: F.when(
        F.exists(acc, lambda a: (a["s0"] < h["s1"]) & (h["s0"] < a["s1"])), acc).otherwise(F.array_append(acc, h))))
    return d.withColumn("hits", F.transform("_h", lambda h: F.struct(
        *[h[n].alias(n) for n in ("ord", "kind", "attribute", "op", "value", "description", "s0", "s1")],
        negated_before(F.substring(c("padded"), F.lit(1), h["s0"] - 1), literal=literal).alias("negated")))).drop("_h")


def criteria_of(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    """Long criteria table; the same condition counts once."""
    h = parsed.select(key, F.explode_outer("hits").alias("h")).filter("h.kind = 'is'").select(key, "h.*")
    a = h.groupBy(key, "attribute", "op", "value", "negated").agg(F.min("ord").alias("ord"), F.min_by("description", "ord").alias("description"))
    return a.select(key, "ord", "attribute", "op", "value", "description", "negated")


def sorts_of(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    last = F.try_element_at(F.filter("hits", lambda h: h["kind"] == "sort"), F.lit(-1))
    d = parsed.select(key, F.explode_outer(F.array(last)).alias("l")).filter("l IS NOT NULL")
    return d.select(key, c("l.attribute").alias("sort_by"), (c("l.op") == "desc").alias("sort_desc"))


def unmatched_terms(parsed: DataFrame, key: str = "query_id") -> DataFrame:
    """Words that no phrase used and that carry meaning, in order (``words`` array)."""
    blank = F.aggregate("hits", c("padded"), lambda t, h: F.overlay(t, F.repeat(F.lit(" "), h["s1"] - h["s0"]), h["s0"], h["s1"] - h["s0"]))
    d = parsed.select(key, blank.alias("_t")).select(key, F.regexp_extract_all("_t", F.lit(r"([\p{L}\p{N}-]+)"), F.lit(1)).alias("_w"))
    return d.select(key, F.filter("_w", lambda w: ~w.isin(*D.STOP_WORDS)).alias("words"))


# ------------------------------------------------------------------ briefs

RANKED = sorted(D.LEXICON, key=lambda t: -len(t))
_RUN, _WORD = re.compile("[a-z]+"), re.compile("[a-z0-9'-]+")
_BREAK = re.compile(r"[,.;:!?]|\b(?:" + "|".join(D.CLAUSE_WORDS) + r")\b")
#: Terms by their first run of letters: (what must follow, rank).  A term ends where no letter follows.
_TERMS: dict[str, list[tuple[str, int]]] = {}
for _rank, _term in enumerate(RANKED):
    _TERMS.setdefault(_RUN.match(_term).group(), []).append((_term[_RUN.match(_term).end():], _rank))


def _changes() -> list[list[tuple]]:
    """Per rank the changes of a term as (mode, field, value): * scales, + shifts, the others set."""
    def change(k, v):
        if k[0] in "*+":
            return k[0], k[1:], float(v)
        if k.startswith("transition:"):
            return "bias", k.split(":")[1], float(v)
        return ("bool" if isinstance(v, bool) else "text" if isinstance(v, str) else "cap"), k, v
    return [[change(k, v) for k, v in D.LEXICON[t].items()] for t in RANKED]


CHANGES = _changes()


def words_before(low: str, at: int, count: int = 3) -> tuple[str, ...]:
    """The last ``count`` words before a place, within its clause, however long they are."""
    reach = 64
    while True:
        begin = low.rfind(" ", 0, max(0, at - reach)) + 1
        window, last = low[begin:at], 0
        for m in _BREAK.finditer(window):
            last = m.end()
        found = _WORD.findall(window, last)
        if begin == 0 or last or len(found) >= count:
            return tuple(found[-count:])
        reach *= 4


@functools.lru_cache(65_536)
def context_weight(words: tuple[str, ...]) -> float:
    """Signed strength that the words before a term give to it."""
    joined, w = " ".join(words), 1.0
    for phrase, by in D.INTENSIFIERS.items():
        if phrase in joined and re.search(rf"(?<![a-z]){re.escape(phrase)}(?![a-z])", joined):
            w *= by
    if any(x in D.NEGATORS for x in words):
        return -abs(w)
    return w * 1.25 if "too" in words else w


def _hits(low: str) -> list[tuple[int, int, float]]:
    """(rank, how many hits came before, weight) of every term in a text, by one pass over its runs of letters."""
    out = []
    for m in _RUN.finditer(low):
        for rest, rank in _TERMS.get(m.group(), ()):
            if low.startswith(rest, m.end()) and not _RUN.match(low, m.end() + len(rest)):
                out.append((rank, len(out), context_weight(words_before(low, m.start()))))
    return out


def _once(column: pa.Array) -> tuple[list[str], pa.Array]:
    """The different texts of a batch and, for every row, the place of its text among them: equal texts are read once."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices


def term_hits(df: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """Every whole-word occurrence of every lexicon term, with its rank and its signed weight.

    Texts of any length are read once, by runs of letters, so a word inside a phrase counts as well; the weight comes from the
    three words before, within the clause.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        names = pa.array(RANKED)
        for batch in batches:
            lows, which = _once(batch.column("low"))
            found, which = [_hits(low) for low in lows], which.to_numpy(zero_copy_only=False)
            size = np.array([len(x) for x in found], np.int64)
            n = size[which]
            if n.sum():
                ranks, occ, weights = zip(*(h for x in found for h in x))
                hit = pa.array(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(size) - size)[which], n))
                rank = pa.array(ranks, pa.int32()).take(hit)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), names.take(rank), rank,
                                                  pa.array(occ, pa.int32()).take(hit), pa.array(weights, pa.float64()).take(hit)],
                                                 [key, "term", "rank", "occ", "weight"])
    return df.select(key, padded(c(text)).alias("low")).mapInArrow(run, f"{key} {kind}, term string, rank int, occ int, weight double")


BIASES = ("cut", "whip", "flash", "dissolve")
SWITCHES = {"allow_shake": True, "allow_grain": False}


def _knobs(n: int, at: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Knobs of ``n`` texts from the hits of all of them, each hit with the number of its text; longest terms act first."""
    order = np.lexsort((np.arange(len(at)), rank, at))
    rows = [(a, mode, f, x, w) for a, r, w in zip(at[order].tolist(), rank[order].tolist(), weight[order].tolist()) for mode, f, x in CHANGES[r]]
    by_field: dict[str, list] = {}
    for a, mode, f, x, w in rows:
        by_field.setdefault(f, []).append((a, mode, x, w))
    out: dict[str, np.ndarray] = {f: np.full(n, float(neutral)) for f, (neutral, _, _) in KNOBS.items()}
    out |= {f"bias_{b}": np.ones(n) for b in BIASES} | {f: np.full(n, v) for f, v in SWITCHES.items()}
    out |= {"max_effects_per_clip": np.full(n, 4.0), "shot_size_preference": np.full(n, None, object), "matched": np.bincount(at, minlength=n).astype(np.int64)}
    for f, found in by_field.items():
        v = out[f"bias_{f}" if f in BIASES else f]
        for a, mode, x, w in found:
            if mode == "*":
                v[a] *= max(0.05, 1.0 + (x - 1.0) * w)
            elif mode == "+":
                v[a] += x * w
            elif mode == "bias":
                v[a] = max(0.0, 1.0 + (x - 1.0) * w)
            elif mode == "bool":
                v[a] = x if w > 0 else not x
            elif w > 0:
                v[a] = min(v[a], x) if mode == "cap" else x
    return out


def interpret_brief(df: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """Constraint knobs of every text, clamped; texts without known terms keep the neutral values.

    One row per row, without a shuffle: a text's hits are folded into its knobs where it is read.
    """
    types = {**{f: "double" for f in KNOBS}, **{f"bias_{b}": "double" for b in BIASES}, **{f: "boolean" for f in SWITCHES},
             "max_effects_per_clip": "double", "shot_size_preference": "string", "matched": "long"}
    kinds = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}

    def run(batches):
        for batch in batches:
            lows, which = _once(batch.column("low"))
            hits = [(k, rank, w) for k, low in enumerate(lows) for rank, _, w in _hits(low)]
            at, rank, weight = (np.array(x, t) for x, t in zip(zip(*hits) if hits else ((), (), ()), (np.int64, np.int64, float)))
            got = _knobs(len(lows), at, rank, weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[f], kinds[t]).take(which) for f, t in types.items())], [key, *types])
    schema = ", ".join(f"{n} {t}" for n, t in {key: dict(df.dtypes)[key], **types}.items())
    return clamp(df.select(key, padded(c(text)).alias("low")).mapInArrow(run, schema))


def clamp(df: DataFrame) -> DataFrame:
    """Every knob and transition bias inside the range the rest can honour."""
    have = set(df.columns)
    d = df.withColumns({f: clip(c(f).cast("double"), lo, hi) for f, (_, lo, hi) in KNOBS.items() if f in have and lo is not None})
    if "max_shot_ceiling" in have:
        d = d.withColumn("max_shot_ceiling", clip(c("max_shot_ceiling"), c("min_shot_floor") + 0.1, KNOBS["max_shot_ceiling"][2]))
    if "max_effects_per_clip" in have:
        d = d.withColumn("max_effects_per_clip", c("max_effects_per_clip").cast("long"))
    return d.withColumns({f"bias_{b}": clip(c(f"bias_{b}"), *BIAS_RANGE) for b in BIASES if f"bias_{b}" in have})


def constraint_summary() -> Column:
    """One line on what a brief was taken to mean."""
    p = c("pacing_multiplier")
    strong = F.filter(F.array(*[F.when(c(f"bias_{b}") > 1.4, F.lit(b)) for b in BIASES[1:]]), lambda x: x.isNotNull())
    bits = F.concat_ws("; ",
        F.when(p < 0.85, F.format_string("faster cutting (x%.2f shot length)", p)).when(p > 1.15, F.format_string("slower cutting (x%.2f shot length)", p)),
        F.when((c("intensity_gain") > 1.1) | (c("intensity_offset") > 0.05), "higher intensity").when((c("intensity_gain") < 0.9) | (c("intensity_offset") < -0.05), "lower intensity"),
        F.when(c("motion_preference") > 0.15, "kinetic shots").when(c("motion_preference") < -0.15, "still shots"),
        F.when(c("continuity_weight") > 1.15, "smooth continuity").when(c("continuity_weight") < 0.85, "collision cutting"),
        F.when(c("effect_density") > 0.65, "heavy effects").when(c("effect_density") < 0.35, "restrained effects"),
        F.when(F.size(strong) > 0, F.concat(F.lit("favours "), F.array_join(strong, "/"))),
        F.when(c("bias_cut") > 1.4, "hard cuts"))
    return F.when(bits == "", "no strong preferences detected").otherwise(bits)


# ------------------------------------------------------------------ editing notes

def _any_in(text: Column, words) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def _first_word(text: Column, words) -> Column:
    """First entry of ``words`` that occurs as a whole word."""
    return F.coalesce(*[F.when(text.contains(w) & text.rlike(rf"\b{re.escape(w)}\b"), F.lit(w)) for w in words])


MEASURED = ("shake", "brightness", "sharpness", "noise", "duration")


def parse_notes(notes: DataFrame, clips: DataFrame, note: str = "note_id", key: str = "timeline_id", pos: str = "idx") -> DataFrame:
    """Directives, brief texts and unresolved clauses of editing notes.

    ``notes``: note_id, timeline_id, text.  ``clips``: timeline_id, idx, slot_index, source_id, dur and
    the measures a phrase may refer to.  Result rows: kind is a directive kind, ``brief``
    or ``unresolved``; every clause is judged by itself, the first fitting rule decides.
    """
    have = set(clips.columns)
    pick = F.struct("slot_index", "source_id", "dur")
    ends = [F.count(F.lit(1)).alias("_n"), F.min_by(pick, pos).alias("_first"), F.max_by(pick, pos).alias("_last")]
    refs = {}
    for attr, way in sorted(set(D.ATTRIBUTE_WORDS.values())):
        col = "dur" if attr == "duration" else attr
        if col in have:
            v = c(col)
            known = v.isNotNull()
            best = (F.max_by(pick, F.when(known, F.struct(v, -c(pos)))) if way == "max" else F.min_by(pick, F.when(known, F.struct(v, c(pos)))))
            refs[(attr, way)] = f"_ref_{attr}_{way}"
            ends.append(best.alias(refs[(attr, way)]))
    per = clips.groupBy(key).agg(*ends)
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"^\s+|\s+$", ""), F.lit(" "))
    d = notes.select(note, key, F.posexplode(F.split(t, r"[,;.]| and ")).alias("clause_no", "clause")).withColumn("clause", F.regexp_replace("clause", r"^\s+|\s+$", ""))
    d = d.filter("clause <> ''").join(per, key, "left")
    t = c("clause")
    n = F.coalesce("_n", F.lit(0))
    number = F.nullif(F.regexp_extract(t, r"\b(?:clip|shot|cut)\s*#?\s*(\d+)\b", 1), F.lit("")).try_cast("long")
    ordinal = lookup(D.ORDINALS, _first_word(t, D.ORDINALS)).cast("long")
    last, first = (n > 0) & t.rlike(r"\b(last|final)\b"), (n > 0) & t.rlike(r"\b(first|opening)\b")
    nth = F.when(last | first, F.lit(None).cast("long")).otherwise(F.coalesce(number, ordinal))
    word = _first_word(t, D.ATTRIBUTE_WORDS)
    d = d.withColumns({"_last_hit": last, "_first_hit": first, "_nth": nth, "_word": word, "negated": _any_in(F.concat(F.lit(" "), t, F.lit(" ")), D.NOTE_NEGATIONS)})
    d = d.withColumn("_out", c("_nth").isNotNull() & ((c("_nth") < 1) | (c("_nth") > n)))
    spot = clips.select(key, (c(pos) + 1).cast("long").alias("_nth"), pick.alias("_at"))
    d = d.join(spot, [key, "_nth"], "left")
    ref = F.lit(None).cast(clips.select(pick.alias("p")).schema["p"].dataType)
    for w, (attr, way) in D.ATTRIBUTE_WORDS.items():
        if (attr, way) in refs:
            ref = F.when(c("_word") == w, c(refs[(attr, way)])).otherwise(ref)
    placed = c("_last_hit") | c("_first_hit") | c("_nth").isNotNull()
    target = F.when(c("_last_hit"), c("_last")).when(c("_first_hit"), c("_first")).when(c("_nth").isNotNull(), c("_at")).otherwise(ref)
    d = d.withColumns({"_target": target, "_unmeasured": ~placed & c("_word").isNotNull() & target.isNull()})
    has, neg = c("_target").isNotNull(), c("negated")
    d = d.withColumns({
        "_secs": F.nullif(F.regexp_extract(t, r"([\d.]+)\s*(?:s|sec|seconds)\b", 1), F.lit("")).try_cast("double"), "_longer": _any_in(t, D.LONGER), "_effect": _first_word(t, D.EFFECT_WORDS),
        "_tr": F.nullif(F.regexp_extract(t, r"\b(?:use|make it|change to)?\s*a?\s*(cut|dissolve|flash|whip)\b", 1), F.lit(""))})
    seconds, longer, effect_word, transition = c("_secs"), c("_longer"), c("_effect"), c("_tr")
    hint = _any_in(t, D.WHOLE_PIECE_HINTS)
    kind = (F.when(c("_out"), "unresolved").when(has & (longer | _any_in(t, D.SHORTER)), "set_duration")
             .when(has & neg & ~_any_in(t, list(D.EFFECT_WORDS)), "reject_shot")
             .when(has & t.rlike(r"\b(keep|lock|leave|don't touch|dont touch)\b"), "lock_clip")
             .when(neg & effect_word.isNotNull(), "ban_effect").when(has & transition.isNotNull() & ~neg, "force_transition").when(hint, "brief"))
    d = d.withColumns({"kind": kind, "_seconds": F.round(F.coalesce(seconds, c("_target.dur") * F.when(longer, 1.5).otherwise(0.6)), 3), "_fx": lookup(D.EFFECT_WORDS, effect_word)})
    # a whole-piece clause must change something in the brief vocabulary; it is read where it lies, and no clause is joined or computed twice
    k = c("kind")
    d = d.select(F.struct(
        note, key, "clause_no", "clause", k, F.when(k.isin("set_duration", "lock_clip", "force_transition"), c("_target.slot_index")).alias("slot_index"),
        F.when(k == "reject_shot", c("_target.source_id")).alias("shot_id"),
        F.when(k == "set_duration", c("_seconds").cast("string")).when(k == "ban_effect", c("_fx")).when(k == "force_transition", c("_tr")).when(k == "brief", c("clause")).alias("value"),
        F.when(c("_unmeasured") & ~c("_out"), c("_word")).alias("word")).alias("at"), F.when(k == "brief", c("clause")).alias("text"))
    acts = None
    for f in D.ACTING_KNOBS:
        moved = F.abs(c(f) - F.lit(float(KNOBS[f][0]))) > 1e-12
        acts = moved if acts is None else acts | moved
    d = interpret_brief(d, "at", "text").select("at.*", F.coalesce(acts, F.lit(False)).alias("_acts"))
    d = d.withColumn("kind", F.when((k == "brief") & ~c("_acts"), "unresolved").otherwise(F.coalesce("kind", F.when(~t.isin("the", "it"), "unresolved"))))
    sides = F.array(F.when(k.isNotNull(), F.lit(False)), F.when(c("word").isNotNull(), F.lit(True)))
    d = d.withColumn("_extra", F.explode(F.filter(sides, lambda x: x.isNotNull())))
    own = ~c("_extra")
    return d.select(note, key, "clause_no", "clause", F.when(own, k).otherwise("unmeasured").alias("kind"), F.when(own, c("slot_index")).cast("long").alias("slot_index"),
                    F.when(own, c("shot_id")).alias("shot_id"), F.when(own, F.when(k != "unresolved", c("value"))).otherwise(c("word")).alias("value"))
