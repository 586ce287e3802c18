"""Language rules over part names, documents and texts composed from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..operators import search as S, text as T
from ..rules import words as D
from ..rules.planning import KNOBS
from ..session import stage, table
from ..sources import views as V
from .oracle import r6, sql
from .registry import query
from .timeline_queries import TL, timeline

c = F.col
HOW = ("", "very", "not", "slightly", "too", "extremely", "not too", "a bit")
WEIGHT = {"": 1.0, "very": 1.6, "not": -1.0, "slightly": 0.45, "too": 1.25, "extremely": 2.0, "not too": -1.0, "a bit": 0.5}
WHAT = ("fast", "slow", "chaotic", "restrained", "warm", "cold", "hard cuts", "minimal", "punchy", "smooth transitions", "intense", "calmer", "intimate", "gritty", "seamless", "wide")


def _pick(values, idx):
    return F.get(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def briefs(spark, sf):
    k, s = c("l_partkey"), c("l_suppkey")
    d = V.shots(spark, sf).select("shot_id", _pick(HOW, k % 8).alias("h1"), _pick(WHAT, s % 16).alias("w1"), _pick(HOW, (k * 3 + s) % 8).alias("h2"), _pick(WHAT, (k * 7 + 3) % 16).alias("w2"))
    return d.select(c("shot_id").alias("text_id"), F.concat(F.lit("an edit, "), "h1", F.lit(" "), "w1", F.lit("; "), "h2", F.lit(" "), "w2", F.lit(".")).alias("text"))


def _arr(v):
    return "[" + ", ".join(f"'{x}'" for x in v) + "]"


LEX = []
for _said, _t in [*[(w, w) for w in WHAT], ("smooth transitions", "smooth")]:     # the phrase also holds the word
    for _k, _v in D.LEXICON[_t].items():
        if _k[0] in "*+":
            LEX.append((T.RANKED.index(_t), _said, _k[0], _k[1:], float(_v)))
        elif _k.startswith("transition:"):
            LEX.append((T.RANKED.index(_t), _said, "b", _k[11:], float(_v)))
BRIEF = [
    ("lx", "SELECT * FROM (VALUES " + ", ".join(f"({r}, '{t}', '{m}', '{f}', {v}::DOUBLE)" for r, t, m, f, v in LEX) + ") v(rank, term, mode, field, num)"),
    ("wt", "SELECT * FROM (VALUES " + ", ".join(f"('{h}', {w}::DOUBLE)" for h, w in WEIGHT.items()) + ") v(how, w)"),
    ("oc", f"""SELECT shot_id, 0 AS occ, {_arr(HOW)}[CAST(l_partkey % 8 AS INT) + 1] AS how, {_arr(WHAT)}[CAST(l_suppkey % 16 AS INT) + 1] AS term FROM shots
        UNION ALL SELECT shot_id, 1, {_arr(HOW)}[CAST((l_partkey * 3 + l_suppkey) % 8 AS INT) + 1], {_arr(WHAT)}[CAST((l_partkey * 7 + 3) % 16 AS INT) + 1] FROM shots"""),
    ("dl", "SELECT shot_id, occ, rank, mode, field, num, w FROM oc JOIN wt USING (how) LEFT JOIN lx USING (term)"),
]


def _knob(f, default):
    m = f"coalesce(product(greatest(0.05, 1 + (num - 1) * w)) FILTER (mode = '*' AND field = '{f}'), 1)"
    a = f"coalesce(sum(num * w) FILTER (mode = '+' AND field = '{f}'), 0)"
    _, lo, hi = KNOBS[f]
    return f"least(greatest({default} * {m} + {a}, {lo}), {hi})"


FIELDS = ("pacing_multiplier", "intensity_offset", "motion_preference", "continuity_weight", "quality_weight", "diversity", "prefer_faces", "effect_density", "contrast_delta", "saturation_delta", "warmth_delta")


def _bias(b):
    return f"least(greatest(coalesce(arg_max(greatest(0, 1 + (num - 1) * w), rank * 10 + occ) FILTER (mode = 'b' AND field = '{b}'), 1), 0), 4)"


KN = ("kn", "SELECT shot_id AS text_id, " + ", ".join(f"{_knob(f, KNOBS[f][0])} AS {f}" for f in FIELDS) + ", " + ", ".join(f"{_bias(b)} AS bias_{b}" for b in T.BIASES) + " FROM dl GROUP BY 1")
OUT = (*FIELDS, *[f"bias_{b}" for b in T.BIASES])


@query("interpret_brief", sql("SELECT text_id, " + ", ".join(f"{r6(f)} AS {f}" for f in OUT) + " FROM kn", *BRIEF, KN))
def interpret_brief(spark, sf):
    return T.interpret_brief(briefs(spark, sf)).select("text_id", *[R(c(f)).alias(f) for f in OUT])


SAID = f"""(SELECT unnest({_arr(WHAT)}) AS term, unnest({_arr(WHAT)}) AS said UNION ALL VALUES {', '.join(f"('{a}', '{b}')" for a in WHAT for b in T.RANKED if b != a and b in a.split(' '))})"""


@query("context_weight", sql(f"""SELECT shot_id AS text_id, x.said AS term, {r6('w')} AS weight FROM oc JOIN wt USING (how)
    JOIN {SAID} x USING (term)""", *BRIEF[1:3]))
def context_weight(spark, sf):
    d = T.term_hits(briefs(spark, sf))
    return d.select("text_id", "term", R(c("weight")).alias("weight"))


def _asked(text, n):
    """A whole text that closes with a request made from a number."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(". "), _pick(HOW, n % 8), F.lit(" "), _pick(WHAT, n % 16), F.lit("."))


@query("document_terms", sql(f"SELECT doc_id, said AS term, {r6('w')} AS weight FROM (SELECT doc_id, {_arr(HOW)}[CAST(doc_id % 8 AS INT) + 1] AS how, {_arr(WHAT)}[CAST(doc_id % 16 AS INT) + 1] AS term FROM documents) JOIN wt USING (how) JOIN {SAID} USING (term)", BRIEF[1]))
def document_terms(spark, sf):
    """Style terms, with their weight, in whole documents that close with a request."""
    d = table(spark, sf, "documents").withColumn("text", _asked(c("text"), c("doc_id")))
    return T.term_hits(d, "doc_id").select("doc_id", "term", R(c("weight")).alias("weight"))


@query("conversation_briefs", sql(f"""SELECT conv_id, turn, {r6(_knob("pacing_multiplier", KNOBS["pacing_multiplier"][0]))} AS pacing_multiplier, {r6(_knob("warmth_delta", KNOBS["warmth_delta"][0]))} AS warmth_delta, count(DISTINCT said) AS matched FROM (
    SELECT conv_id, turn, said, w, mode, field, num FROM (SELECT conv_id, turn, {_arr(HOW)}[CAST((conv_id * 7 + turn) % 8 AS INT) + 1] AS how, {_arr(WHAT)}[CAST((conv_id * 7 + turn) % 16 AS INT) + 1] AS term FROM conversations)
    JOIN wt USING (how) JOIN {SAID} USING (term) LEFT JOIN (SELECT DISTINCT rank, mode, field, num, term FROM lx) l USING (term)) GROUP BY 1, 2""", *BRIEF[:2]))
def conversation_briefs(spark, sf):
    """What the turns of conversations ask for; every turn closes with a request."""
    d = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("at"), _asked(c("text"), c("conv_id") * 7 + c("turn")).alias("text"))
    return T.interpret_brief(d, "at").select("at.conv_id", "at.turn", R(c("pacing_multiplier")).alias("pacing_multiplier"), R(c("warmth_delta")).alias("warmth_delta"), "matched")


@query("clamp_knobs", sql(f"""SELECT shot_id, {r6('least(greatest(duration, 0.35), 3.0)')} AS pacing_multiplier, {r6('least(greatest(shake, 0.10), 1.5)')} AS min_shot_floor,
    {r6('least(greatest(flow_magnitude * 2, least(greatest(shake, 0.10), 1.5) + 0.1), 8.0)')} AS max_shot_ceiling, {r6('least(greatest(warmth, -0.6), 0.6)')} AS warmth_delta, {r6('least(greatest(subject_motion, 0), 4)')} AS bias_whip FROM shots"""))
def clamp_knobs(spark, sf):
    d = V.shots(spark, sf).select("shot_id", c("duration").alias("pacing_multiplier"), c("shake").alias("min_shot_floor"), (c("flow_magnitude") * 2).alias("max_shot_ceiling"),
                                  c("warmth").alias("warmth_delta"), c("subject_motion").alias("bias_whip"))
    return T.clamp(d).select("shot_id", *[R(c(x)).alias(x) for x in ("pacing_multiplier", "min_shot_floor", "max_shot_ceiling", "warmth_delta", "bias_whip")])


@query("constraint_summary", sql("""SELECT text_id, CASE WHEN s = '' THEN 'no strong preferences detected' ELSE s END AS summary FROM (SELECT text_id, concat_ws('; ',
    CASE WHEN intensity_offset > 0.05 THEN 'higher intensity' WHEN intensity_offset < -0.05 THEN 'lower intensity' END,
    CASE WHEN motion_preference > 0.15 THEN 'kinetic shots' WHEN motion_preference < -0.15 THEN 'still shots' END, CASE WHEN continuity_weight > 1.15 THEN 'smooth continuity' WHEN continuity_weight < 0.85 THEN 'collision cutting' END,
    CASE WHEN effect_density > 0.65 THEN 'heavy effects' WHEN effect_density < 0.35 THEN 'restrained effects' END,
    CASE WHEN bias_whip > 1.4 OR bias_flash > 1.4 OR bias_dissolve > 1.4 THEN 'favours ' || concat_ws('/', CASE WHEN bias_whip > 1.4 THEN 'whip' END, CASE WHEN bias_flash > 1.4 THEN 'flash' END, CASE WHEN bias_dissolve > 1.4 THEN 'dissolve' END) END,
    CASE WHEN bias_cut > 1.4 THEN 'hard cuts' END) AS s FROM kn)""", *BRIEF, KN))
def constraint_summary(spark, sf):
    d = T.interpret_brief(briefs(spark, sf)).withColumns({"pacing_multiplier": F.lit(1.0), "intensity_gain": F.lit(1.0)})
    return d.select("text_id", T.constraint_summary().alias("summary"))


def requests(spark, sf):
    """A request per part: a phrase about its look, one negated or plain, and its own name."""
    k = c("p_partkey")
    say = _pick(("no handheld", "talking head interview", "close up", "without faces", "pan left", "high quality", "best"), k % 7)
    light = _pick(("dark", "bright", "calm", "warm", "energetic"), k % 5)
    return table(spark, sf, "part").select(k.cast("string").alias("query_id"), F.concat(F.lit("find "), say, F.lit(", "), light, F.lit(" shots of "), c("p_name")).alias("text"))


REQ = [
    ("rq", """SELECT CAST(p_partkey AS VARCHAR) AS query_id, p_partkey % 7 AS a, p_partkey % 5 AS b, p_name LIKE 'cold %' AS cold, p_name FROM part"""),
    ("cr", """SELECT query_id, ['camera_movement', 'speech', 'shot_size', 'faces', 'camera_movement', 'technical_quality', NULL][a + 1] AS attribute, ['==', 'flag', '==', 'flag', '==', '>', NULL][a + 1] AS op,
          ['handheld', 'True', 'close_up', 'True', 'pan_left', '0.6', NULL][a + 1] AS value, a IN (0, 3) AS negated FROM rq WHERE a < 6
        UNION ALL SELECT query_id, ['brightness', 'brightness', 'visual_energy', 'warmth', 'visual_energy'][b + 1], ['<', '>', '<', '>', '>'][b + 1], ['0.35', '0.6', '0.4', '0.55', '0.6'][b + 1], false FROM rq
        UNION ALL SELECT query_id, 'warmth', '<', '0.45', false FROM rq WHERE cold"""),
]


@query("parse_query", sql("SELECT query_id, attribute, op, value, negated FROM cr", *REQ))
def parse_query(spark, sf):
    return T.criteria_of(stage(T.parse_query(requests(spark, sf)))).select("query_id", "attribute", "op", "value", "negated")


@query("query_sorts", sql("SELECT query_id, 'technical_quality' AS sort_by, true AS sort_desc FROM rq WHERE a = 6", *REQ[:1]))
def query_sorts(spark, sf):
    return T.sorts_of(T.parse_query(requests(spark, sf)))


@query("unmatched_terms", sql("""SELECT query_id, CASE WHEN a = 1 THEN '' ELSE '' END || CASE WHEN cold THEN split_part(p_name, ' ', 2) ELSE replace(p_name, ' ', ',') END AS words FROM rq""", *REQ[:1]))
def unmatched_terms(spark, sf):
    d = T.unmatched_terms(T.parse_query(requests(spark, sf)))
    return d.select("query_id", F.array_join("words", ",").alias("words"))


@query("unmatched_documents", sql("""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}-]+'), lambda w: w NOT IN (""" + ", ".join(f"'{w}'" for w in D.STOP_WORDS) + """))) AS BIGINT) AS words FROM documents"""))
def unmatched_documents(spark, sf):
    """Meaningful words of every whole document: those no vocabulary covers plus those a phrase used."""
    parsed = stage(T.parse_query(table(spark, sf, "documents"), "doc_id"))
    used = F.transform("hits", lambda h: F.size(F.filter(F.split(F.substring(c("padded"), h["s0"], h["s1"] - h["s0"]), " "), lambda w: ~w.isin(*D.STOP_WORDS))))
    used = parsed.select("doc_id", F.aggregate(used, F.lit(0), lambda a, x: a + x).alias("used"))
    d = T.unmatched_terms(parsed, "doc_id").join(used, "doc_id")
    return d.select("doc_id", (F.size("words") + c("used")).cast("long").alias("words"))


@query("negated_terms", sql("""SELECT shot_id, l_partkey % 4 IN (0, 2) AS negated FROM shots"""))
def negated_terms(spark, sf):
    pre = _pick((" no ", " no people, ", " a calm pan without ", " someone and "), c("l_partkey") % 4)
    return V.shots(spark, sf).select("shot_id", T.negated_before(pre).alias("negated"))


@query("search_by_text")
def search_by_text(spark, sf):
    """Requests made from the part types, parsed and bound into one search of the whole library."""
    types = table(spark, sf, "part").groupBy("p_type").agg(F.max("p_size").alias("k"))
    say = F.when(F.length("p_type") % 2 == 0, "static shots, no handheld, ").otherwise("bright shots with faces, ")
    asked = types.select(c("p_type").alias("query_id"), F.concat(say, c("p_type")).alias("text"))
    parsed = stage(T.parse_query(asked))
    lib = V.shots(spark, sf)
    out = None
    for group in S.bind(T.criteria_of(parsed), T.sorts_of(parsed)):
        d = S.search(lib, group)
        out = d if out is None else out.unionByName(d)
    return out.select("query_id", c("rank").cast("long").alias("rank"), "shot_id", R(c("score")).alias("score"))


SAY = ("hold the last clip longer", "tighten clip 3", "lose the shaky one", "lock the opening shot", "no flash", "use a dissolve on the second clip", "make it calmer", "clip 9999 shorter", "something else")
NOTE = ("nt", "SELECT shot_id AS note_id, l_suppkey AS timeline_id, l_partkey % 9 AS k FROM shots")


@query("parse_notes", sql("""SELECT note_id, ['set_duration', 'set_duration', 'reject_shot', 'lock_clip', 'ban_effect', 'force_transition', 'brief', 'unresolved', 'unresolved'][k + 1] AS kind,
    CASE k WHEN 0 THEN mx WHEN 1 THEN 2 WHEN 3 THEN 0 WHEN 5 THEN 1 END AS slot_index, CASE WHEN k = 2 THEN sid END AS shot_id,
    """ + r6("CASE k WHEN 0 THEN round(ld * 1.5, 3) WHEN 1 THEN round(d3 * 0.6, 3) END") + """ AS seconds, CASE k WHEN 4 THEN 'flash' WHEN 5 THEN 'dissolve' WHEN 6 THEN 'make it calmer' END AS value
    FROM nt JOIN (SELECT timeline_id, max(idx) AS mx, arg_max(dur, idx) AS ld, max(CASE WHEN idx = 2 THEN dur END) AS d3 FROM tl GROUP BY 1) USING (timeline_id)
    JOIN (SELECT timeline_id, shot_id AS sid FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY shake DESC, idx) AS r FROM tl) WHERE r = 1) USING (timeline_id)""", TL, NOTE))
def parse_notes(spark, sf):
    t = stage(timeline(spark, sf).select("timeline_id", "idx", c("idx").alias("slot_index"), c("shot_id").alias("source_id"), "dur", "shake", "brightness", "sharpness", "noise"))
    notes = V.shots(spark, sf).select(c("shot_id").alias("note_id"), c("l_suppkey").alias("timeline_id"), _pick(SAY, c("l_partkey") % 9).alias("text"))
    d = T.parse_notes(notes, t)
    secs = F.when(c("kind") == "set_duration", c("value").cast("double"))
    return d.select("note_id", "kind", "slot_index", "shot_id", R(secs).alias("seconds"), F.when(c("kind") != "set_duration", c("value")).alias("value"))
