"""Search, identifiers, ingest bookkeeping and probe records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..functions.maths import r6 as R
from ..operators import cells as X, search as S
from ..operators.search import Criterion as C, Query
from ..session import checkpoint_dir, table
from ..sources import media as A, views as V
from .oracle import r6, sql
from .registry import query

c = F.col

WANTED = (
    Query("bright_static", (C("brightness", ">", 0.6, "brightness above 0.6"), C("camera_movement", "==", "static", "camera movement is static"),
                            C("camera_movement", "==", "handheld", "camera movement is handheld", True), C("framing", "==", "wide", "shot size is wide"))),
    Query("lively_pans", (C("camera_movement", "prefix", "pan", "camera movement is pan"), C("visual_energy", ">", 0.6, "visual energy above 0.6"),
                          C("faces", "flag", True, "contains faces")), "duration", True, 20),
    Query("dark_clean", (C("brightness", "<", 0.35, "brightness below 0.35"), C("noise", "<", 0.05, "noise below 0.05"),
                         C("max_useful_duration", "<", 0.3, "cap below 0.3", True)), "brightness", False, 15),
)


def _library(spark, sf):
    return V.shots(spark, sf).withColumn("framing", F.lit("unknown"))


def _hit(qid, tests, sort, limit):
    met = " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t, _ in tests)
    got = ", ".join(f"CASE WHEN {t} THEN '{d}' END" for t, d in tests)
    no = ", ".join(f"CASE WHEN NOT ({t}) THEN '{d}' END" for t, d in tests)
    return f"""SELECT * FROM (SELECT '{qid}' AS query_id, row_number() OVER (ORDER BY score DESC, {sort} DESC, shot_id) AS rank, shot_id, score, matched, unmet FROM (
      SELECT *, ({met}) / {len(tests)}.0::DOUBLE AS score, array_to_string(list_filter([{got}], lambda x: x IS NOT NULL), '; ') AS matched,
        array_to_string(list_filter([{no}], lambda x: x IS NOT NULL), '; ') AS unmet FROM shots WHERE handling <> 'reject') WHERE score > 0) WHERE rank <= {limit}"""


FOUND = " UNION ALL ".join([
    _hit("bright_static", [("brightness > 0.6", "brightness above 0.6"), ("camera_movement = 'static'", "camera movement is static"),
                           ("camera_movement <> 'handheld'", "not camera movement is handheld")], "technical_quality", 10),
    _hit("lively_pans", [("camera_movement LIKE 'pan%'", "camera movement is pan"), ("visual_energy > 0.6", "visual energy above 0.6"),
                         ("faces > 0", "contains faces")], "duration", 20),
    _hit("dark_clean", [("brightness < 0.35", "brightness below 0.35"), ("noise < 0.05", "noise below 0.05"),
                        ("NOT coalesce(max_useful_duration < 0.3, false)", "not cap below 0.3")], "(-brightness)", 15)])


@query("find_attributes", sql(f"SELECT query_id, rank, shot_id, {r6('score')} AS score, matched, unmet FROM ({FOUND})"))
def find_attributes(spark, sf):
    d = S.search(_library(spark, sf), WANTED)
    return d.select("query_id", c("rank").cast("long").alias("rank"), "shot_id", R(c("score")).alias("score"),
                    F.array_join("matched", "; ").alias("matched"), F.array_join("unmet", "; ").alias("unmet"))


@query("inert_criteria", sql("""SELECT 'bright_static' AS query_id, 'shot size is wide' AS criterion FROM
    (SELECT bool_and(coalesce(framing, 'unknown') = 'unknown') AS x FROM (SELECT 'unknown' AS framing FROM shots WHERE handling <> 'reject')) WHERE x"""))
def inert_criteria(spark, sf):
    return S.inert_criteria(_library(spark, sf), WANTED)


@query("usable_shots", sql("SELECT handling, count(*) AS shots FROM shots WHERE handling NOT IN ('reject', 'use_briefly') GROUP BY 1"))
def usable_shots(spark, sf):
    return S.usable_shots(V.shots(spark, sf), False).groupBy("handling").agg(F.count(F.lit(1)).alias("shots"))


@query("filter_predicate", sql("SELECT shot_id FROM shots WHERE sharpness > 0.6 AND camera_movement IN ('pan_left', 'push_in')"))
def filter_predicate(spark, sf):
    return S.where(V.shots(spark, sf), (c("sharpness") > 0.6) & c("camera_movement").isin("pan_left", "push_in")).select("shot_id")


@query("eval_criteria", sql("""SELECT shot_id, brightness > 0.6 AS a, camera_movement <> 'handheld' AS b, NOT coalesce(max_useful_duration < 0.6, false) AS d,
    coalesce(max_useful_duration < 0.6, false) AS e, true AS f FROM shots"""))
def eval_criteria(spark, sf):
    d = V.shots(spark, sf)
    t = dict(d.dtypes)
    return d.select("shot_id", S.passes(C("brightness", ">", 0.6), t).alias("a"), S.passes(C("camera_movement", "==", "handheld", "", True), t).alias("b"),
                    S.passes(C("max_useful_duration", "<", 0.6, "", True), t).alias("d"), S.passes(C("max_useful_duration", "<", 0.6), t).alias("e"),
                    S.passes(C("never_measured", "flag", True, "", True), t).alias("f"))


CENTRES = ("ctr", """SELECT label, list(s ORDER BY d) AS q FROM (SELECT label, d, avg(CAST(x AS DOUBLE)) AS s FROM
    (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS d FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")


def _centres(spark, sf):
    e = table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(c("x").cast("double")).alias("s"))
    arr = F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda z: z["s"])
    return means.groupBy("label").agg(arr.alias("embedding")).select(
        c("label").cast("long").alias("query_id"), "embedding", F.lit(None).cast("long").alias("exclude"))


@query("vector_topk", sql(f"""SELECT * FROM (SELECT CAST(label AS BIGINT) AS query_id, vec_id, {r6('sim')} AS similarity, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM (
    SELECT c.label, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q)) AS sim FROM embeddings e, ctr c)) WHERE rank <= 10""", CENTRES))
def vector_topk(spark, sf):
    d = S.vector_topk(table(spark, sf, "embeddings"), _centres(spark, sf), 10)
    return d.select("query_id", "vec_id", R(c("similarity")).alias("similarity"), c("rank").cast("long").alias("rank"))


FIRSTS = ("fst", "SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1")


@query("find_similar", sql(f"""SELECT * FROM (SELECT query_id, vec_id, {r6('sim')} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS sim
    FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT vec_id FROM fst) AND q.vec_id <> e.vec_id)) WHERE rank <= 5""", FIRSTS))
def find_similar(spark, sf):
    e = table(spark, sf, "embeddings")
    d = S.find_similar(e, e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id"), 5)
    return d.select("query_id", "vec_id", R(c("similarity")).alias("similarity"), c("rank").cast("long").alias("rank"))


@query("semantic_search", sql(f"""SELECT * FROM (SELECT CAST(label AS BIGINT) AS query_id, vec_id, {r6('sim')} AS similarity, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM (
    SELECT c.label, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS sim
    FROM embeddings e, ctr c WHERE e.label % 2 = 0)) WHERE rank <= 5""", CENTRES))
def semantic_search(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("embedding", F.when(c("label") % 2 == 0, c("embedding")))
    d = S.semantic_search(e, _centres(spark, sf), 5, "vec_id", "embedding")
    return d.select("query_id", "vec_id", R(c("similarity")).alias("similarity"), c("rank").cast("long").alias("rank"))


NEIGHBOURS = f"""SELECT * FROM (SELECT query_id, vec_id, {r6('sim')} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
    / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS sim FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 10"""


def _hundredths(spark, sf):
    e = table(spark, sf, "embeddings")
    return e, e.filter("vec_id % 100 = 0").select(c("vec_id").alias("query_id"), "embedding", c("vec_id").alias("exclude"))


@query("cell_neighbours", sql(NEIGHBOURS))
def cell_neighbours(spark, sf):
    """Ten nearest by cosine of every hundredth vector, by cells."""
    e, q = _hundredths(spark, sf)
    d, _ = X.search(X.build(e, unit=True), q, 10)
    return d.select("query_id", "vec_id", R(c("similarity")).alias("similarity"), c("rank").cast("long").alias("rank"))


@query("cell_visits")
def cell_visits(spark, sf):
    """How many cells and vectors each of these queries had to look at."""
    e, q = _hundredths(spark, sf)
    return X.search(X.build(e, unit=True), q, 10)[1]


@query("recall_at_k", sql(f"""SELECT query_id, {r6('avg(CASE WHEN shot_id IN (SELECT f.shot_id FROM found f WHERE f.query_id = t.query_id) THEN 1.0 ELSE 0 END)')} AS recall,
    avg(CASE WHEN shot_id IN (SELECT f.shot_id FROM found f WHERE f.query_id = t.query_id) THEN 1.0 ELSE 0 END) >= 0.5 AS passed
    FROM (SELECT 'lively_pans' AS query_id, shot_id FROM shots WHERE camera_movement LIKE 'pan%' AND duration >= 5 AND faces > 0) t GROUP BY 1""", ("found", FOUND)))
def recall_at_k(spark, sf):
    lib = _library(spark, sf)
    truth = lib.filter("camera_movement LIKE 'pan%' AND duration >= 5 AND faces > 0").select(F.lit("lively_pans").alias("query_id"), "shot_id")
    d = S.recall_at_k(S.search(lib, WANTED), truth)
    return d.select("query_id", R(c("recall")).alias("recall"), "passed")


@query("negation_check", sql("""SELECT count(*) AS leaks FROM (SELECT shot_id FROM shots WHERE handling <> 'reject' AND camera_movement = 'handheld'
    INTERSECT SELECT shot_id FROM shots WHERE handling <> 'reject' AND camera_movement <> 'handheld')"""))
def negation_check(spark, sf):
    lib = V.shots(spark, sf)
    t = dict(lib.dtypes)
    pos = S.usable_shots(lib).filter(S.passes(C("camera_movement", "==", "handheld"), t))
    neg = S.usable_shots(lib).filter(S.passes(C("camera_movement", "==", "handheld", "", True), t))
    return S.negation_leaks(pos, neg).agg(F.count(F.lit(1)).alias("leaks"))


# ------------------------------------------------------------------ identifiers and bookkeeping

FP = "substr(sha256(CAST(octet_length(encode(text)) AS VARCHAR) || text), 1, 24)"


@query("scan_media")
def scan_media(spark, sf):
    return A.scan_media(spark, sf, ("parquet",)).select("name", "length")


@query("content_id", sql("SELECT doc_id, 'asset_' || substr(sha256(CAST(doc_id AS VARCHAR) || source || lang), 1, 16) AS asset_id FROM documents"))
def content_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content_id("asset", c("doc_id"), c("source"), c("lang")).alias("asset_id"))


@query("fingerprint", sql(f"SELECT doc_id, {FP} AS fingerprint, 'asset_' || substr(sha256({FP}), 1, 16) AS asset_id FROM documents"))
def fingerprints(spark, sf):
    return A.with_fingerprint(table(spark, sf, "documents"), "text").select("doc_id", "fingerprint", "asset_id")


@query("pending_analysis", sql(f"""SELECT doc_id FROM documents WHERE {FP} NOT IN (SELECT {FP} FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1)"""))
def pending_analysis(spark, sf):
    docs = A.with_fingerprint(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "fingerprint")
    done = docs.join(table(spark, sf, "labels"), "doc_id").select("fingerprint", F.when(c("quality") == 1, "v2").otherwise("v1").alias("analysis_version"))
    return A.pending_analysis(docs, done, "v2").select("doc_id")


@query("dedupe", sql(f"SELECT {FP} AS fingerprint, min(doc_id) AS doc_id FROM documents GROUP BY 1"))
def dedupe(spark, sf):
    docs = A.with_fingerprint(table(spark, sf, "documents").select("doc_id", "text"), "text").select("fingerprint", "doc_id")
    return A.dedupe_by_content(docs, "doc_id")


@query("nest_flatten_shots", sql(f"""SELECT asset_id, CAST(asset_id AS VARCHAR) || '_s' || lpad(CAST(idx AS VARCHAR), 3, '0') AS id, idx, {r6('duration')} AS duration, camera_movement FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY start, shot_id) - 1 AS idx FROM shots)"""))
def nest_flatten_shots(spark, sf):
    d = A.number_shots(V.shots(spark, sf).withColumn("end", c("start") + c("duration")))
    return A.flatten_shots(A.nest_shots(d)).select("asset_id", "id", "idx", R(c("duration")).alias("duration"), "camera_movement")


PROBE = """format_string('{{"format":{{"duration":"%s","bit_rate":"%s","format_name":"mov,mp4"}},"streams":[%s%s]}}', duration, CAST(bitrate AS BIGINT),
  CASE WHEN l_partkey % 10 = 0 THEN '' ELSE format_string('{{"codec_type":"video","width":%s,"height":%s,"avg_frame_rate":"%s","r_frame_rate":"%s/1","codec_name":"h264","pix_fmt":"yuv420p","side_data_list":[{{"rotation":%s}}]}}',
    width, height, CASE WHEN l_partkey % 3 = 0 THEN '0/0' ELSE '30000/1001' END, CAST(fps AS BIGINT), CASE l_suppkey % 3 WHEN 0 THEN -90 ELSE 0 END) END,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat(CASE WHEN l_partkey % 10 = 0 THEN '' ELSE ',' END, '{{"codec_type":"audio","sample_rate":"48000","channels":2}}') END)"""


def _probes(spark, sf):
    return V.shots(spark, sf).withColumn("probe", F.expr(PROBE.replace("{{", "{").replace("}}", "}"))).select("shot_id", "probe")


PR = ("pr", """SELECT shot_id, l_partkey % 10 <> 0 AS has_video, l_partkey % 4 <> 0 AS has_audio, duration, CAST(bitrate AS BIGINT) AS bitrate,
    CASE WHEN l_partkey % 10 = 0 THEN 0 WHEN l_suppkey % 3 = 0 THEN height ELSE width END AS width,
    CASE WHEN l_partkey % 10 = 0 THEN 0 WHEN l_suppkey % 3 = 0 THEN width ELSE height END AS height,
    CASE WHEN l_partkey % 10 = 0 THEN 0 WHEN l_partkey % 3 = 0 THEN fps ELSE 30000 / 1001.0 END AS fps FROM shots""")


@query("normalize_probe", sql(f"""SELECT shot_id, has_video, has_audio, width, height, {r6('fps')} AS fps, {r6('duration')} AS duration, bitrate,
    CASE WHEN height = 0 THEN 'unknown' WHEN abs(width / height - 9 / 16) < 0.06 THEN '9:16' WHEN abs(width / height - 16 / 9) < 0.06 THEN '16:9' ELSE 'other' END AS aspect_label
    FROM pr WHERE has_video OR has_audio""", PR))
def normalize_probe(spark, sf):
    ok, _ = A.normalize_probe(_probes(spark, sf))
    return ok.select("shot_id", "has_video", "has_audio", "width", "height", R(c("fps")).alias("fps"), R(c("duration")).alias("duration"), "bitrate", "aspect_label")


@query("refused_probe", sql("SELECT shot_id FROM pr WHERE NOT has_video AND NOT has_audio", PR))
def refused_probe(spark, sf):
    return A.normalize_probe(_probes(spark, sf))[1].select("shot_id")


@query("needs_proxy", sql("SELECT shot_id FROM shots WHERE height > 756 OR bitrate > 20000000"))
def needs_proxy(spark, sf):
    return A.needs_proxy(V.shots(spark, sf)).select("shot_id")


@query("table_store", sql("SELECT camera_movement, count(*) AS shots FROM shots GROUP BY 1"))
def table_store(spark, sf):
    import os
    import uuid
    root = os.path.join(checkpoint_dir(spark), f"store-{uuid.uuid4().hex}")
    d = V.shots(spark, sf).select("shot_id", "duration", "camera_movement")
    A.write_table(d, root, "analysis", "shots", "camera_movement")
    A.write_table(d.filter("camera_movement = 'static'"), root, "analysis", "shots", "camera_movement")
    return A.read_table(spark, root, "analysis", "shots").groupBy(c("camera_movement").cast("string").alias("camera_movement")).agg(F.count(F.lit(1)).alias("shots"))
