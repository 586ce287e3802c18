"""Media listings, probe records and the keyed analysis store."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, StringType, StructField, StructType)

from ..functions.ids import content_id, fingerprint, whole_fingerprint
from ..rules.measures import ASPECTS, ASPECT_TOLERANCE, PROXY_BITRATE, PROXY_HEIGHT
from ..operators.blocks import TIME_BLOCK, block_of, dense_index
from .snapshots import Snapshots

NAMESPACES = ("raw", "proxy", "analysis", "render", "output")


def scan_media(spark: SparkSession, folder: str, extensions: Sequence[str] = ("mp4",)) -> DataFrame:
    """Files of the given kinds below ``folder``; only metadata is read."""
    glob = "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length")


def with_fingerprint(df: DataFrame, content: str = "content", prefix: str = "asset", head_tail: bool = False) -> DataFrame:
    """Identity of every row's content: of the whole content, or with ``head_tail`` of its size and ends only."""
    d = df.withColumn("fingerprint", fingerprint(F.col(content)) if head_tail else whole_fingerprint(F.col(content)))
    return d.withColumn("asset_id", content_id(prefix, F.col("fingerprint")))


def pending_analysis(src: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Rows not analysed yet by this analyser version; results of other versions count as missing.  No content is a content too."""
    current = done.filter(F.col("analysis_version") == version).select(F.col("fingerprint").alias("_done"))
    return src.join(current, F.col("fingerprint").eqNullSafe(F.col("_done")), "left_anti")


def dedupe_by_content(df: DataFrame, order: str, key: str = "fingerprint") -> DataFrame:
    """One row per content, the first in ``order``.

    An aggregate with partial results per task, so any number of copies of one content is fine.
    """
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
              .select(key, "_r.*").select(*df.columns))


SHOT_JSON = ArrayType(StructType([
    StructField("idx", LongType()), StructField("id", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType()),
    StructField("camera_movement", StringType()), StructField("handling", StringType())]))


def number_shots(shots: DataFrame, order=("start", "shot_id"), width: float = TIME_BLOCK * 30) -> DataFrame:
    """Position of every shot in its asset and the id made from it."""
    d = dense_index(shots, ["asset_id"], list(order), block_of(F.col(order[0]), width), "idx")
    return d.withColumn("id", F.concat(F.col("asset_id").cast("string"), F.format_string("_s%03d", "idx")))


def nest_shots(shots: DataFrame, per_part: int = 10000) -> DataFrame:
    """Asset records holding their shots as JSON.

    A record carries at most ``per_part`` shots; a longer asset continues in further
    parts, so no record grows with the data.
    """
    item = F.struct(*[F.col(f.name) for f in SHOT_JSON.elementType.fields])
    part = F.floor(F.col("idx") / per_part).cast("long")
    return (shots.groupBy("asset_id", part.alias("part")).agg(F.sort_array(F.collect_list(item)).alias("_s"))
                 .select("asset_id", "part", F.to_json("_s").alias("shots")))


def flatten_shots(assets: DataFrame) -> DataFrame:
    """Shot rows of the asset records; unknown fields are dropped, the duration is recomputed."""
    d = assets.select("asset_id", F.explode(F.from_json("shots", SHOT_JSON)).alias("s")).select("asset_id", "s.*")
    return d.withColumn("duration", F.col("end") - F.col("start"))


_STREAM = StructType([StructField(n, StringType()) for n in (
    "codec_type", "width", "height", "avg_frame_rate", "r_frame_rate", "codec_name", "pix_fmt", "nb_frames", "duration",
    "sample_rate", "channels")] + [StructField("side_data_list", ArrayType(StructType([StructField("rotation", StringType())])))])
PROBE_JSON = StructType([
    StructField("format", StructType([StructField(n, StringType()) for n in ("duration", "bit_rate", "format_name")])),
    StructField("streams", ArrayType(_STREAM))])


def _rate(text):
    """``30000/1001`` or a plain number as frames per second; unusable text is 0."""
    num = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    den = F.when(F.instr(text, "/") > 0, F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")).otherwise(1.0)
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def aspect_label(aspect) -> F.Column:
    out = F.when(aspect == 0, "unknown")
    for label, ratio in ASPECTS:
        out = out.when(F.abs(aspect - F.lit(ratio)) < ASPECT_TOLERANCE, label)
    return out.otherwise(F.format_string("%.2f:1", aspect))


def parse_probe(df: DataFrame, text: str = "probe") -> DataFrame:
    """Media info columns from probe JSON; ``usable`` is false where neither video nor audio exists."""
    d = df.withColumn("_p", F.from_json(F.col(text), PROBE_JSON))

    def first(kind):
        return F.get(F.filter("_p.streams", lambda s: s["codec_type"] == kind), 0)

    d = d.withColumns({"_v": first("video"), "_a": first("audio")})
    fmt = "_p.format."

    def whole(col):
        return F.coalesce(F.col(col).try_cast("bigint"), F.lit(0).cast("long"))

    rate = _rate(F.col("_v.avg_frame_rate"))
    turned = F.filter(F.transform(F.coalesce(F.col("_v.side_data_list"), F.array()), lambda s: s["rotation"].try_cast("bigint")), lambda r: r.isNotNull())
    d = d.withColumns({
        "has_video": F.col("_v").isNotNull(), "has_audio": F.col("_a").isNotNull(),
        "container": F.coalesce(fmt + "format_name", F.lit("")), "bitrate": whole(fmt + "bit_rate"),
        "duration": F.coalesce(F.nullif(F.col(fmt + "duration").try_cast("double"), F.lit(0.0)), F.col("_v.duration").try_cast("double"), F.lit(0.0)),
        "fps": F.when(rate > 0, rate).otherwise(_rate(F.col("_v.r_frame_rate"))),
        "codec": F.coalesce("_v.codec_name", F.lit("")), "pix_fmt": F.coalesce("_v.pix_fmt", F.lit("")),
        "nb_frames": whole("_v.nb_frames"), "sample_rate": whole("_a.sample_rate"), "channels": whole("_a.channels"),
        "rotation": F.coalesce(F.try_element_at(turned, F.lit(-1)), F.lit(0).cast("long")),
        "_w": whole("_v.width"), "_h": whole("_v.height")})
    side = F.abs("rotation").isin(90, 270)
    d = d.withColumns({"width": F.when(side, F.col("_h")).otherwise(F.col("_w")),
                       "height": F.when(side, F.col("_w")).otherwise(F.col("_h"))})
    d = d.withColumn("aspect", F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(0.0))
    d = d.withColumns({"aspect_label": aspect_label(F.col("aspect")), "megapixels": F.col("width") * F.col("height") / 1e6,
                       "usable": F.col("has_video") | F.col("has_audio")})
    return d.drop("_p", "_v", "_a", "_w", "_h")


def normalize_probe(df: DataFrame, text: str = "probe") -> tuple[DataFrame, DataFrame]:
    """Usable media and, as a second table, the refused rows."""
    d = parse_probe(df, text)
    return d.filter("usable").drop("usable"), d.filter("NOT usable").select(*df.columns, F.lit("no usable streams").alias("error"))


def needs_proxy(df: DataFrame) -> DataFrame:
    return df.filter((F.col("height") > PROXY_HEIGHT * 1.4) | (F.col("bitrate") > PROXY_BITRATE))


def _stored(spark: SparkSession, root: str, namespace: str, name: str, by: str) -> Snapshots:
    if namespace not in NAMESPACES:
        raise ValueError(f"unknown namespace {namespace!r}")
    return Snapshots(spark, os.path.join(root, namespace, name), by)


def write_table(df: DataFrame, root: str, namespace: str, name: str, by: str | None = None) -> Snapshots:
    """Store a table under its namespace, seen by readers only once it is whole.

    With ``by`` only rows with the same values of that column are replaced; a table keeps the column it began with.
    """
    store = _stored(df.sparkSession, root, namespace, name, by or df.columns[0])
    if by:
        store.replace(df)
    else:
        store.overwrite(df)
    return store


def read_table(spark: SparkSession, root: str, namespace: str, name: str, by: str = "") -> DataFrame | None:
    """The newest whole version of a table, None before the first."""
    return _stored(spark, root, namespace, name, by).read()
