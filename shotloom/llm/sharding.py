"""Shards in random order by a two-pass external shuffle.

The first pass scatters whole records into buckets by a seeded hash of doc_id and text.  Buckets have a bounded size, and
Spark's shuffle carries them.  The second pass takes one bucket at a time into memory, in an order fixed by the hash, and
deals it by Fisher-Yates.  Places of the buckets follow from their counts, so the whole table has one random order, which is
cut into shards whose counts are at most one apart (law ``rows``).

Records with equal doc_id and text have equal hashes; were they left so, many copies of one record would fill one bucket.
They are found beforehand, scattered by their place in the input too, and written down, so that a repeated task meets the
same buckets.

Nulls: a null text is no bytes, and stays null in the files; rows without doc_id are placed like others.  A very long text
makes its bucket that much larger.  Equal texts under different ids are different records.  No rows: no files, and
``read_shards`` gives no rows.  Records keep all their columns, whatever their names, in one struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, stage

SHARDS = 8
SEED = 20_240_229
BUCKET_BYTES = 16 << 20     # text bytes aimed at per bucket
MOST_BUCKETS = 1 << 18      # bounds the counts that the driver holds (2 MB); buckets grow beyond 4 TB of text
BATCH_ROWS = 4096
LAW = "rows"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0..n-1 that seed and bucket decide."""
    order = list(range(n))
    draws = np.random.Generator(np.random.PCG64([seed, bucket])).integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else []
    for k, j in zip(range(n - 1, 0, -1), draws):
        order[k], order[j] = order[j], order[k]
    return np.array(order, np.int64)


def places(at: np.ndarray, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of places in the order of all rows: shard s has the places from s * total // shards on."""
    shard = -(-shards * (at + 1) // total) - 1
    return shard, at - shard * total // shards


def _deal(starts, total: int, shards: int, seed: int):
    """Batches sorted by bucket: every bucket in its shuffled order, with shard and slot."""
    def dealt(bucket: int, parts: list):
        rows = pa.Table.from_batches(parts)
        order = fisher_yates(len(rows), seed, bucket)
        shard, slot = places(int(starts.value[bucket]) + np.arange(len(rows)), total, shards)
        for lo in range(0, len(rows), BATCH_ROWS):
            part = rows.take(pa.array(order[lo:lo + BATCH_ROWS])).combine_chunks()
            column = part.column("record")
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
            yield pa.RecordBatch.from_arrays([column, pa.array(shard[lo:lo + BATCH_ROWS].astype(np.int32)), pa.array(slot[lo:lo + BATCH_ROWS])], ["record", "shard", "slot"])

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if ids[lo] != bucket:
                    if held:
                        yield from dealt(bucket, held)
                    bucket, held = int(ids[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from dealt(bucket, held)
    return run


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write all records to ``folder`` as Parquet, one sub-folder per shard, each file in the order of its slots."""
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("record"), F.xxhash64(F.lit(seed), doc_id, text).alias("key"))
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    keys = stage(docs.select(F.xxhash64(F.lit(seed), doc_id, text).alias("key"), bytes_.alias("b")).groupBy("key").agg(F.count("*").alias("n"), F.sum("b").alias("b")))
    total, size, repeated = keys.agg(F.sum("n"), F.sum("b"), F.count_if(F.col("n") > 1)).first()
    if not total:
        release(keys)
        return
    n = max(1, min(MOST_BUCKETS, -(-size // bucket_bytes)))
    once, counts = keyed.withColumn("bucket", F.pmod("key", F.lit(n))), keys.where("n = 1").select(F.pmod("key", F.lit(n)).alias("bucket"))
    again = None
    if repeated:
        twice = keys.where("n > 1").select("key")
        again = stage(keyed.join(twice, "key", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(n))))
        once = keyed.join(twice, "key", "left_anti").withColumn("bucket", F.pmod("key", F.lit(n))).unionByName(again)
        counts = counts.union(again.select("bucket"))
    per_bucket = np.zeros(n, np.int64)
    for r in counts.groupBy("bucket").count().toLocalIterator():
        per_bucket[r["bucket"]] = r["count"]
    starts = spark.sparkContext.broadcast(np.cumsum(per_bucket) - per_bucket)
    ties = [F.col("record").getField(f.name) for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    scattered = once.select("record", "key", "bucket").repartition(n, "bucket").sortWithinPartitions("bucket", "key", *ties)
    schema = T.StructType([T.StructField("record", scattered.schema["record"].dataType), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    placed = scattered.select("record", "bucket").mapInArrow(_deal(starts, total, shards, seed), schema)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    release(keys, *([again] if again else []))


def read_shards(spark: SparkSession, folder: str, record: T.StructType) -> DataFrame:
    """record, shard, slot of the written files; ``record`` is the schema of the documents written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    schema = T.StructType([T.StructField("record", record), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def shards(docs: DataFrame, folder: str | None = None, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record, from the files written."""
    import uuid

    from ..session import checkpoint_dir
    folder = folder or f"{checkpoint_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, folder, shards, seed, bucket_bytes)
    text = F.coalesce(F.col("record").getField("text").cast("string"), F.lit(""))
    return read_shards(docs.sparkSession, folder, docs.schema).select(
        F.col("record").getField("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
