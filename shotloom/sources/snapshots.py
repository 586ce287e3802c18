"""Stored tables whose readers see whole commits only.

Rows lie in Parquet files by commit and by a hash of their key (``buckets``).  A manifest per version names the commits and
the buckets that count; it is written beside and then renamed, so a commit that was cut short is never seen, whatever files it
left.  A writer that needs to know some keys reads their buckets only.  Replacing rows writes the touched buckets anew and
leaves all others where they are.  One writer at a time; readers may come at any time, and ``vacuum`` removes what no version
kept names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
COMMITS = 64      # commits of one version before they are rewritten as one


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.n = spark, root.rstrip("/"), key, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(m.group(1)) for x in self._names("versions") if (m := re.fullmatch(r"(\d{10})\.json", x))]

    def manifest(self, version: int | None = None) -> dict:
        """schema and commits (id, token, buckets) of a version, of the newest one by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "buckets": self.n, "commits": []}
        stream = self._fs.open(self._path(f"{self.root}/versions/{version or known[-1]:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, old: dict, schema: StructType, commits: list[dict]) -> None:
        number = old["version"] + 1
        final, part = (self._path(f"{self.root}/versions/{number:010d}.json{end}") for end in ("", ".part"))
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"version": number, "schema": schema.jsonValue(), "buckets": self.n, "commits": commits}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise RuntimeError(f"version {number} of {self.root} came from another writer")

    # --- rows ---

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.n)).cast("int")

    def buckets_of(self, df: DataFrame) -> set[int]:
        """Buckets that the keys of a table fall into (at most ``buckets`` numbers)."""
        return {r["b"] for r in df.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}

    def read(self, buckets: Iterable[int] | None = None, without: str | None = None, version: int | None = None) -> DataFrame | None:
        """Rows of a version, of some buckets and without those of a token if wanted; None before the first commit."""
        m = self.manifest(version)
        if m["schema"] is None:
            return None
        schema, wanted = StructType.fromJson(m["schema"]), None if buckets is None else set(buckets)
        paths = [f"{self.root}/data/{x['id']}/b={b}" for x in m["commits"] if without is None or x["token"] != without for b in x["buckets"] if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, token: str | None) -> dict:
        name = uuid.uuid4().hex
        df.withColumn("b", self.bucket(F.col(self.key))).repartition("b").write.partitionBy("b").parquet(f"{self.root}/data/{name}")
        return {"id": name, "token": token, "buckets": sorted(int(x[2:]) for x in self._names(f"data/{name}") if x.startswith("b="))}

    def append(self, df: DataFrame, token: str | None = None) -> None:
        """Add rows.  What was added under the same token before is replaced, so a repeated batch counts once."""
        m = self.manifest()
        kept = [x for x in m["commits"] if token is None or x["token"] != token]
        self._publish(m, df.schema, [*kept, self._write(df, token)])
        if len(kept) >= COMMITS:
            self.compact()

    def replace(self, df: DataFrame) -> None:
        """Rows of ``df`` take the place of all rows with their keys."""
        m, touched = self.manifest(), self.buckets_of(df)
        old = self.read(touched)
        if old is not None:
            keys = df.select(F.col(self.key).alias("_k")).distinct()
            df = df.unionByName(old.join(keys, F.col(self.key).eqNullSafe(F.col("_k")), "left_anti"))
        kept = [{**x, "buckets": left} for x in m["commits"] if (left := [b for b in x["buckets"] if b not in touched])]
        self._publish(m, df.schema, [*kept, self._write(df, None)])

    def overwrite(self, df: DataFrame) -> None:
        """Rows of ``df`` take the place of the whole table."""
        self._publish(self.manifest(), df.schema, [self._write(df, None)])

    def compact(self) -> None:
        rows = self.read()
        if rows is not None:
            self._publish(self.manifest(), rows.schema, [self._write(rows, None)])

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the last ``keep`` versions and every commit that those do not name; their number."""
        known = self.versions()
        live = {x["id"] for v in known[-keep:] for x in self.manifest(v)["commits"]}
        dead = [f"data/{x}" for x in self._names("data") if x not in live]
        for name in [*(f"versions/{v:010d}.json" for v in known[:-keep]), *dead]:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return len(dead)
