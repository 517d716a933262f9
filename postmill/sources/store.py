"""A keyed table kept as immutable bucket folders; a version names the batch that each bucket is in."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.operators.state import upsert

#: Buckets of a table; each is what an upsert rewrites at least.
BUCKETS = 64


class SnapshotStore:
    """A table of unique keys below one folder, dealt by hash of the key into buckets.

    An upsert reads and writes the buckets that its keys fall into and no others, under a fresh batch
    folder; then one rename of a finished file publishes the next version, which fails if that version is there. So
    readers see all of a version or nothing, older versions stay readable, and of two writers the
    second gets FileExistsError. New columns are added, null where rows lack them; a
    column that changes its type is a ValueError. The rename must be atomic, as that of HDFS is.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        for name in ("versions", "staged"):
            self.fs.mkdirs(self._path(name))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self._path("versions")) if s.getPath().getName().isdigit())

    def _version(self, version: int | None = None) -> dict:
        """schema, buckets (bucket to batch) and n of a version, the latest by default."""
        done = self.versions()
        if not done:
            return {"n": 0, "schema": None, "buckets": {}, "of": self.buckets}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{done[-1] if version is None else version:08d}", wholetext=True).first()[0])

    def _read(self, at: dict, only: list[int] | None = None) -> DataFrame | None:
        if at["schema"] is None:
            return None
        schema = StructType.fromJson(at["schema"])
        paths = [f"{self.root}/data/batch={batch}/bucket={b}" for b, batch in at["buckets"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table of a version, the latest by default; None before the first."""
        return self._read(self._version(version))

    def upsert(self, new: DataFrame, *, observe: dict | None = None, **rules) -> dict:
        """Bring in rows of unique keys by :func:`postmill.operators.state.upsert` and its ``rules``; gives the counts of the pass that wrote.

        rows, new and rewritten count all rows written, keys that were not there, and rows that stand in touched buckets only; ``observe`` names
        further aggregates over the rows of ``new``. Rows with a null key are left out. The driver gets
        the numbers of the buckets that are touched, and those counts.
        """
        at = self._version()
        if at["of"] != self.buckets:
            raise ValueError(f"the table has {at['of']} buckets")
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        counts = Observation(f"new-{uuid.uuid4().hex}")
        new = new.where(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())
        if not touched:
            return {"rows": 0, "new": 0, "rewritten": 0, "buckets": 0} | (new.agg(*(c.alias(k) for k, c in observe.items())).first().asDict() if observe else {})
        old = self._read(at, touched)
        if old is None:
            old = self.spark.createDataFrame([], StructType([new.schema[self.key]]))
        types = {f.name: f.dataType.simpleString() for f in old.schema}
        for f in new.schema:
            if types.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
                raise ValueError(f"column {f.name} has another type in this table")
        old = old.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new.schema if f.name not in types})
        if observe:
            new = new.observe(counts, *(c.alias(k) for k, c in observe.items()))
        passed = Observation(f"all-{uuid.uuid4().hex}")
        merged = upsert(old, new, self.key, **rules).observe(passed, F.count(F.lit(1)).alias("rows"), F.count_if("is_new").alias("new")).drop("is_new")
        batch = uuid.uuid4().hex
        # dealt by bucket, so that a bucket is one file whatever the number of tasks
        merged.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/batch={batch}")
        told = passed.get | (counts.get if observe else {})
        self._publish({"n": at["n"] + 1, "schema": merged.schema.jsonValue(), "buckets": at["buckets"] | {str(b): batch for b in touched}, "of": self.buckets})
        return told | {"rewritten": told["rows"], "buckets": len(touched)}

    def _publish(self, version: dict) -> None:
        staged = self._path(f"staged/{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        target = self._path(f"versions/{version['n']:08d}")
        try:
            self.files.rename(staged, target, self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            if self.fs.exists(target):
                raise FileExistsError(f"version {version['n']} is there already") from e
            raise
