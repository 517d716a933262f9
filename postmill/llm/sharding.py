"""Sharding: arrivals kept as small immutable shards, size-tiered compaction, manifests committed atomically. DataFrame functions only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch_folder

#: Bytes of text that a merged shard aims at, ratio of sizes that makes one tier, documents of an arrival in the queries.
TARGET_BYTES, FANOUT, BASE_BYTES, ARRIVAL_DOCS = 64 << 20, 4, 1 << 16, 1000
#: Files of a merged shard of the size that is aimed at; each is one task's work.
FILES = 4
#: Shards whose sizes are summed in one window of a prefix sum.
_BLOCK = 1024
#: Arrival of documents without an id, beyond those of all ids.
_NO_ID = 2**63 - 1

#: Partition columns of the data folder: what was written at once, and its shards.
BATCH, SHARD = "postmill_batch", "postmill_shard"
MANIFEST = "shard_id string, batch string, level int, first_arrival long, n_docs long, n_bytes long"


class ShardStore:
    """Shards below one folder, listed by numbered manifests of which the highest committed one holds.

    Data and manifests are written under fresh names and never changed. A version is committed by
    one rename of a finished file, which names the manifest and the documents' columns, to the
    version's number; the rename fails if that is there. So a reader sees all of a version or
    nothing, a writer that dies leaves only files that nobody reads, and of two writers the second
    gets an error. It needs a file system whose rename is atomic, as that of HDFS is.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        for name in ("commits", "staged"):
            self.fs.mkdirs(self._path(name))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(self._path("commits")) if s.getPath().getName().isdigit())

    def _commit_of(self, version: int | None) -> dict | None:
        done = self.versions()
        if not done:
            return None
        return json.loads(self.spark.read.text(f"{self.root}/commits/{done[-1] if version is None else version:08d}", wholetext=True).first()[0])

    def _manifest(self, commit: dict | None) -> DataFrame:
        return self.spark.createDataFrame([], MANIFEST) if commit is None else self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{commit['manifest']}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the latest by default; none before the first."""
        return self._manifest(self._commit_of(version))

    def stage(self, shards: DataFrame, schema: StructType) -> str:
        """Write a manifest and the file that will commit it; the file's name."""
        name = uuid.uuid4().hex
        shards.select("shard_id", "batch", "level", "first_arrival", "n_docs", "n_bytes").coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        out = self.fs.create(self._path(f"staged/{name}"), False)
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        return name

    def publish(self, staged: str, after: int) -> int:
        """Make a staged manifest the version that follows ``after``; FileExistsError if another writer has done so."""
        if after and after not in self.versions():
            raise ValueError(f"there is no version {after}")
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.files.rename(self._path(f"staged/{staged}"), self._path(f"commits/{after + 1:08d}"), no_options)
        except Exception as e:
            if self.fs.exists(self._path(f"commits/{after + 1:08d}")):
                raise FileExistsError(f"version {after + 1} is committed already") from e
            raise
        return after + 1

    def commit(self, shards: DataFrame, after: int, schema: StructType) -> int:
        return self.publish(self.stage(shards, schema), after)

    def _write(self, docs: DataFrame, shard: Column) -> str:
        """Write a batch of shards; its name. A task writes a file for each shard that it holds rows of."""
        batch = uuid.uuid4().hex[:12]
        docs.withColumn(SHARD, shard).write.option("compression", "zstd").partitionBy(SHARD).parquet(f"{self.root}/data/{BATCH}={batch}")
        return batch

    def _read(self, batches: list[str], schema: StructType) -> DataFrame:
        """The rows of some batches in one scan, with batch and shard; columns that a batch lacks are null."""
        full = StructType(schema.fields).add(BATCH, "string").add(SHARD, "string")
        paths = [f"{self.root}/data/{BATCH}={b}" for b in batches]
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def _sizes(self, batch: str, schema: StructType, level: Column, arrival: Column) -> DataFrame:
        rows = self._read([batch], schema)
        sizes = rows.groupBy(F.col(SHARD).alias("shard_id")).agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n_bytes"))
        return sizes.select("shard_id", F.lit(batch).alias("batch"), level.cast("int").alias("level"), arrival.cast("long").alias("first_arrival"), "n_docs", "n_bytes")

    def append(self, docs: DataFrame, arrival: Column) -> int:
        """Write each arrival, a number that the column gives, as a small shard of its own; no shuffle.

        Documents may have new columns; a column that is there already must keep its type.
        """
        now = (self.versions() or [0])[-1]
        before = self._commit_of(now) if now else None
        docs = docs.drop(BATCH, SHARD)
        schema = joined(StructType.fromJson(before["schema"]) if before else StructType([]), docs.schema)
        batch = self._write(docs, F.concat(F.lit("a"), numbered(arrival)))
        new = self._sizes(batch, schema, F.lit(0), number_of("shard_id"))
        return self.commit(self._manifest(before).unionByName(new), now, schema)

    def compact(self, target_bytes: int = TARGET_BYTES) -> int:
        """Merge runs of similar size into shards of about ``target_bytes`` and commit the result."""
        now = self.versions()[-1]
        commit = self._commit_of(now)
        schema, plan = StructType.fromJson(commit["schema"]), merge_plan(self._manifest(commit), target_bytes)
        merged = plan.where("merged_id is not null")
        moves = [r["batch"] for r in merged.select("batch").distinct().collect()]  # one for each append or merge before
        if not moves:
            return now
        to = merged.select(F.col("shard_id").alias(SHARD), F.col("batch").alias(BATCH), F.struct("merged_id", "file").alias("__to"))
        n = merged.select("merged_id", "file").distinct().count()
        # dealt by files, not by shards: a shard is the work of several tasks; more partitions than files, so that few share one
        rows = self._read(moves, schema).join(to, [SHARD, BATCH]).drop(SHARD, BATCH).repartition(2 * n, F.col("__to.merged_id"), F.col("__to.file"))
        batch = self._write(rows.sortWithinPartitions("__to", "doc_id").withColumn("__shard", F.col("__to.merged_id")).drop("__to"), F.col("__shard"))
        new = self._sizes(batch, schema, F.element_at(F.split("shard_id", "-"), 1).substr(2, 9), number_of("shard_id"))
        kept = plan.where("merged_id is null").drop("merged_id", "file")
        return self.commit(kept.unionByName(new), now, schema)

    def documents(self, version: int | None = None) -> DataFrame:
        """The documents of a version, with the shard_id of each."""
        commit = self._commit_of(version)
        listed = self._manifest(commit)
        schema = StructType.fromJson(commit["schema"]) if commit else StructType([])
        rows = self._read([r["batch"] for r in listed.select("batch").distinct().collect()], schema)
        return rows.join(listed.select(F.col("batch").alias(BATCH), F.col("shard_id").alias(SHARD)), [BATCH, SHARD], "left_semi").drop(BATCH)


def numbered(n: Column) -> Column:
    """A long in 20 places, its sign included, so that every long has a name of its own."""
    return F.format_string("%020d", n.cast("long"))


def number_of(name: str) -> Column:
    """The long that a shard's name ends with."""
    return F.substring(name, -20, 20).cast("long")


def joined(old: StructType, new: StructType) -> StructType:
    """``old`` with the columns of ``new`` that it lacks; ValueError for a column of another type."""
    types = {f.name: f.dataType for f in old.fields}
    for f in new.fields:
        if types.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} has another type in this store")
    return StructType([*old.fields, *(f for f in new.fields if f.name not in types)])


def running_sum(df: DataFrame, group: list[str], bin: Column, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the group's rows that come before in ``order``, of which ``bin`` is a coarser form.

    Windows run within bins, and over the bins' sums, so no task orders a whole group.
    """
    binned = df.withColumn("__bin", bin)
    sums = binned.groupBy(*group, "__bin").agg(F.sum(value).alias("__sum"))
    upto = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "__bin", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(starts, [*group, "__bin"]).withColumn(out, F.col("__start") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__bin", "__start")


def merge_plan(shards: DataFrame, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, base: int = BASE_BYTES) -> DataFrame:
    """``shards`` with merged_id, the shard that each is to become part of, and file, the part of that; null for those that stay.

    Shards below the target fall into tiers of sizes within a factor of ``fanout``. A tier's shards,
    in order of arrival, are cut wherever another ``target_bytes`` is full; a piece of two shards or
    more is merged, into a file for each FILES-th of ``target_bytes``.
    """
    tier = F.floor(F.log(F.greatest(F.col("n_bytes"), F.lit(base)) / F.lit(base)) / F.log(F.lit(float(fanout))) + 1e-9).cast("int")
    small = shards.where(F.col("n_bytes") < target_bytes).withColumn("tier", tier)
    small = running_sum(small, ["tier"], F.floor(F.col("first_arrival") / _BLOCK), ["first_arrival", "shard_id"], "n_bytes", "before")
    small = small.withColumn("piece", F.floor(F.col("before") / target_bytes)).withColumn("file", F.floor(F.col("before") % target_bytes / (target_bytes / FILES)).cast("int"))
    pieces = small.groupBy("tier", "piece").agg(F.count("*").alias("runs"), F.min("first_arrival").alias("first"), F.max("level").alias("top"))
    name = F.concat(F.lit("m"), (F.col("top") + 1).cast("string"), F.lit("-"), F.col("tier").cast("string"), F.lit("-"), numbered(F.col("first")))
    planned = small.join(pieces, ["tier", "piece"]).withColumn("merged_id", F.when(F.col("runs") > 1, name)).withColumn("file", F.when(F.col("runs") > 1, F.col("file")))
    large = shards.where(F.col("n_bytes") >= target_bytes)
    return planned.select(*shards.columns, "merged_id", "file").unionByName(large.withColumns({"merged_id": F.lit(None).cast("string"), "file": F.lit(None).cast("int")}))


def arrival_of(docs_each: int = ARRIVAL_DOCS) -> Column:
    """The queries' arrivals: documents by ranges of their ids, those without an id last."""
    return F.coalesce(F.floor(F.col("doc_id") / docs_each), F.lit(_NO_ID))


def shard_documents(spark: SparkSession, docs: DataFrame, *, root: str | None = None, target_bytes: int = TARGET_BYTES, arrival: Column | None = None) -> DataFrame:
    """``docs`` appended to a store, compacted, and read back from the committed version, with shard_id.

    Edge cases: an empty table comes back empty, without a version; null and empty texts have 0 bytes, and a text
    longer than the target is a shard or a file of its own; ids may be any longs, null ones arrive last; repeated rows stay. A column of ``docs`` named shard_id gives way to the new one,
    and those named as the store's partition columns are left out. Without a ``root`` the store ends
    with the application.
    """
    docs = docs.drop("shard_id", BATCH, SHARD)
    if docs.isEmpty():
        return docs.withColumn("shard_id", F.lit(None).cast("string"))
    store = ShardStore(spark, root or scratch_folder(spark, "shards"))
    store.append(docs, arrival if arrival is not None else arrival_of())
    store.compact(target_bytes)
    return store.documents().withColumnRenamed(SHARD, "shard_id").select(*docs.columns, "shard_id")


def shard_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """:func:`shard_documents` where what one task reads is one arrival: a file each, however the documents were dealt before."""
    return shard_documents(spark, docs, arrival=F.spark_partition_id().cast("long"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, coalesce(floor(doc_id / {ARRIVAL_DOCS})::BIGINT, {_NO_ID}) AS arrival FROM documents),
a AS (SELECT arrival, sum(n_bytes) AS n_bytes FROM d GROUP BY 1),
t AS (SELECT *, floor(ln(greatest(n_bytes, {BASE_BYTES}) / {BASE_BYTES}) / ln({FANOUT}.0) + 1e-9)::INT AS tier FROM a WHERE n_bytes < {TARGET_BYTES}),
s AS (SELECT *, floor(coalesce(sum(n_bytes) OVER (PARTITION BY tier ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {TARGET_BYTES})::BIGINT AS piece FROM t),
p AS (SELECT tier, piece, count(*) AS runs, min(arrival) AS first FROM s GROUP BY ALL)
SELECT d.doc_id, d.n_bytes::BIGINT AS n_bytes,
  CASE WHEN runs > 1 THEN 'm1-' || s.tier || '-' || printf('%020d', first) ELSE 'a' || printf('%020d', d.arrival) END AS shard_id
FROM d LEFT JOIN s USING (arrival) LEFT JOIN p USING (tier, piece)
"""
