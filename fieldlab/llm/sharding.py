"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards. Compaction merges runs of
similarly sized shards into files of a target size; every merge task reads
whole shards and writes one file, so rows are not shuffled.

The manifest is a log: each version is one small file that names the shards it
adds and those it takes away, so a commit costs what it changes. It becomes
visible by a rename that fails if another writer was first; that writer's
shards are then looked at and the commit is tried again as the next version.
Readers see a version whole or not at all. A job that dies leaves only files
that no version names; vacuum() removes such files once they are older than
any commit that may still be under way.

The table of shards is read by Spark from the log; only shards below the
target size, which are to be merged, come to the driver. All columns, nulls
and repeated rows are kept as they are. An empty arrival adds no shard.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.llm.common import remove, shared_dir, table

TARGET_BYTES = 64 << 20
FAN_IN = 4
ROWS_PER_ARRIVAL_SHARD = 8_000
#: Merges that one job runs side by side.
WAVE = 64
#: Files that no version names are left alone for so long.
GRACE_SECONDS = 86_400.0
#: Appends in which the query's documents come.
ARRIVALS = 3


def tier(size: int, target: int, fan_in: int = FAN_IN) -> int:
    """0 for shards of the target size or nearly (a factor of fan_in ** 0.5), one more for each factor of fan_in below."""
    return max(0, round(math.log(max(1.0, target / max(1, size)), fan_in)))


def plan_merges(shards: list[dict], target: int, fan_in: int = FAN_IN) -> list[list[dict]]:
    """Runs of shards of the same tier, in arrival order, each filling a file of the target size, or at least fan_in shards of it."""
    tiers: dict[int, list[dict]] = {}
    for s in sorted(shards, key=lambda s: s["name"]):
        if (t := tier(s["bytes"], target, fan_in)) > 0:
            tiers.setdefault(t, []).append(s)
    merges = []
    for t in sorted(tiers, reverse=True):
        run: list[dict] = []
        for s in tiers[t]:
            if run and sum(x["bytes"] for x in run) + s["bytes"] > target * 1.25:
                merges.append(run)
                run = []
            run.append(s)
        if len(run) >= fan_in or (len(run) > 1 and sum(x["bytes"] for x in run) >= target / 2):
            merges.append(run)
    return [m for m in merges if len(m) > 1]


LOG = "version bigint, action string, name string, path string, rows bigint, bytes bigint, schema string"


class LostShards(RuntimeError):
    """Another writer has taken away shards that were to be merged."""


class ShardTable:
    """A folder of shards with a log of versions. `root` is on a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first."""
        folder = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v")), default=0)

    def log(self, version: int | None = None) -> DataFrame:
        """Additions and removals up to a version, by default the newest."""
        upto = self.version() if version is None else version
        if not upto:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json([f"{self.root}/manifest/v{v:010d}.json" for v in range(1, upto + 1)])

    def shards(self, version: int | None = None) -> DataFrame:
        """(name, path, rows, bytes) of the shards of a version."""
        log = self.log(version)
        gone = log.where("action = 'remove'").select("name")
        return log.where("action = 'add'").join(gone, "name", "left_anti").select("name", "path", "rows", "bytes")

    def schema(self, version: int | None = None) -> T.StructType | None:
        """That of the newest commit which had one."""
        row = self.log(version).where("schema IS NOT NULL").agg(F.max_by("schema", "version")).first()
        return T.StructType.fromJson(json.loads(row[0])) if row[0] else None

    def commit(self, added: list[dict], removed: list[str] = (), schema: str | None = None, tries: int = 20) -> int:
        """Makes the next version visible and returns it. Other writers' commits in between are kept; removed shards must still be there."""
        for _ in range(tries):
            version = self.version() + 1
            if removed and self.shards(version - 1).where(F.col("name").isin(list(removed))).count() < len(removed):
                raise LostShards("shards that were merged are no longer in the table")
            lines = [{"version": version, "action": "add", **s} for s in sorted(added, key=lambda s: s["name"])]
            lines += [{"version": version, "action": "remove", "name": n} for n in sorted(removed)]
            lines += [{"version": version, "action": "schema", "schema": schema}] if schema else []
            if self._publish(version, "\n".join(map(json.dumps, lines)) + "\n"):
                return version
        raise RuntimeError(f"{tries} other writers were first")

    def _publish(self, version: int, text: str) -> bool:
        """Writes the file of a version beside its place and renames it there; False if the place is taken."""
        part, place = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{version:010d}.json")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, place, never_over)
        except Exception:
            if not self._fs.exists(place):
                raise
            self._fs.delete(part, False)
            return False
        return True

    def _written(self, folder: str, schema: T.StructType, prefix: str) -> list[dict]:
        """Shards of the files in a folder, with rows and bytes; empty files are none. One row per file comes to the driver."""
        files = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        found = files.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows")).orderBy("file").collect()
        part = lambda file: file.split("-")[1] + "-" + file.split("-c")[-1].split(".")[0]
        return [{"name": f"{prefix}-{part(r.file)}", "path": f"{folder}/{r.file}", "rows": r.rows, "bytes": r.bytes} for r in found]

    def append(self, df: DataFrame, rows_per_shard: int = ROWS_PER_ARRIVAL_SHARD) -> int:
        """Writes the rows as small shards, one or more a task, and commits them."""
        name = f"a{self.version() + 1:08d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/data/{name}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_shard).parquet(folder)
        return self.commit(self._written(folder, df.schema, name), schema=df.schema.json())

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN, wave: int = WAVE) -> int:
        """Merges tiers until none has a run to merge; each wave of merges is one commit."""
        while merges := plan_merges(self.open_shards(target, fan_in), target, fan_in):
            schema = self.schema()
            for at in range(0, len(merges), wave):
                some = merges[at : at + wave]
                name = f"m{self.version() + 1:08d}-{uuid.uuid4().hex[:8]}"
                folder = f"{self.root}/data/{name}"
                runs = [self.spark.read.schema(schema).parquet(*[s["path"] for s in m]).coalesce(1) for m in some]
                joined = runs[0]
                for r in runs[1:]:
                    joined = joined.union(r)
                joined.write.option("compression", "zstd").parquet(folder)
                done = self._written(folder, schema, name)
                if sum(s["rows"] for s in done) != sum(s["rows"] for m in some for s in m):
                    raise RuntimeError("merged shards don't hold the rows of their sources")
                try:
                    self.commit(done, [s["name"] for m in some for s in m])
                except LostShards:  # another compaction was first: look anew
                    remove(self.spark, folder)
                    break
        return self.version()

    def open_shards(self, target: int, fan_in: int) -> list[dict]:
        """The shards below the target's tier: what arrived since, and fewer than fan_in per tier."""
        small = self.shards().where(F.col("bytes") < target / fan_in**0.5 + 1)
        return [r.asDict() for r in small.collect()]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        schema, paths = self.schema(version), [r.path for r in self.shards(version).select("path").collect()]
        if schema is None:
            raise ValueError("nothing has been committed yet")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def assignments(self, id_col: str) -> DataFrame:
        """One row per row of the newest version: id, shard, its rows and bytes, version."""
        version = self.version()
        facts = self.shards(version).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("name").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
        rows = self.read(version)
        if not rows.inputFiles():
            return rows.select(F.col(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("shard", "string"), ("shard_rows", "bigint"), ("shard_bytes", "bigint"), ("version", "bigint"))])
        file = F.split("_metadata.file_path", "/")
        placed = rows.select(F.col(id_col).alias("id"), F.element_at(file, -1).alias("file"), F.element_at(file, -2).alias("folder")).join(facts, ["folder", "file"])
        return placed.select(F.col("id").alias(id_col), "shard", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))

    def vacuum(self, grace_seconds: float = GRACE_SECONDS) -> None:
        """Deletes data files that the newest version doesn't name and that are older than the grace, which must exceed the time any writer takes to commit and any reader to read."""
        keep = {r.path.rsplit("/data/", 1)[1] for r in self.shards().select("path").collect()}
        before = (time.time() - grace_seconds) * 1000
        folder = self._path(f"{self.root}/data")
        for run in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            inside = list(self._fs.listStatus(run.getPath()))
            gone = [f for f in inside if f"{run.getPath().getName()}/{f.getPath().getName()}" not in keep and f.getModificationTime() <= before]
            for f in gone if len(gone) < len(inside) else ():
                self._fs.delete(f.getPath(), False)
            if inside and len(gone) == len(inside):
                remove(self.spark, run.getPath().toString())


def shard(
    docs: DataFrame, *, id_col: str = "doc_id", root: str | None = None, target: int = TARGET_BYTES, fan_in: int = FAN_IN,
    rows_per_shard: int = ROWS_PER_ARRIVAL_SHARD, arrivals: int = 1,
) -> DataFrame:
    """Appends the documents to a shard table, compacts it and returns where each row is.

    A new table by default, from which what compaction has replaced is deleted
    at once: nobody else knows it. arrivals: the documents come in so many
    appends, dealt by a hash of their id.
    """
    spark = docs.sparkSession
    store = ShardTable(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs if arrivals == 1 else docs.where(part == i), rows_per_shard)
    store.compact(target, fan_in)
    if root is None:
        store.vacuum(0)
    return store.assignments(id_col)


def op3_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"), arrivals=ARRIVALS)
