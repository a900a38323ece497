"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of runs and a folder of manifest versions. Arrivals are appended as small runs
of immutable files. Runs of one size tier are merged, ``FANOUT`` or more at a time, into a run of
target-sized files. Each change writes its files first and then commits one new manifest version by
a rename that fails if the version exists, so readers always see a whole version, and a job that
is lost before its commit leaves nothing but files that no manifest names. Merged runs stay readable
by the versions that name them until ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch_dir, table

TARGET_BYTES = 64 << 20
LEAST_BYTES = 1 << 20
FANOUT = 4
ARRIVALS = 16


@dataclass(frozen=True)
class Run:
    """Files of one folder in the store. What each of them holds is in the part manifest ``part``."""

    path: str
    part: str
    bytes: int
    rows: int
    files: int

    def tier(self, least: int, fanout: int) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / least, fanout)) + 1) if self.bytes > least else 0


class ShardStore:
    """``root`` must be a folder that the driver and all executors share.

    A version's manifest has the schema of its rows and one line for each run, of which there are few as runs are merged; the
    files of runs stand in part manifests, one written by Spark for each append or merge and never again.
    Rows are kept as they are: nulls, empty texts and repeats too. A null arrival is an arrival of its own, as is
    the empty text; an empty append adds no run. A store without rows reads as no rows of the columns it was given.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, least: int = LEAST_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.least, self.fanout = spark, root, target, least, fanout
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # the manifest

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[str | None, list[Run]]:
        """The schema of the rows as JSON, and the runs."""
        known = self.versions()
        if not known:
            return None, []
        lines = self.spark.read.text(f"{self.root}/manifest/v{known[-1] if version is None else version:08d}.json").collect()
        found = [json.loads(r["value"]) for r in lines]
        return next((x["schema"] for x in found if "schema" in x), None), [Run(**x) for x in found if "path" in x]

    def runs(self, version: int | None = None) -> list[Run]:
        return self._manifest(version)[1]

    def commit(self, runs: list[Run], base: int, schema: str | None = None) -> int:
        """Version base + 1, or an error if another writer committed it first."""
        part = self._path(f"manifest/.{uuid.uuid4().hex}")
        lines = [{"schema": schema or self._manifest(base or None)[0]}, *map(asdict, runs)]
        try:
            out = self._fs.create(part, False)
            out.write(bytearray("\n".join(map(json.dumps, lines)) + "\n", "utf-8"))
            out.close()
            renames = self._hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(renames, 1)
            options[0] = renames.NONE
            context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
            context.rename(part, self._path(f"manifest/v{base + 1:08d}.json"), options)
        finally:
            self._fs.delete(part, False)  # still there only if the commit failed
        return base + 1

    def _last(self) -> int:
        return (self.versions() or [0])[-1]

    def _measured(self, folder: str) -> list[Run]:
        """The runs in ``folder``, after its part manifest has been written: files, bytes and rows from footers, a run
        for each folder of files. Only runs come to the driver."""
        path, part = f"{self.root}/data/{folder}", f"{self.root}/parts/{folder}"
        at = F.regexp_extract("_metadata.file_path", f"^.*/(data/{folder}/.*)$", 1)
        files = self.spark.read.parquet(path).groupBy(at.alias("shard"), F.col("_metadata.file_size").alias("shard_bytes")).agg(F.count("*").alias("shard_rows"))
        files.write.parquet(part)
        run = F.regexp_extract("shard", "^(.*)/[^/]*$", 1).alias("path")
        sums = [F.sum("shard_bytes").alias("bytes"), F.sum("shard_rows").alias("rows"), F.count("*").alias("files")]
        return [Run(r["path"], folder, r["bytes"], r["rows"], r["files"]) for r in self.spark.read.parquet(part).groupBy(run).agg(*sums).orderBy("path").collect()]

    # writers

    def append(self, rows: DataFrame, arrival: Column) -> int:
        """Append arrivals, one small run each, in one pass without a shuffle. ``arrival`` may be of any type and value."""
        base, stage = self._last(), f"in-{uuid.uuid4().hex}"
        at = "arrival"
        while at in rows.columns:
            at += "_"
        # folders are named by letters and digits alone, so a path is the same text wherever it is read
        named = F.coalesce(F.concat(F.lit("x"), F.lower(F.hex(arrival.cast("string").cast("binary")))), F.lit("null"))
        rows.withColumn(at, F.when(F.length(named) <= 200, named).otherwise(F.concat(F.lit("h"), F.sha2(named, 256)))).write.partitionBy(at).option("compression", "zstd").parquet(f"{self.root}/data/{stage}")
        some = any(s.isDirectory() for s in self._fs.listStatus(self._path(f"data/{stage}")))
        return self.commit(self.runs() + (self._measured(stage) if some else []), base, rows.schema.json())

    def compact(self) -> int:
        """Merge tiers that hold ``fanout`` runs or more until there is none; the last version."""
        while True:
            base, runs = self._last(), self.runs()
            tiers: dict[int, list[Run]] = {}
            for run in runs:
                tiers.setdefault(run.tier(self.least, self.fanout), []).append(run)
            full = {t: r for t, r in tiers.items() if len(r) >= self.fanout}
            if not full:
                return base
            old = full[min(full)]
            self.commit([r for r in runs if r not in old] + self._merge(old), base)

    def _merge(self, old: list[Run]) -> list[Run]:
        folder = f"run-{uuid.uuid4().hex}"
        # small files are packed into tasks as they are read, so nothing is shuffled
        tasks = max(1, math.ceil(sum(r.bytes for r in old) / self.target))
        self._rows(old, self._manifest()[0]).coalesce(tasks).write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return self._measured(folder)

    def _rows(self, runs: list[Run], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{r.path}" for r in runs])

    def vacuum(self, keep: int = 1) -> None:
        """Delete what the last ``keep`` versions do not name: older manifests and the files of their runs."""
        known = self.versions()
        old, named = known[:-keep], [r for v in known[-keep:] for r in self.runs(v)]
        gone = {r for v in old for r in self.runs(v)}
        for version in old:
            self._fs.delete(self._path(f"manifest/v{version:08d}.json"), False)
        for path in sorted({r.path for r in gone} - {r.path for r in named}) + sorted({f"parts/{r.part}" for r in gone} - {f"parts/{r.part}" for r in named}):
            self._fs.delete(self._path(path), True)

    # readers

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the columns that were appended."""
        schema, runs = self._manifest(version)
        if schema is None:
            raise ValueError("the store has no version yet")
        return self._rows(runs, schema) if runs else self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromJson(json.loads(schema))])

    def shards(self, version: int | None = None) -> DataFrame:
        """shard, shard_bytes, shard_rows of a version's files, from the part manifests of its runs; a shard's name is its
        path in the store, as files of several arrivals that one task wrote have one name."""
        runs = self.runs(version)
        if not runs:
            return self.spark.range(0).selectExpr("'' as shard", "id as shard_bytes", "id as shard_rows")
        kind = "shard string, shard_bytes long, shard_rows long"
        parts = self.spark.read.schema(kind).parquet(*sorted({f"{self.root}/parts/{r.part}" for r in runs}))
        here = self.spark.range(1).select(F.explode(F.array(*[F.lit(r.path) for r in runs])).alias("run"))
        return parts.withColumn("run", F.regexp_extract("shard", "^(.*)/[^/]*$", 1)).join(here, "run", "left_semi").select("shard", "shard_bytes", "shard_rows")


_IN_STORE = "^.*/(data/(?:in|run)-[0-9a-f]{32}/.*)$"


def compacted(docs: DataFrame, arrival: Column, root: str, **sizes) -> DataFrame:
    """Appends all arrivals of ``docs`` to a new store at ``root``, compacts it and returns one row
    per row: doc_id, shard, shard_bytes, shard_rows, version. A shard is a file, by its path in the store.

    Nulls, empty texts, repeats and null arrivals as in ``ShardStore``; an empty table gives no rows.
    """
    store = ShardStore(docs.sparkSession, root, **sizes)
    store.append(docs, arrival)
    version = store.compact()
    rows = store.read().select("doc_id", F.regexp_extract("_metadata.file_path", _IN_STORE, 1).alias("shard")) if store.runs() else store.read().select("doc_id", F.lit("").alias("shard"))
    # a row for each file of the manifest: Spark broadcasts it while it is small
    return rows.join(store.shards(), "shard").select("doc_id", "shard", "shard_bytes", "shard_rows", F.lit(version).alias("version"))


def op5_compaction(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # feeds of several sources each; one of them holds the hot source
    feed = F.pmod(F.xxhash64("source"), F.lit(ARRIVALS))
    return compacted(docs, feed, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
