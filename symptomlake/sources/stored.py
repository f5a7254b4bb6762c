"""Changes to stored tables that touch only the files they concern.

A *keyed table* is a folder of Parquet files partitioned by ``_bucket``, a hash of its keys; the number of buckets comes
from the number of rows, and is doubled by ``compact`` as the table grows, so a bucket keeps its size and a change of a
given size concerns an ever smaller share of the table. The folder also holds ``_buckets`` with that number; readers
ignore names with an underscore.

All writes can be repeated: an interrupted run is taken up by the next one.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.quality import conformance
from ..session import shared_dir

ROWS_PER_BUCKET = 1_000_000


class _Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name) if "/" in name and ":" in name.split("/")[0] else self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def read(self, name: str) -> str | None:
        at = self.path(name)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        self.fs.mkdirs(self.root)
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def names(self, pattern: str) -> list[str]:
        return [s.getPath().toString() for s in self.fs.globStatus(self.path(pattern)) or ()]

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def move(self, old: str, new: str) -> None:
        to = self.path(new)
        self.fs.mkdirs(to.getParent())
        if self.fs.exists(self.path(old)):
            self.fs.delete(to, False)
            self.fs.rename(self.path(old), to)


class KeyedTable:
    """A table with a row for each key, stored by a hash of the key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.keys, self.rows_per_bucket = spark, path, keys, rows_per_bucket
        self.files = _Files(spark, path)

    def _state(self) -> dict:
        return json.loads(self.files.read("_buckets") or "{}")

    def _hash(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("_bucket", self._hash(n))

    def _write(self, rows: DataFrame, mode: str) -> None:
        (rows.hint("rebalance", "_bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy("_bucket").parquet(self.path))

    def buckets(self, rows: DataFrame | None = None) -> int:
        """The number of buckets; of a new table, as many as ``rows`` need, a power of two."""
        state = self._state()
        if "n" not in state and rows is not None:
            state = {"n": 1 << max(0, -(-rows.count() // self.rows_per_bucket) - 1).bit_length()}
            self.files.write("_buckets", json.dumps(state))
        return state.get("n", 1)

    def read(self, schema, buckets: list[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if named; other partitions are not listed into the scan."""
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as missing:  # nothing stored yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))

    def insert_if_absent(self, rows: DataFrame, first) -> tuple[int, int]:
        """Append the rows whose key is not stored; ``first`` picks one of several in ``rows``. Files read and stored."""
        new = self._dealt(rows, self.buckets(rows))
        mine = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most one for each new key, and bucket
        known = self.read(new.schema, mine)
        every = self.files.names("_bucket=*/*.parquet")
        share = sum(int(name.split("_bucket=")[1].split("/")[0]) in set(mine) for name in every), len(every)
        fresh = first(new).join(known.select(*self.keys, "_bucket"), [*self.keys, "_bucket"], "left_anti").select(*new.columns)
        self._write(fresh, "append")
        return share

    def upsert(self, rows: DataFrame) -> int:
        """Replace the rows of the keys in ``rows`` (one row each); the number of partitions written.

        Only partitions in which a row differs are rewritten, so a repeated
        run writes nothing and files elsewhere keep their names.
        """
        new = self._dealt(rows, self.buckets(rows))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        old = self.read(new.schema, touched)
        same = F.lit(True)
        for c in new.columns:
            same = same & new[c].eqNullSafe(old[c])
        staged = shared_dir(self.spark, "upsert")
        new.join(old, same, "left_anti").write.parquet(staged)
        changed = self.spark.read.schema(new.schema).parquet(staged)
        dirty = [r[0] for r in changed.select("_bucket").distinct().collect()]
        if dirty:
            kept = self.read(new.schema, dirty).join(changed.select(*self.keys, "_bucket"), [*self.keys, "_bucket"], "left_anti")
            whole = shared_dir(self.spark, "partitions")
            kept.select(*new.columns).unionByName(changed).write.parquet(whole)
            self._write(self.spark.read.schema(new.schema).parquet(whole), "overwrite")
        return len(dirty)

    def compact(self, schema) -> int:
        """Double the buckets while they hold too many rows, and merge small files; the number of buckets.

        Each bucket is split into itself and a new one. While that goes on,
        ``_buckets`` says so, and a run that finds it goes on.
        """
        state = self._state()
        stored = self.read(schema).select("_bucket").count()
        n = state.get("n", 1)
        while "to" in state or stored > 2 * n * self.rows_per_bucket:
            to = state.get("to", 2 * n)
            self.files.write("_buckets", json.dumps({"n": n, "to": to}))
            staged = shared_dir(self.spark, "compacted")
            rows = self.read(schema)
            rows.drop("_bucket").withColumn("_bucket", self._hash(to)).dropDuplicates([*self.keys]).write.parquet(staged)
            dealt = self.spark.read.schema(rows.schema).parquet(staged)
            self._write(dealt, "overwrite")
            held = {r[0] for r in dealt.select("_bucket").distinct().collect()}
            for empty in set(range(n)) - held:  # dynamic overwrite leaves a partition that gets no rows as it was
                self.files.remove(f"_bucket={empty}")
            n, state = to, {}
            self.files.write("_buckets", json.dumps({"n": n}))
        return n


def delete_rows(spark: SparkSession, path: str, doomed: DataFrame, on: list[str], partition_by: list[str] = ()) -> dict[str, int]:
    """Delete the rows whose ``on`` columns are in ``doomed`` from a stored table; rows removed, files rewritten and all.

    A semi-join on the key columns finds the files that hold such rows; only
    these are rewritten. New files are complete before old ones go, and
    ``_pending`` in the table's folder lists both, so that a run that was cut
    off in between is finished by the next one.
    """
    files = _Files(spark, path)
    _finish(files)
    table = spark.read.parquet(path)
    keys = doomed.select(*on).distinct()
    hit = table.select(*on, F.col("_metadata.file_path").alias("_file")).join(keys, on, "left_semi")
    found = hit.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each file concerned
    every = len(table.inputFiles())
    if not found:
        return {"removed": 0, "rewritten": 0, "files": every}
    old = [r["_file"] for r in found]
    rest = spark.read.option("basePath", path).schema(table.schema).parquet(*old).join(keys, on, "left_anti").select(*table.columns)
    staged = shared_dir(spark, "survivors")
    writer = rest.hint("rebalance", *partition_by) if partition_by else rest.hint("rebalance")
    writer.write.partitionBy(*partition_by).parquet(staged) if partition_by else writer.write.parquet(staged)
    new = [f for f in spark.read.parquet(staged).inputFiles()] if not rest.isEmpty() else []
    moves = {f: f.split(staged.split(":")[-1].lstrip("/"), 1)[1].lstrip("/") for f in new}
    files.write("_pending", json.dumps({"old": old, "moves": moves}))
    _finish(files)
    return {"removed": sum(r["n"] for r in found), "rewritten": len(old), "files": every}


def _finish(files: _Files) -> None:
    pending = json.loads(files.read("_pending") or "null")
    if pending:
        for name in pending["old"]:
            files.remove(name)
        for name, to in pending["moves"].items():
            files.move(name, to)
        files.remove("_pending")


def quarantine(df: DataFrame, rules: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """valid rows, quarantined rows with their violations, and how often each rule is broken, from one pass.

    Rows are written once, partitioned by validity; the counts are observed as
    the rows go by.
    """
    checked = conformance(df, rules).withColumn("_valid", F.size("violations") == 0)
    seen = Observation()
    counted = checked.observe(seen, F.count(F.lit(1)).alias("_rows"), F.count_if("_valid").alias("_valid"), *[
        F.count_if(F.array_contains("violations", code)).alias(code) for code in rules])
    counted.write.partitionBy("_valid").parquet(path)
    stored = df.sparkSession.read.schema(checked.schema).parquet(path)
    return (stored.where("_valid").drop("violations", "_valid"), stored.where("NOT _valid").drop("_valid"), seen.get)


def footer_overview(spark: SparkSession, tables: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows, least and greatest value of one column of each table, from the footers of its files.

    ``tables``: name -> (path, column). Count, minimum and maximum are pushed
    into the Parquet source, which answers them without reading a data page.
    """
    own = spark.newSession()  # the settings below hold for these frames alone
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    out = None
    for name, (path, column) in tables.items():
        one = own.read.parquet(path).agg(F.count("*").alias("documents"), F.min(column).alias("first"), F.max(column).alias("last"))
        one = one.select(F.lit(name).alias("collection"), "documents", F.col("first").cast("string"), F.col("last").cast("string"))
        out = one if out is None else out.unionByName(one)
    return out
