"""Tables as runs of batches, merged on read and compacted step by step.

A table is a folder of runs and a manifest. A small batch becomes a run of level 0, written as it is. When a level has ``fan``
runs, they become one run of the next level, which holds a file per hash bucket of the key; so the number of runs
grows with the logarithm of the number of batches, and a row is rewritten once per level. A merge into a stored table rewrites the
buckets of the delivered keys alone: the new run has these buckets, and older runs lose them.

Every change writes its files first and then a new manifest under the next number, which must not exist yet. Readers take the last
manifest, so what a job left behind that died between two steps is never seen, and the next change deletes it. A batch
that is delivered again replaces its run, or is left alone if it has been compacted. One writer at a time; another one that
commits the same number fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.session import cut_lineage

BUCKETS = 64
FAN = 8
#: Manifests that stay, for readers that began before the last change.
KEPT = 8
MANIFEST = "_manifest"


@dataclass(frozen=True)
class Run:
    """Batches ``first`` to ``last`` in one folder; ``buckets`` None: files of all buckets."""

    folder: str
    level: int
    first: int
    last: int
    buckets: tuple[int, ...] | None = None


class RunTable:
    """A table below ``path`` with rows of ``schema``, and ``batch_id`` where it is a log."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "url_hash", buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.path, self.key, self.buckets, self.fan = spark, path.rstrip("/"), key, buckets, fan
        self.schema = f"{schema.strip().rstrip(',')}, batch_id bigint, bucket int"

    # --- manifest

    def _hadoop(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, fs = self._hadoop(MANIFEST)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def runs(self, number: int | None = None) -> list[Run]:
        numbers = self._numbers()
        if number is None and not numbers:
            return []
        path, fs = self._hadoop(MANIFEST, f"{numbers[-1] if number is None else number:012d}.json")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return [Run(**{**r, "buckets": None if r["buckets"] is None else tuple(r["buckets"])}) for r in json.loads(text)]

    def _commit(self, runs: Iterable[Run]) -> None:
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        draft, fs = self._hadoop(MANIFEST, f".draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps([asdict(r) for r in runs]).encode()))
        finally:
            stream.close()
        final, _ = self._hadoop(MANIFEST, f"{number:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another job changed {self.path}")
        self._vacuum([*numbers, number])

    def _vacuum(self, numbers: list[int]) -> None:
        """Delete manifests but the last ones, and folders that none of these names."""
        keep = numbers[-KEPT:]
        named = {r.folder for n in keep for r in self.runs(n)}
        for n in numbers[:-KEPT]:
            path, fs = self._hadoop(MANIFEST, f"{n:012d}.json")
            fs.delete(path, False)
        root, fs = self._hadoop()
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in named:
                fs.delete(status.getPath(), True)

    # --- rows

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """Buckets of the keys of ``df``; never more than there are buckets."""
        return sorted(r[0] for r in df.select(self.bucket_of()).distinct().collect())

    def _read_run(self, run: Run, buckets: Iterable[int] | None) -> DataFrame | None:
        folder = f"{self.path}/{run.folder}"
        reader = self.spark.read.schema(self.schema)
        if run.buckets is None:
            rows = reader.parquet(folder)
            return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))
        wanted = [b for b in run.buckets if buckets is None or b in set(buckets)]
        return reader.option("basePath", folder).parquet(*(f"{folder}/bucket={b}" for b in wanted)) if wanted else None

    def _rows(self, runs: Iterable[Run], buckets: Iterable[int] | None = None) -> DataFrame:
        out = None
        for run in runs:
            rows = self._read_run(run, buckets)
            if rows is not None:
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of all runs, with their ``batch_id``; of some buckets, where given."""
        return self._rows(self.runs(), None if buckets is None else list(buckets)).drop("bucket")

    def _new_folder(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def _write_bucketed(self, rows: DataFrame, folder: str) -> None:
        rows.withColumn("bucket", self.bucket_of()).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _found_buckets(self, folder: str) -> tuple[int, ...]:
        root, fs = self._hadoop(folder)
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return tuple(sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")))

    # --- logs

    def append(self, df: DataFrame, batch_id: int) -> bool:
        """Add a batch; the same batch again replaces its run. False if it is part of a compacted run, and so known."""
        runs = self.runs()
        if any(r.level and r.first <= batch_id <= r.last for r in runs):
            return False
        folder = self._new_folder()
        df.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "bucket": self.bucket_of()}).write.parquet(f"{self.path}/{folder}")
        kept = [r for r in runs if not (r.level == 0 and r.first == batch_id)]
        self._commit([*kept, Run(folder, 0, batch_id, batch_id)])
        return True

    def compact(self, survivors: Callable[[DataFrame], DataFrame]) -> int:
        """Put the runs of each full level together; gives the number of steps taken.

        ``survivors`` leaves the rows of a log that can still matter, whatever comes later.
        """
        steps = 0
        while True:
            runs = self.runs()
            full = next((lv for lv in sorted({r.level for r in runs}) if sum(r.level == lv for r in runs) >= self.fan), None)
            if full is None:
                return steps
            old = sorted((r for r in runs if r.level == full), key=lambda r: r.first)
            folder = self._new_folder()
            self._write_bucketed(survivors(self._rows(old).drop("bucket")), folder)
            new = Run(folder, full + 1, min(r.first for r in old), max(r.last for r in old), self._found_buckets(folder))
            self._commit([*(r for r in runs if r not in old), new])
            steps += 1

    # --- stored tables

    def create(self, df: DataFrame) -> None:
        """Store a table; replaces what there is."""
        folder = self._new_folder()
        self._write_bucketed(df.withColumn("batch_id", F.lit(0).cast("bigint")), folder)
        self._commit([Run(folder, 1, 0, 0, self._found_buckets(folder))])

    def merge(self, updates: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Bring ``updates`` in by ``rule(stored, updates)``; only the buckets of their keys are read and written. Gives these buckets.

        ``rule`` merges by the key of the table, one row per key, and keeps the stored columns.
        """
        runs = self.runs()
        if any(r.buckets is None for r in runs):
            raise ValueError("a log is merged by its batches")
        updates = cut_lineage(updates)
        touched = self.touched(updates)
        if not touched:
            return []
        stored = self._rows(runs, touched).drop("bucket", "batch_id")
        folder = self._new_folder()
        self._write_bucketed(rule(stored, updates).withColumn("batch_id", F.lit(0).cast("bigint")), folder)
        left = (Run(r.folder, r.level, r.first, r.last, tuple(b for b in r.buckets or () if b not in set(touched))) for r in runs)
        self._commit([*(r for r in left if r.buckets), Run(folder, 1, 0, 0, self._found_buckets(folder))])
        return touched
