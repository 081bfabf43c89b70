"""Inverted index of character grams over a run table: which files may hold a text.

Every run of the table gets its postings once: a row for each gram of two or three characters and each bucket file that holds
it, sorted by gram. A search reads the postings of the grams of its text, keeps the files that have all of
them, and asks their rows for the text itself. A merge adds a run, so only the rows of touched buckets are indexed
again; postings of files that a run has lost since are left out by the manifest.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.matching import cut_grams
from noticeworks.sources.runs import Run, RunTable

SIZES = (2, 3)
FOLDER = "_grams"


class GramIndex:
    """Index of the texts in ``columns`` of a table of bucketed runs."""

    def __init__(self, table: RunTable, columns: Iterable[str] = ("title", "summary", "search_query")):
        self.table, self.columns = table, tuple(columns)

    def _names(self) -> set[str]:
        root, fs = self.table._hadoop(FOLDER)
        return {s.getPath().getName() for s in fs.listStatus(root)} if fs.exists(root) else set()

    def update(self) -> list[str]:
        """Index the runs that are new, and delete the postings of those that are gone. Gives the new ones."""
        runs, names = {r.folder: r for r in self.table.runs()}, self._names()
        for name in names - set(runs):
            path, fs = self.table._hadoop(FOLDER, name)
            fs.delete(path, True)
        finished = {n for n in names & set(runs) if self.table._hadoop(FOLDER, n, "_SUCCESS")[1].exists(self.table._hadoop(FOLDER, n, "_SUCCESS")[0])}
        new = [r for f, r in runs.items() if f not in finished]
        for run in new:
            rows = self.table._rows([run])
            text = F.concat_ws("\0", *self.columns)
            grams = rows.select("bucket", F.explode(cut_grams(text, SIZES)).alias("gram")).distinct()
            grams.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.table.path}/{FOLDER}/{run.folder}")
        return [r.folder for r in new]

    def postings(self, text: str) -> DataFrame | None:
        """(folder, bucket) of the files that hold all grams of ``text``; None if it is too short to tell."""
        size = min(len(text), max(SIZES))
        runs = [r for r in self.table.runs() if r.buckets]
        if size < min(SIZES) or not runs:
            return None
        grams = sorted({text[i : i + size] for i in range(len(text) - size + 1)})
        out = None
        for run in runs:
            rows = self.table.spark.read.schema("bucket int, gram string").parquet(f"{self.table.path}/{FOLDER}/{run.folder}")
            hits = rows.where(F.col("gram").isin(grams) & F.col("bucket").isin(list(run.buckets))).select(F.lit(run.folder).alias("folder"), "bucket", "gram")
            out = hits if out is None else out.unionByName(hits)
        return out.groupBy("folder", "bucket").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("folder", "bucket")

    def files_with_any(self, texts: DataFrame) -> dict[str, list[int]] | None:
        """Buckets by folder of the files that hold all grams of one of ``texts`` (column ``term``); None if one is too short to tell."""
        runs, size = [r for r in self.table.runs() if r.buckets], F.length("term")
        if not runs or not texts.where(size < min(SIZES)).isEmpty():
            return None
        cuts = F.when(size < max(SIZES), F.array("term")).otherwise(cut_grams(F.col("term"), [max(SIZES)]))
        # grams that many texts share are looked up once
        grams = texts.select("term", cuts.alias("grams")).distinct().select("term", F.size("grams").alias("wanted"), F.explode("grams").alias("gram"))
        found, sought = None, grams.select("gram").distinct()
        for run in runs:
            rows = self.table.spark.read.schema("bucket int, gram string").parquet(f"{self.table.path}/{FOLDER}/{run.folder}")
            hits = rows.where(F.col("bucket").isin(list(run.buckets))).join(sought, "gram", "left_semi").select(F.lit(run.folder).alias("folder"), "bucket", "gram")
            found = hits if found is None else found.unionByName(hits)
        held = found.join(grams, "gram").groupBy("term", "folder", "bucket").agg(F.count_distinct("gram").alias("n"), F.first("wanted").alias("wanted"))
        files = held.where("n = wanted").select("folder", "bucket").distinct()
        buckets: dict[str, list[int]] = {}
        for r in files.collect():  # at most one row per file
            buckets.setdefault(r["folder"], []).append(r["bucket"])
        return buckets

    def rows_with_any(self, texts: DataFrame) -> DataFrame:
        """Rows of the files that may hold one of ``texts`` (column ``term``), each once."""
        buckets = self.files_with_any(texts)
        return self.table.read().drop("batch_id") if buckets is None else self._rows_of(buckets)

    def rows_with(self, text: str) -> DataFrame:
        """Rows of the files that may hold ``text``: all that contain it in a column, and others."""
        files = self.postings(text)
        if files is None:
            return self.table.read().drop("batch_id")
        buckets: dict[str, list[int]] = {}
        for r in files.collect():  # at most one row per file
            buckets.setdefault(r["folder"], []).append(r["bucket"])
        return self._rows_of(buckets)

    def _rows_of(self, buckets: dict[str, list[int]]) -> DataFrame:
        runs = [Run(r.folder, r.level, r.first, r.last, tuple(sorted(buckets[r.folder]))) for r in self.table.runs() if r.folder in buckets]
        return self.table._rows(runs).drop("bucket", "batch_id")
