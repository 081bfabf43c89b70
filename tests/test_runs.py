"""Run tables: compaction, replays, crashes, pruned merges."""

import random
from datetime import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noticeworks import schemas
from noticeworks.operators import merge as M
from noticeworks.sources import tables as T
from noticeworks.sources.runs import RunTable
from noticeworks.streaming import jobs as J


def files(path):
    return sorted(str(f.relative_to(path)) for f in Path(path).rglob("*.parquet"))


def read_files(df):
    return df._jdf.queryExecution().executedPlan().toString(), set(df.inputFiles())


def page_rows(rng, batch):
    return [
        (f"{batch}-{i}", f"u{rng.randrange(40)}", f"html {batch} {i}", f"c{batch}{i}", rng.choice([None, dt(2024, 1, 1 + rng.randrange(20))]), "q", "s", ("t", "website", None))
        for i in range(6)
    ]


def test_fifty_batches_stay_few_files(spark, tmp_path):
    rng, log, plain = random.Random(1), RunTable(spark, str(tmp_path / "log"), J.PAGE_LOG, "url", 4, 4), None
    counts = []
    for batch in range(50):
        df = M.dedup_pages(spark.createDataFrame(page_rows(rng, batch), schemas.RAW_PAGES)).coalesce(1)
        assert log.append(df, batch)
        log.compact(T.surviving_pages)
        rows = df.withColumn("batch_id", F.lit(batch).cast("bigint"))
        rows.write.mode("append").parquet(str(tmp_path / "plain"))
        counts.append(sum(len(r.buckets or (0,)) for r in log.runs()))
        if batch in (3, 17, 49):
            plain = spark.read.parquet(str(tmp_path / "plain"))
            a, b = (sorted(map(str, T.current_pages(x).select("id", "url", "html", "crawled_at", "meta").collect())) for x in (log.read(), plain))
            assert a == b and len(a) > 10
    assert max(counts[10:]) <= 3 + 3 * 4 * 3 and log.read().count() < plain.count()
    assert sorted(r.level for r in log.runs()) == [0, 0, 2, 2, 2] and [r.last for r in log.runs() if r.level == 0] == [48, 49]
    assert T.read_log(spark, J.PAGE_LOG, str(tmp_path / "log")).count() == log.read().count()


def test_replays_and_crashes(spark, tmp_path, monkeypatch):
    log = RunTable(spark, str(tmp_path), "k string, v int", "k", 2, 3)

    def rows(*vs):
        return spark.createDataFrame([(f"k{v}", v) for v in vs], "k string, v int")

    def first(df):
        return M.one_per_key(df, ["k"], ["batch_id"], "first")

    def held():
        return sorted((r.k, r.v, r.batch_id) for r in log.read().collect())

    log.append(rows(1, 2), 0)
    log.append(rows(3), 1)
    log.append(rows(4), 1)  # again, with other rows: they replace it
    assert held() == [("k1", 1, 0), ("k2", 2, 0), ("k4", 4, 1)]
    commit = RunTable._commit
    monkeypatch.setattr(RunTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        log.append(rows(5), 2)
    assert held() == [("k1", 1, 0), ("k2", 2, 0), ("k4", 4, 1)]
    monkeypatch.setattr(RunTable, "_commit", commit)
    log.append(rows(5, 1), 2)
    monkeypatch.setattr(RunTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        log.compact(first)
    assert len(log.runs()) == 3 and len(held()) == 5
    monkeypatch.setattr(RunTable, "_commit", commit)
    assert log.compact(first) == 1 and held() == [("k1", 1, 0), ("k2", 2, 0), ("k4", 4, 1), ("k5", 5, 2)]
    assert not log.append(rows(9), 1) and len(held()) == 4  # part of a compacted run
    for i in range(3, 20):
        log.append(rows(i), i)
        log.compact(first)
    named = {r.folder for n in log._numbers() for r in log.runs(n)}
    assert {p.name for p in tmp_path.iterdir() if p.name.startswith("run-")} <= named and len(log._numbers()) == 8


def test_empty_batches_and_no_log(spark, tmp_path):
    log = RunTable(spark, str(tmp_path / "a"), "k string, v int", "k", 2, 2)
    assert log.read().collect() == [] and log.runs() == [] and log.compact(lambda df: df) == 0
    for i in range(4):
        log.append(spark.createDataFrame([], "k string, v int"), i)
        log.compact(lambda df: df)
    assert log.read().collect() == [] and all(r.level for r in log.runs())
    assert log.merge(spark.createDataFrame([], "k string, v int"), M.upsert) == []


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (RunTable(spark, str(tmp_path), "k string, v int", "k", 2, 3) for _ in range(2))
    df = spark.createDataFrame([("x", 1)], "k string, v int")
    a.append(df, 0)
    numbers = b._numbers()
    monkeypatch.setattr(b, "_numbers", lambda: numbers)
    a.append(df, 1)
    with pytest.raises(RuntimeError, match="another job"):
        b.append(df, 2)


def test_merges_touch_their_buckets_only(spark, tmp_path):
    table = RunTable(spark, str(tmp_path), schemas.RAW_PAGES, "url", 16)
    base = M.with_page_keys(spark.createDataFrame([r for b in range(60) for r in page_rows(random.Random(b), b)], schemas.RAW_PAGES)).drop("url_hash")
    base = M.dedup_pages(base)
    table.create(base)
    before = set(files(tmp_path))
    one = base.where("url = 'u7'").withColumn("html", F.lit("new html of the page")).withColumn("crawled_at", F.lit(dt(2025, 1, 1)))
    more = one.union(one.withColumn("url", F.lit("unseen")).withColumn("id", F.lit("z")))
    want = sorted(map(str, M.merge_raw_pages(base, more).collect()))
    touched = table.merge(more, M.merge_raw_pages)
    new = set(files(tmp_path)) - before
    assert 1 <= len(touched) <= 2 and len(new) == len(touched)
    assert sorted(map(str, table.read().drop("batch_id").collect())) == want
    plan, used = read_files(table.read(touched))
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in used} == set(touched)
    for i in range(20):
        table.merge(one.withColumn("crawled_at", F.lit(dt(2025, 2, 1 + i))), M.merge_raw_pages)
    assert sum(len(r.buckets) for r in table.runs()) <= 16 and len(table.runs()) <= 16
    assert table.read().where("url = 'u7'").first().crawled_at == dt(2025, 2, 20)


def test_alerts_read_the_buckets_of_the_batch(spark, tmp_path):
    log = J.outbox_log(spark, str(tmp_path), 16)
    rows = spark.range(200).select(F.lit(1).cast("bigint").alias("channel_id"), F.md5(F.col("id").cast("string")).alias("url_hash"))
    full = spark.createDataFrame([], J.OUTBOX_LOG).unionByName(rows, allowMissingColumns=True)
    for i in range(8):
        log.append(full.where(F.pmod(F.xxhash64("url_hash"), F.lit(8)) == i).coalesce(1), i)
    assert log.compact(T.surviving_messages) == 1
    one = rows.limit(1)
    _, used = read_files(log.read(log.touched(one)))
    assert len(used) == 1 and len(read_files(log.read())[1]) == 16


def test_parsed_log_compacts_to_the_same_table(spark, tmp_path):
    rng, log = random.Random(2), RunTable(spark, str(tmp_path / "log"), J.PARSED_LOG, "url_hash", 3, 2)
    schema = spark.createDataFrame([], J.PARSED_LOG).schema
    for batch in range(13):
        rows = []
        for i in range(5):
            outcome = rng.choice(["ok", "invalid", "too_short", "listing"])
            values = {f.name: None for f in schema} | {"url_hash": f"h{rng.randrange(9)}", "mongo_doc_id": f"{batch}{i}", "title": f"t{batch}{i}", "summary": f"s{batch}{i}", "notice_type": f"n{batch}{i}", "outcome": outcome, "created_by": f"b{batch}"}
            rows.append(tuple(values.values()))
        df = spark.createDataFrame(rows, schema).coalesce(1)
        log.append(df, batch)
        log.compact(T.surviving_parsed)
        df.withColumn("batch_id", F.lit(batch).cast("bigint")).write.mode("append").parquet(str(tmp_path / "plain"))
    a, b = (sorted(map(str, T.current_parsed(x).collect())) for x in (log.read(), spark.read.parquet(str(tmp_path / "plain"))))
    assert a == b and log.read().count() < 13 * 5
