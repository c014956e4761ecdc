"""Versioned tables, summaries, streams that stop and go on."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators import summaries, versions
from folioflow.streaming import ingest
from folioflow.streaming.schedule import PROVIDER, paced, schedule

T0 = datetime.datetime(2026, 1, 1)


def minutes(m):
    return T0 + datetime.timedelta(minutes=m)


def test_readers_see_whole_versions_only(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/t"
    rows = lambda *r: spark.createDataFrame(list(r), "k long, n long")
    seen = lambda v=None: sorted(map(tuple, versions.read(spark, table, v).select("k", "n").collect()))
    assert versions.read(spark, table) is None
    assert versions.merge(rows((1, 1), (2, 1), (3, 1)), table, "k", "n", 4) == 1
    # a writer fails between its data and its manifest: nothing is seen of it
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            versions.merge(rows((1, 9), (7, 9)), table, "k", "n", 4)
    assert seen() == [(1, 1), (2, 1), (3, 1)]
    # another writer commits first: the second starts again from its version
    real, first = versions.commit, []

    def beaten(*args):
        if not first:
            first.append(1)
            versions.merge(rows((2, 5), (4, 5)), table, "k", "n", 4)
        return real(*args)

    monkeypatch.setattr(versions, "commit", beaten)
    assert versions.merge(rows((2, 3), (5, 3)), table, "k", "n", 4) == 3
    assert seen() == [(1, 1), (2, 5), (3, 1), (4, 5), (5, 3)] and seen(1) == [(1, 1), (2, 1), (3, 1)] and seen(2) == [(1, 1), (2, 5), (3, 1), (4, 5)]
    with pytest.raises(versions.Conflict):
        real(spark, table, 2, {})
    versions.expire(spark, table, keep=1)
    assert versions.version_numbers(spark, table) == [3] and versions.read(spark, table, 1) is None and seen() == [(1, 1), (2, 5), (3, 1), (4, 5), (5, 3)]
    kept = {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t/data").glob("*/*") if p.is_dir()}
    assert kept == set(versions.manifest(spark, table)["parts"].values())


def test_summaries_read_what_is_new(spark, tmp_path):
    table, rng = f"file://{tmp_path}/s", random.Random(1)
    assert summaries.report(spark, table).count() == 0
    whole = []
    for _ in range(3):
        new = [(rng.choice(["a", "b", None]), rng.choice([None, *range(9)])) for _ in range(50)]
        whole += new
        summaries.add(spark.createDataFrame(new, "g string, v long"), table, "g", "v", 4)
        want = {}
        for g, v in whole:
            if v is not None:
                want.setdefault(g, []).append(v)
        got = {r.group: (r.n, r.total, r.least, r.most, r.median) for r in summaries.report(spark, table).collect()}
        assert got == {g: (len(v), sum(v), min(v), max(v), sorted(v)[len(v) // 2]) for g, v in want.items()}


def test_a_batch_is_applied_once(spark, tmp_path):
    """The stream's last batch is named by the manifest: when it runs again it changes nothing."""
    table, checkpoint = f"file://{tmp_path}/t", f"file://{tmp_path}/c"
    spark.createDataFrame([(1, 1, T0)], "k long, n long, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = lambda: ingest.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    ingest.upsert_stream(stream(), table, checkpoint, "k", "ts").awaitTermination()
    for path in (tmp_path / "c/commits").iterdir():  # as if the batch had been committed to the table, but not to the checkpoint
        path.unlink()
    ingest.upsert_stream(stream(), table, checkpoint, "k", "ts").awaitTermination()
    assert versions.version_numbers(spark, table) == [1] and ingest.current(spark, table).count() == 1


def test_repeats_and_late_rows_of_a_stream(spark, tmp_path):
    ddl = "id long, ts timestamp"
    files = [[(1, minutes(0)), (2, minutes(1)), (1, minutes(2))], [(3, minutes(60)), (2, minutes(8))], [(3, minutes(62)), (4, minutes(61)), (2, minutes(61))], [(5, minutes(5)), (6, minutes(63)), (4, minutes(61))]]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if n in (1, 3):  # stops in between
            stream = ingest.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
            ingest.append_stream(ingest.deduplicated(stream, ["id"]), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = sorted((r.id, round((r.ts - T0).total_seconds() / 60)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 0), (2, 1), (2, 61), (3, 60), (4, 61), (6, 63)]  # 2 comes again in its time and after it, 5 comes too late


def test_schedule_over_two_runs(spark, tmp_path):
    """A bucket of two at a request a minute; refusals block, are made again, and end it all after two."""
    ddl = "host string, request_id long, ts timestamp, delay long"
    minute = 60_000_000
    files = [[("h", 1, minutes(0), None), ("h", 2, minutes(0), None), ("h", 3, minutes(0), None), ("g", 9, minutes(0), None)], [("h", 4, minutes(10), 5 * minute), ("h", 5, minutes(11), None)],
             [("h", 6, minutes(40), minute), ("h", 7, minutes(50), None), ("g", 10, minutes(90), None)]]
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        for n, rows in enumerate(files):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if n:
                stream = ingest.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, 1)
                ingest.append_stream(schedule(stream, minute, 2, 2), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    got = sorted((r.request_id, r.attempt, round((r.start - T0).total_seconds() / 60, 3), r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 1, 0, "made"), (2, 1, 0, "made"), (3, 1, 1, "made"), (4, 1, 10, "refused"), (4, 2, 15, "made again"), (5, 1, 15, "made"), (6, 1, 40, "refused"), (7, 1, 50, "not made"), (9, 1, 0, "made"), (10, 1, 90, "made")]


def test_pace_is_a_token_bucket():
    rng = random.Random(3)
    due = blocked = refused = at = 0
    tokens, last = 3.0, 0
    for _ in range(300):
        at += rng.randrange(0, 8)
        start, due, blocked, refused, _ = paced(at, None, due, blocked, refused, 5, 3)
        begin = max(at, last)
        tokens = min(3.0, tokens + (begin - last) / 5)
        if tokens < 1 - 1e-9:
            begin, tokens = begin + (1 - tokens) * 5, 1.0
        tokens, last = tokens - 1, begin
        assert abs(start - begin) < 1e-6


def test_a_crawl_goes_on_where_it_stopped(spark, tmp_path):
    from folioflow.sources.crawl import PagesById

    (tmp_path / "pages").mkdir()
    for i in range(1, 11):
        if i != 6:
            (tmp_path / f"pages/{i}.html").write_text(f"<p>{i}</p>")
    spark.dataSource.register(PagesById)
    sizes = []
    for due in (4, 4, 7, 99):
        options = {"url": f"file://{tmp_path}/pages/{{id}}.html", "start": "10", "back": "10", "pace": "1000", "since": str(time.time() - 1000 * (due + 0.5))}
        query = spark.readStream.format("pages_by_id").options(**options).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
        query.trigger(availableNow=True).start().awaitTermination()
        sizes.append(spark.read.parquet(f"{tmp_path}/out").count())
    ids = [r.rbi_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sizes == [4, 4, 6, 9] and sorted(ids) == [1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_page_blocks_in_sql(spark):
    from folioflow.functions import tables

    tables.register(spark)
    rows = [(1, "<p>a<p>b", "x"), (2, None, "y"), (3, "<table><tr><td>h<td>i</table>", None)]
    spark.createDataFrame(rows, "id long, html string, note string").createOrReplaceTempView("given_pages")
    got = spark.sql("SELECT * FROM page_blocks(TABLE(given_pages) PARTITION BY id) ORDER BY id, pos")
    assert got.columns == ["id", "note", "pos", "kind", "text"]
    assert [tuple(r) for r in got.collect()] == [(1, "x", 0, "text", "a"), (1, "x", 1, "text", "b"), (3, None, 0, "table", "| h | i |\n| --- | --- |")]
    with pytest.raises(Exception, match="html"):
        spark.sql("SELECT * FROM page_blocks(TABLE(SELECT 1 AS x))").collect()


def test_vector_files_by_ranges_of_bytes(spark, tmp_path):
    import numpy as np

    from folioflow.sources.vectors import VectorFiles, in_ranges

    spark.dataSource.register(VectorFiles)
    v = np.random.default_rng(1).normal(size=(1000, 6)).astype(np.float32)
    df = spark.createDataFrame([(7 * i, x.tolist()) for i, x in enumerate(v)] + [(3, None)], "id long, embedding array<float>").repartition(5)
    path = str(tmp_path / "v")
    in_ranges(df, "id").write.format("vectors").mode("overwrite").option("rows", 90).save(path)
    back = spark.read.format("vectors").option("rows", 40).load(path)
    assert back.rdd.getNumPartitions() >= 25
    rows = sorted(back.collect())
    assert [r.row for r in rows] == list(range(1000)) and np.array_equal(np.array([r.embedding for r in rows], np.float32), v)
    (tmp_path / "v/part-of-a-failed-job.npy").write_bytes(b"x")  # in no list
    in_ranges(df.filter("id < 70"), "id").write.format("vectors").mode("append").save(path)
    assert spark.read.format("vectors").load(path).count() == 1010
    np.save(tmp_path / "alone.npy", v[:5])
    assert spark.read.format("vectors").load(f"file://{tmp_path}/alone.npy").count() == 5
    in_ranges(df.limit(0), "id").write.format("vectors").mode("overwrite").save(path)
    assert spark.read.format("vectors").load(path).count() == 0


def shuffled_events(tmp_path):
    """Events twice, the second time under later ids at the same times: ids aren't in order of time."""
    import duckdb

    duckdb.sql(f"COPY (SELECT event_id + k * 1000 AS event_id, ts, user_id + k * 500 AS user_id, event_type, value, props FROM '/root/testdata/sf0.001/events.parquet', (SELECT unnest([0, 1]) AS k)) TO '{tmp_path}/events.parquet'")
    return str(tmp_path)


def test_streams_of_events_whose_ids_are_out_of_time(spark, tmp_path):
    import duckdb

    from folioflow.plans import relational

    path = shuffled_events(tmp_path)
    for name in ("stream_dedup", "request_schedule"):
        got = relational.R.queries[name](spark, path)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({relational.R.sql[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 2000


def test_a_host_costs_the_same_however_often_it_refuses():
    """State and timers are written once a batch, not once a refusal."""
    from pyspark.sql import Row

    from folioflow.streaming.schedule import Pace

    class Handle:
        def __init__(self):
            self.value, self.timers, self.calls = None, [], 0

        def getValueState(self, *_):  # noqa: N802
            return self

        def called(self):
            self.calls += 1

        def get(self):
            self.called()
            return self.value

        def update(self, value):
            self.called()
            self.value = value

        def registerTimer(self, ms):  # noqa: N802
            self.called()
            self.timers.append(ms)

        def deleteTimer(self, ms):  # noqa: N802
            self.called()
            self.timers.remove(ms)

    calls = set()
    for refusals in (1, 2, 20):
        handle, pace = Handle(), Pace(1_000_000, 2, 50)
        pace.init(handle)
        out = list(pace.handleInputRows(("h",), iter([Row(us=n * 2_000_000, request_id=n, delay=1_500_000) for n in range(refusals)]), None))
        assert [r.outcome for r in out] == ["refused"] * refusals and handle.timers == [1500]
        calls.add(handle.calls)
        info = type("Info", (), {"getExpiryTimeInMs": lambda self: 1500})()
        again = list(pace.handleExpiredTimer(("h",), type("Times", (), {"getCurrentWatermarkInMs": lambda self: 4000})(), info))
        assert [r.us for r in again] == [1_500_000, 3_500_000][:refusals] and handle.timers == ([1500] if refusals < 3 else [1500, 5500])
    assert calls == {3}
