"""Upserts, logs, windows and joins over the event and star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.operators import summaries, versions
from folioflow.operators.chunk import upper_median_by
from folioflow.operators.store import categories, latest, unfetched, upsert
from folioflow.plans.materialize import shared_dir, spill
from folioflow.plans.registry import Registry
from folioflow.sources.tables import read_table

R = Registry()


@R.add("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = latest(read_table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")])
    return kept.select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


@R.add("""WITH delta AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT max(c_custkey) + 1, 0.0 FROM customer)
SELECT coalesce(c.c_custkey, d.c_custkey) AS c_custkey, c.c_name, round(CASE WHEN d.c_custkey IS NOT NULL THEN d.c_acctbal ELSE c.c_acctbal END, 2) AS c_acctbal
FROM customer c FULL JOIN delta d ON c.c_custkey = d.c_custkey""")
def upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table.agg((F.max("c_custkey") + 1).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    delta = table.filter("c_custkey % 7 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")).unionByName(new)
    return upsert(table, delta, "c_custkey").withColumn("c_acctbal", F.round("c_acctbal", 2))


@R.add("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unfetched(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@R.add("SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND x.quality = 1)")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id"), read_table(spark, sf_dir, "labels")
    good = labels.filter("quality = 1").select("doc_id")
    return docs.join(labels, "doc_id").join(good, "doc_id", "left_semi").select("doc_id", "quality", "toxic")


@R.add("SELECT kind, category, count(*) AS n FROM (SELECT 'lang' AS kind, lang AS category FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE category IS NOT NULL GROUP BY ALL")
def category_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return categories(docs, {"lang": F.array("lang"), "source": F.array("source")}).groupBy("kind", "category").agg(F.count("*").alias("n"))


@R.add("""WITH classes AS (SELECT doc_id, CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END || CASE WHEN quality = 1 THEN ['good'] ELSE [] END AS c FROM labels)
SELECT class, count(*) AS n FROM (SELECT unnest(CASE WHEN len(c) = 0 THEN ['(unscoped)'] ELSE c END) AS class FROM classes) GROUP BY class""")
def label_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.chunk import class_counts

    flags = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good")))
    return class_counts(read_table(spark, sf_dir, "labels").select(flags.alias("applies_to")))


_LOG = """WITH log AS (SELECT event_id AS seq, ts, event_type AS model, value, user_id % 5 = 0 AS failed, event_type = 'view' AS short FROM events)"""


@R.add(_LOG + """ SELECT count(*) AS logged, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date,
count(*) FILTER (NOT failed) AS answered, count(*) FILTER (NOT failed AND short) AS insufficient,
sum(CASE WHEN NOT failed THEN seq % 3 ELSE 0 END)::BIGINT AS verified, sum(CASE WHEN NOT failed THEN 3 ELSE 0 END)::BIGINT AS citations,
(100 * sum(CASE WHEN NOT failed THEN seq % 3 ELSE 0 END) // greatest(sum(CASE WHEN NOT failed THEN 3 ELSE 0 END), 1))::BIGINT AS verified_percent FROM log""")
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.answer import history

    return history(event_log(spark, sf_dir))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a question log."""
    e = read_table(spark, sf_dir, "events")
    failed = F.col("user_id") % 5 == 0
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("timestamp"), F.lit("events").alias("run_id"), F.col("event_type").alias("model"), (F.col("event_type") == "view").alias("insufficient_context"),
        (F.col("event_id") % 3).alias("verified"), F.lit(3).cast("long").alias("n_citations"), F.col("value").alias("seconds"), F.when(failed, "failed").alias("error"),
    )


@R.add(_LOG + " SELECT model, count(*) AS n FROM log WHERE NOT failed GROUP BY model")
def log_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.answer import by_model

    return by_model(event_log(spark, sf_dir))


@R.add(_LOG + " SELECT seq, model FROM log ORDER BY ts DESC, seq DESC LIMIT 10")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten records: a report whose length is the feature."""
    from folioflow.operators.answer import tail

    return tail(event_log(spark, sf_dir), 10).select("seq", "model")


@R.add("SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median_value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def upper_median_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upper_median_by(read_table(spark, sf_dir, "events"), ["event_type"], "value", "median_value")


@R.add("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@R.add("""SELECT conv_id, turn, (list(turn ORDER BY turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))[1] AS next_reply FROM conversations""")
def turn_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 3)
    reply = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(ahead)
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("next_reply"))


@R.add("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def running_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    section = F.last_value(F.when(F.col("role") == "user", F.col("turn")), F.lit(True)).over(so_far)
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", section.alias("section"))


@R.add("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in files out of order, a file a micro-batch, upserted into a table of buckets: late rows don't replace newer ones."""
    from folioflow.streaming.ingest import current, read_stream, upsert_stream

    events, base = read_table(spark, sf_dir, "events"), _stream_folder(spark)
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{base}/in")
    stream = read_stream(spark, f"{base}/in", events.schema, files_per_trigger=1).withColumn("newest", F.struct("ts", "event_id"))
    upsert_stream(stream, f"{base}/table", f"{base}/checkpoint", "user_id", "newest", buckets=8).awaitTermination()
    return current(spark, f"{base}/table").select("user_id", "event_id", "event_type")


def _stream_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folioflow-stream-{uuid.uuid4().hex}"


@R.add("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in files by time, each with the rows of the file before once more and new rows far too late: every event comes out once, the late ones don't. The stream stops after three files and is restarted."""
    from folioflow.streaming.ingest import append_stream, deduplicated, read_stream

    base = _stream_folder(spark)
    events = _in_parts(spark, sf_dir)
    newest = {r["part"]: r["ts"] for r in events.groupBy("part").agg(F.max(F.unix_micros("ts")).alias("ts")).collect()}  # five rows
    behind = F.lit(False)
    for part in range(5):  # by the watermark of the part before the one they come with
        behind |= (F.col("part") == part) & (F.unix_micros("ts") < max((newest[p] or 0 for p in newest if p < part + 2), default=0) - 600_000_000)
    late = events.filter(F.col("event_id") % 10 == 0).filter(behind).withColumns({"event_id": -1 - F.col("event_id"), "part": F.col("part") + 3})
    sent = spill(events.unionByName(events.withColumn("part", F.col("part") + 1)).unionByName(late), "sent")
    for files in ((0, 1, 2), (3, 4, 5, 6, 7)):
        for part in files:
            sent.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = read_stream(spark, f"{base}/in", sent.drop("part").schema, files_per_trigger=1)
        append_stream(deduplicated(stream, ["event_id"]), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(sent.drop("part").schema).parquet(f"{base}/out").select("event_id", "user_id", "event_type")


def _in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the number of their fifth in order of time, whatever the order of their ids; rows of one time are in one part."""
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    cuts = events.agg(F.percentile_approx(us, [0.2, 0.4, 0.6, 0.8]).alias("cuts")).first()["cuts"] or []
    return events.withColumn("part", sum((F.coalesce((us > cut).cast("int"), F.lit(0)) for cut in cuts), F.lit(0)))


EVERY, BURST, QUOTA = 4 * 3600 * 1_000_000, 2, 8
_DELAY = 360_000_000


@R.add(f"""WITH RECURSIVE asked AS (
  SELECT user_id::VARCHAR AS host, event_id, epoch_us(ts) AS us, CASE WHEN event_type = 'error' THEN floor(value)::BIGINT * {_DELAY} END AS delay,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
mark AS (SELECT max(us) // 1000 - 600000 AS ms FROM asked),
paced AS (
  SELECT host, 0::BIGINT AS n, 0::BIGINT AS due, 0::BIGINT AS blocked, 0::BIGINT AS refused, NULL::BIGINT AS event_id, NULL::BIGINT AS start, NULL::BIGINT AS over, true AS made FROM asked WHERE n = 1
  UNION ALL
  SELECT host, n, CASE WHEN made THEN greatest(due, start) + {EVERY} ELSE due END, CASE WHEN made AND delay IS NOT NULL THEN greatest(blocked, start + delay) ELSE blocked END,
         CASE WHEN made AND delay IS NOT NULL THEN refused + 1 ELSE refused END, event_id, start, CASE WHEN made AND delay IS NOT NULL THEN start + delay END, made
  FROM (SELECT a.host, a.n, a.event_id, a.delay, p.due, p.blocked, p.refused, p.refused < {QUOTA} AS made,
               CASE WHEN p.refused < {QUOTA} THEN greatest(a.us, p.due - {(BURST - 1) * EVERY}, p.blocked) ELSE a.us END AS start
        FROM paced p JOIN asked a ON a.host = p.host AND a.n = p.n + 1)),
shown AS (
  SELECT host, event_id AS request_id, 1 AS attempt, start, CASE WHEN NOT made THEN 'not made' WHEN over IS NOT NULL THEN 'refused' ELSE 'made' END AS outcome FROM paced WHERE n > 0
  UNION ALL SELECT host, event_id, 2, (over + 999) // 1000 * 1000, 'made again' FROM paced, mark WHERE over IS NOT NULL AND refused < {QUOTA} AND (over + 999) // 1000 <= ms)
SELECT host, request_id, attempt::INT AS attempt, start::BIGINT AS start_us, outcome FROM shown""")
def request_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of requests of their users: paced by a bucket, blocked and made again after errors, given up after eight. The stream stops half-way and is restarted with its state."""
    from folioflow.streaming.ingest import append_stream, read_stream
    from folioflow.streaming.schedule import PROVIDER, schedule

    base, before = _stream_folder(spark), spark.conf.get(PROVIDER[0])
    events = spill(_in_parts(spark, sf_dir), "events")
    spark.conf.set(*PROVIDER)
    try:
        for files in ((0, 1), (2, 3, 4)):
            for part in files:
                events.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = read_stream(spark, f"{base}/in", events.drop("part").schema, files_per_trigger=1)
            delay = F.when(F.col("event_type") == "error", F.floor("value").cast("long") * _DELAY)
            requests = stream.select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("request_id"), "ts", delay.alias("delay"))
            append_stream(schedule(requests, EVERY, BURST, QUOTA), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return spark.read.parquet(f"{base}/out").select("host", "request_id", "attempt", F.unix_micros("start").alias("start_us"), "outcome")


@R.add("""SELECT version, count(*) AS users, sum(event_id)::BIGINT AS newest FROM (
  SELECT v AS version, event_id FROM events, (SELECT unnest([1, 2, 3]) AS v) WHERE event_id % 3 < v QUALIFY row_number() OVER (PARTITION BY v, user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY version""")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three merges of a third of the events each; every version of the table as it was."""
    table, events = _stream_folder(spark), read_table(spark, sf_dir, "events").withColumn("newest", F.struct("ts", "event_id"))
    out = None
    for third in range(3):
        version = versions.merge(events.filter(F.col("event_id") % 3 == third), table, "user_id", "newest", buckets=8)
    for v in range(1, version + 1):
        row = versions.read(spark, table, v).agg(F.lit(v).alias("version"), F.count("*").alias("users"), F.sum("event_id").alias("newest"))
        out = row if out is None else out.unionByName(row)
    return out


@R.add("""SELECT lang AS "group", count(*) AS n, sum(n_chars)::BIGINT AS total, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median
FROM documents WHERE n_chars IS NOT NULL GROUP BY lang""")
def summary_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents by language, counted a third of the table at a time: the same as of the whole."""
    docs, table = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), _stream_folder(spark)
    for third in range(3):
        summaries.add(docs.filter(F.col("doc_id") % 3 == third), table, "lang", "n_chars", buckets=8)
    return summaries.report(spark, table)


@R.add("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.streaming.ingest import windowed_counts

    return windowed_counts(read_table(spark, sf_dir, "events"))


@R.add("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def star_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read_table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n")
    )


@R.add("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    placed = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    asia = placed.join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return asia.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@R.add("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
