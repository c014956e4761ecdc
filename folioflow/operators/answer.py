"""Questions to answers: detect classes, search, generate, verify, log. One question and a batch are the same plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import embed as E
from folioflow.operators import generate as G
from folioflow.operators.chunk import upper_median_by
from folioflow.operators.search import topk
from folioflow.operators.verify import verified, verify
from folioflow.plans.materialize import spill
from folioflow.tracing import observe


def detect_entities(question: Column) -> Column:
    """The classes a question names; null where it names none, which turns the filter off."""
    found = X.scan_entities(question)
    return F.when(F.size(found) > 0, found)


def retrieve(questions: DataFrame, index: DataFrame, embedder: E.Embedder, k: int = 8, use_filter: bool = True) -> DataFrame:
    """``questions`` (query_id, question, entity) with ``sources``: up to k chunks of the index in rank order."""
    classes = F.col("entity") if use_filter else F.lit(None).cast("array<string>")
    vectors = E.embed_queries(questions, embedder).select("query_id", "embedding", classes.alias("classes"))
    # written: its size is then known, and Spark broadcasts it only if it is small
    hits = spill(topk(index.select(F.col("chunk_id").alias("id"), "embedding", "applies_to"), vectors, k).select("query_id", "rank", "id", "sim"), "hits")
    payload = F.struct("rank", "sim", "number", "issue_date", "applies_to", "subject", "section", "text", F.col("chunk_id"))
    named = index.drop("embedding").join(hits, F.col("chunk_id") == F.col("id")).groupBy("query_id").agg(F.sort_array(F.collect_list(payload)).alias("sources"))  # k rows a query
    empty = F.expr("CAST(array() AS array<struct<rank:int,sim:double,number:string,issue_date:string,applies_to:array<string>,subject:string,section:string,text:string,chunk_id:bigint>>)")
    return questions.join(named, "query_id", "left").withColumn("sources", F.coalesce("sources", empty))


def classified(questions: DataFrame) -> DataFrame:
    """``questions`` with ``entity``: the given one, else what the question names."""
    given = F.col("entity") if "entity" in questions.columns else F.lit(None).cast("array<string>")
    return questions.withColumn("entity", F.coalesce(given, detect_entities(F.col("question"))))


def records(found: DataFrame, generator: G.Generator, clock: Column, run_id: str, source: str, use_filter: bool) -> DataFrame:
    """Log records of questions whose sources are found."""
    done = G.generate(found.withColumn("texts", F.transform("sources", lambda s: s["text"])), generator)
    reply = F.col("generated.reply")
    numbers = F.transform("sources", lambda s: s["number"])
    done = done.withColumn("checks", verify(reply["citations"], F.col("texts"), numbers))
    return done.select(
        F.col("query_id").alias("seq"), clock.alias("timestamp"), F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), "question", "entity",
        (F.col("entity").isNotNull() & F.lit(use_filter)).alias("filtered"), numbers.alias("retrieved"), reply["answer"].alias("answer"),
        reply["insufficient_context"].alias("insufficient_context"), F.col("checks").alias("citations"), verified(F.col("checks")).alias("verified"),
        F.size("checks").alias("n_citations"), F.col("generated.seconds").alias("seconds"), F.lit(generator.name).alias("model"), F.col("generated.error").alias("error"),
    )


def answer(questions: DataFrame, index: DataFrame, embedder: E.Embedder, generator: G.Generator, clock: Column, run_id: str, source: str = "ask", k: int = 8, use_filter: bool = True) -> DataFrame:
    """Log records, successes and errors, for ``questions`` (query_id, question, and optionally entity, which then overrides detection)."""
    asked = classified(questions).select("query_id", "question", "entity")
    return records(retrieve(asked, index, embedder, k, use_filter), generator, clock, run_id, source, use_filter)


NOT_ASKED = f"{G.QuotaExhausted.__name__}: not asked"
LEAST_TASK = 50  # questions of a block; fewer aren't worth a task of their own
ORDER = ("timestamp", "run_id", "seq")  # of the records of a log: runs by time, questions by their place in a run


def _numbered(questions: DataFrame) -> DataFrame:
    """``questions`` with ``place``, from 1 on in order of query_id: ranges are counted, then numbered inside each; only the counts, a row a range, meet in one task."""
    ranged = spill(questions.repartitionByRange("query_id").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").count()
    starts = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = ranged.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy("query_id")))
    return inside.join(starts, F.col("_range") == F.col("_of")).withColumn("place", F.col("_start") + F.col("_at")).drop("_range", "_of", "_start", "_at")


def answer_batch(questions: DataFrame, index: DataFrame, embedder: E.Embedder, generator: G.Generator, clock: Column, run_id: str, source: str = "batch", k: int = 8, use_filter: bool = True, block: int = 1000) -> DataFrame:
    """The log of a batch. The index is searched once for all questions; they are answered in blocks: once the generator's quota is gone the batch stops and what was answered is kept.

    The first block has ``block`` questions, each later one as many as were asked before it, so that few blocks do for any batch. The record of the first refused question stays, in each task that met it; questions that weren't asked any more leave none.
    """
    table = spill(_numbered(questions), "questions")
    asked = classified(table).select(F.col("place").alias("query_id"), F.col("query_id").alias("seq"), "question", "entity")  # places are unique, ids of questions need not be
    found = retrieve(asked, index, embedder, k, use_filter).withColumnRenamed("query_id", "place").withColumnRenamed("seq", "query_id")
    found = spill(found.repartitionByRange("place").sortWithinPartitions("place"), "found")  # so that a block is read without the others
    parts: list[DataFrame] = []
    first, total = 0, table.count()
    while first < total:
        last = min(total, first + max(block, first))
        tasks = max(1, min(questions.sparkSession.sparkContext.defaultParallelism, (last - first) // LEAST_TASK))
        with observe(f"answers {first + 1} to {last}", "generation", questions.sparkSession) as span:
            part = found.filter(F.col("place").between(first + 1, last)).repartition(tasks, "place")
            part = spill(records(part, generator, clock, run_id, source, use_filter), "answers")
            stop = part.filter(F.startswith("error", F.lit(G.QuotaExhausted.__name__))).limit(1).count() > 0
            parts.append(part.filter(F.col("error").isNull() | (F.col("error") != NOT_ASKED)))
            span["note"] = "quota exhausted" if stop else None
        if stop:
            break
        first = last
    return reduce(DataFrame.unionByName, parts) if parts else records(found.drop("place"), generator, clock, run_id, source, use_filter)


def history(log: DataFrame) -> DataFrame:
    """One row: records, dates of the first and last record, answers, how many lacked context, citations and how many are verified."""
    ok = F.col("error").isNull()
    day, place = F.date_format("timestamp", "yyyy-MM-dd"), F.struct(*ORDER)
    total = log.agg(
        F.count("*").alias("logged"), F.min_by(day, place).alias("first_date"), F.max_by(day, place).alias("last_date"), F.count_if(ok).alias("answered"),
        F.count_if(ok & F.col("insufficient_context")).alias("insufficient"), F.coalesce(F.sum(F.when(ok, F.col("verified"))), F.lit(0)).alias("verified"),
        F.coalesce(F.sum(F.when(ok, F.col("n_citations"))), F.lit(0)).alias("citations"),
    )
    return total.withColumn("verified_percent", F.floor(100 * F.col("verified") / F.greatest("citations", F.lit(1))))


def by_model(log: DataFrame) -> DataFrame:
    return log.filter(F.col("error").isNull()).groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model")


def tail(log: DataFrame, n: int = 10) -> DataFrame:
    """The last n records, oldest first."""
    return log.orderBy(*map(F.desc, ORDER)).limit(n).orderBy(*ORDER)


def batch_summary(log: DataFrame) -> DataFrame:
    """One row: answers of records, how many lacked context, citations by outcome, upper median of seconds."""
    log = spill(log.select("error", "insufficient_context", "citations", "seconds"), "log")  # counted twice, made once
    ok = F.col("error").isNull()
    status = lambda s: F.coalesce(F.sum(F.when(ok, F.size(F.filter("citations", lambda c: c["status"] == s)))), F.lit(0))
    counts = log.agg(
        F.count_if(ok).alias("answered"), F.count_if(ok & F.col("insufficient_context")).alias("insufficient"), status("ok").alias("ok"),
        status("wrong_source").alias("wrong_source"), status("not_found").alias("not_found"), F.count("*").alias("asked"),
    )
    middle = upper_median_by(log.filter(ok).withColumn("all", F.lit(1)), ["all"], "seconds", "median_seconds").agg(F.max("median_seconds").alias("median_seconds"))
    return counts.join(F.broadcast(middle))  # one row each
