"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import html_extract, language_id, secrets, sentencepieces, sql, toxicity, turn_repair, warc
from folioflow.llm.exact_dedup import decide
from folioflow.llm.fingerprints import edited_fingerprints
from folioflow.llm.minhash import near_duplicates
from folioflow.llm.mixing import mix_plan
from folioflow.llm.prefix_trie import prefix_trie
from folioflow.llm.substring_dedup import substring_dedup
from folioflow.llm.training import held_out
from folioflow.session import bounded
from folioflow.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, lexicon, out="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = edited_fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256")
    return done.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < len(secrets.BASE))
    kind = lambda i: lambda s: s["kind"] == i
    counts = [F.size(F.filter(spans, kind(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return secrets.scan_secrets(docs).select(
        "doc_id", *counts, F.sha2(F.encode(secrets.written(base), "UTF-8"), 256).alias("base_sha256"), secrets.written(spans).alias("spans")
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepieces.encode_and_decode(docs)
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.scratch_archive(spark)
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(read_table(spark, sf_dir, "conversations"))).drop("turns")



def queries() -> dict[str, Query]:
    found = {
        "op1_minhash": op1_minhash,
        "op2_toxicity": op2_toxicity,
        "op3_html_extract": op3_html_extract,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_language_id": op6_language_id,
        "op7_secret_scan": op7_secret_scan,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_mixing": op10_mixing,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_warc": op12_warc,
        "op13_turn_repair": op13_turn_repair,
    }
    return {name: _bounded(query) for name, query in found.items()}


def _bounded(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(bounded(spark), sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": sql.MINHASH,
        "op3_html_extract": sql.PAGES,
        "op4_exact_dedup": sql.EXACT_DEDUP,
        "op7_secret_scan": sql.SECRETS,
        "op9_substring_dedup": sql.SUBSTRINGS,
        "op10_mixing": sql.MIXING,
        "op11_prefix_trie": sql.PREFIX_TRIE,
        "op12_warc": sql.WARC,
        "op13_turn_repair": sql.TURN_REPAIR,
    }
