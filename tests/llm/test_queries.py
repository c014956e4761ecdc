"""Registered queries against their SQL twins, or against plain versions where SQL can't express them."""

import hashlib
import zlib

import pytest
from helpers import spark_rows, sql_rows

from folioflow.llm import registry

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(registry.queries()[name](spark, SMALL)) == sql_rows(registry.oracle_sql()[name], SMALL)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_fingerprints_against_a_plain_edit(spark):
    got = registry.op5_fingerprints(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = documents(spark, SMALL)
    texts = docs["text"].fillna("").tolist()
    assert got["doc_id"].tolist() == docs["doc_id"].tolist()
    for i, text in enumerate(texts):
        half, after = len(text) // 2, texts[(i + 1) % len(texts)]
        edited = text[: len(text) - half] + after[:half]
        assert got["edited_sha256"][i] == hashlib.sha256(edited.encode()).hexdigest() and got["n_chars"][i] == len(text)
    assert got.groupby(docs["text"])["fingerprint"].nunique().max() == 1
    assert got["near_edited"].between(0, 1).all() and (got["near_edited"] > got["near_next"]).mean() > 0.9


def test_languages_on_held_out_rows(spark):
    got = registry.op6_language_id(spark, MIDDLE).toPandas().merge(documents(spark, MIDDLE), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(is_held_out)).all()
    held = got[got["held_out"] & got["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["rejected"].mean() < 0.01 and got["score"].between(0, 1).all()


def test_a_language_left_out_is_rejected(spark):
    from folioflow.llm import language_id

    docs = documents(spark, MIDDLE).dropna(subset=["text", "lang"])
    held = docs["doc_id"].map(is_held_out)
    for lang in sorted(docs["lang"].unique()):
        model = language_id.fit([(t, own) for t, own in zip(docs["text"][~held], docs["lang"][~held], strict=True) if own != lang])
        judged = [model.judge(t)[2] for t in docs["text"][held & (docs["lang"] == lang)] if len(t) > 100]
        assert len(judged) > 20 and sum(judged) >= 0.97 * len(judged), lang


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas()
    got = registry.op2_toxicity(spark, MIDDLE).toPandas()
    assert len(got) == 1000 and (got["held_out"] == got["doc_id"].map(is_held_out)).all()
    held = got.merge(labels, on="doc_id")
    held = held[held["held_out"]]
    hit = held[held["predicted"] == 1]
    assert (hit["toxic"] == 1).mean() > 0.9 and len(hit) > 0.4 * (held["toxic"] == 1).sum()


def test_pieces_against_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    from folioflow.llm.sentencepieces import MODEL

    library = sp.SentencePieceProcessor(model_file=MODEL)
    docs = documents(spark, SMALL)
    got = registry.op8_sentencepiece(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got["round_trip"].all()
    for ids, text in zip(got["token_ids"], docs["text"].fillna(""), strict=True):
        assert list(ids) == library.encode(text)


def test_mix_is_near_its_targets(spark):
    got = registry.op10_mixing(spark, MIDDLE).toPandas()
    source = documents(spark, MIDDLE)[["doc_id", "source"]]
    by = got.merge(source, on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), all=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"]).all() and (by["target"] <= 3 * by["all"]).all()
    assert (got["taken"] <= 3 * got["size"]).all() and abs(by["target"].sum() - by["all"].sum()) < 1e-3


def test_pipeline_against_plain_stages(spark):
    """Every stage on its predecessor's rows, decided anew by plain Python."""
    import duckdb

    import corpus_pipeline as P
    from folioflow.llm import language_id, sql

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        kept[name] = (docs.toPandas(), out.toPandas())
        docs = spark.createDataFrame(kept[name][1], out.schema)
    before, after = kept["language"]
    model = language_id.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert sorted(after["doc_id"]) == sorted(i for i, t in zip(before["doc_id"], before["text"], strict=True) if not model.judge(t)[2])
    assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) > 0.98 * len(before) and list(after.columns) == list(before.columns)
    before, after = kept["exact"]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    assert sorted(after["doc_id"]) == sorted(before.groupby(before["text"].map(low))["doc_id"].max())
    before, after = kept["near"]
    sets = {i: shingle_set(low(t), 5) for i, t in zip(before["doc_id"], before["text"], strict=True)}
    assert sorted(after["doc_id"]) == sorted(set(roots(sets, 80).values()))
    before, after = kept["mix"]
    con = duckdb.connect()
    con.register("documents", before)
    copies = {i: n for i, n in con.sql(f"SELECT doc_id, copies FROM ({sql.MIXING}) WHERE copies > 0").fetchall()}
    assert after.groupby("doc_id").size().to_dict() == copies
    assert set(after["doc_id"]) <= set(before["doc_id"]) and after.groupby("doc_id").size().max() <= 3 and list(after.columns) == list(before.columns)
    assert len(kept["tokens"][1]) == len(after) and kept["tokens"][1]["round_trip"].all()


def shingle_set(text, k):
    words = text.encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def roots(sets, percent):
    """The least id reachable from each, by comparing all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}
