"""Approximate similarity search: inverted lists, product-quantised codes, exact re-ranking.

The lists are the cells of a k-means model. It is fitted on a sample of about ``SAMPLE`` rows chosen by a hash of their ids, and is the only thing that
looks at a sample: every row of the corpus is put into a list and coded. A code holds, for every stretch of ``SUB`` dimensions, which of up to 256 typical stretches
is nearest to the row's distance from the centre of its list; the codebooks of the stretches are fitted in tasks, one for each stretch.

A query probes the lists whose centres are most similar to it. Queries and rows meet by an equi-join on the list: a cogroup whose
cells hold at most ``LIST_BLOCK`` rows of a list and ``PROBE_BLOCK`` of the queries that probe it, so a hot list is many cells. In a cell, codes are scored from a table of
products (a sum of one entry for each stretch), the filter on classes masks rows before any is chosen, and the best ``keep`` per query leave it. Those of all lists,
``keep`` per query, meet their exact vectors by id, are scored as the exact search scores, and ranked alike. The corpus's vectors are read for the candidates alone.

How many lists to probe and how many candidates to keep isn't guessed: ``calibrated`` looks up, for vectors of the sample, in which list and at which place
by code their true neighbours are found, and takes the numbers that reach ``AIM`` of them.

Ids must be unique. Rows and queries without a vector are left out; null or empty classes ask without a filter; rows of no class fit every filter; an empty corpus
gives an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.vectors import dot
from folioflow.operators.search import DIGITS, askable, blocks, chosen, dealt, fitting, matrix, ranked, searchable
from folioflow.plans.materialize import spill

SAMPLE = 20_000
MAX_LISTS = 1024
SUB, CODES = 4, 256
LIST_BLOCK, PROBE_BLOCK, SLICE = 16_384, 256, 32
ROUNDS = 8
AIM, PROBES = 0.96, 200

INDEX = "list_id int, id long, code binary, applies_to array<string>"
_MODEL = "part string, number int, probes int, keep int, values array<float>"


@dataclass(frozen=True)
class Model:
    """Centres of the lists, codebooks (stretch, code, SUB), and how widely to search."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    keep: int

    def stretched(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as (row, stretch, SUB), filled up with zeros."""
        width = len(self.books) * SUB
        return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))).reshape(len(vectors), -1, SUB)

    def lists(self, vectors: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest centre."""
        return np.argmax(vectors @ self.centres.T - (self.centres**2).sum(1) / 2, axis=1)

    def codes(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        parts = self.stretched(vectors - self.centres[lists])
        return np.stack([_nearest(parts[:, j], book) for j, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def probed(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """For each query its lists, the most similar centre first."""
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, : probes or self.probes]

    def scores(self, queries: np.ndarray, codes: np.ndarray, lists: np.ndarray | int) -> np.ndarray:
        """(row, query): the similarity that the codes stand for."""
        table = np.einsum("qjs,jcs->jcq", self.stretched(queries), self.books)
        out = (self.centres @ queries.T)[lists] + np.zeros((len(codes), 1), np.float32)
        for j in range(len(self.books)):
            out += table[j][codes[:, j]]
        return out


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmax(points @ book.T - (book**2).sum(1) / 2, axis=1)


def codebook(points: np.ndarray, codes: int = CODES, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Typical points, by some rounds of k-means; a code that no point is nearest to stays where it is."""
    rng = np.random.default_rng(seed)
    book = points[rng.choice(len(points), min(codes, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, book)
        n = np.bincount(near, minlength=len(book))
        for s in range(points.shape[1]):
            total = np.bincount(near, points[:, s], minlength=len(book))
            book[:, s] = np.where(n > 0, total / np.maximum(n, 1), book[:, s])
    return book


def sampled(rows: DataFrame, at_most: int = SAMPLE) -> DataFrame:
    """About ``at_most`` rows by a hash of their ids, the same in every run; all where there are fewer."""
    n = rows.count()
    return rows if n <= at_most else rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(n)) < at_most)


def fit(corpus: DataFrame, lists: int | None = None, k: int = 10) -> Model:
    """A model for ``corpus`` (id, embedding, applies_to), for searches of the ``k`` best."""
    rows = searchable(corpus)
    sample = spill(sampled(rows).select("id", "embedding"), "ann-sample")
    n = sample.count()
    if not n:
        return Model(np.zeros((1, 1), np.float32), np.zeros((1, 1, SUB), np.float32), 1, k)
    lists = max(1, min(lists or round(math.sqrt(rows.count())), MAX_LISTS, n))
    if lists > 1:
        trained = KMeans(k=lists, seed=7, maxIter=ROUNDS).fit(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
        centres = np.array(trained.clusterCenters(), np.float32)
    else:
        centres = matrix(sample.agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(len(sample.first()["embedding"]))]).alias("embedding")).toArrow(), kind=np.float32)
    width = -(-centres.shape[1] // SUB)
    coarse = Model(centres, np.zeros((width, 1, SUB), np.float32), lists, n)
    parts = sample.mapInArrow(lambda batches: _stretches(batches, coarse), "stretch int, point array<float>")
    fitted = parts.groupBy("stretch").applyInArrow(_fit_stretch, "stretch int, book array<float>").orderBy("stretch").toArrow()
    books = [np.array(b, np.float32).reshape(-1, SUB) for b in fitted["book"].to_pylist()]
    return calibrated(Model(centres, np.stack(books), lists, n), sample, k)


def _stretches(batches: Iterator[pa.RecordBatch], coarse: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = matrix(pa.Table.from_batches([batch]), kind=np.float32)
        if len(vectors):
            parts = coarse.stretched(vectors - coarse.centres[coarse.lists(vectors)])
            for j in range(parts.shape[1]):
                yield pa.RecordBatch.from_pydict({"stretch": pa.array([j] * len(parts), pa.int32()), "point": pa.array(list(parts[:, j]), pa.list_(pa.float32()))})


def _fit_stretch(table: pa.Table) -> pa.Table:
    book = codebook(matrix(table, "point", np.float32))
    return pa.table({"stretch": table["stretch"].slice(0, 1), "book": pa.array([book.ravel()], pa.list_(pa.float32()))})


def calibrated(model: Model, sample: DataFrame, k: int) -> Model:
    """``model`` with the number of lists and of candidates at which AIM of the true neighbours of ``PROBES`` vectors of the sample are found.

    The sample is a share of the corpus, so a true neighbour has more rows before it in the corpus than in the sample: candidates are scaled up by that share's root.
    """
    rows = sample.toArrow()
    vectors = matrix(rows, kind=np.float32)
    rng = np.random.default_rng(1)
    asked = rng.choice(len(vectors), min(PROBES, len(vectors)), replace=False)
    true = np.argsort(-(vectors[asked] @ vectors.T), axis=1, kind="stable")[:, : k + 1]
    lists = model.lists(vectors)
    codes = model.codes(vectors, lists)
    places = np.argsort(model.probed(vectors[asked], len(model.centres)), axis=1)
    probes = int(np.quantile(places[np.arange(len(asked))[:, None], lists[true]], (1 + AIM) / 2, method="higher")) + 1
    found = np.argsort(np.argsort(-model.scores(vectors[asked], codes, lists), axis=0, kind="stable"), axis=0)
    keep = int(np.quantile(found[true, np.arange(len(asked))[:, None]], (1 + AIM) / 2, method="higher")) + 1
    return Model(model.centres, model.books, probes, max(4 * k, 2 * keep))


def index(corpus: DataFrame, model: Model) -> DataFrame:
    """Every row of ``corpus`` with its list and code: (list_id, id, code, applies_to)."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(pa.Table.from_batches([batch]), kind=np.float32)
                lists = model.lists(vectors)
                code = [c.tobytes() for c in model.codes(vectors, lists)]
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch["id"], pa.array(code, pa.binary()), batch["applies_to"]], ["list_id", "id", "code", "applies_to"])

    return searchable(corpus).mapInArrow(coded, INDEX)


def save(corpus: DataFrame, model: Model, path: str) -> None:
    """The index of ``corpus`` and its model as two tables in the folder ``path``; rows lie by list, a hot list in several files."""
    index(corpus, model).repartitionByRange("list_id", "id").sortWithinPartitions("list_id", "id").write.mode("overwrite").parquet(f"{path}/lists")
    rows = [("centre", i, model.probes, model.keep, c.tolist()) for i, c in enumerate(model.centres)] + [("book", j, model.probes, model.keep, b.ravel().tolist()) for j, b in enumerate(model.books)]
    corpus.sparkSession.createDataFrame(rows, _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Model]:
    """(index, model) of a folder that ``save`` wrote. The model is bounded: MAX_LISTS centres and one codebook a stretch."""
    rows = spark.read.parquet(f"{path}/model").orderBy("number").collect()
    part = lambda name: [np.array(r["values"], np.float32) for r in rows if r["part"] == name]
    model = Model(np.stack(part("centre")), np.stack([b.reshape(-1, SUB) for b in part("book")]), rows[0]["probes"], rows[0]["keep"])
    return spark.read.parquet(f"{path}/lists"), model


def probing(queries: DataFrame, model: Model) -> DataFrame:
    """``queries`` once for each list they probe: list_id in front."""

    @F.pandas_udf("array<int>")
    def probed(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(model.probed(np.stack(vectors.to_numpy()).astype(np.float32)).astype(np.int32)), index=vectors.index)

    return askable(queries).select(F.explode(probed("wanted")).alias("list_id"), "*")


def candidates(lists: DataFrame, queries: DataFrame, model: Model, exclude_self: bool = False) -> DataFrame:
    """(query_id, id): the ``model.keep`` best rows by code for each query, of the lists it probes and the rows that fit its filter."""
    asked = spill(probing(queries, model), "ann-probes")
    # the sizes of lists and of the crowds that probe them, at most MAX_LISTS rows each, say into how many cells a list is dealt
    sizes = lists.groupBy("list_id").agg(F.count("*").alias("_rows")).join(asked.groupBy("list_id").agg(F.count("*").alias("_asked")), "list_id")
    sizes = F.broadcast(sizes.select("list_id", _parts("_rows", LIST_BLOCK).alias("_down"), _parts("_asked", PROBE_BLOCK).alias("_across")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lists.join(sizes, "list_id").withColumn("_c", dealt(F.col("id"), F.col("_down"))).withColumn("_q", spread("_across")).drop("_down", "_across")
    right = asked.join(sizes, "list_id").withColumn("_q", dealt(F.col("query_id"), F.col("_across"))).withColumn("_c", spread("_down")).drop("_down", "_across")
    keep = model.keep

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        parts = list(_best_codes(rows, asked, model, keep, exclude_self))
        return pa.concat_tables(parts) if parts else _CANDIDATES.empty_table()

    key = ["list_id", "_c", "_q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query_id long, id long, score float")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("_n", place).filter(F.col("_n") <= keep).select("query_id", "id")


def _parts(column: str, size: int) -> Column:
    return F.ceil(F.col(column) / size).cast("int")


_CANDIDATES = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float32())])


def _best_codes(rows: pa.Table, asked: pa.Table, model: Model, keep: int, exclude_self: bool) -> Iterator[pa.Table]:
    if not rows.num_rows or not asked.num_rows:
        return
    own, names, vectors = rows["id"].to_numpy(), asked["query_id"].to_numpy(), matrix(asked, "wanted", np.float32)
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    number = rows["list_id"][0].as_py()
    fits = dict(fitting(rows, asked))
    for at in range(0, len(names), SLICE):
        scores = model.scores(vectors[at : at + SLICE], codes, number)
        fit = np.ones(scores.shape, bool)
        for q in range(scores.shape[1]):
            if fits[at + q] is not None:
                fit[:, q] = fits[at + q]
        if exclude_self:
            fit &= own[:, None] != names[at : at + SLICE]
        row, q = chosen(scores, fit, own, keep)
        yield pa.table({"query_id": names[at + q], "id": own[row], "score": scores[row, q]}, schema=_CANDIDATES)


def search(corpus: DataFrame, lists: DataFrame, queries: DataFrame, model: Model, k: int, exclude_self: bool = False) -> DataFrame:
    """As ``search.topk``: (query_id, rank, id, sim, applies_to), of the rows found by their codes. ``lists`` is the index of ``corpus``."""
    found = spill(candidates(lists, queries, model, exclude_self), "ann-candidates")
    asked = askable(queries).select("query_id", "wanted")
    met = found.join(searchable(corpus), "id").join(asked, "query_id")
    return ranked(met.select("query_id", "id", F.round(dot(F.col("embedding"), F.col("wanted")), DIGITS).alias("sim"), "applies_to"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the (query_id, id) of an exact search were found."""
    marked = exact.select("query_id", "id").join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return marked.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
