"""Training and applying LDA topic models."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark import Broadcast
from pyspark.ml.clustering import LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.lookup import TermIndex
from newsloom.functions.staging import path_exists, stage
from newsloom.operators import lda_steps as L
from newsloom.operators import topic_sampling as S
from newsloom.operators.articles import top_rows_per
from newsloom.operators.features import apply_phrases
from newsloom.operators.lemma_rules import prepare_tokens
from newsloom.operators.topic_tables import TopicTable

MIN_PROB = 0.1
TOP_WORDS = 10
# Numbers that pass between the driver's Python and its JVM at once, and terms that a task makes rows of.
PASSED_NUMBERS = 1 << 19
TERMS_PER_TASK = 1 << 17


@dataclass
class TopicModel:
    """A vocabulary and an LDA model over it, with the lemmas, lemma rules and phrases of its tokens.

    Phrases and lemmas may be any number. Where they are too many to look up inside a row, a stream is
    tagged batch by batch (``newsloom.streaming.tag_in_batches``).
    """

    vectoriser: CountVectorizerModel
    lda: LDAModel
    phrases: DataFrame | None = None
    lemmas: DataFrame | None = None
    rules: DataFrame | None = None

    @property
    def num_topics(self) -> int:
        return self.lda.getK()

    def prepare(self, texts: DataFrame) -> DataFrame:
        """Tokens of ``(id, text)`` as the training texts had them, before phrases are merged."""
        return prepare_tokens(texts, self.lemmas, self.rules)

    @cached_property
    def _matrix(self) -> np.ndarray:
        """Weights by term and topic; a model trained here still has them."""
        kept = getattr(self.lda, "_trained_matrix", None)
        return _from_jvm(self.lda) if kept is None else kept

    @cached_property
    def _terms(self) -> pa.Array:
        return pa.array(self.vectoriser.vocabulary, pa.string())

    @cached_property
    def _sent(self) -> Broadcast:
        """Terms, how likely they are in each topic, and the topics' prior, for all tasks."""
        alpha = np.array(self.lda.estimatedDocConcentration().toArray())
        weights = L.expected_weights(self._matrix)
        return SparkSession.getActiveSession().sparkContext.broadcast((TermIndex(self._terms), weights, alpha))

    def shares(self, tokens: DataFrame) -> DataFrame:
        """``(id, shares, has_terms)`` and the other columns, row by row: no shuffle, on streams as well.

        Each document by variational steps, with the model's matrix sent to the tasks once.
        """
        sent = self._sent

        @F.arrow_udf("struct<shares: array<double>, has_terms: boolean>")
        def infer(lists: pa.Array) -> pa.Array:
            terms, weights, alpha = sent.value
            shares, known = [np.zeros((0, len(alpha)))], [np.zeros(0, dtype=bool)]
            for part in L.pieces(lists):
                codes, n, bounds = L.coded(part, terms)
                gamma = S.variational(codes, n, bounds, weights, alpha)
                known.append(np.diff(bounds) > 0)
                shares.append(np.where(known[-1][:, None], gamma / gamma.sum(axis=1, keepdims=True), 0.0))
            every = np.arange(len(lists) + 1, dtype=np.int32) * len(alpha)
            found = pa.ListArray.from_arrays(pa.array(every), pa.array(np.concatenate(shares).ravel()))
            return pa.StructArray.from_arrays([found, pa.array(np.concatenate(known))], names=["shares", "has_terms"])

        kept = [name for name in tokens.columns if name != "tokens"]
        return tokens.select(*kept, infer("tokens").alias("inferred")).select(*kept, "inferred.shares", "inferred.has_terms")

    def term_weights(self) -> DataFrame:
        """``(topic_id, term_id, term, weight)``, adding up to 1 in each topic; the model and its vocabulary
        are on the driver and are sent to the tasks, which make a row per term."""
        spark = SparkSession.getActiveSession()
        sent = spark.sparkContext.broadcast((self._terms, self._matrix, self._matrix.sum(axis=0)))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, matrix, totals = sent.value
            for batch in batches:
                ids = batch.column(0)
                weights = matrix[ids.to_numpy()] / totals
                every = np.arange(len(ids) + 1, dtype=np.int32) * len(totals)
                lists = pa.ListArray.from_arrays(pa.array(every), pa.array(weights.ravel()))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int32()), terms.take(ids), lists], names=["term_id", "term", "weights"])

        size = len(self._matrix)
        numbers = spark.range(0, size, 1, max(1, -(-size // TERMS_PER_TASK)))
        stored = stage(numbers.mapInArrow(rows, "term_id int, term string, weights array<double>"), "term_weights")
        sent.destroy()
        return stored.select(F.posexplode("weights").alias("topic_id", "weight"), "term_id", "term").select(
            "topic_id", "term_id", "term", "weight"
        )

    def write_parts(self, folder: str) -> None:
        self.vectoriser.write().save(f"{folder}/vectoriser")
        self.lda.write().save(f"{folder}/lda")

    @classmethod
    def read_parts(cls, spark: SparkSession, folder: str, **tables: DataFrame | None) -> TopicModel:
        return cls(CountVectorizerModel.load(f"{folder}/vectoriser"), LocalLDAModel.load(f"{folder}/lda"), **tables)

    def save(self, path: str) -> None:
        save_model(self, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnyModel:
        return load_model(spark, path)


AnyModel = TopicModel | TopicTable
PREPARATION = ("phrases", "lemmas", "rules")
VERSION_SCHEMA = "number long, folder string, " + ", ".join(f"has_{part} boolean" for part in PREPARATION)


def _last_version(spark: SparkSession, path: str) -> int:
    if not path_exists(spark, f"{path}/versions"):
        return 0
    return spark.read.schema(VERSION_SCHEMA).parquet(f"{path}/versions").agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]


def save_model(model: AnyModel, path: str) -> None:
    """Write all parts to a new folder and list it last, so that an older model under the same
    path stays whole until then and none of its parts is mixed in."""
    spark = SparkSession.getActiveSession()
    number = _last_version(spark, path)
    name = f"model-{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    model.write_parts(folder)
    for part in PREPARATION:
        if (table := getattr(model, part)) is not None:
            table.write.parquet(f"{folder}/{part}")
    row = (number + 1, name, *(getattr(model, part) is not None for part in PREPARATION))
    spark.createDataFrame([row], VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def load_model(spark: SparkSession, path: str) -> AnyModel:
    """The model saved last; of models saved at once, with equal numbers, always the same one."""
    version = spark.read.schema(VERSION_SCHEMA).parquet(f"{path}/versions").orderBy(F.desc("number"), "folder").first()
    folder = f"{path}/{version['folder']}"
    kind = TopicTable if path_exists(spark, f"{folder}/about") else TopicModel
    tables = {part: spark.read.parquet(f"{folder}/{part}") for part in PREPARATION if version[f"has_{part}"]}
    return kind.read_parts(spark, folder, **tables)


def _local_model(spark: SparkSession, matrix: np.ndarray, alpha: np.ndarray, eta: float) -> LocalLDAModel:
    """Spark's model with weights by term and topic, so that all it offers can be used."""
    jvm = spark._jvm.org.apache.spark
    topics = jvm.mllib.linalg.DenseMatrix(len(matrix), len(alpha), _to_jvm(spark, matrix.T))
    prior = jvm.mllib.linalg.DenseVector(_to_jvm(spark, alpha[None, :]))
    weights = jvm.mllib.clustering.LocalLDAModel(topics, prior, eta, L.GAMMA_SHAPE)
    model = jvm.ml.clustering.LocalLDAModel(f"lda_{uuid.uuid4().hex[:12]}", len(matrix), weights, spark._jsparkSession)
    found = LocalLDAModel(model.set(model.k(), len(alpha)))._set(k=len(alpha))
    found._trained_matrix = matrix
    return found


def _to_jvm(spark: SparkSession, rows: np.ndarray) -> JavaObject:
    """An array of the JVM with the numbers of all rows, some of them at a time."""
    gateway = spark.sparkContext._gateway
    found, done = gateway.new_array(gateway.jvm.double, rows.size), 0
    for row in rows:
        for low in range(0, len(row), PASSED_NUMBERS):
            piece = row[low : low + PASSED_NUMBERS].astype(">f8")
            gateway.jvm.java.nio.ByteBuffer.wrap(piece.tobytes()).asDoubleBuffer().get(found, done, len(piece))
            done += len(piece)
    return found


def _from_jvm(lda: LDAModel) -> np.ndarray:
    """Weights by term and topic of a model that Spark has loaded, some numbers at a time."""
    topics, jvm = lda._java_obj.topicsMatrix(), SparkSession.getActiveSession()._jvm
    if topics.isTransposed():
        return lda.topicsMatrix().toArray()
    size, num_topics, values = topics.numRows(), topics.numCols(), topics.values()
    out = np.empty((size, num_topics))
    for k in range(num_topics):
        for low in range(0, size, PASSED_NUMBERS):
            n = min(PASSED_NUMBERS, size - low)
            buffer = jvm.java.nio.ByteBuffer.allocate(8 * n)
            buffer.asDoubleBuffer().put(values, k * size + low, n)
            out[low : low + n, k] = np.frombuffer(buffer.array(), ">f8")
    return out


def train_lda(tokens: DataFrame, vectoriser: CountVectorizerModel, num_topics: int, optimizer: str = "online", **params) -> LDAModel:
    """LDA over the terms of ``vectoriser``; other parameters are those of Spark's estimator.

    Every iteration reads the documents, as numbers of terms, from the shared folder. ``online`` is
    variational Bayes on mini batches, ``em`` keeps every document in each step. A batch is drawn with
    replacement; by default it is as large as the collection, so that after n iterations a share of e**-n
    of the documents has not been drawn. A lower ``subsamplingRate`` r leaves e**-(r n).
    """
    if optimizer not in ("online", "em"):
        raise ValueError(f"unknown optimizer: {optimizer}")
    terms = pa.array(vectoriser.vocabulary, pa.string())
    # Dealt out evenly, as each step is as slow as its largest task.
    documents = stage(L.code_documents(tokens, terms).repartition(tokens.sparkSession.sparkContext.defaultParallelism), "coded")
    train = L.train_online if optimizer == "online" else L.train_em
    return _local_model(tokens.sparkSession, *train(documents, len(terms), num_topics, **params))


def infer_topics(model: AnyModel, tokens: DataFrame) -> DataFrame:
    """``(id, shares, has_terms)`` of prepared tokens: one share per topic, adding up to 1.

    A document without any known term is kept, with zeros and ``has_terms`` false. Other columns are
    kept too. With a ``TopicModel`` this is row by row, so it needs no shuffle and runs on streams.
    """
    return model.shares(tokens if model.phrases is None else apply_phrases(tokens, model.phrases))


def long_topics(vectors: DataFrame) -> DataFrame:
    """``(id, topic_id, prob)`` for every article and topic.

    The outer generator matters: before an inner one Spark adds a test of the array, and
    with shares that are being inferred that would infer them twice.
    """
    return vectors.select("id", F.posexplode_outer("shares").alias("topic_id", "prob")).where("topic_id is not null")


def write_topics(vectors: DataFrame, path: str) -> None:
    """Two layouts: by article for scans and lookups by id, by topic and share for retrieval.

    Inference runs once and keeps the order of its input, so tokens clustered by id give
    shares clustered by id without a shuffle. The second layout is sorted from the first;
    there a query for one topic above a bound skips all other row groups, and a topic found
    in most articles is spread over many files.
    """
    vectors.write.mode("overwrite").parquet(f"{path}/by_article")
    by_topic = long_topics(vectors.sparkSession.read.parquet(f"{path}/by_article")).where("prob > 0")
    # Copies of an article share their shares; with the id in the key they do not share a task.
    by_topic.repartitionByRange("topic_id", "prob", "id").sortWithinPartitions("topic_id", "prob").write.mode(
        "overwrite"
    ).parquet(f"{path}/by_topic")


def topic_words(model: AnyModel, spark: SparkSession, normalised: bool = False) -> DataFrame:
    """``(topic_id, term_id, term, weight)`` for all topics and terms of the model."""
    weights = model.term_weights()
    return normalise_topic_words(weights) if normalised else weights


def normalise_topic_words(words: DataFrame) -> DataFrame:
    """Weights that add up to 1 in each topic."""
    totals = words.groupBy("topic_id").agg(F.sum("weight").alias("total"))
    return (
        words.join(F.broadcast(totals), "topic_id")
        .withColumn("weight", F.col("weight") / F.col("total"))
        .drop("total")
    )


def top_words(words: DataFrame, top_n: int = TOP_WORDS) -> DataFrame:
    """``(topic_id, words, label)``: the heaviest words of each topic, in order."""
    ranked = top_rows_per(words.select("topic_id", "term", "weight"), "topic_id", [F.desc("weight"), F.asc("term")], top_n)
    in_order = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return (
        ranked.groupBy("topic_id")
        .agg(in_order.alias("ranked"))
        .select("topic_id", F.col("ranked.term").alias("words"))
        .withColumn("label", F.array_join("words", ", "))
    )


def article_topics(vectors: DataFrame, min_prob: float = MIN_PROB) -> DataFrame:
    """``(id, rank, topic_id, prob)``: topics of each article above ``min_prob``, best first.

    Ranked inside each row: no window and no shuffle, on streams as well.
    """
    pairs = F.transform("shares", lambda share, topic: F.struct((-share).alias("order"), topic.alias("topic_id")))
    ranked = F.sort_array(F.filter(pairs, lambda pair: -pair["order"] > min_prob))
    rows = vectors.select(
        *[name for name in vectors.columns if name not in ("shares", "has_terms")],
        F.posexplode_outer(ranked).alias("pos", "pair"),
    )
    kept = [name for name in rows.columns if name not in ("pos", "pair")]
    return rows.where("pos is not null").select(
        *kept,
        (F.col("pos") + 1).alias("rank"),
        F.col("pair.topic_id").alias("topic_id"),
        (-F.col("pair.order")).alias("prob"),
    )


def tag_texts(model: AnyModel, texts: DataFrame, min_prob: float = MIN_PROB) -> DataFrame:
    """Topics of unseen ``(id, text)``, prepared exactly as the training texts were."""
    return article_topics(infer_topics(model, model.prepare(texts)), min_prob)


def with_labels(tagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the words of each topic; one row per topic is broadcast."""
    return tagged.join(F.broadcast(labels), "topic_id")

