"""Tokens, lemmas, phrases, vocabulary and bags of words."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.lookup import TermIndex
from newsloom.functions.sizing import is_small
from newsloom.functions.staging import drop_stage, free_shuffles, stage
from newsloom.functions.text import alphabetic_words

MIN_DOCS = 5
MAX_DOC_SHARE = 0.6
# Terms a trained model can have: its vocabulary passes through the driver.
MAX_MODEL_TERMS = 5_000_000
# Tokens that are counted at once.
COUNTED_TOKENS = 1 << 20
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 10.0
PHRASE_DELIMITER = "_"
# Passes over the pairs of a large collection, and tokens for each of them.
PAIR_PASSES = 4
PASS_TOKENS = 1 << 24
# Between terms that pass as one string.
SEPARATOR = "\0"


def tokenise(texts: DataFrame) -> DataFrame:
    """Lower-cased words of each text; a missing text has none."""
    none = F.array().cast("array<string>")
    return texts.select("id", F.coalesce(alphabetic_words(F.col("text")), none).alias("tokens"))


def lemmatise(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace forms by the lemmas of ``(form, lemma)``; other tokens stay.

    The size of the lemma table decides only how: forms are looked up inside the row, without
    a shuffle, or joined. Both ways keep all rows and columns and give the same tokens. Streams
    need a table that fits in a row's lookup. Of several lemmas of a form the first in
    alphabetical order is taken.
    """
    known = lemmas.where("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    if is_small(known):
        return _lemmatise_by_lookup(tokens, known)
    return _lemmatise_by_join(tokens, known)


def _lemmatise_by_join(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Any number of forms: the words are joined with them, and back by row.

    Rows are numbered in a stored copy, so that ids may repeat and numbers stay.
    """
    if tokens.isStreaming:
        raise ValueError("this lemma table is too large to look up in a row of a stream; use newsloom.streaming.tag_in_batches")
    rows = stage(tokens.withColumn("_row", F.monotonically_increasing_id()), "rows")
    words = rows.select("_row", F.posexplode_outer("tokens").alias("pos", "form")).where("pos is not null")
    found = words.join(stage(known, "lemmas"), "form", "left")
    term = F.struct("pos", F.coalesce("lemma", "form").alias("term"))
    lists = found.groupBy("_row").agg(F.sort_array(F.collect_list(term))["term"].alias("_terms"))
    joined = rows.join(lists, "_row", "left").withColumn("tokens", F.coalesce("_terms", "tokens"))
    return joined.select(*tokens.columns)


def with_values(lists: pa.Array, values: pa.Array) -> pa.Array:
    """Lists of the lengths of ``lists`` with other values."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())


def _lemmatise_by_lookup(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """A lemma table of checked size: no shuffle, so it also works on a stream."""
    table = known.toArrow()
    forms, found = (pa.chunked_array(table[name].chunks, pa.string()).combine_chunks() for name in ("form", "lemma"))
    sent = tokens.sparkSession.sparkContext.broadcast((TermIndex(forms), found))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def look_up(lists: pa.Array) -> pa.Array:
        forms, found = sent.value
        flat = lists.flatten()
        places = forms.find(flat)
        return with_values(lists, pc.coalesce(found.take(pa.array(places, mask=places < 0)), flat))

    return tokens.withColumn("tokens", look_up("tokens"))


def _with_next(tokens: Column) -> Column:
    """``(w1, w2)`` for every token and the one after it; the last has a NULL ``w2``.

    Neighbours come from the row itself, without a window or a shuffle. Here and below rows
    are made by outer generators and empty ones dropped afterwards: before an inner one
    Spark tests the array for emptiness, which would tokenise every text twice.
    """
    return F.arrays_zip(tokens.alias("w1"), F.slice(tokens, 2, F.size(tokens)).alias("w2"))


def learn_phrases(
    tokens: DataFrame,
    min_count: int = PHRASE_MIN_COUNT,
    threshold: float = PHRASE_THRESHOLD,
) -> DataFrame:
    """``(w1, w2, n, score)`` of word pairs seen together more often than by chance.

    The score is ``(n12 - min_count) / n1 / n2 * V``, V being the number of distinct words
    and pairs. Every token is the first of one pair, the last token of a pair without a second, so
    words are counted from the pairs. The tokens are stored, and the pairs of a large collection are counted in
    up to ``PAIR_PASSES`` passes, by a hash of their first word: what a pass shuffles, and its pairs that are
    too rare, are deleted before the next one. Counts and phrases are written to the shared folder, as they are
    read several times.
    """
    spark = tokens.sparkSession
    stored = stage(tokens.select("tokens"), "phrase_tokens")
    free_shuffles(spark)
    total = stored.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    passes = min(PAIR_PASSES, max(1, math.ceil(total / PASS_TOKENS)))
    counted, kept, entries = [], [], 0
    for number in range(passes):
        found = stored.select(F.inline_outer(_with_next(F.col("tokens"))).alias("w1", "w2")).where("w1 is not null")
        if passes > 1:
            found = found.where(F.pmod(F.xxhash64("w1"), F.lit(passes)) == number)
        pairs = stage(found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")), "pair_counts")
        del found
        free_shuffles(spark)
        counted.append(stage(pairs.groupBy("w1").agg(F.sum("n").alias("n1")), "word_counts"))
        entries += counted[-1].count() + pairs.where("w2 is not null").count()
        often = pairs.where("w2 is not null")
        if threshold >= 0:
            # Only these can pass, and they are few; so are the rows of a frequent word below.
            often = often.where(F.col("n") > min_count)
        kept.append(stage(often, "frequent_pairs"))
        drop_stage(pairs)
    drop_stage(stored)
    words, candidates = reduce(DataFrame.unionAll, counted), reduce(DataFrame.unionAll, kept)
    scored = (
        candidates.join(words, "w1")
        .join(words.select(F.col("w1").alias("w2"), F.col("n1").alias("n2")), "w2")
        .withColumn("score", (F.col("n") - min_count) / F.col("n1") / F.col("n2") * F.lit(float(entries)))
        .where(F.col("score") > threshold)
        .select("w1", "w2", "n", "score")
    )
    phrases = stage(scored, "phrases")
    for table in (*counted, *kept):
        drop_stage(table)
    free_shuffles(spark)
    return phrases


def _merge_by_join(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Any number of phrases: the pairs of words are joined with them, and back by row.

    Rows are numbered in a stored copy, so that ids may repeat and numbers stay.
    """
    if tokens.isStreaming:
        raise ValueError("this phrase set is too large to look up in a row of a stream; use newsloom.streaming.tag_in_batches")
    rows = stage(tokens.withColumn("_row", F.monotonically_increasing_id()), "rows")
    pairs = rows.select("_row", F.posexplode_outer(_with_next(F.col("tokens"))).alias("pos", "pair"))
    wanted = phrases.select("w1", "w2").distinct()
    hits = pairs.select("_row", "pos", "pair.*").where("w2 is not null").join(wanted, ["w1", "w2"])
    # Overlapping matches form runs of neighbouring positions; left to right, a run gives
    # its first, third, fifth ... pair.
    by_position = W.partitionBy("_row").orderBy("pos")
    runs = hits.select("_row", "pos", (F.col("pos") - F.row_number().over(by_position)).alias("run"))
    in_run = W.partitionBy("_row", "run").orderBy("pos")
    starts = (
        runs.withColumn("nth", F.row_number().over(in_run))
        .where(F.col("nth") % 2 == 1)
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list("pos")).alias("starts"))
    )
    # Copy the stretch before each phrase, then the phrase: linear in the number of tokens.
    merged = F.flatten(
        F.transform(
            "starts",
            lambda start, i: F.concat(
                F.slice("tokens", *_stretch(F.coalesce(F.get("starts", i - 1) + 2, F.lit(0)), start)),
                F.array(
                    F.concat_ws(PHRASE_DELIMITER, F.get("tokens", start), F.get("tokens", start + 1))
                ),
            ),
        )
    )
    tail = F.slice("tokens", *_stretch(F.element_at("starts", -1) + 2, F.size("tokens")))
    whole = F.when(F.col("starts").isNull(), F.col("tokens")).otherwise(F.concat(merged, tail))
    joined = rows.join(starts, "_row", "left").withColumn("tokens", whole)
    return joined.select(*tokens.columns)


def _stretch(begin: Column, end: Column) -> tuple[Column, Column]:
    """Arguments of ``slice`` for positions ``begin`` up to, not including, ``end``."""
    return begin + 1, end - begin


def _merged_lists(lists: pa.Array, words: pa.Array, phrases: np.ndarray) -> pa.Array:
    """One Arrow batch of token lists with phrases joined, without a loop over tokens.

    ``phrases`` holds sorted codes of pairs, ``first * len(words) + second`` by position in
    ``words``.
    """
    flat = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    code = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy().astype(np.int64)
    pair = code[:-1] * len(words) + code[1:]
    pair[(code[:-1] < 0) | (code[1:] < 0)] = -1
    across = ends[(ends > 0) & (ends < len(flat))] - 1  # pairs of two documents
    pair[across] = -1
    place = np.minimum(np.searchsorted(phrases, pair), len(phrases) - 1)
    hits = np.flatnonzero(phrases[place] == pair)
    # In a run of overlapping hits, left to right, the first, third, fifth ... are taken.
    number = np.arange(len(hits))
    opens = np.diff(hits, prepend=-2) != 1
    starts = hits[(number - np.maximum.accumulate(np.where(opens, number, 0))) % 2 == 0]

    joined = pc.binary_join_element_wise(flat.take(pa.array(starts)), flat.take(pa.array(starts + 1)), PHRASE_DELIMITER)
    first, kept = np.zeros(len(flat), bool), np.ones(len(flat), bool)
    first[starts] = True
    kept[starts + 1] = False
    values = pc.replace_with_mask(flat, pa.array(first), joined).filter(pa.array(kept))
    lost = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(lengths))
    offsets = np.concatenate([[0], np.cumsum(lengths - lost)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())


def _merge_by_lookup(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """A phrase set of checked size: no shuffle, so it also works on a stream."""
    pairs = phrases.select("w1", "w2").distinct().toArrow()
    if pairs.num_rows == 0:
        return tokens
    words = pc.unique(pa.chunked_array([*pairs["w1"].chunks, *pairs["w2"].chunks]).combine_chunks())
    first, second = (pc.index_in(pairs[name], value_set=words).to_numpy().astype(np.int64) for name in ("w1", "w2"))
    known = tokens.sparkSession.sparkContext.broadcast((words, np.sort(first * len(words) + second)))

    @F.arrow_udf("array<string>")
    def merge(lists: pa.Array) -> pa.Array:
        if len(lists.flatten()) < 2:
            return lists
        return _merged_lists(lists, *known.value)

    return tokens.withColumn("tokens", merge("tokens"))


def apply_phrases(tokens: DataFrame, phrases: DataFrame) -> DataFrame:
    """Join the words of known phrases, greedily from left to right.

    The size of the phrase set decides only how: both ways keep all rows and columns and
    give the same tokens. Streams need a set that fits in a row's lookup.
    """
    if is_small(phrases.select("w1", "w2")):
        return _merge_by_lookup(tokens, phrases)
    return _merge_by_join(tokens, phrases)


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each stretch of documents with the documents that hold them and their occurrences."""
    for batch in batches:
        lists = batch.column(0)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        passed = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.flatnonzero(np.diff(passed[:-1] // COUNTED_TOKENS)) + 1
        for low, high in zip((0, *cuts), (*cuts, len(lists)), strict=True):
            words = lists.slice(low, high - low).flatten().dictionary_encode()
            kept = words.indices.is_valid().to_numpy(zero_copy_only=False)
            codes = pc.fill_null(words.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)[kept]
            owners = np.repeat(np.arange(high - low), lengths[low:high])[kept]
            size = len(words.dictionary)
            df = np.bincount(np.unique(owners * max(size, 1) + codes) % max(size, 1), minlength=size)[:size]
            tf = np.bincount(codes, minlength=size)[:size]
            yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(df), pa.array(tf)], names=["term", "df", "tf"])


def term_counts(tokens: DataFrame) -> DataFrame:
    """``(term, df, tf)``: documents that hold a term and occurrences, in one shuffle.

    Terms are counted by stretches of documents first, so a frequent term has a row per stretch and no
    (document, term) pairs are shuffled.
    """
    counted = tokens.select("tokens").mapInArrow(_counted_terms, "term string, df long, tf long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def build_vocabulary(
    tokens: DataFrame,
    min_docs: int = MIN_DOCS,
    max_doc_share: float = MAX_DOC_SHARE,
    max_terms: int | None = None,
) -> DataFrame:
    """``(term, df, tf)``: terms neither rare nor everywhere.

    All of them, unless the caller asks for the ``max_terms`` with the highest ``df``.
    """
    documents = tokens.agg(F.count(F.lit(1))).scalar()
    terms = term_counts(tokens).where(
        (F.col("df") >= min_docs) & (F.col("df") <= F.floor(F.lit(max_doc_share) * documents))
    )
    return terms if max_terms is None else terms.orderBy(F.desc("df"), F.asc("term")).limit(max_terms)


def fit_vectoriser(
    tokens: DataFrame,
    min_docs: int = MIN_DOCS,
    max_doc_share: float = MAX_DOC_SHARE,
    max_terms: int | None = None,
) -> CountVectorizerModel:
    """A transformer of ``tokens`` to sparse counts over the terms of ``build_vocabulary``.

    Spark's estimator would cap by occurrences instead of documents and leave the order of
    equally frequent terms to chance; here the order is fixed, so that a seed decides what
    a model trained on the counts looks like. The terms pass through the driver, as they do in
    the estimator; more than ``MAX_MODEL_TERMS`` are an error, never a cut. Models of
    ``newsloom.operators.topic_tables`` have no such bound.
    """
    vocabulary = stage(build_vocabulary(tokens, min_docs, max_doc_share, max_terms), "vocabulary")
    size = vocabulary.count()
    if size > MAX_MODEL_TERMS:
        raise ValueError(f"{size} terms are too many for the driver; train with optimizer 'gibbs' or 'variational', which need no driver")
    if not size:
        return CountVectorizerModel.from_vocabulary([], inputCol="tokens", outputCol="features")
    # Terms pass as one string: Spark's ``from_vocabulary`` makes a call to the JVM for every term.
    in_order = F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("order"), "term")))
    joined = vocabulary.agg(in_order.alias("ranked")).select(F.array_join("ranked.term", SEPARATOR)).first()[0]
    jvm = tokens.sparkSession.sparkContext._jvm
    terms = jvm.java.util.regex.Pattern.compile(SEPARATOR).split(joined, -1)
    if len(terms) != size:  # terms that hold the separator
        ranked = vocabulary.orderBy(F.desc("df"), F.asc("term")).select("term").collect()
        return CountVectorizerModel.from_vocabulary([row.term for row in ranked], inputCol="tokens", outputCol="features")
    model = jvm.org.apache.spark.ml.feature.CountVectorizerModel(f"terms_{uuid.uuid4().hex[:12]}", terms)
    model.setInputCol("tokens")
    model.setOutputCol("features")
    return CountVectorizerModel(model)._set(inputCol="tokens", outputCol="features")


def vocabulary_terms(spark: SparkSession, vectoriser: CountVectorizerModel) -> DataFrame:
    """``(term_id, term)`` of a fitted model; its size is checked when it is fitted."""
    terms = pa.array(vectoriser.vocabulary, pa.string())
    return spark.createDataFrame(pa.table({"term_id": pa.array(np.arange(len(terms), dtype=np.int32)), "term": terms}))


def bags_of_words(tokens: DataFrame, vectoriser: CountVectorizerModel) -> DataFrame:
    """``(id, features)`` with sparse vectors over ``term_id``; unknown terms are dropped."""
    return vectoriser.transform(tokens).drop("tokens")


def count_terms(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(id, term, n)`` of the terms of a vocabulary table of any size, without the driver.

    Terms are counted within their row first, so a frequent term has one row per document.
    """
    in_order = F.sort_array("tokens")
    starts = F.filter(
        F.sequence(F.lit(0), F.size("sorted") - 1), lambda i: (i == 0) | (F.get("sorted", i) != F.get("sorted", i - 1))
    )
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("sorted")))
    counted = F.zip_with("starts", ends, lambda a, b: F.struct(F.get("sorted", a).alias("term"), (b - a).cast("long").alias("n")))
    # Each step stands in a variable, so that it is computed once per row.
    rows = tokens.where(F.size("tokens") > 0).select("id", in_order.alias("sorted"))
    rows = rows.withColumn("starts", starts).select("id", F.inline(counted))
    return rows.join(vocabulary.select("term"), "term").select("id", "term", "n")


def flat_bags_of_words(bags: DataFrame) -> DataFrame:
    """``(id, term_id, n)`` from sparse vectors, without a shuffle; other columns are kept."""
    vector = F.unwrap_udt("features")
    entries = F.arrays_zip(vector["indices"].alias("term_id"), vector["values"].alias("n"))
    kept = [name for name in bags.columns if name != "features"]
    flat = bags.select(*kept, F.inline_outer(entries)).where("term_id is not null")
    return flat.withColumn("n", F.col("n").cast("long"))
