"""Trained topic models. Their values depend on seed and partitioning, so SQL checks what
must hold for any model: one share per topic adding up to 1, all articles, all terms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.staging import scratch_path, stage
from newsloom.operators import features as C
from newsloom.operators import topic_model as E
from newsloom.operators.features import tokenise
from newsloom.plans import ArticleCorpus, TopicExplorer
from newsloom.sources.pages import extract_articles
from newsloom.streaming import read_article_stream, tag_in_batches, tag_stream, write_tags
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query
from newsloom.workload.source_queries import PAGES_SQL
from newsloom.workload.tables import NUM_TOPICS, Tables

ONLINE = {"maxIter": 10, "docConcentration": [0.1], "seed": 7}
EM = {"maxIter": 5, "seed": 7}
GIBBS = {"iterations": 20, "sweeps_per_merge": 4, "alpha": 0.1, "optimize_interval": 1, "seed": 7}
VARIATIONAL = {"iterations": 6, "alpha": 0.1, "seed": 7}
OPTIONS = {"online": ONLINE, "em": EM, "gibbs": GIBBS, "variational": VARIATIONAL}

_corpora: dict[tuple[str, str], ArticleCorpus] = {}
_models: dict[tuple[str, str, str], E.AnyModel] = {}


def corpus(t) -> ArticleCorpus:
    """One corpus per session and data folder, with its tokens stored."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _corpora:
        _corpora[key] = ArticleCorpus(t.texts, t.posts, tokens_path=scratch_path(t.spark, "tokens"))
    return _corpora[key]


def model(t, optimizer: str = "online") -> E.AnyModel:
    key = (t.spark.sparkContext.applicationId, t.sf_dir, optimizer)
    if key not in _models:
        _models[key] = corpus(t).train(NUM_TOPICS, optimizer, **OPTIONS[optimizer])
    return _models[key]


def forget() -> None:
    """Drop what queries share, so that the next one trains and tokenises for itself."""
    _corpora.clear()
    _models.clear()


def prepare(spark, sf_dir: str) -> None:
    """Train the model that queries share."""
    model(Tables(spark, sf_dir))


def vectors(t, optimizer: str = "online"):
    return E.infer_topics(model(t, optimizer), corpus(t).tokens())


TOPIC_SUMS_SQL = """SELECT topic_id, (SELECT count(*) FROM vocabulary) AS n_terms, CAST(1.0 AS DOUBLE) AS total FROM topics"""

# Articles with a known term have shares that add up to 1, others have none.
SHARE_SUMS_SQL = """SELECT t.id, coalesce(k.known, false) AS has_terms, CAST(10 AS INTEGER) AS n_topics,
    CASE WHEN k.known THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS total
    FROM texts t LEFT JOIN (SELECT DISTINCT id, true AS known FROM words JOIN vocabulary USING (term)) k ON k.id = t.id"""


def topic_sums(words):
    return words.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("total")
    )


def share_sums(found):
    total = F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)
    return found.select("id", "has_terms", F.size("shares").alias("n_topics"), F.round(total, 6).alias("total"))


# What holds for the ten heaviest words of every topic of a model.
TRAINED_SQL = """SELECT topic_id, CAST(10 AS BIGINT) AS n_words, CAST(10 AS BIGINT) AS n_terms, true AS is_falling,
    true AS is_positive, (SELECT count(*) FROM vocabulary) AS n_weights FROM topics"""


def trained(t, optimizer: str):
    """Distinct words of the vocabulary in falling, positive weight, and a weight for every term."""
    words = E.topic_words(model(t, optimizer), t.spark)
    weights = words.groupBy("topic_id").agg(F.count_distinct("term").alias("n_weights"))
    listed = E.top_words(words).select("topic_id", F.posexplode("words").alias("pos", "term"))
    vocabulary = C.build_vocabulary(C.tokenise(t.texts)).select("term", F.lit(1).alias("known"))
    found = listed.join(words.select("topic_id", "term", "weight"), ["topic_id", "term"]).join(vocabulary, "term", "left")
    in_order = F.sort_array(F.collect_list(F.struct("pos", "weight")))
    falling = F.array_sort(F.col("ranked.weight"), lambda a, b: F.signum(b - a).cast("int")) == F.col("ranked.weight")
    return (
        found.groupBy("topic_id")
        .agg(in_order.alias("ranked"), F.count_distinct("term").alias("n_words"), F.count("known").alias("n_terms"), F.min("weight").alias("least"))
        .join(weights, "topic_id")
        .select("topic_id", "n_words", "n_terms", falling.alias("is_falling"), (F.col("least") > 0).alias("is_positive"), "n_weights")
    )


@query("e1_train_online", sql(TRAINED_SQL, "topics", "vocabulary"))
def train_online(t):
    return trained(t, "online")


@query("e2_train_em", sql(TRAINED_SQL, "topics", "vocabulary"))
def train_em(t):
    return trained(t, "em")


@query("e1_train_variational", sql(TRAINED_SQL, "topics", "vocabulary"))
def train_variational(t):
    return trained(t, "variational")


@query("e2_train_gibbs", sql(TRAINED_SQL, "topics", "vocabulary"))
def train_gibbs(t):
    return trained(t, "gibbs")


TERM_TOTALS_SQL = "SELECT term, tf, CAST(tf AS DOUBLE) AS in_topics, true AS in_range FROM vocabulary"


def term_totals(t, optimizer: str):
    """The weights of a term add up to its occurrences, each one being in a topic, or in shares in several."""
    weights = model(t, optimizer).weights.join(C.build_vocabulary(C.tokenise(t.texts)), "term")
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    in_range = F.forall("topics", lambda k: k.between(0, NUM_TOPICS - 1)) & F.forall("values", lambda x: x > 0)
    return weights.select("term", "tf", F.round(total, 6).alias("in_topics"), in_range.alias("in_range"))


@query("e1_variational_term_totals", sql(TERM_TOTALS_SQL, "vocabulary"))
def variational_term_totals(t):
    return term_totals(t, "variational")


@query("e2_gibbs_term_totals", sql(TERM_TOTALS_SQL, "vocabulary"))
def gibbs_term_totals(t):
    return term_totals(t, "gibbs")


@query("e2_gibbs_token_total", sql("SELECT CAST(sum(tf) AS DOUBLE) AS tokens, true AS adds_up, 10 AS n_topics FROM vocabulary", "vocabulary"))
def gibbs_token_total(t):
    """All tokens are in a topic, and the topics' sizes that the model keeps are those of its table."""
    own = model(t, "gibbs")
    kept = t.spark.createDataFrame(list(enumerate(own.totals)), "topic int, kept double")
    counted = own.weights.select(F.inline(F.arrays_zip(F.col("topics").alias("topic"), F.col("values").alias("n")))).groupBy("topic").agg(F.sum("n").alias("n"))
    joined = kept.join(counted, "topic", "left")
    return joined.agg(F.sum("kept").alias("tokens"), F.every(F.col("kept") == F.coalesce("n", F.lit(0.0))).alias("adds_up"), F.count(F.lit(1)).cast("int").alias("n_topics"))


INFERRED_SQL = """SELECT t.id, k.known IS NOT NULL AS has_terms, CAST(10 AS BIGINT) AS n_topics, true AS is_share,
    true AS adds_up FROM texts t LEFT JOIN (SELECT DISTINCT id, true AS known FROM words JOIN vocabulary USING (term)) k
    ON k.id = t.id"""


@query("e3_infer_topics", sql(INFERRED_SQL, "texts", "words", "vocabulary"))
def infer_topics(t, optimizer: str = "online"):
    """One share per topic and article, between 0 and 1, adding up to 1 where a term is known."""
    found = stage(vectors(t, optimizer), "shares")
    total = F.when(F.col("has_terms"), 1.0).otherwise(0.0)
    return (
        E.long_topics(found)
        .groupBy("id")
        .agg(F.count_distinct("topic_id").alias("n_topics"), F.every(F.col("prob").between(0.0, 1.0)).alias("is_share"), F.sum("prob").alias("total"))
        .join(found.select("id", "has_terms", total.alias("wanted")), "id")
        .select("id", "has_terms", "n_topics", "is_share", (F.abs(F.col("total") - F.col("wanted")) < 1e-6).alias("adds_up"))
    )


@query("e3_infer_topics_gibbs", sql(INFERRED_SQL, "texts", "words", "vocabulary"))
def infer_sampled_topics(t):
    return infer_topics(t, "gibbs")


@query("e3_infer_topics_variational", sql(INFERRED_SQL, "texts", "words", "vocabulary"))
def infer_variational_topics(t):
    return infer_topics(t, "variational")


@query("e3_share_sums", sql(SHARE_SUMS_SQL, "texts", "words", "vocabulary"))
def online_share_sums(t):
    return share_sums(vectors(t))


@query("e3_share_sums_em", sql(SHARE_SUMS_SQL, "texts", "words", "vocabulary"))
def em_share_sums(t):
    return share_sums(vectors(t, "em"))


@query("e4_topic_word_sums", sql(TOPIC_SUMS_SQL, "topics", "vocabulary"))
def online_topic_sums(t):
    return topic_sums(E.topic_words(model(t), t.spark, normalised=True))


@query("e4_topic_word_sums_em", sql(TOPIC_SUMS_SQL, "topics", "vocabulary"))
def em_topic_sums(t):
    return topic_sums(E.topic_words(model(t, "em"), t.spark, normalised=True))


@query("e5_article_topics", sql("SELECT topic_id, (SELECT count(*) FROM documents) AS n FROM topics", "topics"))
def stored_article_topics(t):
    """Every article has a row for every topic."""
    path = scratch_path(t.spark, "shares")
    vectors(t).write.parquet(path)
    return E.long_topics(t.spark.read.parquet(path)).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))


def _turns(t):
    conversations = t.read("conversations")
    return conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _known_sql(source: str) -> str:
    """Share sums of other texts, by the vocabulary of the articles."""
    return rf"""SELECT id, any_value(known) AS has_terms, CAST(10 AS INTEGER) AS n_topics,
        CASE WHEN any_value(known) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS total
    FROM (SELECT id, len(list_intersect(regexp_extract_all(lower(text), '\p{{L}}+'),
                              (SELECT list(term) FROM vocabulary))) > 0 AS known FROM ({source}))
    GROUP BY id"""


TURNS_SQL = "SELECT conv_id * 1000 + turn AS id, text FROM conversations"


@query("e6_share_sums", sql(_known_sql(TURNS_SQL), "vocabulary"))
def text_share_sums(t):
    return share_sums(E.infer_topics(model(t), tokenise(_turns(t))))


@query("e7_share_sums", sql(_known_sql(f"SELECT id, text FROM ({PAGES_SQL}) WHERE length(text) > 0"), "vocabulary"))
def page_share_sums(t):
    return share_sums(E.infer_topics(model(t), tokenise(extract_articles(t.pages).select("id", "text"))))


# Texts with a known term; ten shares that add up to 1 are not all at the bound, so each has a topic.
TAGGED_SQL = r"""SELECT DISTINCT id, true AS is_dense, true AS is_inferred{more} FROM (SELECT id, len(list_intersect(
    regexp_extract_all(lower(text), '\p{{L}}+'), (SELECT list(term) FROM vocabulary))) > 0 AS known FROM ({source}))
    WHERE known"""
PAGE_TEXTS_SQL = f"SELECT id, text FROM ({PAGES_SQL}) WHERE length(text) > 0"


def tagged_sql(source: str, more: str = "") -> str:
    return sql(TAGGED_SQL.format(source=source, more=more), "vocabulary")


def check_tags(tags, shares, *flags):
    """Per text: are its ranks 1, 2, ... and its topics those of its shares above the bound, best first?"""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "topic_id", "prob")))
    found = tags.groupBy("id").agg(ranked.alias("found"), *flags)
    above = E.long_topics(shares).where(F.col("prob") > E.MIN_PROB)
    wanted = above.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("prob")).alias("order"), "topic_id"))).alias("wanted"))
    same = (F.col("found.topic_id") == F.col("wanted.topic_id")) & (F.transform("found.prob", lambda p: -p) == F.col("wanted.order"))
    dense = F.col("found.rank") == F.sequence(F.lit(1), F.size("found"))
    names = [name for name in found.columns if name not in ("id", "found")]
    joined = found.join(wanted, "id", "left")
    return joined.select("id", dense.alias("is_dense"), F.coalesce(same, F.lit(False)).alias("is_inferred"), *names)


def _page_texts(t):
    return extract_articles(t.pages).select("id", "text")


@query("e6_tag_texts", tagged_sql(TURNS_SQL))
def tag_texts(t):
    return check_tags(E.tag_texts(model(t), _turns(t)), E.infer_topics(model(t), tokenise(_turns(t))))


@query("e6_tag_texts_gibbs", tagged_sql(TURNS_SQL))
def tag_texts_by_samples(t):
    own = model(t, "gibbs")
    return check_tags(E.tag_texts(own, _turns(t)), stage(E.infer_topics(own, tokenise(_turns(t))), "shares"))


@query("e7_tag_pages", tagged_sql(PAGE_TEXTS_SQL))
def tag_pages(t):
    return check_tags(E.tag_texts(model(t), _page_texts(t)), E.infer_topics(model(t), tokenise(_page_texts(t))))


def _with_checked_labels(t, texts):
    """The label of each topic is that of the model's heaviest words."""
    labels = E.top_words(E.topic_words(model(t), t.spark)).select("topic_id", "label")
    shown = E.with_labels(E.tag_texts(model(t), texts), labels).withColumnRenamed("label", "shown")
    right = F.every(F.col("shown") == F.col("label")).alias("is_labelled")
    return check_tags(shown.join(labels, "topic_id"), E.infer_topics(model(t), tokenise(texts)), right)


@query("f8_show_text_topics", tagged_sql(TURNS_SQL, ", true AS is_labelled"))
def show_text_topics(t):
    return _with_checked_labels(t, _turns(t))


@query("f8_show_page_topics", tagged_sql(PAGE_TEXTS_SQL, ", true AS is_labelled"))
def show_page_topics(t):
    return _with_checked_labels(t, _page_texts(t))


LEMMA_SQL = r"""SELECT w.id, count(*) AS n_tokens, md5(string_agg(coalesce(l.lemma, w.term), ' ' ORDER BY w.pos)) AS digest
    FROM (SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM (
        SELECT id, regexp_extract_all(lower(text), '\p{L}+') AS tokens FROM (%s))) w
    LEFT JOIN (%s) l ON l.form = w.term GROUP BY w.id"""
# A rule that makes a lemma table from the words at hand: longer words lose their last letter.
LEMMAS_SQL = r"""SELECT DISTINCT form, left(form, length(form) - 1) AS lemma FROM (
    SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS form FROM conversations) WHERE length(form) > 4"""


@query("e6_lemmatised_texts", LEMMA_SQL % (TURNS_SQL, LEMMAS_SQL))
def lemmatised_texts(t):
    """Unseen texts are prepared with the lemmas of the model, here all the words they may need."""
    words = tokenise(_turns(t)).select(F.explode("tokens").alias("form")).where(F.length("form") > 4).distinct()
    lemmas = words.select("form", F.expr("left(form, length(form) - 1)").alias("lemma"))
    own = model(t)
    prepared = E.TopicModel(own.vectoriser, own.lda, lemmas=lemmas).prepare(_turns(t)).where(F.size("tokens") > 0)
    return prepared.select(
        "id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest")
    )


@query("e5_stored_by_article", sql("SELECT id, topic_id, prob FROM doc_topics", "doc_topics"))
def stored_by_article(t):
    path = scratch_path(t.spark, "topics")
    E.write_topics(t.vectors, path)
    return E.long_topics(t.spark.read.parquet(f"{path}/by_article")).where("prob > 0")


@query("e5_stored_by_topic", sql("SELECT id, topic_id, prob FROM doc_topics", "doc_topics"))
def stored_by_topic(t):
    path = scratch_path(t.spark, "topics")
    E.write_topics(t.vectors, path)
    return t.spark.read.parquet(f"{path}/by_topic")


@query("a10_explorer_from_tables", sql("SELECT rank, topic_id, round(score, 9) AS score, label FROM topic_table", "topic_table"))
def explorer_from_tables(t):
    """Tables made elsewhere, here by the topic rule, answer the same questions."""
    explorer = TopicExplorer(t.vectors, t.topic_words, NUM_TOPICS, posts=t.posts, texts=t.texts)
    return explorer.topics_table().select("rank", "topic_id", F.round("score", 9).alias("score"), "label")


@query("a9_model_round_trip", sql(SHARE_SUMS_SQL, "texts", "words", "vocabulary"))
def model_round_trip(t, optimizer: str = "online"):
    path = scratch_path(t.spark, "model")
    E.save_model(model(t, optimizer), path)
    loaded = E.load_model(t.spark, path)
    return share_sums(E.infer_topics(loaded, corpus(t).tokens()))


@query("a9_table_model_round_trip", sql(SHARE_SUMS_SQL, "texts", "words", "vocabulary"))
def table_model_round_trip(t):
    return model_round_trip(t, "gibbs")


@query(
    "a10_explorer_from_model",
    sql("SELECT topic_id, true AS is_ranked, true AS is_score, true AS is_labelled FROM topics", "topics"),
)
def explorer_from_model(t):
    """Ranks, scores and labels against the built-in percentile over the stored shares."""
    path = scratch_path(t.spark, "explorer")
    explorer = TopicExplorer.from_model(corpus(t), model(t), path)
    shown = explorer.topics_table().select("rank", "topic_id", "score", "label")
    shares = t.spark.read.parquet(f"{path}/by_article").select(F.posexplode("shares").alias("topic_id", "prob"))
    medians = shares.groupBy("topic_id").agg(F.expr("percentile(prob, 0.5) FILTER (WHERE prob >= 0.1)").alias("median"))
    place = F.row_number().over(W.orderBy(F.desc_nulls_last("median"), "topic_id"))
    labels = E.top_words(E.topic_words(model(t), t.spark)).select("topic_id", F.col("label").alias("wanted"))
    joined = shown.join(medians.withColumn("place", place), "topic_id").join(labels, "topic_id")
    close = F.coalesce(F.abs(F.col("score") - F.col("median")) < 1e-9, F.col("score").isNull() & F.col("median").isNull())
    return joined.select(
        "topic_id",
        (F.col("rank") == F.col("place")).alias("is_ranked"),
        close.alias("is_score"),
        (F.col("label") == F.col("wanted")).alias("is_labelled"),
    )


def _streamed(t):
    """Documents arrive as files; the query stops when all are tagged."""
    arriving, tags, progress = (scratch_path(t.spark, name) for name in ("arriving", "tags", "progress"))
    t.texts.write.parquet(arriving)
    stream = read_article_stream(t.spark, arriving, max_files_per_trigger=4)
    tagged = tag_stream(model(t), stream)
    write_tags(tagged, tags, progress, available_now=True).awaitTermination()
    return t.spark.read.schema(tagged.schema).parquet(tags)


@query("l1_tag_stream", tagged_sql("SELECT doc_id AS id, text FROM documents"))
def tagged_stream(t):
    """Each streamed article has the topics that inference on the table gives it."""
    return check_tags(_streamed(t), vectors(t))


@query("l1_tag_in_batches", tagged_sql("SELECT doc_id AS id, text FROM documents"))
def tagged_in_batches(t):
    """A model in tables tags a stream batch by batch, with the topics of inference on the whole table."""
    arriving, tags, progress = (scratch_path(t.spark, name) for name in ("arriving", "tags", "progress"))
    t.texts.repartition(8, "id").write.parquet(arriving)
    stream = read_article_stream(t.spark, arriving, max_files_per_trigger=4)
    tag_in_batches(model(t, "gibbs"), stream, tags, progress, available_now=True).awaitTermination()
    return check_tags(t.spark.read.parquet(tags).drop("batch"), stage(vectors(t, "gibbs"), "shares"))


@query("l1_stream_equals_batch", "SELECT CAST(0 AS BIGINT) AS n_different")
def stream_equals_batch(t):
    """Tags that only the stream or only the batch job has."""
    columns = ["id", "rank", "topic_id", "prob"]
    streamed, batch = _streamed(t).select(columns), E.tag_texts(model(t), t.texts).select(columns)
    different = streamed.exceptAll(batch).unionAll(batch.exceptAll(streamed))
    return different.agg(F.count(F.lit(1)).alias("n_different"))
