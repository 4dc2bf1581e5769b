"""Tokens, phrases, vocabulary, bags of words and the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.staging import scratch_path, stage
from newsloom.operators import features as C
from newsloom.operators import search_index as D
from newsloom.operators.lemma_rules import learn_lemma_rules, prepare_tokens
from newsloom.plans import ArticleCorpus, SearchIndex
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query
from newsloom.workload.source_queries import TOKEN_DIGESTS_SQL, token_digests

# Ids per posting block here, small enough that frequent tokens have several blocks.
BLOCK_IDS = 256


@query("c1_tokens", sql(TOKEN_DIGESTS_SQL + " FROM tokens", "tokens"))
def tokens(t):
    return token_digests(C.tokenise(t.texts))


@query(
    "c1_lemmas",
    sql(
        """SELECT w.id, count(*) AS n_tokens, md5(string_agg(coalesce(l.lemma, w.term), ' ' ORDER BY w.pos)) AS digest
        FROM words w LEFT JOIN (
            SELECT term AS form, left(term, length(term) - 1) AS lemma FROM word_counts
            WHERE term LIKE '_%s' AND left(term, length(term) - 1) IN (SELECT term FROM word_counts)) l ON l.form = w.term
        GROUP BY w.id""",
        "words",
        "word_counts",
    ),
)
def lemmas(t):
    """The lemma table holds words with a final s that also occur without it."""
    tokens = C.tokenise(t.texts)
    terms = C.term_counts(tokens).select("term")
    plural = terms.where(F.col("term").like("_%s")).select(
        F.col("term").alias("form"), F.expr("left(term, length(term) - 1)").alias("lemma")
    )
    table = stage(plural.join(terms.withColumnRenamed("term", "lemma"), "lemma", "left_semi"), "lemmas")
    return token_digests(C.lemmatise(tokens, table))


# Pairs of words of the documents, one being the other with an ending; of several lemmas the first one.
ENDINGS = ("s", "en", "er", "ed", "ing", "tion")
LEMMA_PAIRS_SQL = f"""lemma_pairs AS (
    SELECT term AS form, min(left(term, length(term) - length(ending))) AS lemma
    FROM word_counts, (SELECT unnest({list(ENDINGS)}) AS ending)
    WHERE term LIKE ('__%' || ending) AND left(term, length(term) - length(ending)) IN (SELECT term FROM word_counts)
    GROUP BY term)"""
LEMMA_RULES_SQL = f"""{LEMMA_PAIRS_SQL}, edits AS (
    SELECT form, length(form) - kept AS cut, substr(lemma, kept + 1) AS addition FROM (
        SELECT form, lemma, list_max(list_filter(range(0, least(length(form), length(lemma)) + 1),
            lambda n: left(form, n) = left(lemma, n))) AS kept FROM lemma_pairs)),
counted AS (
    SELECT right(form, n) AS suffix, cut, addition, count(*) AS n FROM (
        SELECT *, unnest(range(cut, greatest(cut, least(length(form), 5)) + 1)) AS n FROM edits) GROUP BY ALL),
rules AS (
    SELECT * FROM (SELECT suffix, cut, addition, n, sum(n) OVER (PARTITION BY suffix) AS total,
        row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, addition) AS nth FROM counted)
    WHERE nth = 1 AND n >= 2 AND n >= 0.5 * total),
own_rules AS (
    SELECT r.* FROM rules r LEFT JOIN rules p ON r.suffix <> '' AND p.suffix = substr(r.suffix, 2)
    WHERE p.suffix IS NULL OR p.cut <> r.cut OR p.addition <> r.addition)"""


def lemma_pairs(t):
    """A lemma table that the words at hand make."""
    terms = stage(C.term_counts(C.tokenise(t.texts)).select("term"), "terms")
    stem = F.expr("left(term, length(term) - length(ending))")
    forms = terms.withColumn("ending", F.explode(F.array(*map(F.lit, ENDINGS))))
    forms = forms.where(F.expr("term like concat('__%', ending)")).select(F.col("term").alias("form"), stem.alias("lemma"))
    known = forms.join(terms.select(F.col("term").alias("lemma")), "lemma", "left_semi")
    return stage(known.groupBy("form").agg(F.min("lemma").alias("lemma")), "lemma_pairs")


@query(
    "c1_lemma_rules",
    sql(f", {LEMMA_RULES_SQL} SELECT suffix, CAST(cut AS INTEGER) AS cut, addition, n, CAST(total AS BIGINT) AS total FROM own_rules", "word_counts"),
)
def lemma_rules(t):
    return learn_lemma_rules(lemma_pairs(t))


@query(
    "c1_lemmas_by_rules",
    sql(
        rf""", {LEMMA_RULES_SQL}, spoken AS (
            SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '\p{{L}}+') AS tokens FROM conversations),
        turns AS (SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM spoken),
        guessed AS (
            SELECT term, CASE WHEN length(edited) > 0 THEN edited ELSE term END AS lemma FROM (
                SELECT term, left(term, length(term) - cut) || addition AS edited,
                    row_number() OVER (PARTITION BY term ORDER BY length(suffix) DESC) AS nth
                FROM (SELECT DISTINCT term FROM turns) JOIN own_rules ON right(term, length(suffix)) = suffix)
            WHERE nth = 1)
        SELECT id, count(*) AS n_tokens,
            md5(string_agg(coalesce(p.lemma, g.lemma, t.term), ' ' ORDER BY pos)) AS digest
        FROM turns t LEFT JOIN lemma_pairs p ON p.form = t.term LEFT JOIN guessed g ON g.term = t.term GROUP BY id""",
        "word_counts",
    ),
)
def lemmas_by_rules(t):
    """Other texts than those the lemma table was made for: forms it does not hold follow the rules."""
    pairs = lemma_pairs(t)
    turns = t.read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return token_digests(prepare_tokens(turns, pairs, stage(learn_lemma_rules(pairs), "rules")))


@query("c2_surface_tokens", sql(TOKEN_DIGESTS_SQL + " FROM surface", "surface"))
def surface(t):
    return token_digests(D.with_surface_tokens(t.texts))


@query(
    "c3_lower_tokens",
    sql(
        """SELECT id, len(tokens) AS n_tokens,
            md5(array_to_string(list_transform(tokens, lambda x: lower(x)), ' ')) AS digest FROM surface""",
        "surface",
    ),
)
def lower(t):
    found = D.with_surface_tokens(t.texts)
    return token_digests(found.select("id", D.lower_tokens(F.col("tokens")).alias("tokens")))


@query("c4_phrases", sql("SELECT w1, w2, n, round(score, 6) AS score FROM phrases", "phrases"))
def phrases(t):
    return C.learn_phrases(C.tokenise(t.texts)).withColumn("score", F.round("score", 6))


MERGED_SQL = sql(
    """SELECT id, count(*) AS n_tokens, md5(string_agg(term, ' ' ORDER BY pos)) AS digest FROM merged GROUP BY id""",
    "merged",
)


@query("c5_merge_phrases", MERGED_SQL)
def merge_phrases(t):
    tokens = C.tokenise(t.texts)
    return token_digests(C.apply_phrases(tokens, C.learn_phrases(tokens)))


@query("c5_merge_phrases_by_join", MERGED_SQL)
def merge_phrases_by_join(t):
    """The way taken for phrase sets too large to broadcast."""
    tokens = C.tokenise(t.texts)
    return token_digests(C._merge_by_join(tokens, C.learn_phrases(tokens)))


@query("c6_vocabulary", sql("SELECT term, df, tf FROM vocabulary", "vocabulary"))
def vocabulary(t):
    return C.build_vocabulary(C.tokenise(t.texts))


@query(
    "c7_bags_of_words",
    sql("SELECT id, term, count(*) AS n FROM words JOIN vocabulary USING (term) GROUP BY ALL", "words", "vocabulary"),
)
def bags_of_words(t):
    """Counted in the row and joined with the vocabulary as a table, whatever its size."""
    corpus = ArticleCorpus(t.texts, tokens_path=scratch_path(t.spark, "tokens"))
    tokens = corpus.tokens()
    return C.count_terms(tokens, C.build_vocabulary(tokens))


@query(
    "c7_vectors",
    sql("SELECT id, term, count(*) AS n FROM words JOIN vocabulary USING (term) GROUP BY ALL", "words", "vocabulary"),
)
def vectors_of_words(t):
    """The sparse vectors that a model is trained on, spelled out."""
    corpus = ArticleCorpus(t.texts, tokens_path=scratch_path(t.spark, "tokens"))
    flat = C.flat_bags_of_words(corpus.bags_of_words())
    return flat.join(corpus.vocabulary(), "term_id").select("id", "term", "n")


INDEX_SQL = """SELECT DISTINCT token, id FROM (
    SELECT id, unnest(tokens) AS token FROM surface
    UNION ALL SELECT id, unnest(list_transform(tokens, lambda x: lower(x))) FROM surface)"""


@query("d1_index", sql("SELECT DISTINCT id, unnest(tokens) AS token FROM surface", "surface"))
def index(t):
    return D.index_documents(t.texts)


@query("d1_index_with_lower", sql(INDEX_SQL, "surface"))
def index_with_lower(t):
    return D.index_documents(t.texts, preprocess_tokens=True)


LATEST_SQL = """SELECT id, text FROM (
    SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY batch DESC, text DESC) AS nth FROM (
        SELECT doc_id AS id, 0 AS batch, text FROM documents
        UNION ALL SELECT conv_id, turn + 1, text FROM conversations))
    WHERE nth = 1"""


def _turns(t):
    return t.read("conversations").select(
        F.col("conv_id").alias("id"), (F.col("turn") + 1).alias("batch"), "text"
    )


@query(
    "d1_reindex",
    rf"""SELECT DISTINCT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS token
    FROM ({LATEST_SQL})""",
)
def reindex(t):
    """Conversations replace the documents that have their ids."""
    return D.add_to_index(D.index_documents(t.texts), D.latest_documents(_turns(t)))


@query(
    "d1_search_index",
    rf"""SELECT token, count(*) AS n_docs FROM (
        SELECT DISTINCT id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) AS token
        FROM ({LATEST_SQL})) GROUP BY token""",
)
def search_index(t):
    """Articles in one batch, then the last turn of every conversation in another."""
    index = SearchIndex(t.spark)
    index.index(t.texts)
    index.index(D.latest_documents(_turns(t)))
    path = scratch_path(t.spark, "index")
    index.save(path)
    return SearchIndex.load(t.spark, path).document_frequency()


@query("d2_query_term", sql("SELECT DISTINCT id FROM surface WHERE list_contains(tokens, 'the')", "surface"))
def query_term(t):
    path = scratch_path(t.spark, "index")
    D.write_index(D.index_documents(t.texts), path)
    return D.query_index(t.spark.read.parquet(path), "the")


@query("d3_document_frequency", sql(f"SELECT token, count(*) AS n_docs FROM ({INDEX_SQL}) GROUP BY token", "surface"))
def document_frequency(t):
    return D.document_frequency(D.index_documents(t.texts, preprocess_tokens=True))


@query(
    "d3_posting_blocks",
    sql(
        f"""SELECT token, id // {BLOCK_IDS} AS block, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids,
            count(*) AS n_docs FROM ({INDEX_SQL}) GROUP BY ALL""",
        "surface",
    ),
)
def posting_blocks(t):
    blocks = D.posting_blocks(D.index_documents(t.texts, preprocess_tokens=True), BLOCK_IDS)
    return blocks.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("d4_latest_documents", f"SELECT id, length(text) AS n_chars, md5(text) AS digest FROM ({LATEST_SQL})")
def latest_documents(t):
    documents = t.texts.select("id", F.lit(0).cast("long").alias("batch"), "text")
    latest = D.latest_documents(documents.unionByName(_turns(t)))
    return latest.select("id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
