"""One object for a collection of articles."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame

from newsloom.operators import articles as A
from newsloom.operators import features as C
from newsloom.operators import trends as T
from newsloom.operators.lemma_rules import learn_lemma_rules, prepare_tokens
from newsloom.operators.topic_model import AnyModel, TopicModel, train_lda
from newsloom.operators.topic_tables import GIBBS, VARIATIONAL, train_tables
from newsloom.sources.tokens import materialise_tokens


class ArticleCorpus:
    """Texts ``(id, text)``, optionally with posts, a lemma table, lemma rules and a place for tokens.

    Methods return DataFrames. Without ``tokens_path`` every use reads the texts again.
    """

    def __init__(
        self,
        texts: DataFrame,
        posts: DataFrame | None = None,
        tokens_path: str | None = None,
        lemmas: DataFrame | None = None,
        rules: DataFrame | None = None,
    ):
        self.spark = texts.sparkSession
        self.texts = texts
        self.metadata = posts
        self.tokens_path = tokens_path
        self.lemmas = lemmas
        self.rules = rules
        self.phrases: DataFrame | None = None

    @property
    def posts(self) -> DataFrame:
        if self.metadata is None:
            raise ValueError("this needs post metadata")
        return self.metadata

    def articles(self, max_count: int | None = None, min_points: int = A.MIN_POINTS) -> DataFrame:
        return A.stream_articles(self.texts, self.metadata, max_count, min_points)

    def _tokenised(self, texts: DataFrame) -> DataFrame:
        return prepare_tokens(texts, self.lemmas, self.rules)

    def learn_lemma_rules(self, **bounds) -> DataFrame:
        """Learn from the lemma table how other forms end; tokens that are not stored yet follow it."""
        if self.lemmas is None:
            raise ValueError("rules are learned from a lemma table")
        self.rules = learn_lemma_rules(self.lemmas, **bounds)
        self.__dict__.pop("vectoriser", None)
        return self.rules

    def plain_tokens(self) -> DataFrame:
        if self.tokens_path is None:
            return self._tokenised(self.texts)
        return materialise_tokens(self.spark, self.tokens_path, self.texts, self._tokenised)

    def tokens(self, max_count: int | None = None) -> DataFrame:
        """Token lists, with phrases merged once they are learned."""
        plain = A.first_articles(self.plain_tokens(), max_count)
        return plain if self.phrases is None else C.apply_phrases(plain, self.phrases)

    def learn_phrases(self, min_count: int = C.PHRASE_MIN_COUNT, threshold: float = C.PHRASE_THRESHOLD) -> DataFrame:
        self.phrases = C.learn_phrases(self.plain_tokens(), min_count, threshold)
        self.__dict__.pop("vectoriser", None)
        return self.phrases

    @cached_property
    def vectoriser(self) -> CountVectorizerModel:
        """Fitted once: every bag of words needs it."""
        return C.fit_vectoriser(self.tokens())

    def vocabulary(self) -> DataFrame:
        return C.vocabulary_terms(self.spark, self.vectoriser)

    def bags_of_words(self, max_count: int | None = None) -> DataFrame:
        return C.bags_of_words(self.tokens(max_count), self.vectoriser)

    def bag_of(self, ids: int | list[int] | DataFrame) -> DataFrame:
        """``(id, term_id, n)`` of given articles; only their tokens are read."""
        found = A.rows_of(self.plain_tokens(), ids)
        if self.phrases is not None:
            found = C.apply_phrases(found, self.phrases)
        return C.flat_bags_of_words(C.bags_of_words(found, self.vectoriser))

    def __contains__(self, article_id: int) -> bool:
        return not A.rows_of(self.texts.select("id"), article_id).isEmpty()

    def get_posts(self, ids: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame([(i, pos) for pos, i in enumerate(ids)], "id long, pos long")
        return A.posts_by_ids(self.posts.where(self.posts.id.isin(ids)), rows)

    def article_text(self, ids: int | list[int] | DataFrame, max_length: int | None = None) -> DataFrame:
        return A.article_texts(A.rows_of(self.texts, ids), max_length)

    def article_counts(self, ids: DataFrame, window_size: int = T.COUNT_WINDOW) -> DataFrame:
        return T.article_counts(self.posts, ids, window_size)

    def time_slices(self) -> DataFrame:
        return T.time_slices(self.posts, self.texts)

    def ids_by_time(self, max_count: int | None = None) -> DataFrame:
        return T.ids_by_time(self.posts, self.texts, max_count)

    def tokens_by_time(self, max_count: int | None = None) -> DataFrame:
        """Of the first ``max_count`` articles in the order of time, or all."""
        return T.by_time(self.tokens(), self.posts, max_count)

    def bags_by_time(self, max_count: int | None = None) -> DataFrame:
        return T.by_time(self.bags_of_words(), self.posts, max_count)

    def train(self, num_topics: int, optimizer: str = "online", **params) -> AnyModel:
        """``'gibbs'`` samples topics and ``'variational'`` takes variational steps, both over tables, for
        vocabularies of any size; ``'online'`` and ``'em'`` are LDA with the model on the driver."""
        if optimizer in (GIBBS, VARIATIONAL):
            tokens = self.tokens()
            found = train_tables(tokens, C.build_vocabulary(tokens), num_topics, optimizer, **params)
            found.phrases, found.lemmas, found.rules = self.phrases, self.lemmas, self.rules
            return found
        lda = train_lda(self.tokens(), self.vectoriser, num_topics, optimizer, **params)
        return TopicModel(self.vectoriser, lda, self.phrases, self.lemmas, self.rules)
