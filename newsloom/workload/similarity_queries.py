"""Similar, common and stand-alone topics, on rule topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions.staging import stage
from newsloom.operators import similarity as G
from newsloom.operators import topic_model as E
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query
from newsloom.workload.tables import NUM_TOPICS


def similarities(t):
    """A row per pair of topics, written once: percentiles read it again."""
    return stage(G.topic_similarities(t.vectors, t.topic_words, NUM_TOPICS), "similarities")


def rounded(cells, *columns):
    return cells.withColumns({name: F.round(name, 6) for name in columns or ("sim",)})


def zeroed(metric: str) -> str:
    return f"SELECT i, j, CASE WHEN i = j THEN 0.0 ELSE {metric} END AS sim FROM sims"


def percentile(matrix: str, p: float = 0.85) -> str:
    return f"(SELECT quantile_cont(sim, {p}) FROM ({matrix}))"


def thresholded(matrix: str, p: float = 0.85) -> str:
    return f"SELECT i, j, CASE WHEN sim <= {percentile(matrix, p)} THEN 0.0 ELSE sim END AS sim FROM ({matrix})"


@query(
    "g1_to_g4_similarities",
    sql(
        """SELECT i, j, round(doc_sim, 6) AS doc_sim, round(word_sim, 6) AS word_sim, round(jaccard, 6) AS jaccard,
            round(word_doc_sim, 6) AS word_doc_sim FROM sims""",
        "sims",
    ),
)
def all_similarities(t):
    return rounded(similarities(t), *G.METRICS)


def _metric_query(name: str, metric: str):
    @query(name, sql(f"SELECT i, j, round({metric}, 6) AS sim FROM sims", "sims"))
    def one_metric(t):
        return rounded(G.similarity_matrix(similarities(t), metric))


_metric_query("g1_doc_similarity", "doc_sim")
_metric_query("g2_word_similarity", "word_sim")
_metric_query("g3_jaccard", "jaccard")
_metric_query("g4_word_doc_similarity", "word_doc_sim")


@query("g5_zero_self_similarity", sql(f"SELECT i, j, round(sim, 6) AS sim FROM ({zeroed('doc_sim')})", "sims"))
def zero_self_similarity(t):
    return rounded(G.similarity_matrix(similarities(t), "doc_sim", zero_self_similarity=True))


@query(
    "g6_similar_topics",
    sql(
        """SELECT j AS topic_id, round(word_doc_sim, 6) AS sim, label FROM sims JOIN labels10 ON topic_id = j
        WHERE i = 3 AND j <> 3 AND word_doc_sim >= 0 ORDER BY word_doc_sim DESC, j LIMIT 5""",
        "sims",
        "labels10",
    ),
)
def similar_topics(t):
    similar = G.similar_topics(similarities(t), 3, top_n=5)
    labels = E.top_words(t.topic_words).select("topic_id", "label")
    return rounded(E.with_labels(similar, labels)).select("topic_id", "sim", "label")


@query(
    "g7_similar_pairs",
    sql("SELECT i, j, round(word_doc_sim, 6) AS sim FROM sims WHERE i > j ORDER BY word_doc_sim DESC, i, j LIMIT 20", "sims"),
)
def similar_pairs(t):
    return rounded(G.similar_pairs(similarities(t)))


@query(
    "g8_common_topics",
    sql(
        f"""SELECT i AS topic_id, count(*) FILTER (WHERE sim >= {percentile(zeroed('word_doc_sim'))}) AS n_similar
        FROM ({zeroed('word_doc_sim')}) GROUP BY i
        HAVING n_similar >= 0.2 * 10 ORDER BY n_similar DESC, topic_id LIMIT 10""",
        "sims",
    ),
)
def common_topics(t):
    return G.common_topics(similarities(t), NUM_TOPICS)


@query(
    "g9_standalone_topics",
    sql(
        f"""SELECT i AS topic_id FROM ({zeroed('word_doc_sim')}) GROUP BY i
        HAVING bool_and(sim <= {percentile(zeroed('word_doc_sim'), 0.95)})""",
        "sims",
    ),
)
def standalone_topics(t):
    return G.standalone_topics(similarities(t), threshold_percentile=95)


@query(
    "g10_threshold_matrix",
    sql(f"SELECT i, j, round(sim, 6) AS sim FROM ({thresholded('SELECT i, j, doc_sim AS sim FROM sims')})", "sims"),
)
def threshold_matrix(t):
    return rounded(G.threshold_matrix(G.similarity_matrix(similarities(t), "doc_sim"), 85))


@query("g11_heat_map", sql(f"SELECT i, j, round(sim, 6) AS sim FROM ({thresholded(zeroed('word_doc_sim'))})", "sims"))
def heat_map(t):
    return rounded(G.heat_map(similarities(t)))
