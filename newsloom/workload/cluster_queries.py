"""Topic clusters, on rule topics. Where SQL checks them, each topic is in the cluster of the seed
topic that it is most similar to."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.staging import stage
from newsloom.operators import clustering as H
from newsloom.operators import ranking as R
from newsloom.operators import topic_model as E
from newsloom.operators.similarity import METRICS
from newsloom.workload.oracle import sql
from newsloom.workload.registry import query
from newsloom.workload.similarity_queries import percentile, rounded, similarities, thresholded, zeroed
from newsloom.workload.tables import NUM_TOPICS

# Two topics are taken as common and one as stand-alone, as in EXCLUDED_SQL.
EXCLUDED = ((1, "common"), (2, "common"), (9, "standalone"))
EXCLUDED_SQL = "(VALUES (1, 'common'), (2, 'common'), (9, 'standalone')) AS x(topic_id, kind)"

# Topics that the others are grouped around.
SEEDS = (0, 4, 7)

SELECTED_SQL = f"""SELECT i, j, word_doc_sim AS sim FROM sims
    WHERE i NOT IN (SELECT topic_id FROM {EXCLUDED_SQL}) AND j NOT IN (SELECT topic_id FROM {EXCLUDED_SQL})"""

LABELLED_SQL = f"""SELECT t.topic_id, coalesce(x.kind, 'cluster') AS kind,
    CASE WHEN x.kind IS NULL THEN s.cluster END AS cluster
    FROM topics t LEFT JOIN {EXCLUDED_SQL} ON x.topic_id = t.topic_id
    JOIN (SELECT i, j AS cluster, row_number() OVER (PARTITION BY i ORDER BY i = j DESC, round(word_doc_sim, 6) DESC, j) AS nth
          FROM sims WHERE j IN {SEEDS}) s ON s.i = t.topic_id AND s.nth = 1"""

CLUSTERS_SQL = f""", matrix AS ({thresholded(SELECTED_SQL)}), labelled AS ({LABELLED_SQL}),
distances AS (SELECT m.i AS topic_id, a.cluster AS own, b.cluster AS other, avg(1.0 - m.sim) AS d
    FROM matrix m JOIN labelled a ON a.topic_id = m.i JOIN labelled b ON b.topic_id = m.j
    WHERE m.i <> m.j GROUP BY ALL),
ab AS (SELECT topic_id, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b
    FROM distances GROUP BY topic_id),
clusters AS (SELECT l.topic_id, l.kind, l.cluster,
    CASE WHEN l.kind <> 'cluster' OR b IS NULL THEN NULL WHEN a IS NULL THEN 0.0
         ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS silhouette
    FROM labelled l LEFT JOIN ab ON ab.topic_id = l.topic_id),
cluster_scores AS (SELECT kind, cluster, CASE WHEN kind = 'cluster' THEN coalesce(sum(silhouette), 0) / count(*) END AS score,
    count(*) AS n_topics FROM clusters GROUP BY kind, cluster),
positions AS (SELECT c.*, s.score, CAST(row_number() OVER (
        ORDER BY s.score DESC NULLS LAST, c.kind, c.cluster, c.topic_id) - 1 AS INTEGER) AS position
    FROM clusters c JOIN cluster_scores s ON s.kind = c.kind AND s.cluster IS NOT DISTINCT FROM c.cluster)
"""


def _excluded(t):
    """Kinds of the topics above, as a table with a row per topic."""
    topics = t.spark.range(NUM_TOPICS).select(F.col("id").cast("int").alias("topic_id"))
    kind = F.coalesce(*[F.when(F.col("topic_id") == topic, F.lit(name)) for topic, name in EXCLUDED])
    return topics.withColumn("kind", kind).where("kind is not null")


def _clusters(t, sims):
    excluded = _excluded(t)
    near = W.partitionBy("i").orderBy(F.desc(F.col("i") == F.col("j")), F.desc(F.round("word_doc_sim", 6)), "j")
    nearest = sims.where(F.col("j").isin(*SEEDS)).withColumn("nth", F.row_number().over(near)).where("nth = 1")
    given = nearest.select(F.col("i").alias("topic_id"), F.col("j").alias("cluster")).join(excluded, "topic_id", "left_anti")
    labelled = H.label_topics(given, excluded)
    matrix = H.selected_similarities(sims, excluded)
    return H.topic_clusters(labelled, H.silhouettes(matrix, labelled))


def kinds_sql(p: float) -> str:
    matrix = zeroed("word_doc_sim")
    return f"""SELECT topic_id, min(kind) AS kind FROM (
        SELECT topic_id, 'common' AS kind FROM (
            SELECT i AS topic_id, count(*) FILTER (WHERE sim >= {percentile(matrix, p)}) AS n
            FROM ({matrix}) GROUP BY i HAVING n >= 0.2 * 10 ORDER BY n DESC, topic_id LIMIT 10)
        UNION ALL SELECT i, 'standalone' FROM ({matrix}) GROUP BY i HAVING bool_and(sim <= {percentile(matrix, p)}))
    GROUP BY topic_id"""


@query("h1_excluded_topics", sql(kinds_sql(0.95), "sims"))
def excluded_topics(t):
    sims = similarities(t)
    return H.excluded_topics(
        sims, NUM_TOPICS, exclude_common=True, exclude_standalone=True, threshold_percentile=95
    )


@query("h1_selected_similarities", sql(f"SELECT i, j, round(sim, 6) AS sim FROM ({thresholded(SELECTED_SQL)})", "sims"))
def selected_similarities(t):
    return rounded(H.selected_similarities(similarities(t), _excluded(t)))


# Nations as topics, similar within their region: each cluster is a region, named by its first nation.
REGIONS_SQL = """SELECT 'nation' AS source, CAST(n_nationkey AS INTEGER) AS topic_id, {columns}
    CAST(min(n_nationkey) OVER (PARTITION BY n_regionkey) AS INTEGER) AS first_topic FROM nation"""


def _region_similarities(t):
    """``(i, j)`` and every metric: 0.8 within a region and 0 elsewhere; a cell per pair of nations."""
    nations = t.read("nation").select(F.col("n_nationkey").cast("int").alias("i"), F.col("n_regionkey").alias("region_i"))
    others = nations.select(F.col("i").alias("j"), F.col("region_i").alias("region_j"))
    sim = F.when(F.col("i") == F.col("j"), 0.0).when(F.col("region_i") == F.col("region_j"), 0.8).otherwise(0.0)
    cells = nations.crossJoin(F.broadcast(others)).withColumn("sim", sim)
    return cells.select("i", "j", *[F.col("sim").alias(metric) for metric in METRICS])


def _named_by_first(clusters):
    clusters = stage(clusters, "region_clusters")
    first = clusters.groupBy("cluster").agg(F.min("topic_id").alias("first_topic"))
    return clusters.join(first, "cluster").drop("cluster").withColumn("source", F.lit("nation"))


@query(
    "h2_spectral_clusters",
    sql(
        REGIONS_SQL.format(columns="CAST(NULL AS INTEGER) AS n_clusters, CAST(NULL AS BOOLEAN) AS is_unit,")
        + """ UNION ALL BY NAME SELECT 'rule' AS source, topic_id, 3 AS n_clusters, true AS is_unit,
        CAST(NULL AS INTEGER) AS first_topic FROM topics""",
        "topics",
    ),
)
def spectral_clusters(t):
    """The clusters of nations are the regions; each rule topic is in one of three clusters, and all are used."""
    regions = _region_similarities(t).select("i", "j", F.col("word_doc_sim").alias("sim"))
    exact = _named_by_first(H.spectral_clusters(regions, n_clusters=5))
    return exact.unionByName(_rule_clusters(t).withColumn("source", F.lit("rule")), allowMissingColumns=True)


def _rule_clusters(t):
    matrix = H.selected_similarities(similarities(t), t.spark.createDataFrame([], "topic_id int, kind string"))
    clusters = H.spectral_clusters(matrix, n_clusters=3)
    used = clusters.agg(F.count_distinct("cluster").cast("int").alias("n_clusters"))
    return clusters.join(F.broadcast(used)).select("topic_id", "n_clusters", F.col("cluster").between(0, 2).alias("is_unit"))


@query(
    "h2_clustered_kinds",
    sql(
        f"""SELECT t.topic_id, coalesce(x.kind, 'cluster') AS kind, x.kind IS NULL AS has_cluster
        FROM topics t LEFT JOIN ({kinds_sql(0.85)}) x ON x.topic_id = t.topic_id""",
        "sims",
        "topics",
    ),
)
def clustered_kinds(t):
    """Every topic is in a cluster, common or stand-alone."""
    clusters = H.cluster_topics(
        similarities(t), NUM_TOPICS, n_clusters=3, exclude_common=True, exclude_standalone=True
    )
    return clusters.select("topic_id", "kind", F.col("cluster").isNotNull().alias("has_cluster"))


@query(
    "h2_cluster_topics",
    sql(
        REGIONS_SQL.format(columns="'cluster' AS kind, CAST(1.0 AS DOUBLE) / 1.0 * 0.8 AS silhouette, CAST(NULL AS BOOLEAN) AS is_silhouette,")
        + """ UNION ALL BY NAME SELECT 'rule' AS source, topic_id, 'cluster' AS kind, CAST(NULL AS DOUBLE) AS silhouette,
        true AS is_silhouette, CAST(NULL AS INTEGER) AS first_topic FROM topics""",
        "topics",
    ),
)
def cluster_topics(t):
    """Nations within a region have the distance 0.2, to the others 1; the silhouette of each rule topic is the
    one that its mean distances to the clusters found give."""
    clusters = H.cluster_topics(_region_similarities(t), 25, n_clusters=5, threshold_percentile=None)
    exact = _named_by_first(clusters).withColumn("silhouette", F.round("silhouette", 9))
    return exact.unionByName(_rule_silhouettes(t).withColumn("source", F.lit("rule")), allowMissingColumns=True)


def _rule_silhouettes(t):
    sims = similarities(t)
    clusters = stage(H.cluster_topics(sims, NUM_TOPICS, n_clusters=3), "clusters")
    matrix = H.selected_similarities(sims, t.spark.createDataFrame([], "topic_id int, kind string"))
    others = clusters.select(F.col("topic_id").alias("j"), F.col("cluster").alias("to"))
    means = matrix.where("i <> j").join(others, "j").groupBy("i", "to").agg(F.avg(1 - F.col("sim")).alias("mean"))
    own = means.join(clusters.select(F.col("topic_id").alias("i"), "cluster"), "i").groupBy("i").agg(
        F.max(F.when(F.col("to") == F.col("cluster"), F.col("mean"))).alias("a"),
        F.min(F.when(F.col("to") != F.col("cluster"), F.col("mean"))).alias("b"),
    )
    wanted = F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))
    joined = clusters.join(own.select(F.col("i").alias("topic_id"), wanted.alias("wanted")), "topic_id")
    return joined.select("topic_id", "kind", (F.abs(F.col("silhouette") - F.col("wanted")) < 1e-9).alias("is_silhouette"))


@query(
    "h3_labels_h5_silhouettes",
    sql(
        CLUSTERS_SQL + "SELECT topic_id, kind, cluster, round(silhouette, 6) AS silhouette FROM clusters",
        "sims",
        "topics",
    ),
)
def silhouettes(t):
    return rounded(_clusters(t, similarities(t)), "silhouette")


@query(
    "h4_cluster_members",
    sql(
        CLUSTERS_SQL
        + """SELECT kind, cluster, string_agg(CAST(topic_id AS VARCHAR), ',' ORDER BY topic_id) AS topic_ids
        FROM clusters GROUP BY kind, cluster""",
        "sims",
        "topics",
    ),
)
def cluster_members(t):
    members = H.cluster_members(_clusters(t, similarities(t)))
    return members.withColumn("topic_ids", F.array_join(F.col("topic_ids").cast("array<string>"), ","))


@query(
    "h6_cluster_scores",
    sql(CLUSTERS_SQL + "SELECT kind, cluster, round(score, 6) AS score, n_topics FROM cluster_scores", "sims", "topics"),
)
def cluster_scores(t):
    return rounded(H.cluster_scores(_clusters(t, similarities(t))), "score")


@query(
    "h7_clusters_table",
    sql(
        CLUSTERS_SQL
        + """SELECT position, kind, cluster, round(score, 6) AS score, p.topic_id, label
        FROM positions p JOIN labels10 l ON l.topic_id = p.topic_id""",
        "sims",
        "topics",
        "labels10",
    ),
)
def clusters_table(t):
    table = R.topics_table(R.topic_scores(t.doc_topics, NUM_TOPICS), E.top_words(t.topic_words))
    placed = H.clusters_table(_clusters(t, similarities(t)), table)
    return rounded(placed.drop("words"), "score")


@query(
    "h8_clustered_heat_map",
    sql(
        CLUSTERS_SQL
        + f"""SELECT a.position AS "row", b.position AS "column", m.i, m.j, round(m.sim, 6) AS sim
        FROM ({thresholded(zeroed('word_doc_sim'))}) m
        JOIN positions a ON a.topic_id = m.i JOIN positions b ON b.topic_id = m.j""",
        "sims",
        "topics",
    ),
)
def clustered_heat_map(t):
    sims = similarities(t)
    return rounded(H.clustered_heat_map(sims, _clusters(t, sims)))
