"""Common table expressions shared by the reference SQL."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "texts": ((), "SELECT doc_id AS id, text FROM documents"),
    "posts": (
        (),
        r"""SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title,
               'http://example.com/' || d.doc_id AS url,
               CAST(regexp_extract(e.props, '"k": *([0-9]+)', 1) AS INTEGER) AS num_points,
               c.c_name AS author, o.o_orderdate AS created_at, CAST(o.o_orderdate AS DATE) AS created_date
        FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id
             JOIN customer c ON c.c_custkey = o.o_custkey JOIN events e ON e.event_id = d.doc_id""",
    ),
    # Letter runs of each text, and the same as one row per word.
    "tokens": ((), r"SELECT doc_id AS id, regexp_extract_all(lower(text), '\p{L}+') AS tokens FROM documents"),
    "words": (
        ("tokens",),
        "SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM tokens",
    ),
    "surface": (
        (),
        r"SELECT doc_id AS id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS tokens FROM documents",
    ),
    "vocabulary": (
        ("words",),
        """SELECT term, df, tf FROM (SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM words GROUP BY term)
        WHERE df >= 5 AND df <= floor(0.6 * (SELECT count(*) FROM documents))""",
    ),
    "pair_words": (
        ("words",),
        """SELECT * FROM (SELECT id, pos, term AS w1, lead(term) OVER (PARTITION BY id ORDER BY pos) AS w2 FROM words)
        WHERE w2 IS NOT NULL""",
    ),
    "word_counts": (("words",), "SELECT term, count(*) AS n FROM words GROUP BY term"),
    "pair_counts": (("pair_words",), "SELECT w1, w2, count(*) AS n FROM pair_words GROUP BY w1, w2"),
    "phrases": (
        ("word_counts", "pair_counts"),
        """SELECT * FROM (SELECT p.w1, p.w2, p.n,
               CAST(p.n - 5 AS DOUBLE) / a.n / b.n
                 * ((SELECT count(*) FROM word_counts) + (SELECT count(*) FROM pair_counts)) AS score
            FROM pair_counts p JOIN word_counts a ON a.term = p.w1 JOIN word_counts b ON b.term = p.w2)
        WHERE score > 10""",
    ),
    "merged": (
        ("words", "phrase_starts"),
        """SELECT w.id, w.pos, CASE WHEN s.pos IS NULL THEN w.term ELSE w.term || '_' || s.w2 END AS term
        FROM words w LEFT JOIN phrase_starts s ON s.id = w.id AND s.pos = w.pos
             LEFT JOIN phrase_starts t ON t.id = w.id AND t.pos = w.pos - 1
        WHERE t.pos IS NULL""",
    ),
    "phrase_starts": (
        ("pair_words", "phrases"),
        """SELECT id, pos, w2 FROM (
            SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY pos) AS nth FROM (
                SELECT id, pos, w2, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run
                FROM pair_words JOIN phrases USING (w1, w2)))
        WHERE nth % 2 = 1""",
    ),
    # Rule topics.
    "terms": (
        (),
        "SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents",
    ),
    "term_counts": (("terms",), "SELECT id, term, count(*) AS n FROM terms GROUP BY id, term"),
    "weights": (
        ("terms",),
        """SELECT term, topic_id, sum(w) AS w FROM (
            SELECT DISTINCT term, CAST((length(term) - 1) % 10 AS INTEGER) AS topic_id, 7 AS w FROM terms
            UNION ALL SELECT DISTINCT term, CAST((ascii(term) - 97) % 10 AS INTEGER), 3 FROM terms)
        GROUP BY term, topic_id""",
    ),
    "doc_topics": (
        ("term_counts", "weights"),
        """SELECT id, topic_id, CAST(s AS DOUBLE) / CAST(10 * total AS DOUBLE) AS prob FROM (
            SELECT id, topic_id, CAST(sum(n * w) AS BIGINT) AS s FROM term_counts JOIN weights USING (term)
            GROUP BY id, topic_id)
        JOIN (SELECT id, CAST(sum(n) AS BIGINT) AS total FROM term_counts GROUP BY id) USING (id)""",
    ),
    "topic_words": (
        ("term_counts", "weights"),
        """SELECT topic_id, term, CAST(sum(n * w) AS DOUBLE) / 10 AS weight
        FROM term_counts JOIN weights USING (term) GROUP BY topic_id, term""",
    ),
    "labels10": (
        ("topic_words",),
        """SELECT topic_id, string_agg(term, ', ' ORDER BY weight DESC, term) AS label FROM (
            SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM topic_words)
        WHERE rank <= 10 GROUP BY topic_id""",
    ),
    "topics": ((), "SELECT CAST(range AS INTEGER) AS topic_id FROM range(10)"),
    "scores": (
        ("topics", "doc_topics"),
        """SELECT topic_id, score FROM topics LEFT JOIN (
            SELECT topic_id, quantile_cont(prob, 0.5) AS score FROM doc_topics WHERE prob >= 0.1 GROUP BY topic_id)
        USING (topic_id)""",
    ),
    "topic_table": (
        ("scores", "labels10"),
        """SELECT CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, topic_id) AS INTEGER) AS rank,
               topic_id, score, label
        FROM scores LEFT JOIN labels10 USING (topic_id)""",
    ),
    # Similarities of rule topics, all 100 cells.
    "doc_dots": (
        ("doc_topics",),
        """SELECT a.topic_id AS i, b.topic_id AS j, sum(a.prob * b.prob) AS dot,
               count(*) FILTER (WHERE a.prob > 0.15 AND b.prob > 0.15) AS both_over
        FROM doc_topics a JOIN doc_topics b ON a.id = b.id AND a.topic_id <= b.topic_id GROUP BY ALL""",
    ),
    "word_dots": (
        ("topic_words",),
        """SELECT a.topic_id AS i, b.topic_id AS j, sum(a.weight * b.weight) AS dot
        FROM topic_words a JOIN topic_words b ON a.term = b.term AND a.topic_id <= b.topic_id GROUP BY ALL""",
    ),
    "cells": (
        ("topics", "doc_dots", "word_dots"),
        """SELECT a.topic_id AS i, b.topic_id AS j, coalesce(d.dot, 0.0) AS doc_dot,
               coalesce(d.both_over, 0) AS both_over, coalesce(w.dot, 0.0) AS word_dot
        FROM topics a CROSS JOIN topics b
             LEFT JOIN doc_dots d ON d.i = least(a.topic_id, b.topic_id) AND d.j = greatest(a.topic_id, b.topic_id)
             LEFT JOIN word_dots w ON w.i = least(a.topic_id, b.topic_id) AND w.j = greatest(a.topic_id, b.topic_id)""",
    ),
    "base_sims": (
        ("cells",),
        """SELECT c.i, c.j,
               round(coalesce(c.doc_dot / nullif(sqrt(a.doc_dot) * sqrt(b.doc_dot), 0), 0), 12) AS doc_sim,
               round(coalesce(c.word_dot / nullif(sqrt(a.word_dot) * sqrt(b.word_dot), 0), 0), 12) AS word_sim,
               round(CAST(c.both_over AS DOUBLE) / nullif(a.both_over + b.both_over - c.both_over, 0), 12) AS jaccard
        FROM cells c JOIN cells a ON a.i = c.i AND a.j = c.i JOIN cells b ON b.i = c.j AND b.j = c.j""",
    ),
    "sims": (
        ("base_sims",),
        """SELECT i, j, doc_sim, word_sim, jaccard, CASE WHEN i = j THEN 0.0 ELSE round((
               (SELECT max(doc_sim) FROM base_sims WHERE i <> j) / (SELECT max(word_sim) FROM base_sims WHERE i <> j)
               * word_sim + doc_sim) / 2.0, 12) END AS word_doc_sim
        FROM base_sims""",
    ),
}


def sql(body: str, *names: str) -> str:
    """``body`` after the named expressions and all that they use."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in CTES[name][0]:
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    parts = [f"{name} AS (\n{CTES[name][1]}\n)" for name in ordered]
    # A body that starts with a comma adds expressions of its own.
    return "WITH " + ",\n".join(parts) + "\n" + body
