from newsloom.sources.articles import (
    append_ids,
    clustered_by_id,
    read_manifest,
    read_text_folder,
    read_work_list,
    write_articles,
    write_text_folder,
)
from newsloom.sources.pages import article_text_from_html, extract_articles, rejected_pages
from newsloom.sources.posts import POSTS_SCHEMA, read_posts
from newsloom.sources.progress import article_metrics, throughput
from newsloom.sources.tokens import materialise_tokens
from newsloom.sources.topic_files import read_corpus_file, read_doc_topics_file, read_topic_keys_file

__all__ = [
    "POSTS_SCHEMA",
    "append_ids",
    "article_metrics",
    "article_text_from_html",
    "clustered_by_id",
    "extract_articles",
    "materialise_tokens",
    "read_corpus_file",
    "read_doc_topics_file",
    "read_manifest",
    "read_posts",
    "read_text_folder",
    "read_topic_keys_file",
    "read_work_list",
    "rejected_pages",
    "throughput",
    "write_articles",
    "write_text_folder",
]
