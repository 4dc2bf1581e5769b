from newsloom.streaming.tagging import read_article_stream, tag_in_batches, tag_stream, write_tags

__all__ = ["read_article_stream", "tag_in_batches", "tag_stream", "write_tags"]
