from newsloom.plans.corpus import ArticleCorpus
from newsloom.plans.explorer import TopicExplorer
from newsloom.plans.ingest import ingest_pages
from newsloom.plans.search import SearchIndex

__all__ = ["ArticleCorpus", "SearchIndex", "TopicExplorer", "ingest_pages"]
