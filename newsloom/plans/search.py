"""One object for an inverted index that grows batch by batch and outlives its session."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.staging import path_exists, path_is_complete, scratch_path
from newsloom.operators import search_index as D

DOCUMENT_FIELDS = "id long, text string"
POSTING_FIELDS = "token string, id long"
REPLACED_FIELDS = "id long, old int"
MANIFEST_FIELDS = "batch int, documents long, replaced long, preprocess_tokens boolean"
# Batches of about one size that are merged into one.
FAN_IN = 8


class SearchIndex:
    """Documents ``(id, text)`` and their postings; a document that comes again is replaced.

    Every batch is appended to the folder ``path``: a table of documents, one of postings, and one of the
    ids it replaces with the batch that held them. A manifest that is written last lists the batches, so a
    batch that breaks off is not there, and any session can open the folder again. Reading leaves out the
    replaced rows, which are known and not derived. ``FAN_IN`` batches of about one size are merged into
    one, without their replaced rows, so there are few batches and each document is written anew a few
    times only, however many batches come. Two writers at once are refused: they write the same batch.

    Without a path the index lies in the shared folder.
    """

    def __init__(
        self,
        spark: SparkSession,
        preprocess_tokens: bool = False,
        preprocessor: Callable[[Column], Column] = D.lower_tokens,
        path: str | None = None,
    ):
        self.spark = spark
        self._options = {"preprocess_tokens": preprocess_tokens, "preprocessor": preprocessor}
        self.path = scratch_path(spark, "search_index") if path is None else path
        self._version, self._batches = self._last_manifest()
        if any(batch["preprocess_tokens"] != preprocess_tokens for batch in self._batches):
            raise ValueError(f"the index at {self.path} has other forms of tokens; open it with preprocess_tokens={not preprocess_tokens}")

    def _last_manifest(self) -> tuple[int, list[dict]]:
        """The highest finished version and its batches, a row each."""
        folder = f"{self.path}/manifest"
        if not path_exists(self.spark, folder):
            return 0, []
        versions = self.spark.read.schema(f"{MANIFEST_FIELDS}, version int").parquet(folder).select("version").distinct().collect()
        last = max((r.version for r in versions if path_is_complete(self.spark, f"{folder}/version={r.version}")), default=0)
        rows = self.spark.read.schema(MANIFEST_FIELDS).parquet(f"{folder}/version={last}").collect() if last else []
        return last, sorted((r.asDict() for r in rows if r.batch >= 0), key=lambda r: r["batch"])

    def _commit(self, batches: list[dict]) -> None:
        # A row without a batch keeps the version where there are no batches.
        rows = [tuple(b[name] for name in ("batch", "documents", "replaced", "preprocess_tokens")) for b in batches]
        rows = rows or [(-1, 0, 0, self._options["preprocess_tokens"])]
        table = self.spark.createDataFrame(rows, MANIFEST_FIELDS).coalesce(1)
        table.write.parquet(f"{self.path}/manifest/version={self._version + 1}")
        self._version, self._batches = self._version + 1, batches

    def _read(self, name: str, fields: str, batches: list[dict] | None = None) -> DataFrame:
        """Rows of all listed batches of a table; the condition on the batch prunes folders."""
        chosen = [b["batch"] for b in (self._batches if batches is None else batches)]
        if not chosen:
            return self.spark.createDataFrame([], f"{fields}, batch int")
        return self.spark.read.schema(f"{fields}, batch int").parquet(f"{self.path}/{name}").where(F.col("batch").isin(chosen))

    def _replaced(self, batches: list[dict]) -> DataFrame | None:
        """``(id, batch)`` of the rows of ``batches`` that later batches replaced, if there are any."""
        if not any(b["replaced"] for b in self._batches):
            return None
        rows = self._read("replaced", REPLACED_FIELDS).where(F.col("old").isin([b["batch"] for b in batches]))
        return rows.select("id", F.col("old").alias("batch"))

    def _live(self, name: str, fields: str, batches: list[dict] | None = None) -> DataFrame:
        batches = self._batches if batches is None else batches
        rows = self._read(name, fields, batches)
        replaced = self._replaced(batches) if batches else None
        return rows if replaced is None else rows.join(replaced, ["id", "batch"], "left_anti")

    def _append(self, documents: DataFrame, postings: DataFrame | None, merged: list[dict]) -> None:
        """Write a batch in place of ``merged`` ones, or as a new one, and list it."""
        number = 1 + max((b["batch"] for b in self._batches), default=-1)
        folder = lambda name: f"{self.path}/{name}/batch={number}"
        # A writer that broke off may have left this batch half written; it is not listed.
        mode = "errorifexists" if path_is_complete(self.spark, folder("replaced")) else "overwrite"
        documents.select("id", "text").write.mode(mode).parquet(folder("documents"))
        stored = self.spark.read.schema(DOCUMENT_FIELDS).parquet(folder("documents"))
        if postings is None:
            postings = D.index_documents(stored, **self._options)
        postings.select("token", "id").write.mode(mode).parquet(folder("postings"))
        kept = [b for b in self._batches if b not in merged]
        if merged:
            # The merged batches took place of each other already; ids they replaced elsewhere stay replaced.
            replaced = self._read("replaced", REPLACED_FIELDS, merged).where(F.col("old").isin([b["batch"] for b in kept]))
        else:
            replaced = self._live("documents", "id long").join(stored.select("id"), "id", "left_semi").withColumnRenamed("batch", "old")
        replaced.select("id", "old").write.mode(mode).parquet(folder("replaced"))
        row = {"batch": number, "documents": stored.count(), "preprocess_tokens": self._options["preprocess_tokens"]}
        row["replaced"] = self.spark.read.schema(REPLACED_FIELDS).parquet(folder("replaced")).count()
        self._commit([*kept, row])

    def index(self, documents: DataFrame) -> None:
        """Ids must be unique within a batch."""
        self._append(documents, None, [])
        while batches := self._mergeable():
            self._merge(batches)

    def _mergeable(self) -> list[dict]:
        """The newest batches if ``FAN_IN`` of them are of about one size. Only batches that follow each
        other are merged, so that a later one still replaces an earlier one."""
        newest = self._batches[-FAN_IN:]
        levels = {int(math.log(max(b["documents"], 1), FAN_IN) + 1e-9) for b in newest}
        return newest if len(newest) == FAN_IN and len(levels) == 1 else []

    def _merge(self, batches: list[dict]) -> None:
        self._append(self._live("documents", DOCUMENT_FIELDS, batches), self._live("postings", POSTING_FIELDS, batches), batches)

    @property
    def documents(self) -> DataFrame:
        return self._live("documents", DOCUMENT_FIELDS).select("id", "text")

    @property
    def postings(self) -> DataFrame:
        return self._live("postings", POSTING_FIELDS).select("token", "id")

    @property
    def num_batches(self) -> int:
        return len(self._batches)

    def compact(self) -> None:
        """Write one batch instead of all so far."""
        if self._batches:
            self._merge(list(self._batches))

    def query(self, term: str) -> DataFrame:
        return D.query_index(self.postings, term)

    def document_frequency(self) -> DataFrame:
        return D.document_frequency(self.postings)

    def save(self, path: str) -> None:
        """Export the postings, clustered by token, and the documents."""
        D.write_index(self.postings, f"{path}/postings")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> SearchIndex:
        """An exported index becomes the first batch of a new one."""
        index = cls(spark, **options)
        saved = [spark.read.schema(fields).parquet(f"{path}/{name}") for name, fields in (("documents", DOCUMENT_FIELDS), ("postings", POSTING_FIELDS))]
        index._append(*saved, [])
        return index
