"""Pages of documents: a data source over binary files, a recognition cache, a table in manifest order.

A page has ``manifest_ord, doc_id, page, text``.  The manifest is a JSON array
as ``files.read_manifest`` takes it; its order is that of all results.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .journal import content

SCHEMA = "manifest_ord int, doc_id string, page int, text string"
CACHED = "doc_id string, page int, text string"
#: Documents a task.
DOCS_PER_TASK = 64


@dataclass
class DocumentRange(InputPartition):
    """Entries (order, id, path) that follow each other in the manifest."""

    entries: list[tuple[int, str, str]]


class PageReader(DataSourceReader):
    """Opens only the wanted documents' files and passes on only the wanted pages."""

    def __init__(self, options: dict, parse: Callable[[bytes], list[str]], doc_ids: Collection[str] | None, numbers: Collection[int] | None):
        self.folder, self.manifest = options["path"].rstrip("/"), options["manifest"]
        self.docs_per_task = int(options.get("docspertask", DOCS_PER_TASK))
        self.parse, self.doc_ids, self.numbers = parse, doc_ids, numbers

    def partitions(self) -> list[DocumentRange]:
        entries = [
            (i, e["id"], f"{self.folder}/{e['filename']}")
            for i, e in enumerate(json.loads(content(self.manifest)))
            if e.get("text_layer") != "ocr" and (self.doc_ids is None or e["id"] in self.doc_ids)
        ]
        step = self.docs_per_task
        return [DocumentRange(entries[at : at + step]) for at in range(0, len(entries), step)] or [DocumentRange([])]

    def read(self, partition: DocumentRange) -> Iterator[tuple]:
        for order, doc_id, path in partition.entries:
            for page, text in enumerate(self.parse(content(path)), 1):
                if self.numbers is None or page in self.numbers:
                    yield order, doc_id, page, text


def read_pages(spark: SparkSession, folder: str, manifest: str, parse: Callable[[bytes], list[str]], doc_ids: Collection[str] | None = None, numbers: Collection[int] | None = None, docs_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """The pages of a manifest's files by a pluggable ``parse`` of a file's bytes.

    ``doc_ids`` and ``numbers`` of pages reach the source: a lookup of a page
    opens one file.  They are arguments because Spark keeps one reader for all
    uses of a Python source, so filters pushed by one use would cut another's
    rows; filters of the frame are applied to what was read.  Entries whose
    text layer is recognised (``ocr``) aren't opened; ``all_pages`` adds them.
    A file that is missing ends the job, as does one that the parser refuses.
    The driver holds the manifest's entries that are left, one a file.
    """
    ids, wanted = (None if x is None else frozenset(x) for x in (doc_ids, numbers))

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "document_pages"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> PageReader:  # noqa: ARG002
            return PageReader(dict(self.options), parse, ids, wanted)

    spark.dataSource.register(Pages)
    return spark.read.format("document_pages").option("manifest", manifest).option("docspertask", str(docs_per_task)).load(folder)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised pages; none where nothing was recognised yet."""
    spark.createDataFrame([], CACHED).write.mode("append").parquet(folder)
    return spark.read.schema(CACHED).parquet(folder)


def recognised(wanted: DataFrame, folder: str, recognise: Callable[[str, int], str]) -> DataFrame:
    """(doc_id, page, text) of the wanted (doc_id, page): from the cache, and what it lacks through ``recognise``.

    Missing pages are recognised where Spark deals them, each once, and become
    rows of the cache when their job has ended: a task that fails leaves no
    row, and a later call asks for what is still missing.  Null ids or pages
    are none; repeated ones give one row.
    """
    spark = wanted.sparkSession

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            yield own.assign(text=[recognise(d, int(p)) for d, p in zip(own.doc_id, own.page, strict=True)])

    keys = wanted.select("doc_id", "page").where("doc_id IS NOT NULL AND page IS NOT NULL").distinct()
    missing = keys.join(read_cache(spark, folder), ["doc_id", "page"], "left_anti")
    # Recognition takes seconds a page, so pages are dealt evenly, whatever partitions the join left.
    missing.repartition(spark.sparkContext.defaultParallelism, "doc_id", "page").mapInPandas(work, CACHED).write.mode("append").parquet(folder)
    return read_cache(spark, folder).join(keys, ["doc_id", "page"], "left_semi").dropDuplicates(["doc_id", "page"])


def all_pages(pages: DataFrame, manifest: DataFrame, cached: DataFrame) -> DataFrame:
    """Parsed pages, and of the entries with a recognised text layer those in the cache."""
    entries = manifest.where("text_layer = 'ocr'").select("manifest_ord", F.col("id").alias("doc_id"))
    return pages.unionByName(entries.join(cached, "doc_id").select(pages.columns))


def write_pages(pages: DataFrame, folder: str, order: str = "manifest_ord") -> DataFrame:
    """Pages as a table in manifest order, so a range of it is a range of files; read back."""
    # By range of order and page, so a long document is several files.
    pages.repartitionByRange(order, "page").sortWithinPartitions(order, "page").write.parquet(folder)
    return pages.sparkSession.read.schema(pages.schema).parquet(folder)
