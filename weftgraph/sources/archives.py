"""Archives, documents and paged services as rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_FILES, MOST_BYTES, MOST_TOTAL = 2000, 10 << 20, 100 << 20


def zip_entries(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(archive, entry, bytes, content, problem): a row for each file of each zip of (path, content).

    What would leave the folder, is larger than 10 MiB, or comes after 2,000 files or 100 MiB of an archive has no content
    and says why; bytes that are no zip make one row with that problem.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["archive"], b["content"], strict=True):
                try:
                    box = zipfile.ZipFile(io.BytesIO(raw))
                except (zipfile.BadZipFile, TypeError):
                    yield pd.DataFrame({"archive": [name], "entry": [None], "bytes": [0], "content": [None], "problem": ["no zip"]})
                    continue
                files, total = 0, 0
                for e in box.infolist():
                    if e.is_dir():
                        continue
                    files, parts, problem = files + 1, re.split(r"[/\\]", e.filename), None
                    if e.filename.startswith(("/", "\\")) or ".." in parts or re.match(r"[A-Za-z]:", e.filename):
                        problem = "outside"
                    elif e.file_size > MOST_BYTES or total + e.file_size > MOST_TOTAL:
                        problem = "too large"
                    elif files > MOST_FILES:
                        problem = "too many"
                    data = None if problem else box.read(e)
                    total += len(data or b"")
                    yield pd.DataFrame({"archive": [name], "entry": [e.filename], "bytes": [e.file_size], "content": [data], "problem": [problem]})

    rows = archives.select(F.col(path).alias("archive"), F.col(content).alias("content"))
    return rows.mapInPandas(run, "archive string, entry string, bytes long, content binary, problem string")


def docx_text(documents: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, text): the paragraphs of each document, a line each; null for what is no such document."""
    body = zip_entries(documents, path, content).where("entry = 'word/document.xml'").select(F.col("archive").alias("path"), F.decode("content", "UTF-8").alias("xml"))
    paragraphs = F.regexp_extract_all("xml", F.lit(r"(?s)<w:p[ >].*?</w:p>"), F.lit(0))
    line = lambda p: F.array_join(F.regexp_extract_all(p, F.lit(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>"), F.lit(1)), "")
    from ..functions.paths import html_decode

    texts = body.select("path", html_decode(F.array_join(F.transform(paragraphs, line), "\n")).alias("text"))
    return documents.select(F.col(path).alias("path")).join(texts, "path", "left")


def skill_problems(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, problem): files whose front matter is missing, has no pair, or lacks a name or description; the rest have null."""
    from .files import front_matter

    m = front_matter(F.col(text))
    blank = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")) == ""
    rows = files.select(path, m.alias("m"))
    return rows.select(path, F.when(F.col("m").isNull(), "no front matter").when(F.size("m") == 0, "no pair").when(blank("name"), "no name").when(blank("description"), "no description").alias("problem"))


def save_records(rows: DataFrame, key: str, folder: str) -> None:
    """A folder of its own for each key, with its row as JSON; written anew."""
    rows.withColumn("_key", F.col(key)).repartition("_key").write.mode("overwrite").partitionBy("_key").json(folder)


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedSource(DataSource):
    """A service that gives its rows by pages, as a batch source: each page is a partition, fetched by the task.

    paged_source() makes one from fetch(page) -> rows; a page that fails, fails the whole scan. Pages are counted from
    0, `pages` of them at most; what comes after the total is empty.
    """

    fetch: Callable[[int], list[tuple]]
    fields: str
    pages: int

    def schema(self) -> str:
        return self.fields

    def reader(self, schema) -> DataSourceReader:
        fetch, pages = self.fetch, self.pages

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [_Page(i) for i in range(pages)]

            def read(self, partition: InputPartition) -> Iterator[tuple]:
                yield from fetch(partition.number)

        return Reader()


def paged_source(spark: SparkSession, name: str, fetch: Callable[[int], list[tuple]], schema: str, total: int, page_size: int = 100, most_pages: int = 50) -> DataFrame:
    """The rows of a paged service: page_size is held between 1 and 100, the pages end with the total or at most_pages."""
    size = min(100, max(1, page_size))
    kind = type(f"Paged_{name}", (PagedSource,), {"fetch": staticmethod(fetch), "fields": schema, "pages": min(most_pages, -(-total // size)), "name": classmethod(lambda cls: name)})
    spark.dataSource.register(kind)
    return spark.read.format(name).load()
