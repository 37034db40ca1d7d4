"""Results that a paged interface has left as files: a Spark data source with one partition per page.

A page is a JSON object with `offset` (rows before it), `total` (rows of the whole result), `next` (the offset at which the next
page begins, null on the last one) and `rows`. Nothing is fetched here: pages are read as they have landed, and what is missing is told.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import ensure_checkpoint_dir

SCHEMA = "result string, offset long, total long, next long, row string"


def _files(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    url = urlparse(path)
    return (fs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


class Page(InputPartition):
    def __init__(self, path: str, result: str):
        super().__init__(path)
        self.path, self.result = path, result


class PageReader(DataSourceReader):
    """Rows of the pages under `path`, laid out as result=<name>/page=<number>/."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        files, root = _files(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        pages = [f.path for f in found if f.is_file and "/page=" in f.path and not f.base_name.startswith(("_", "."))]
        return [Page(p, unquote(p.split("/result=")[1].split("/")[0])) for p in sorted(pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        files, _ = _files(self.path)
        with files.open_input_stream(partition.path) as f:
            for line in f.read().decode().splitlines():
                page = json.loads(line)
                head = (partition.result, page["offset"], page["total"], page.get("next"))
                yield (*head, None)  # the page itself, also if it is empty
                for row in page["rows"]:
                    yield (*head, json.dumps(row))


class LandedPages(DataSource):
    """`spark.read.format("landed_pages").load(path)`"""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").load(path)


def page_rows(pages: DataFrame, schema: str) -> DataFrame:
    """result and the fields of every row; a row that overlapping pages repeat comes once."""
    return pages.filter("row is not null").select("result", F.from_json("row", schema).alias("r")).select("result", "r.*").distinct()


def missing_pages(pages: DataFrame) -> DataFrame:
    """(result, offset, until): the runs of rows that no landed page covers, by following each page's `next` to the following one."""
    heads = pages.filter("row is null").select("result", "offset", "total", "next").distinct()
    w = Window.partitionBy("result").orderBy("offset")
    upto = F.coalesce("next", "total")
    covered = F.max(upto).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gaps = heads.select(
        "result",
        F.array(
            F.when(F.lag("offset").over(w).isNull() & (F.col("offset") > 0), F.struct(F.lit(0).cast("long").alias("offset"), F.col("offset").alias("until"))),
            F.when(covered < F.coalesce(F.lead("offset").over(w), "total"), F.struct(covered.alias("offset"), F.coalesce(F.lead("offset").over(w), "total").alias("until"))),
        ).alias("g"),
    )
    return gaps.select("result", F.explode(F.array_compact("g")).alias("g")).select("result", "g.*")


def land(rows: DataFrame, result: str, order: str, size: int, skip=None) -> str:
    """Write `rows` as pages of `size` rows per result into the shared folder, as a downloader would; pages for which `skip` holds do not arrive."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pages-{uuid.uuid4().hex}"
    w = Window.partitionBy(result).orderBy(order)
    fields = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != result]))
    numbered = rows.select(F.col(result).alias("result"), fields.alias("row"), (F.row_number().over(w) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(result)).alias("total"))
    pages = numbered.groupBy("result", F.floor(F.col("at") / size).alias("page"), "total").agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("r"))
    if skip is not None:
        pages = pages.filter(~skip)
    first, end = F.col("page") * size, (F.col("page") + 1) * size
    head = F.concat(F.lit('{"offset":'), first, F.lit(',"total":'), F.col("total"), F.lit(',"next":'), F.when(end < F.col("total"), end.cast("string")).otherwise("null"), F.lit(',"rows":['))
    text = F.concat(head, F.array_join(F.transform("r", lambda x: x["row"]), ","), F.lit("]}"))
    pages.select("result", "page", text.alias("value")).write.partitionBy("result", "page").text(at)
    return at
