"""A streaming source of delta feeds: pages of changed items by drive, whose offset is the map of delta links.

A feed is a folder of pages as write_pages() makes it, with Parquet files: drive_id=<d>/page=<n>, or drive_id=<d>/pages=<first>-<last> for pages that share
files, in the order of the column page. A link names a drive, the columns that are asked for and the next page. A link that doesn't name its columns is stale: its drive is read
from the first page again, and the owner's epoch rises by one, which tells whoever keeps state that what is known of files is void.

    spark.dataSource.register(DeltaFeed)
    spark.readStream.format("delta_feed").option("path", folder).option("pages_per_batch", 2).load()

Options: path; pages_per_batch (of each drive; all by default); links (JSON: the links of a saved cursor, by drive). Rows
without an item id are left out. Offsets are read from the query's checkpoint after a restart, so pages are neither lost nor repeated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.operators.ordering import numbered
from tessera.schemas import DELTA_ITEMS

#: What a row of the source has beside an item: the page, the link after it, and the epoch of its owner.
SCHEMA = f"{DELTA_ITEMS}, page bigint, delta_link string, epoch bigint"
#: Columns that a link names.
SELECT = "id,name,parentReference,eTag,deleted"


def link(drive: str | int, page: int | str) -> str:
    """The link that goes on with a page of a drive."""
    return f"/drives/{drive}/root/delta?$select={SELECT}&page={page}"


def stale(text: str) -> bool:
    return "$select=" not in text


def page_of(text: str) -> int:
    return int(re.search(r"page=(\d+)", text)[1])


def write_pages(items: DataFrame, folder: str, rows_per_page: int, pages_per_folder: int = 1) -> None:
    """Write items as pages of their drives, in order. A drive's rows are counted over range partitions, so a large drive is in many tasks.

    A folder with its files costs about as much as some thousand rows, and so does a task of the source, which reads one: small pages should share folders.
    """
    x = numbered(items, ["drive_id"], [F.col("ts"), F.col("seq")], "_place", "feed-places")
    x = x.withColumn("page", F.floor((F.col("_place") - 1) / rows_per_page).cast("long")).drop("_place")
    by = "page"
    if pages_per_folder > 1:
        by, first = "pages", F.floor(F.col("page") / pages_per_folder).cast("long") * pages_per_folder
        x = x.join(x.groupBy("drive_id").agg(F.max("page").alias("_most")), "drive_id")
        x = x.withColumn(by, F.concat_ws("-", first.cast("string"), F.least(first + (pages_per_folder - 1), "_most").cast("string"))).drop("_most")
    x.repartition("drive_id", by).sortWithinPartitions("drive_id", by, "page", "ts", "seq").write.partitionBy("drive_id", by).parquet(folder)


@dataclass
class Page(InputPartition):
    """Pages of a drive from page to last, in a folder, and the epoch in which they are read."""

    drive: str
    page: int
    epoch: int
    last: int
    folder: str


class DeltaFeedReader(DataSourceStreamReader):
    """Offsets: {"links": {drive: link}, "epoch": resets of the owner}."""

    def __init__(self, options: dict):
        self.path, self.per_batch = options["path"], int(options.get("pages_per_batch", 0))
        self.saved = json.loads(options.get("links", "{}"))
        self.at: dict | None = None

    def _store(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.path)

    def _folders(self, below: str, name: str) -> list[str]:
        """Values of the folders name=<value> below a path, in order of their length and text."""
        import pyarrow.fs as pafs

        store, root = self._store()
        found = store.get_file_info(pafs.FileSelector(f"{root}/{below}".rstrip("/"), allow_not_found=True))
        values = [i.base_name.partition("=")[2] for i in found if i.type == pafs.FileType.Directory and i.base_name.startswith(f"{name}=")]
        return sorted(values, key=lambda v: (len(v), v))

    def _pages(self, drive: str) -> list[tuple[int, int, str]]:
        """First page, last page and name of the folders of a drive, in order."""
        single = [(int(v), int(v), f"page={v}") for v in self._folders(f"drive_id={drive}", "page")]
        shared = [(*map(int, v.split("-")), f"pages={v}") for v in self._folders(f"drive_id={drive}", "pages")]
        return sorted(single + shared)

    def initialOffset(self) -> dict:
        return {"links": dict(self.saved), "epoch": 0}

    def latestOffset(self) -> dict:
        start = self.at if self.at is not None else self.initialOffset()
        links, epoch = dict(start["links"]), start["epoch"]
        for drive in self._folders("", "drive_id"):
            pages, was = max((last + 1 for _, last, _ in self._pages(drive)), default=0), links.get(drive)
            if was is not None and stale(was):
                epoch, was = epoch + 1, None
            first = 0 if was is None else page_of(was)
            links[drive] = link(drive, min(pages, first + self.per_batch) if self.per_batch else pages)
        return {"links": links, "epoch": epoch}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.at = end  # Spark calls this with equal offsets after a restart
        out = []
        for drive, text in end["links"].items():
            was = start["links"].get(drive)
            first, stop = 0 if was is None or stale(was) else page_of(was), page_of(text)
            if first < stop:
                out += [Page(drive, max(a, first), end["epoch"], min(b, stop - 1), folder) for a, b, folder in self._pages(drive) if a < stop and b >= first]
        return out

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        store, root = self._store()
        kinds = {"ts": pa.timestamp("us"), "kind": pa.string(), "deleted": pa.bool_(), "path": pa.string(), "name": pa.string(), "etag": pa.string()}
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        whole = ds.dataset(f"{root}/drive_id={partition.drive}/{partition.folder}", filesystem=store, format="parquet")
        fixed = {"drive_id": int(partition.drive), "epoch": partition.epoch}
        asked, shared = pc.field("item_id").is_valid(), partition.folder.startswith("pages=")
        if shared:
            asked &= (pc.field("page") >= partition.page) & (pc.field("page") <= partition.last)
        for batch in whole.to_batches(filter=asked):
            if not batch.num_rows:
                continue
            page = batch.column("page") if shared else pa.array([partition.page] * batch.num_rows, pa.int64())
            next_page = pc.cast(pc.add(page, 1), pa.string())
            made = {"page": page, "delta_link": pc.binary_join_element_wise(link(partition.drive, ""), next_page, "")}
            made |= {n: pa.array([v] * batch.num_rows, pa.int64()) for n, v in fixed.items()}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n).cast(kinds.get(n, pa.int64())) for n in names], names=names)

    def commit(self, end: dict) -> None:
        pass


class DeltaFeed(DataSource):
    """format("delta_feed"): a stream of the pages of a folder."""

    @classmethod
    def name(cls) -> str:
        return "delta_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DeltaFeedReader:
        return DeltaFeedReader(dict(self.options))


def read_feed(spark: SparkSession, path: str, pages_per_batch: int = 0, links: dict[str, str] | None = None) -> DataFrame:
    """The stream of a feed's items. links: those of a saved cursor, by drive."""
    spark.dataSource.register(DeltaFeed)
    reader = spark.readStream.format("delta_feed").option("path", path).option("pages_per_batch", pages_per_batch)
    return reader.option("links", json.dumps(links or {})).load()
