"""A batch source and sink of objects under keys, one file each, as object stores keep them.

    spark.dataSource.register(ObjectStore)
    df.write.format("object_store").mode("append").save(root)
    spark.read.format("object_store").option("prefix", "manifests/7/").load(root)

Columns: key, size, body. A read is narrowed by the options prefix or keys (a JSON list): only folders that these can be in are listed, by
tasks, and only objects that pass are opened. bodies=false lists keys without opening anything. Objects that go
while they are read are passed over. A write puts each object in place by a rename, so a task that is tried
again, or runs twice, does no harm. Names that start with a dot aren't objects.

The narrowing isn't a pushed filter: Spark 4.1 keeps what was pushed with the relation, not with the scan, so a frame that is
filtered in two ways in one plan would read the same keys for both.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "key string, size bigint, body binary"
_ARROW = pa.schema([("key", pa.string()), ("size", pa.int64()), ("body", pa.binary())])
#: Folders that a task lists, and bytes of a batch, about.
FOLDERS, BYTES = 64, 8 << 20


def _open(root: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(root)


def sound(key: str) -> bool:
    """Whether a key stays inside the store."""
    return bool(key) and not key.startswith("/") and all(p and not p.startswith(".") for p in key.split("/"))


@dataclass
class Listed(InputPartition):
    """Folders to be listed with all below them, or single keys."""

    folders: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


class ObjectStoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.bodies = options["path"], options.get("bodies", "true") == "true"
        self.prefix, keys = options.get("prefix", ""), options.get("keys")
        self.keys = set(json.loads(keys)) if keys else None

    def partitions(self) -> list[InputPartition]:
        """Tasks of FOLDERS folders each, from the folder that the prefix names; of asked keys, those that pass it."""
        import pyarrow.fs as pafs

        if self.keys is not None:
            kept = sorted(k for k in self.keys if k is not None and k.startswith(self.prefix) and sound(k))
            return [Listed(keys=tuple(kept[i : i + 1024])) for i in range(0, len(kept), 1024)] or [Listed()]
        store, root = _open(self.root)
        top = self.prefix.rpartition("/")[0]
        found = store.get_file_info(pafs.FileSelector(f"{root}/{top}".rstrip("/"), allow_not_found=True))
        names = sorted((f"{top}/{i.base_name}".lstrip("/"), i.type) for i in found if not i.base_name.startswith("."))
        names = [(n, t) for n, t in names if n.startswith(self.prefix) or self.prefix.startswith(f"{n}/")]
        keys = tuple(n for n, t in names if t == pafs.FileType.File)
        folders = [n for n, t in names if t == pafs.FileType.Directory]
        parts = [Listed(keys=keys)] if keys else []
        return parts + [Listed(folders=tuple(folders[i : i + FOLDERS])) for i in range(0, len(folders), FOLDERS)] or [Listed()]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, root = _open(self.root)

        def there() -> Iterator[tuple[str, int]]:
            for info in store.get_file_info([f"{root}/{k}" for k in partition.keys]):
                if info.type == pafs.FileType.File:
                    yield info.path[len(root) + 1 :], info.size
            for folder in partition.folders:
                for info in store.get_file_info(pafs.FileSelector(f"{root}/{folder}", recursive=True, allow_not_found=True)):
                    if info.type == pafs.FileType.File and not info.base_name.startswith(".") and (key := info.path[len(root) + 1 :]).startswith(self.prefix):
                        yield key, info.size

        rows, held = [], 0
        for key, size in there():
            body = None
            if self.bodies:
                try:
                    with store.open_input_file(f"{root}/{key}") as file:
                        body = file.read()
                except FileNotFoundError:
                    continue
            rows.append((key, size, body))
            held += size if self.bodies else 64
            if held >= BYTES or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class ObjectStoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _open(self.root)
        mark = f".{uuid.uuid4().hex}"
        for batch in iterator:
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                if key is None or not sound(key):
                    raise ValueError(f"not a key: {key!r}")
                folder, _, name = f"{root}/{key}".rpartition("/")
                try:
                    file = store.open_output_stream(f"{folder}/{mark}.{name}")
                except FileNotFoundError:  # as a rule, another object has made the folder
                    store.create_dir(folder, recursive=True)
                    file = store.open_output_stream(f"{folder}/{mark}.{name}")
                with file:
                    file.write(body or b"")
                store.move(f"{folder}/{mark}.{name}", f"{folder}/{name}")
        return WriterCommitMessage()


class ObjectStore(DataSource):
    """format("object_store")."""

    @classmethod
    def name(cls) -> str:
        return "object_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectStoreReader:
        return ObjectStoreReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ObjectStoreWriter:
        return ObjectStoreWriter(dict(self.options))


def put(objects: DataFrame, root: str) -> None:
    """Write objects (key, body) under root; an object that is there under a key is replaced."""
    objects.sparkSession.dataSource.register(ObjectStore)
    objects.select("key", F.octet_length("body").cast("long").alias("size"), "body").write.format("object_store").mode("append").save(root)


def objects(spark: SparkSession, root: str, prefix: str = "", keys: list[str] | None = None, bodies: bool = True) -> DataFrame:
    """The objects under root whose keys start with a prefix, or those of some keys. Without bodies, keys and sizes only."""
    spark.dataSource.register(ObjectStore)
    reader = spark.read.format("object_store").option("prefix", prefix).option("bodies", str(bodies).lower())
    return (reader if keys is None else reader.option("keys", json.dumps(keys))).load(root)


def get(keys: DataFrame, root: str, column: str = "key") -> DataFrame:
    """keys with the column body: the object under each key, or null if there is none. Tasks open what their rows ask for, so nothing is listed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    target = StructType([*keys.schema.fields, StructField("body", BinaryType())])
    at, schema = keys.columns.index(column), to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(root)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, bodies = batch.slice(start, 256), []
                for key in part.column(at).to_pylist():
                    try:
                        if key is None or not sound(key):
                            raise FileNotFoundError
                        with store.open_input_file(f"{folder}/{key}") as file:
                            bodies.append(file.read())
                    except OSError:
                        bodies.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary())], schema=schema)

    return keys.mapInArrow(run, target)
