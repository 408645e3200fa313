"""URL filters by sorted arrays of digests.

Strings of a host and the beginning of a path, such as `example.org/en/`, are kept in an array: their 64-bit xxhashes in
order, the ends of the strings, and the strings themselves, in files of the shared folder, split into shards by the
digest's low bits. Tasks write the shards and map them into memory, so that only pages that a search touches are
read, and all workers of a machine share them. A URL gives one probe for each suffix of its host's labels and
each stored length of a path; all probes of a batch are looked up in one binary search per shard, and what
is found is compared with the stored string, so that equal digests of different strings do no harm.

An entry fits its host and all subdomains if the URL's path starts with its path. The longest one counts (host and
path together); of an entry that is listed twice, with `allow` and `block`, the allowing one.

A null URL, or one without `://`, has an empty host and path and fits nothing. Repeated rows give repeated results.
Columns of pages that have an output column's name are replaced. Null entries are passed over; an array
without entries fits nothing; an empty table gives an empty result. A host may be of any length and have any number of labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import read_documents
from tessera.session import cut, shared_dir

#: Seed of Spark's xxhash64.
SEED = 42
#: Entries of a shard, about.
SHARD = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules that op13 is to apply.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words between dots and hyphens of a host that put its domain on op13's list.
TERMS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


@dataclass(frozen=True)
class DigestArray:
    """Where the shards of an array are: folder, number of shards, and the lengths that the entries' paths have."""

    folder: str
    shards: int
    lengths: tuple[int, ...]


def digest(text: bytes) -> int:
    """The 64-bit hash that F.xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(text, SEED)
    return h - (1 << 64) if h >> 63 else h


class _Shard:
    """A mapped shard; where the shared store can't be mapped, its bytes are read."""

    def __init__(self, folder: str, at: int):
        store, path = pafs.FileSystem.from_uri(folder)
        read = lambda name, kind: self._bytes(store, f"{path}/{at}.{name}", kind)
        self.keys, self.ends, self.text = read("keys", np.int64), read("ends", np.int64), read("text", np.uint8)

    @staticmethod
    def _bytes(store: pafs.FileSystem, path: str, kind: type) -> np.ndarray:
        if not (size := store.get_file_info(path).size):
            return np.zeros(0, kind)
        if isinstance(store, pafs.LocalFileSystem):
            return np.memmap(path, kind, "r")
        with store.open_input_file(path) as file:
            return np.frombuffer(file.read(size), kind)

    def string(self, i: int) -> bytes:
        return self.text[self.ends[i - 1] if i else 0 : self.ends[i]].tobytes()


class Searcher:
    """Looks strings up in an array; shards are opened when a probe needs them."""

    def __init__(self, array: DigestArray):
        self.array, self.opened = array, {}

    def find(self, keys: np.ndarray, texts: list[bytes]) -> list[bytes | None]:
        """The stored string (its verdict's first letter, then the string) of each probe that is there."""
        out: list[bytes | None] = [None] * len(texts)
        shard = keys & (self.array.shards - 1)
        for s in np.unique(shard):
            if s not in self.opened:
                self.opened[s] = _Shard(self.array.folder, int(s))
            held = self.opened[s]
            mine = np.flatnonzero(shard == s)
            mine = mine[np.argsort(keys[mine], kind="stable")]  # probes in order touch the array's pages in order
            low = np.searchsorted(held.keys, keys[mine], "left")
            hit = low < len(held.keys)
            hit[hit] = held.keys[low[hit]] == keys[mine[hit]]
            for i, at in zip(mine[hit].tolist(), low[hit].tolist()):
                while at < len(held.keys) and held.keys[at] == keys[i]:
                    if (stored := held.string(at))[1:] == texts[i]:
                        out[i] = stored
                        break
                    at += 1
        return out


def _write_shards(folder: str):
    """Rows shard, digest, entry, verdict, ordered, to files of the folder; gives each shard's number of entries. A shard that is written again replaces itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        shard, files, count, end, mark = None, {}, 0, 0, uuid.uuid4().hex

        def close() -> Iterator[pa.RecordBatch]:
            if shard is not None:
                for name, file in files.items():
                    file.close()
                    store.move(f"{path}/{mark}.{shard}.{name}", f"{path}/{shard}.{name}")
                yield pa.RecordBatch.from_pydict({"shard": [shard], "entries": [count]})

        for batch in batches:
            shards = batch.column(0).to_numpy()
            for s in np.unique(shards).tolist():
                part = batch.filter(pa.array(shards == s))
                if s != shard:
                    yield from close()
                    shard, count, end = s, 0, 0
                    files = {n: store.open_output_stream(f"{path}/{mark}.{s}.{n}") for n in ("keys", "ends", "text")}
                texts = [v[:1].encode() + e.encode() for e, v in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                ends = end + np.cumsum([len(t) for t in texts], dtype=np.int64)
                files["keys"].write(part.column(1).to_numpy().astype(np.int64).tobytes())
                files["ends"].write(ends.tobytes())
                files["text"].write(b"".join(texts))
                count, end = count + len(texts), int(ends[-1])
        yield from close()

    return run


def build(entries: DataFrame, name: str = "urls") -> DigestArray:
    """An array of entries: columns entry (host, and a path that is empty or starts with a slash) and verdict (allow or block)."""
    spark = entries.sparkSession
    folder = f"{shared_dir(spark)}/digests-{name}-{uuid.uuid4().hex}"
    kept = entries.where("entry is not null").groupBy("entry").agg(F.min("verdict").alias("verdict"))
    kept = cut(kept.select("entry", "verdict", F.xxhash64("entry").alias("digest"), F.char_length(F.regexp_extract("entry", r"(?s)^[^/]*(.*)$", 1)).alias("length")), f"digest-{name}")
    shards = 1
    while shards * SHARD < kept.count():
        shards *= 2
    x = kept.withColumn("shard", F.col("digest").bitwiseAND(shards - 1)).repartition("shard").sortWithinPartitions("shard", "digest", "entry")
    written = cut(x.select("shard", "digest", "entry", "verdict").mapInArrow(_write_shards(folder), "shard long, entries long"), f"shards-{name}")
    empty = sorted(set(range(shards)) - {r[0] for r in written.select("shard").collect()}) if written.count() < shards else []
    if empty:
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for s in empty:
            for part in ("keys", "ends", "text"):
                store.open_output_stream(f"{path}/{s}.{part}").close()
    return DigestArray(folder, shards, tuple(sorted(r[0] for r in kept.select("length").distinct().collect())))


def _probed(arrays: list[DigestArray], schema: pa.Schema, at: int):
    """Rows whose columns at and at + 1 are host and path, to the same rows with a stored string of each array."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [Searcher(a) for a in arrays]
        suffixes: dict[str, list[bytes]] = {}
        for batch in batches:
            hosts, paths = batch.column(at).to_pylist(), [p.encode("utf-8", "surrogatepass") for p in batch.column(at + 1).to_pylist()]
            added = []
            for searcher in searchers:
                lengths, texts, owner = searcher.array.lengths, [], []
                for i, (host, path) in enumerate(zip(hosts, paths)):
                    if not host:
                        continue
                    if host not in suffixes:
                        if len(suffixes) >= 100_000:
                            suffixes.clear()
                        labels = host.encode("utf-8", "surrogatepass").split(b".")
                        suffixes[host] = [b".".join(labels[k:]) for k in range(len(labels))]
                    starts = [path.decode("utf-8", "surrogatepass")[:n].encode("utf-8", "surrogatepass") for n in lengths] if not path.isascii() else [path[:n] for n in lengths if n <= len(path)]
                    for suffix in suffixes[host]:
                        texts += [suffix + s for s in starts]
                        owner += [i] * len(starts)
                found = searcher.find(np.fromiter(map(digest, texts), np.int64, len(texts)), texts)
                best: list[bytes | None] = [None] * batch.num_rows
                for i, stored in zip(owner, found):
                    if stored is not None and (best[i] is None or len(stored) > len(best[i])):
                        best[i] = stored
                added.append(pa.array(best, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*batch.columns, *added], schema.types)], schema=schema)

    return run


def judge(pages: DataFrame, rules: DigestArray, listed: DigestArray, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (the longest one that fits, or null), listed (the longest entry of the list that fits, or null) and verdict: the rule's, else the entry's, else allow. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*names, host.alias("host"), path.alias("path"))
    target = StructType([*rows.schema.fields, StructField("_rule", StringType()), StructField("_listed", StringType())])
    x = rows.mapInArrow(_probed([rules, listed], to_arrow_schema(target), len(names)), target)
    entry = lambda c: F.substring(c, 2, F.char_length(c))
    letter = F.substring(F.coalesce("_rule", "_listed", F.lit("a")), 1, 1)
    return x.select(*names, "host", "path", entry(F.col("_rule")).alias("rule"), entry(F.col("_listed")).alias("listed"), F.when(letter == "b", "block").otherwise("allow").alias("verdict"))


def listed_domains(pages: DataFrame, terms: list[str], url_col: str = "url") -> DataFrame:
    """Entries that block each domain of pages whose name holds a term between hyphens: the label that does, and those after it."""
    host, _ = host_and_path(F.col(url_col))
    words = "|".join(terms)
    domain = F.regexp_extract("host", rf"(?:^|\.)((?:[^.]*-)?(?:{words})(?:-[^.]*)?\..*)$", 1)
    return pages.select(host.alias("host")).distinct().select(domain.alias("domain")).where("domain <> ''").distinct().select(F.concat("domain", F.lit("/")).alias("entry"), F.lit("block").alias("verdict"))


def op13_digest_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL: the fixed rules, and else a list of domains that is drawn from all pages."""
    pages = read_documents(spark, sf_dir, "pages").select("page_id", "url")
    rules = build(spark.createDataFrame(RULES, "entry string, verdict string"), "rules")
    listed = build(listed_domains(pages, TERMS), "listed")
    return judge(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rule_host, rule_path, says)),
hosts AS (SELECT DISTINCT host, path FROM parts),
best AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS says
 FROM hosts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL),
listed AS (SELECT DISTINCT regexp_extract(host, '(?:^|\.)((?:[^.]*-)?(?:ads|adult|bets|casino|pills|spam)(?:-[^.]*)?\..*)$', 1) AS domain FROM parts),
bad AS (SELECT DISTINCT host, path FROM hosts JOIN listed ON domain <> '' AND (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, '/'))
SELECT page_id, p.host, p.path, rule, coalesce(says, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p LEFT JOIN best ON best.host = p.host AND best.path = p.path LEFT JOIN bad ON bad.host = p.host AND bad.path = p.path"""
