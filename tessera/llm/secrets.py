"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. Rules come in groups, and a group's
version is a hash of its rules. A ledger records which (blob, version) pairs have been scanned and what was found.
A run scans the pairs that the ledger lacks, and joins findings back to all paths that hold the blob. A text is scanned
once, by all groups that it lacks, where it is read: the list of blobs and the paths that stand for them is sent to the tasks. If it isn't
small, all texts are scanned if there is no ledger, and else those that lack something are shuffled.

Nulls: a null text is the empty text; a null path is a path of its own. Repeated rows give repeated
results. An empty table gives an empty result and ledger.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.common import map_rows, read_documents, small
from tessera.session import cut, shared_dir

#: Kinds in their order, pattern, whole-match or group whose length counts, least length.
RULES = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
#: Kinds of the base rules; the others are added by this operator.
BASE = ("assign", "access", "hex")
#: Groups of rules, each of which is scanned and recorded by itself.
GROUPS = {"base": [r for r in RULES if r[0] in BASE], "added": [r for r in RULES if r[0] not in BASE]}
#: A text that has none of these (lower-cased) has no match of the rule.
HINTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "pem": ("-----begin ",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "jwt": ("eyj",)}
FINDINGS = "array<struct<kind:int,start:int,end:int>>"
LEDGER = f"blob binary, version string, findings {FINDINGS}"
_COMPILED = {kind: (i, re.compile(pattern), group, least, HINTS.get(kind)) for i, (kind, pattern, group, least) in enumerate(RULES)}
#: Blobs that a task remembers to have scanned.
SEEN = 200_000


def version(group: str) -> str:
    """Version of a group of rules: another pattern, another version."""
    return hashlib.sha256(repr(GROUPS[group]).encode()).hexdigest()[:16]


def find_secrets(text: str, groups: Iterable[str] = tuple(GROUPS)) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) in code points, by start and then kind."""
    lower, found = text.lower(), []
    for rule in (r for g in groups for r in GROUPS[g]):
        kind, pattern, group, least, hints = _COMPILED[rule[0]]
        if hints is None or any(h in lower for h in hints):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[1], x[0]))


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def address(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Columns path, text and blob: each version under its content address (32 bytes)."""
    return versions.select(F.col(path).alias("path"), _body(text).alias("text"), F.unhex(F.sha2(_body(text).cast("binary"), 256)).alias("blob"))


def _scan_blobs(rows: DataFrame) -> DataFrame:
    """Columns blob, version, findings: each blob's scan by the groups that its row names (todo), in one pass over its text, once in each task that holds it."""

    def per_row():
        seen: set[bytes] = set()
        named = {group: version(group) for group in GROUPS}

        def run(blob, text, todo):
            if blob in seen:
                return None
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(blob)
            spans = lambda group: [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(text, (group,))]
            return blob, [{"version": named[g], "findings": spans(g)} for g in todo]

        return run

    scanned = map_rows(rows.select("blob", "text", "todo"), per_row, f"blob binary, scans array<struct<version:string,findings:{FINDINGS}>>")
    return scanned.select("blob", F.explode("scans").alias("s")).select("blob", "s.version", "s.findings")


def _to_scan(rows: DataFrame, ledger: DataFrame | None, groups: Iterable[str]) -> DataFrame:
    """The rows to scan with todo, the groups that the ledger lacks for their blobs. Of the paths of a blob, the least is scanned, if the list of these is small; else each task scans what it holds."""
    names = {version(g): g for g in groups}
    wanted = F.array(*(F.lit(g) for g in names.values()))
    carriers = rows.groupBy("blob").agg(F.min("path").alias("carrier"))
    if ledger is not None:
        past = ledger.where(F.col("version").isin(list(names))).groupBy("blob").agg(F.collect_set("version").alias("done"))
        known = F.array(*(F.when(F.array_contains("done", v), F.lit(g)) for v, g in names.items()))
        carriers = carriers.join(past, "blob", "left").withColumn("todo", F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, F.array_compact(known))))
        carriers = carriers.where(F.size("todo") > 0).drop("done")
    else:
        carriers = carriers.withColumn("todo", wanted)
    carriers = cut(carriers.select(F.col("blob").alias("_blob"), "carrier", "todo"), "secret-carriers")
    mine = (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("carrier"))
    sent = small(carriers, 80)
    if sent is carriers and ledger is None:
        return rows.withColumn("todo", wanted)
    return rows.join(sent, mine).select("path", "text", "blob", "todo")


def scan(versions: DataFrame, path: str = "path", text: str = "text", ledger: DataFrame | None = None, groups: Iterable[str] = tuple(GROUPS)) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; returns (findings per row: path, blob, findings, n_reused; the ledger's new rows: blob, version, findings).

    n_reused is the number of groups of which the blob's findings come from the ledger. The new rows are written
    to the shared folder once; scan_into() keeps them in a ledger that lasts.
    """
    rows = address(versions, path, text)
    # Copies in different tasks give equal rows.
    fresh = _scan_blobs(_to_scan(rows, ledger, groups)).groupBy("blob", "version").agg(F.first("findings").alias("findings"))
    fresh = cut(fresh, "secret-ledger")
    known = fresh.withColumn("reused", F.lit(0))
    if ledger is not None:
        past = ledger.where(F.col("version").isin([version(g) for g in groups])).dropDuplicates(["blob", "version"]).select("blob", "version", "findings", F.lit(1).alias("reused"))
        known = known.unionByName(past)
    # Only blobs with findings, or of which something is reused, are joined to the rows.
    known = known.where((F.size("findings") > 0) | (F.col("reused") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings")), _by_place).alias("findings"), F.sum("reused").alias("n_reused"))
    known = cut(known, "secret-known")
    found = rows.select("path", "blob").join(small(known, 64 + 16 * F.size("findings")), "blob", "left")
    return found.select("path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"), F.coalesce("n_reused", F.lit(0)).cast("int").alias("n_reused")), fresh


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """The ledger under a path, or None if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger_path}/part=*/_SUCCESS")
    parts = [s.getPath().getParent().toString() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    return spark.read.schema(LEDGER).parquet(*parts) if parts else None


def scan_into(versions: DataFrame, ledger_path: str, path: str = "path", text: str = "text", groups: Iterable[str] = tuple(GROUPS)) -> DataFrame:
    """scan() against a ledger that lasts: what is new is appended to the table under ledger_path, so the next run finds it. Returns the findings.

    Each run adds a part of its own, which counts once it is whole; a run that dies leaves nothing that is read, and two
    runs at once add equal rows for what both have scanned.
    """
    spark = versions.sparkSession
    found, fresh = scan(versions, path, text, read_ledger(spark, ledger_path), groups)
    if not fresh.isEmpty():
        fresh.write.parquet(f"{ledger_path}/part={uuid.uuid4().hex}")
    return found


def _by_place(x: Column, y: Column) -> Column:
    """Order of findings: by start, then kind."""
    sign = lambda f: F.when(x[f] < y[f], -1).when(x[f] > y[f], 1)
    return F.coalesce(sign("start"), sign("kind"), F.lit(0))


def spans_string(findings, names=tuple(r[0] for r in RULES)):
    """kind:start:end of each finding, comma-joined."""
    kinds = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secret_ledger(spark, sf_dir: str) -> DataFrame:
    """Every secret span of documents; doc_id is the path. A ledger of its own is filled by one pass of all groups of rules, each blob scanned once."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    found = scan_into(docs, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}", "doc_id", "text")
    base = F.filter("findings", lambda x: x["kind"] < len(BASE))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)),
        F.sha2(spans_string(base).cast("binary"), 256).alias("base_sha256"),
        spans_string(F.col("findings")).alias("spans"),
        F.col("n_reused").cast("long").alias("n_reused"),
        (F.lit(len(GROUPS)) - F.col("n_reused")).cast("long").alias("n_scanned"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret span replaced by a mark; all columns stay.

    Overlapping spans are replaced as one. The spans come from scan(), by blob; with a ledger_path, from scan_into(), so that texts that
    an earlier run has seen aren't scanned again. Null texts stay null.
    """
    rows = docs.select(id_col, text_col)
    found = scan_into(rows, ledger_path, id_col, text_col) if ledger_path else scan(rows, id_col, text_col)[0]
    hits = cut(found.where(F.size("findings") > 0).groupBy(F.col("blob").alias("_blob")).agg(F.first("findings").alias("_spans")), "secret-hits")
    blob = F.unhex(F.sha2(_body(text_col).cast("binary"), 256))
    joined = docs.withColumn("_blob", blob).join(small(hits, 64 + 16 * F.size("_spans")), "_blob", "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] >= acc["end"], F.concat(acc["out"], F.substring(text, acc["end"] + 1, s["start"] - acc["end"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["end"], s["end"]).alias("end"))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["end"] + 1, F.char_length(text))))
    return joined.select(*(F.when(F.col("_spans").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(c) for c in docs.columns))
