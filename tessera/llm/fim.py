"""Fill-in-middle transformation by rank and select over code point boundaries.

The bytes of a batch of texts get a bitvector with a one where a code point starts, packed into 64-bit words, and a
directory of the ones before each block of eight words. The ones between a text's ends are its code points n; select
on the two ranks that the id's hash picks gives the bytes at which the text is cut, without decoding it.

The text becomes `<P>`prefix`<S>`suffix`<M>`middle (psm), `<S>`suffix`<P>`prefix`<M>`middle (spm), or stays as it is
(plain): if it is empty, holds one of the three marks, or the hash says so. restore() gives the text back.

A null text is empty; a null id hashes as no digits. Equal ids are cut at the same ranks of their own texts; repeated
rows give repeated results. A byte that isn't the start of a code point counts as part of the one before it. Columns of
docs that have an output column's name are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm.common import STEP, read_documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
BLOCK = 8
#: Columns that transform() adds: n and the cuts in code points (null if plain), the cuts in bytes, the form and the text.
OUTPUT = StructType([StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes")] + [StructField("form", StringType()), StructField("output", StringType())])


class Boundaries:
    """Rank and select over the bytes that start a code point."""

    def __init__(self, data: np.ndarray):
        bits = np.zeros(-(-(len(data) + 1) // (64 * BLOCK)) * 64 * BLOCK, bool)
        bits[: len(data)] = (data & 0xC0) != 0x80
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.counts = np.bitwise_count(self.words).astype(np.int64).reshape(-1, BLOCK)
        self.before = np.r_[0, np.cumsum(self.counts.sum(axis=1))]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that start before each byte."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        within = np.where(np.arange(BLOCK) < (word % BLOCK)[:, None], self.counts[word // BLOCK], 0).sum(axis=1)
        return self.before[word // BLOCK] + within + np.bitwise_count(low)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The byte at which the code point with each rank (the first one has 0) starts; ranks must be below the total."""
        block = np.searchsorted(self.before, rank, side="right") - 1
        left = rank - self.before[block]
        ends = np.cumsum(self.counts[block], axis=1)
        word = (ends <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, np.take_along_axis(ends, np.maximum(word - 1, 0)[:, None], axis=1)[:, 0], 0)
        at = block * BLOCK + word
        ones = np.cumsum(np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1)
        return at * 64 + (ones <= left[:, None]).sum(axis=1)


def cuts(texts: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n, the code points before the two cuts and the bytes before them, of large_binary texts; ends: two numbers of each, taken modulo n + 1."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    offsets = offsets - first
    index = Boundaries(data)
    ranks = index.rank(offsets)
    n = np.diff(ranks)
    two = np.sort(ends % (n + 1)[:, None], axis=1)
    at = np.empty_like(two)
    for k in range(2):
        inside = two[:, k] < n
        at[:, k] = offsets[1:]
        at[inside, k] = index.select((ranks[:-1] + two[:, k])[inside])
    at = at - offsets[:-1, None]
    return n, two[:, 0], two[:, 1], at[:, 0], at[:, 1]


def _arranged(text_at: int, spm: int, plain: int, schema: pa.Schema):
    """Rows with four numbers behind them, to the rows with OUTPUT's columns instead of the numbers."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                texts = part.column(text_at).cast(pa.large_binary()).fill_null(b"")
                h = np.stack([part.column(part.num_columns - 4 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
                n, pre, mid, pre_at, mid_at = cuts(texts, h[:, :2])
                forms, outputs = [], []
                for i, text in enumerate(texts.to_pylist()):
                    if not text or p in text or s in text or m in text or h[i, 2] % 100 >= plain:
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    prefix, middle, suffix = text[: pre_at[i]], text[pre_at[i] : mid_at[i]], text[mid_at[i] :]
                    forms.append("spm" if h[i, 3] % 100 < spm else "psm")
                    outputs.append(b"".join((s, suffix, p, prefix, m, middle) if forms[-1] == "spm" else (p, prefix, s, suffix, m, middle)))
                whole = np.array([f == "plain" for f in forms])
                numbers = [pa.array(n)] + [pa.array(x, mask=whole) for x in (pre, mid - pre, pre_at, mid_at - pre_at)]
                kept = [part.column(i) for i in range(part.num_columns - 4)]
                added = [pa.array(forms, pa.string()), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*kept, *numbers, *added], schema.types)], schema=schema)

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """docs with n, form, output, and the lengths of prefix and middle in code points and bytes (null if plain).

    The four numbers of a document are the first four groups of 8 digits of the SHA-256 of seed, a colon and the id.
    plain_from and spm_below: percentages that the third and fourth number are held against. No shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c not in OUTPUT.names or c in (id_col, text_col)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k}") for k in range(4)]
    target = StructType([docs.schema[c] for c in kept] + OUTPUT.fields)
    rows = docs.select(*kept, *numbers)
    return rows.mapInArrow(_arranged(kept.index(text_col), spm_below, plain_from, to_arrow_schema(target)), target)


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed, from the output and its form alone. No mark occurs in a text that was cut, so the first of each is the one that was put there."""
    first, second = (F.when(form == "spm", F.lit(x)).otherwise(F.lit(y)) for x, y in ((SUFFIX, PREFIX), (PREFIX, SUFFIX)))
    body = F.substring(output, F.char_length(first) + 1, F.char_length(output))
    one = F.when(form == "spm", F.substring_index(body, PREFIX, 1)).otherwise(F.substring_index(body, SUFFIX, 1))
    rest = F.substring(body, F.char_length(one) + F.char_length(second) + 1, F.char_length(body))
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substring(rest, F.char_length(two) + len(MIDDLE) + 1, F.char_length(rest))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op11_rank_select_fim(spark, sf_dir: str) -> DataFrame:
    """Every document, arranged for filling in the middle, and restored."""
    x = transform(read_documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
num AS (SELECT *, CAST(('0x' || substr(d, 1, 8)) AS BIGINT) % (n + 1) AS c1, CAST(('0x' || substr(d, 9, 8)) AS BIGINT) % (n + 1) AS c2,
 CAST(('0x' || substr(d, 17, 8)) AS BIGINT) % 100 AS h3, CAST(('0x' || substr(d, 25, 8)) AS BIGINT) % 100 AS h4 FROM hashed),
formed AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form, least(c1, c2) AS p, greatest(c1, c2) AS m FROM num),
parts AS (SELECT *, substring(t, 1, p) AS pre, substring(t, p + 1, m - p) AS mid, substring(t, m + 1) AS suf FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""
