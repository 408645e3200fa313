"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed; pairs of neighbouring hashes are hashed again, doubling the length, so gram hashes of any
length need a few passes. The least 8-gram hash of every 6 consecutive ones is a fingerprint. Two texts that
share 13 consecutive words share the 6 hashes in them, thus a fingerprint. Fingerprints of documents and items
are joined; each hit is extended to the windows of 13 words whose fingerprint it is, and those windows are
compared word by word. Items of fewer than 13 words are one window; for these lengths, every gram is compared.

Nulls: a null text has no words and hits nothing; a null item id is the empty text. Repeated documents give
repeated results; items that share an id count once. Empty tables give no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import read_documents, small
from tessera.session import cut

WINDOW, GRAM = 13, 8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z. In pure ASCII text lower() does that, and is faster."""
    low = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def count_words(text: Column) -> Column:
    """Number of words; it doesn't depend on the case."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, ANY_CASE), ""))).cast("long")


def shifted(column: str, by: int) -> Column:
    return F.slice(column, F.lit(by + 1), F.greatest(F.size(column), F.lit(0)))


def paired(column: str, by: int, other: str | None = None) -> Column:
    """Hash of each element with the one `by` places on."""
    return F.zip_with(F.col(column), shifted(other or column, by), lambda x, y: F.xxhash64(x, y))


def lowest(column: str, by: int) -> Column:
    """The lesser of each element and the one `by` places on; at the end, what there is."""
    return F.zip_with(F.col(column), shifted(column, by), lambda x, y: F.least(x, y))


def with_fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """df, which has the column words, with f_0 (fingerprint of the window that starts at each place) and f_t for each short length t."""
    keep = df.columns
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("h2", paired("h1", 1))
    df = df.withColumn("h4", paired("h2", 2))
    df = df.withColumn("h8", paired("h4", 4))
    # Grams that run over the end are left out.
    df = df.withColumn("h8", F.slice("h8", F.lit(1), F.greatest(F.size("words") - (GRAM - 1), F.lit(0))))
    df = df.withColumn("m2", lowest("h8", 1)).withColumn("m4", lowest("m2", 2)).withColumn("f_0", lowest("m4", 2))
    for t in short:
        at, name = 0, None
        for power in (8, 4, 2, 1):
            if t & power:
                df = df.withColumn(f"g_{t}", F.col(f"h{power}") if name is None else paired(name, at, f"h{power}"))
                name, at = f"g_{t}", at + power
        df = df.withColumn(f"f_{t}", F.transform(F.slice(f"g_{t}", F.lit(1), F.greatest(F.size("words") - (t - 1), F.lit(0))), lambda x, t=t: F.xxhash64(x, F.lit(t))))
    return df.select(*keep, "f_0", *(f"f_{t}" for t in short))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Columns text_key, n_words, n_hit, item_ids (sorted as strings) for each distinct text of docs that has a hit.

    text_key is the text's MD5 (16 bytes). Of the copies of a text, one with the least id is looked at in full. The join strategy of the benchmark is left to Spark's
    size statistics: fingerprints of a small benchmark are broadcast, those of a large one are shuffled.
    """
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    # The lengths below 13 that occur; there are 12 at most.
    short = sorted(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < WINDOW).distinct().collect())
    items = items.withColumn("class", F.xxhash64("words"))
    classes = items.dropDuplicates(["words"]).select("class", "words")
    grams = with_fingerprints(classes, [t for t in short])
    own = [F.when(F.size("words") >= WINDOW, F.col("f_0"))] + [F.when(F.size("words") == t, F.col(f"f_{t}")) for t in short]
    prints = grams.select(F.explode(F.concat(*(F.coalesce(x, F.array().cast("array<bigint>")) for x in own))).alias("print")).distinct()
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = classes.select("class", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, length), " "))).alias("window")).distinct()

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    seen = with_fingerprints(docs.select("id", "text_key", words_of(F.col("text")).alias("words")), short)
    lists = [F.array_distinct(F.col(c)) for c in ["f_0", *(f"f_{t}" for t in short)]]
    seen = seen.select("id", "text_key", F.explode(F.concat(*lists) if short else lists[0]).alias("print"))
    matched = cut(seen.join(prints, "print").groupBy("text_key").agg(F.min("id").alias("carrier")), "hit-texts")

    # Texts stay where they are read: the list of carriers is sent to them, unless it is large.
    mine = (F.col("d.text_key") == F.col("m.text_key")) & F.col("d.id").eqNullSafe(F.col("m.carrier"))
    hit = docs.alias("d").join(small(matched, 48).alias("m"), mine).select("d.text_key", words_of(F.col("text")).alias("words")).dropDuplicates(["text_key"])
    hit = cut(hit, "hit-words")

    def places(t: int) -> Column:
        """Fingerprint, start and length of each of the document's windows."""
        n = t or WINDOW
        found = F.transform(F.slice(f"f_{t}", F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(0))), lambda x, i: F.struct(x.alias("print"), (i + 1).alias("at"), F.lit(n).alias("n")))
        return found

    placed = with_fingerprints(hit, short).select("text_key", F.explode(reduce(lambda a, b: F.concat(a, b), [places(t) for t in [0, *short]])).alias("span"))
    placed = placed.select("text_key", F.col("span.print").alias("print"), F.struct("span.at", "span.n").alias("span")).join(prints, "print", "left_semi")
    placed = placed.groupBy("text_key").agg(F.collect_list("span").alias("spans"))
    hit = hit.join(placed, "text_key").select("text_key", "words", F.explode("spans").alias("span"))
    hit = hit.select("text_key", F.size("words").alias("n_words"), "span", F.array_join(F.slice("words", F.col("span.at"), F.col("span.n")), " ").alias("window"))
    # Windows that the same items have are one kind, told by a hash over their classes, so a span is one row, however many items share it.
    kinds = windows.groupBy("window").agg(F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("class")), F.bit_xor(F.xxhash64("class", F.lit(1)))).alias("kind"))
    kinds = cut(kinds.select("window", F.xxhash64("kind").alias("kind"), F.xxhash64("kind", F.lit(1)).alias("kind_2")), "hit-kinds")
    of_kind = kinds.groupBy("kind", "kind_2").agg(F.min("window").alias("window")).join(windows, "window").select("kind", "kind_2", "class")
    hit = hit.join(kinds, "window").select("text_key", "n_words", "span", "kind", "kind_2")

    covered = hit.groupBy("text_key").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, s):
        end = s["at"] + s["n"] - 1
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], s["at"] - 1), F.lit(0))).alias("n"))

    covered = covered.select("text_key", "n_words", F.aggregate("spans", start, add)["n"].cast("long").alias("n_hit"))
    named = hit.select("text_key", "kind", "kind_2").distinct().join(of_kind, ["kind", "kind_2"]).select("text_key", "class").distinct()
    named = named.join(items.select("class", "item").distinct(), "class")
    named = named.groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return covered.join(named, "text_key")


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs with text_key, n_words, n_hit, item_ids and contaminated; columns of these names in docs are replaced."""
    names = [c for c in docs.columns if c not in ("text_key", "n_words", "n_hit", "item_ids", "contaminated")]
    found = cut(contamination(docs, items).drop("n_words"), "hits")
    # What was hit is sent to the rows unless it is large, so copies of one text don't meet in one task.
    found = small(found, 64 + 32 * F.size("item_ids"))
    rows = docs.select(*names, F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"), count_words(F.col("text")).alias("n_words"))
    rows = rows.join(found, "text_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(*names, "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def op3_winnowing(spark, sf_dir: str) -> DataFrame:
    """How much of every document stands in the benchmark."""
    docs, items = read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark")
    x = judge(docs.select("doc_id", "text"), items)
    return x.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, one_in: int = 20) -> DataFrame:
    """The rows of docs, without those of which one word in `one_in` or more stands in the benchmark."""
    found = cut(contamination(docs, items).where(F.col("n_hit") * one_in >= F.col("n_words")).select("text_key"), "hits")
    found = small(found, 48)
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    return docs.join(found, key == found["text_key"], "left_anti")
