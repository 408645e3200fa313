"""Language identification as a multilingual mixture.

Each language has a multinomial over hashed trigrams of bytes of UTF-8. A document is a mixture of languages;
expectation-maximisation estimates the proportions. Languages join the mixture one at a time, while the
penalised log likelihood gains. The prediction is the language with the largest proportion.

Nulls, and texts without a letter (a character of a category L of Unicode), get `und` with score 0; so does every text if nothing was learned. Rows
without a language teach nothing. Repeated rows give repeated results; ties go to the language that sorts first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import STEP, crc_mod, map_rows, read_documents

#: Trigrams are hashed to so many features.
BITS = 16
#: Overlapping trigrams repeat each character; likelihoods count each trigram as this part of one observation.
WEIGHT = 1 / 3
#: ASCII characters that are no letters become spaces.
PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the lower-cased text, and how often each occurs; runs of spaces don't count."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(PLAIN) + b" ", np.uint8).astype(np.uint32)
    grams = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    grams = grams[(grams & 0xFFFF) != 0x2020]
    grams = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    if len(grams) > 8192:
        counts = np.bincount(grams, minlength=1 << BITS)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(grams, return_counts=True)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 3000, id_col: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and a table of probabilities, features by languages.

    The classifier is fitted on about sample_per_language rows of each language, chosen by a hash of the text, and of
    the id if there is one, so that of many copies a part is chosen. It only chooses rows, so reruns agree. The table's size is 2**BITS by the number of languages, whatever the corpus.
    """
    docs = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    languages = sorted(rows)
    if not languages:
        return [], np.zeros((1 << BITS, 0))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample_per_language / rows[lang]))))
    picked = docs.where(F.pmod(F.xxhash64(*([text_col, id_col] if id_col else [text_col])), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)) * 1_000_000)

    def per_row():
        def run(lang, text):
            found, counts = features(text)
            return lang, found.tolist(), counts.tolist()

        return run

    grams = map_rows(picked.select(lang_col, text_col), per_row, "lang string, features array<int>, counts array<long>")
    grams = grams.select("lang", F.explode(F.arrays_zip("features", "counts")).alias("x"))
    counts = grams.groupBy("lang", F.col("x.features").alias("feature")).agg(F.sum("x.counts").alias("n")).toPandas()
    table = np.full((1 << BITS, len(languages)), 0.05)
    np.add.at(table, (counts["feature"].to_numpy(np.int64), counts["lang"].map(languages.index).to_numpy(np.int64)), counts["n"].to_numpy(float))
    return languages, table / table.sum(axis=0)


def mixture(table: np.ndarray, found: np.ndarray, counts: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in a document, and the posterior of each language if there were only one."""
    p, n = table[found], counts.astype(float)
    total = n.sum()
    alone = n @ np.log(p)
    near = np.exp(WEIGHT * (alone - alone.max()))
    chosen, share = [int(alone.argmax())], np.ones(1)
    best, mixed = alone.max(), p[:, chosen[0]]
    while len(chosen) < p.shape[1]:
        # The slope of the likelihood when a language enters: without a rise, it can't gain.
        slope = (n / mixed) @ p - total
        slope[chosen] = -1
        new = int(slope.argmax())
        if slope[new] <= 0:
            break
        q, w = p[:, [*chosen, new]], np.append(share * 0.9, 0.1)
        for _ in range(rounds):
            w = w * ((n / (q @ w)) @ q) / total
        value = float(n @ np.log(q @ w))
        if WEIGHT * (value - best) <= 0.5 * math.log(total) + math.log(p.shape[1]):
            break
        chosen, share, best, mixed = [*chosen, new], w, value, q @ w
    out = np.zeros(p.shape[1])
    out[chosen] = share
    return out, near / near.sum()


def predict(text: str | None, languages: list[str], table: np.ndarray) -> tuple[str, float, list[dict]]:
    """Language, score and proportions of one text. The score is the proportion, times the posterior if there is one language only."""
    if not text or not languages or not any(map(str.isalpha, text)):
        return "und", 0.0, []
    found, counts = features(text)
    if not len(found):
        return "und", 0.0, []
    share, near = mixture(table, found, counts)
    best = int(share.argmax())
    parts = [{"lang": languages[i], "share": float(x)} for i, x in enumerate(share) if x > 0]
    return languages[best], float(min(1.0, share[best] * (near[best] if share[best] == 1 else 1))), parts


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, lang_pred, score, proportions (array of language and share, those above zero) for each row of docs."""
    languages = model[0]
    table = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float64))
    kind = docs.schema[id_col].dataType.simpleString()

    def per_row():
        probabilities = table.value
        return lambda key, text: (key, *predict(text, languages, probabilities))

    return map_rows(docs.select(id_col, text_col), per_row, f"`{id_col}` {kind}, lang_pred string, score double, proportions array<struct<lang:string,share:double>>")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is identified with a score of `least` or more; all columns stay, in one pass without a join."""
    languages, at = model[0], docs.columns.index(text_col)
    table = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = table.value
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                said = (predict(text, languages, probabilities) for text in part.column(at).to_pylist())
                yield part.filter(pa.array([lang != "und" and score >= least for lang, score, _ in said]))

    return docs.mapInArrow(run, docs.schema)


def op6_language_mixture(spark, sf_dir: str) -> DataFrame:
    """Predict the language of every document; learn from those whose crc32 modulo 4 is not 2."""
    docs = read_documents(spark, sf_dir)
    model = train(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"), id_col="doc_id")
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.to_json("proportions").alias("proportions"))
