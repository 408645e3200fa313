"""Language-model scoring by the likelihood of subword lattices.

The model draws pieces of an existing vocabulary one after another, and an end. A word, with its leading space
mark, may be cut into pieces in many ways; its probability is the sum over all of them, by the forward recursion
in log space. A document's probability is the product over its words and the end. The vocabulary's scores are the
prior of the piece probabilities; the expected counts of pieces in the training words, with forward and backward
sums under those scores, are added to it.

Words are counted over all training documents, and each distinct word is scored once; the lattices of many words are
summed at once, as arrays (Lattices), and those of words of more than WIDE bytes one by one (Lattice). Frequent words, at most
FREQUENT of them, of at most SHORT bytes each and SENT_BYTES in all, are sent to the tasks; the others of a document are joined with the table of words. So no key
of that join is frequent, unless it is that of a long word.

Nulls count as empty texts, which have only the end. Repeated rows give repeated results. With nothing to learn
from, the vocabulary's scores stand alone.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import vocab
from tessera.llm.common import STEP, crc_mod, lower_words, name_of, read_documents
from tessera.session import cut

#: Most bytes of a word that is sent to the tasks, and of all that are.
SHORT, SENT_BYTES = 256, 8 << 20
#: Most words sent to the tasks; distinct words of a partition that are counted before they are passed on.
FREQUENT, FLUSH = 100_000, 250_000
#: Training pieces that the vocabulary's own scores count as.
PRIOR = 1000.0
#: Words of more bytes don't keep their pieces; parts of one in which expected counts, and in which sums of logarithms, are added up.
LONG, UNIT, FINE = 4096, 1 << 40, 1 << 32
#: Bytes of the longest words whose lattices are summed as arrays, and places (bytes of words, padded) in such arrays. No word has the byte NONE.
WIDE, PLACES, NONE = 512, 1 << 15, 256
#: Logarithm of what can't be reached: finite, so that differences are no NaN.
NEVER = -1e300


class Lattice:
    """All segmentations of a word into pieces; scores are natural logarithms.

    The pieces of a word of at most LONG bytes are found once and kept; those of a longer word are found again in each pass, so that
    it takes a few numbers for each byte.
    """

    def __init__(self, scores: dict[bytes, float]):
        self.next: dict[bytes, float | None] = {p[:i]: None for p in scores for i in range(1, len(p))}
        self.next |= scores

    def pieces(self, text: bytes, start: int) -> list[tuple[int, bytes, float]]:
        """End, piece and score of the pieces that start there."""
        get, found = self.next.get, []
        for end in range(start + 1, len(text) + 1):
            score = get(piece := text[start:end], 0.0)
            if score:
                found.append((end, piece, score))
            elif score == 0.0:
                break
        return found

    def edges(self, text: bytes) -> Callable[[int], list[tuple[int, bytes, float]]]:
        """The pieces by their start."""
        if len(text) > LONG:
            return lambda start: self.pieces(text, start)
        return [self.pieces(text, start) for start in range(len(text))].__getitem__

    def forward(self, n: int, edges: Callable) -> array:
        """Log sums of all ways to each place of a text of n bytes."""
        a = array("d", [-math.inf]) * (n + 1)
        a[0] = 0.0
        for start in range(n):
            before = a[start]
            for end, _, score in edges(start):
                x, y = before + score, a[end]
                if y < x:
                    x, y = y, x
                a[end] = y + math.log1p(math.exp(x - y)) if x > -700 + y else y
        return a

    def log_probability(self, word: bytes) -> float:
        return self.forward(len(word) + 1, self.edges(b" " + word))[-1]

    def expect(self, word: bytes, times: int, into: Counter) -> None:
        """Add the expected number of each piece in the word, times `times`, in units of 1 / UNIT: whole numbers give the same sum in any order."""
        edges, n = self.edges(b" " + word), len(word) + 1
        a = self.forward(n, edges)
        b = array("d", [-math.inf]) * n + array("d", [0.0])
        total = a[n]
        for start in range(n - 1, -1, -1):
            top = -math.inf
            before = a[start]
            for end, piece, score in edges(start):
                x = score + b[end]
                if before + x - total > -40:
                    into[piece] += int(times * math.exp(before + x - total) * UNIT + 0.5)
                y = top
                if y < x:
                    x, y = y, x
                top = y + math.log1p(math.exp(x - y)) if x > -700 + y else y
            b[start] = top


class Lattices:
    """The lattices of many words at once, as arrays; they give the sums of Lattice.

    Pieces are found by a trie with one slot for each node: a node's child by a byte stands at base[node] + byte, if owner says that it is this node's.
    Sums to and from a place are relative to the best single way to it, so that they neither vanish nor overflow, however improbable a word is
    (a word of n bytes has at most 2 ** n ways). Each sum is made in the order of the starts, whatever words stand beside.
    """

    def __init__(self, scores: dict[bytes, float]):
        self.pieces, self.scores, self.single = list(scores), np.fromiter(scores.values(), np.float64, len(scores)), None
        self.number = {p: i for i, p in enumerate(self.pieces)}
        children: dict[bytes, list[int]] = {}
        for prefix in {p[:i] for p in scores for i in range(1, len(p) + 1)}:
            children.setdefault(prefix[:-1], []).append(prefix[-1])
        # Parents of many children first, each looking on from where the one before found room; those of one take what is left.
        order = sorted(children, key=lambda p: (-len(children[p]), p))
        several = [p for p in order if len(children[p]) > 1]
        size = sum(map(len, children.values())) + 8 * NONE
        free, bases, at = np.ones(2 * size, bool), {}, 1
        for i, prefix in enumerate(several):
            held = np.array(sorted(children[prefix]))
            if i and len(held) < len(children[several[i - 1]]):
                at = 1
            while True:
                if at + 5 * NONE > len(free):
                    free = np.concatenate([free, np.ones(size, bool)])
                room = free[at + held[0] : at + held[0] + NONE].copy()
                for byte in held[1:]:
                    room &= free[at + byte : at + byte + NONE]
                found = int(room.argmax())
                at += found if room[found] else NONE
                if room[found]:
                    break
            free[at + held] = False
            bases[prefix] = at
        left = order[len(several) :]
        if left:
            free = np.concatenate([free, np.ones(size, bool)])
            for prefix, slot in zip(left, (np.flatnonzero(free[NONE:]) + NONE).tolist()):
                bases[prefix] = slot - children[prefix][0]
        end = max(bases.values(), default=0) + 2 * NONE
        self.base, self.owner, self.piece = np.zeros(end, np.int64), np.full(end, -1, np.int64), np.full(end, -1, np.int64)
        slot = lambda p: bases[p[:-1]] + p[-1] if p else 0
        for prefix, base in bases.items():
            self.base[slot(prefix)] = base
            self.owner[base + np.array(children[prefix])] = slot(prefix)
        for p, i in self.number.items():
            self.piece[slot(p)] = i

    def with_scores(self, scores: dict[bytes, float]) -> Lattices:
        """The same pieces with other scores."""
        other = copy(self)
        other.scores, other.single = np.array([scores[p] for p in self.pieces]), None
        return other

    def one(self) -> Lattice:
        """The lattice for words of more than WIDE bytes, made when there is one."""
        if self.single is None:
            self.single = Lattice(dict(zip(self.pieces, self.scores.tolist())))
        return self.single

    def groups(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Places in the list of words that are summed together: those of more than WIDE bytes alone, others with such of like length."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        end = len(order)
        while end:
            n = int(lengths[order[end - 1]]) + 1
            start = max(0, end - (PLACES // n if n <= WIDE else 1))
            yield order[start:end]
            end = start

    def sums(self, words: list[bytes]) -> tuple:
        """Of each word with a leading space: length, logarithm of the best way, sum of all ways relative to it. Then the lattice: probabilities
        by start, piece's length and word, sums to each place, and edges (length, start, piece, probability)."""
        m = len(words)
        lengths = np.fromiter(map(len, words), np.int64, m) + 1
        n = int(lengths.max())
        rows = np.full((m, n), NONE, np.int64)
        rows[:, 0] = 32
        rows[:, 1:][np.arange(1, n) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        # A place is position * m + word.
        text = rows.T.ravel()
        at, node, found = np.arange(n * m), np.zeros(n * m, np.int64), []
        for length in range(1, n + 1):
            inside = np.searchsorted(at, (n - length + 1) * m)
            at, node = at[:inside], node[:inside]
            to = self.base[node] + text[at + (length - 1) * m]
            fits = np.flatnonzero(self.owner[to] == node)
            if not len(fits):
                break
            at, node = at[fits], to[fits]
            ids = self.piece[node]
            whole = np.flatnonzero(ids >= 0)
            found.append((length, at[whole], ids[whole]))
        longest = max(1, len(found))
        cells = np.full((n, longest, m), NEVER)
        # A cell is position * longest * m + (length - 1) * m + word.
        cell = lambda length, at: at + at // m * ((longest - 1) * m) + (length - 1) * m
        for length, at, ids in found:
            cells.ravel()[cell(length, at)] = self.scores[ids]
        best = np.full((n + 1, m), NEVER)
        best[0] = 0.0
        for start in range(n):
            to = best[start + 1 : start + 1 + longest]
            np.maximum(to, best[start] + cells[start, : len(to)], out=to)
        cells[:] = 0.0
        edges = []
        for length, at, ids in found:
            p = np.exp(best.ravel()[at] + self.scores[ids] - best.ravel()[at + length * m])
            cells.ravel()[cell(length, at)] = p
            edges.append((length, at, ids, p))
        a = np.zeros((n + 1, m))
        a[0] = 1.0
        for start in range(n):
            to = a[start + 1 : start + 1 + longest]
            to += a[start] * cells[start, : len(to)]
        each = np.arange(m)
        return lengths, best[lengths, each], a[lengths, each], cells, a, edges

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for group in self.groups(words):
            some = [words[i] for i in group]
            if len(some[-1]) >= WIDE:
                out[group] = [self.one().log_probability(w) for w in some]
            else:
                _, best, total, *_ = self.sums(some)
                out[group] = [b + math.log(x) if x else -math.inf for b, x in zip(best.tolist(), total.tolist())]
        return out

    def expect(self, words: list[bytes], times: list[int], into: tuple[np.ndarray, np.ndarray]) -> None:
        """Add the expected number of each piece in the words, times `times`, to two arrays: whole ones, and parts in units of 1 / UNIT, fewer than UNIT."""
        whole, parts = into
        for group in self.groups(words):
            some = [words[i] for i in group]
            if len(some[-1]) >= WIDE:
                found: Counter = Counter()
                for i in group:
                    self.one().expect(words[i], times[i], found)
                for piece, units in found.items():
                    whole[self.number[piece]] += units // UNIT
                    parts[self.number[piece]] += units % UNIT
            else:
                lengths, _, total, cells, a, edges = self.sums(some)
                m, longest = len(some), cells.shape[1]
                b = np.zeros_like(a)
                b[lengths, np.arange(m)] = 1.0
                for start in range(len(a) - 2, -1, -1):
                    for length in range(1, min(longest, len(a) - 1 - start) + 1):
                        b[start] += cells[start, length - 1] * b[start + length]
                share = np.divide([times[i] for i in group], total, out=np.zeros(m), where=total > 0)
                for length, at, ids, p in edges:
                    x = a.ravel()[at] * p * b.ravel()[at + length * m] * share[at % m]
                    full = np.floor(x)
                    np.add.at(whole, ids, full.astype(np.int64))
                    np.add.at(parts, ids, ((x - full) * UNIT + 0.5).astype(np.int64))
            whole += parts // UNIT
            parts %= UNIT


def word_counts(docs: DataFrame, text_col: str, train_col: str) -> DataFrame:
    """Columns word, c (in training rows), n (in all rows) for each distinct word; counted within partitions first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = {True: Counter(), False: Counter()}

        def flush():
            for train, counts in both.items():
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values() if train else repeat(0, len(counts)), pa.int64()), pa.array(counts.values(), pa.int64())], names=["word", "c", "n"])
                    counts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for text, train in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    both[bool(train)].update(lower_words(text))
                if sum(map(len, both.values())) > FLUSH:
                    yield from flush()
        yield from flush()

    counted = docs.select(text_col, train_col).mapInArrow(run, "word binary, c long, n long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_scores(words: DataFrame, prior: Lattices, ends: int, weight: float = PRIOR) -> tuple[dict[bytes, float], float]:
    """Log probabilities of the pieces and of the end, from the words' counts; the vocabulary bounds their number."""
    shared = words.sparkSession.sparkContext.broadcast(prior)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = shared.value
        whole, parts = into = [np.zeros(len(lattices.pieces), np.int64) for _ in range(2)]
        for batch in batches:
            lattices.expect(batch.column(0).to_pylist(), batch.column(1).to_pylist(), into)
        some = np.flatnonzero(whole | parts)
        yield pa.RecordBatch.from_arrays([pa.array([lattices.pieces[i] for i in some], pa.binary()), pa.array(whole[some]), pa.array(parts[some])], names=["piece", "n", "parts"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece binary, n long, parts long").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("parts").alias("parts")).collect()
    expected = {bytes(r["piece"]): r["n"] + r["parts"] / UNIT for r in rows}
    scores = dict(zip(prior.pieces, prior.scores.tolist()))
    if math.isinf(weight):
        return scores, math.log((ends + 0.5) / (ends + 0.5 + sum(expected.values())))
    total = math.fsum(expected.values()) + weight + ends + 0.5
    return {p: math.log((expected.get(p, 0.0) + weight * math.exp(s)) / total) for p, s in scores.items()}, math.log((ends + 0.5) / total)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, vocab_path: str | None = None, weight: float = PRIOR) -> DataFrame:
    """Columns id, n_tokens, n_known, train_tokens, base_score, score (logarithms to base 10) for each row of docs.

    train says which rows to learn from (all, if none). weight is the number of pieces that the vocabulary's own scores
    count as; an infinite one takes the scores as they are. base_score is that of single words with half a count added.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.lit(True) if train is None else train).alias("train"))
    words = cut(word_counts(rows, "text", "train"), "lm-words")
    ends = rows.where("train").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    lattices = Lattices(vocab.load(vocab_path))
    pieces, end_score = piece_scores(words, lattices, ends, weight)
    base_of = lambda c: math.log10((c + 0.5) / (n_train + 0.5 * (distinct + 1)))
    shared = spark.sparkContext.broadcast(lattices.with_scores(pieces))

    def add_scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("lp", pa.array(shared.value.log_probabilities(batch.column(0).to_pylist()), pa.float64()))

    table = cut(words.mapInArrow(add_scores, "word binary, c long, n long, lp double"), "lm-scores")
    # The least count of the words to send: by steps of a twelfth of an octave, so that few rows come back.
    step = F.floor(F.log2("n") * 12).cast("long")
    short = table.where(F.octet_length("word") <= SHORT)
    steps = short.groupBy(step.alias("step")).agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).collect()
    least, sent, size = 1 << 62, 0, 0
    for at, count, held in sorted(steps, reverse=True):
        if sent + count > FREQUENT or size + held > SENT_BYTES:
            break
        least, sent, size = at, sent + count, size + held
    often = short.where(step >= least).select("word", "c", "lp").collect() if sent else []
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"] > 0, base_of(r["c"]), r["lp"]) for r in often})
    del often
    own = (ends > 0, base_of(ends), end_score)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP // 4):
                part = batch.slice(at, STEP // 4)
                out: list[list] = [[] for _ in range(7)]
                take: list[int | None] = []
                times: list[int] = []
                for i, (key, text) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    words = lower_words(text)
                    counts = Counter(words)
                    there, base, lp, rare = int(own[0]), own[1], own[2], []
                    for word, n in counts.items():
                        x = known.get(word)
                        if x is None:
                            rare.append(word)
                        else:
                            there += n * x[0]
                            base += n * x[1]
                            lp += n * x[2]
                    k = len(rare)
                    for column, values in zip(out, ([key] * (k + 1), [len(words) + 1] + [0] * k, [there] + [0] * k, [round(base * FINE)] + [0] * k, [round(lp * FINE)] + [0] * k, [1] + [0] * k, [None, *rare])):
                        column += values
                    take += [i] + [None] * k
                    times += [0, *map(counts.__getitem__, rare)]
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                ids = part.column(1).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(times, pa.int64()), ids], names=["key", "tokens", "known", "base", "lp", "copies", "word", "n", "id"])

    keyed = rows.select(name_of("id", "text").alias("key"), "id", "text")
    parts = cut(keyed.mapInArrow(run, f"key binary, tokens long, known long, base long, lp long, copies long, word binary, n long, id {kind}"), "lm-parts")
    whole = parts.where("copies > 0").select("key", "tokens", "known", "base", "lp", "copies", "id")
    base = F.log10((F.col("c") + 0.5) / F.lit(n_train + 0.5 * (distinct + 1)))
    # Sums of whole numbers, so that reruns agree to the last digit.
    fine = lambda c: F.round(c * FINE).cast("long")
    rare = parts.where("copies = 0").select("key", "word", "n").join(table.select("word", "c", F.col("lp").alias("each")), "word")
    rare = rare.select("key", F.lit(0).cast("long").alias("tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long").alias("known"), fine(base * F.col("n")).alias("base"), fine(F.col("each") * F.col("n")).alias("lp"), F.lit(0).cast("long").alias("copies"), F.lit(None).cast(kind).alias("id"))
    # Two parts, so that many copies of a row don't overflow.
    halves = [x for c in ("base", "lp") for x in (F.sum(F.shiftright(c, 20)).alias(f"{c}_high"), F.sum(F.col(c).bitwiseAND(F.lit((1 << 20) - 1))).alias(f"{c}_low"))]
    total = whole.unionByName(rare).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("tokens", "known", "copies")), *halves, F.min("id").alias("id"))
    total = total.select("*", *((F.col(f"{c}_high") * float(1 << 20) + F.col(f"{c}_low")).alias(c) for c in ("base", "lp")))
    # Rows that are alike have one key; their sums are the row's, times their number.
    per = lambda c: F.col(c).cast("double") / F.col("copies")
    total = total.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 4096))))
    total = total.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4096).cast("long"), F.col("copies") - 4096 * F.col("_chunk")))))
    return total.select(F.col("id").alias(id_col), per("tokens").cast("long").alias("n_tokens"), per("known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (per("base") / FINE).alias("base_score"), (per("lp") / FINE / math.log(10)).alias("score"))


def op8_lattice_score(spark, sf_dir: str) -> DataFrame:
    """Score every document; learn from those whose crc32 modulo 5 is not 1."""
    x = score(read_documents(spark, sf_dir), train=crc_mod("doc_id", 5) != 1)
    return x.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
