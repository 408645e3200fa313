"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its distinct word n-grams, hashed to 64 bits. Sizes fall into bands. In a band, two
sets that are similar enough differ in at most H elements, so if the universe is hashed into H + 1 + spare
segments, 1 + spare segments of theirs are equal. The segments of every set are indexed by their content.
Sets look in their own band and in lower ones that may hold partners.

Of the sets under one index key, the one with the most keys is the hub: each other set is compared with it,
exactly. Where all are linked with the hub's class, nothing is left to compare. Where some are apart from it, they are
compared with the key's other sets, save where a lower bound of the distance, from sketches, sizes and distances to the
hub, rules it out. A key with more sets apart than that is worth is costly: it is skipped, and a set of which more than
the spare segments are skipped (or empty) is allocated anew, together with the others of that kind, the crowd.

In a crowd, elements that no other set of it has are a set's own. Sets with u and v own elements differ in u + v
elements at least, so the rest of them may differ in H - u - v only. Sets that have so many of their own that no size
and number of a partner suits them are done with. The others' rests are indexed first by rare elements: the elements of a set
that others have too are put in one order, rarest first; similar sets have one of the first few in common, as many as
a set may lose and stay similar, and one more, less its own. Those that wait because of costly keys are then indexed by classes of own
elements, with as few segments as that smaller bound needs: the more a set is edited, the larger its segments
become, until nobody shares them. Every other level also halves the number of segments and indexes one-deletion
neighbourhoods, so that segments that differ in one element meet too. Levels follow each other, with other
segments and smaller crowds, while they at least halve the sets that wait, and at most LEVELS of them. What waits
then, such as sets with fewer elements than segments, is settled by rare elements without skipping any. No set waits after that.

Documents with equal sets are one set. Rows are never paired with rows, and no group is gathered in one place:
the groups of a key are streamed from sorted partitions, to which each task sends a set once.

Nulls and texts without words have the empty set and no links; a null id takes part but names nothing. Repeated
rows are members of one set. Rows that share an id but not the text are kept apart by their sets. Sets are named by
128 bits; the index tells them by half of these, and a name that two sets share there only adds comparisons.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.llm.common import STEP, lower_words, read_documents, small
from tessera.llm.components import components
from tessera.session import cut, drop

#: A key is costly if more sets than this are apart from its hub's class, and these times its sets are more than ROOM, or for rare elements, of which a set has few, RARE_ROOM; sets that a task remembers to have sent.
COSTLY, ROOM, RARE_ROOM, SENT = 2, 1 << 18, 1 << 22, 200_000
#: Levels before what still waits is settled by rare elements, and counters of elements in the order of rarity.
LEVELS, COUNTERS = 8, 1 << 16
#: Columns of a set's sketch, 64 bits each.
SKETCH = [f"b{i}" for i in range(8)]
_BITS = ", ".join(f"{c} long" for c in SKETCH)
#: Classes of own elements in a band, where contents are indexed and where one-deletion neighbourhoods are too.
CLASSES = (6, 3)
#: A character of a word, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]"
#: Added to a set's excess, to keep it positive in a packed number.
BIAS = 1 << 19
#: A set of which more than one in so many rows is a copy is hot; there are at most so many hot sets.
HOT = 10_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on each other (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words; of fewer words, the whole sequence's."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _M1 + h[i : len(words) - k + 1 + i]
    return np.unique(mix(out))


def set_name(grams: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return xxhash.xxh3_128_digest(grams.tobytes())


def sketch(grams: np.ndarray) -> np.ndarray:
    """Bits of which each element turns one: sets of which d bits differ differ in d elements or more."""
    bits = (mix(grams + _M1) >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(bits, minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def handle(name: bytes) -> int:
    """Half of a set's name, as a number above zero, by which the index tells sets."""
    return int.from_bytes(name[:8], "little") >> 1


class Bands:
    """Size bands of similar sets, for a similarity of percent/100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.floor = next(n for n in range(1, 10_000) if (2 * n + 1) * (100 - percent) >= 100 + percent)
        self.starts = [self.floor]

    @staticmethod
    def spare(m: int) -> int:
        """Segments beyond those that the pigeonhole needs, for m of these: a few may be empty or costly."""
        return 1 + m // 8

    def of(self, n: int) -> list[tuple[int, int]]:
        """(band, most differing elements) of each band in which a set of n elements may have partners of at most its size."""
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 13 // 10))
        least, out = -(-n * self.percent // 100), []
        for band in range(int(np.searchsorted(self.starts, n, side="right")) - 1, -1, -1):
            top = self.starts[band + 1] - 1
            if top < least:
                break
            out.append((band, (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)))
        return out


def _plans(n: int, own: int, bands: Bands, level: int) -> list[tuple[int, int, int]]:
    """(tag, elements in which the rests may differ, least segments needed) for each group of partners of a set.

    Level 0 has a group for each band. Later levels have one for each band and class of the partner's own elements.
    """
    out = []
    for band, most in bands.of(n):
        width = max(1, -(-(most + 1) // CLASSES[level % 2 == 0])) if level else most + 1
        mine = own // width
        for other in range(most // width - mine + 1):
            rest = most - (mine + other) * width
            low, high = sorted((mine, other))
            out.append(((level * 64 + band) * 4096 + low * 64 + high, rest, rest // 2 + 1 if level and level % 2 == 0 else rest + 1))
    return out


def keys_of(grams: np.ndarray, bands: Bands, level: int, n: int | None = None, own: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Index keys of a set, the segment of each, and its excess: segments without a key of use beyond the spare ones, in the worst group.

    grams are a set's elements but its own; n is the size of the whole set. Level 0 and odd levels index the contents
    of many segments, even levels contents and one-deletion neighbourhoods of fewer segments.
    A partner shares 1 - excess segments with the set, or more, in one group.
    """
    keys, places, excess = [], [], []
    deletions = level > 0 and level % 2 == 0
    for group, (tag, _, least) in enumerate(_plans(len(grams) if n is None else n, own, bands, level)):
        m = least + bands.spare(least)
        salt = np.uint64((tag + 7) * 0x632BE59BD9B4E019 % 2**64)
        mixed = mix(grams ^ salt)
        segment = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, content = segment[order], mix(mixed[order] + _M1)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
        total, there = (np.add.reduceat(content, starts), segment[starts]) if len(segment) else (content, segment)
        mark = salt + there.astype(np.uint64) * _M1
        keys.append(mix(total ^ mix(mark)))
        places.append(there + (group << 20))
        if not deletions:
            excess.append(least - len(there))
        else:
            sizes = np.diff(np.r_[starts, len(segment)])
            excess.append(least - int((sizes > 1).sum()))
            each = np.repeat(np.arange(len(starts)), sizes)
            large = sizes[each] > 1
            keys.append(mix((total[each] - content) ^ mix(mark[each]))[large])
            places.append((there[each] + (group << 20))[large])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), -BIAS
    return np.concatenate(keys).astype(np.int64), np.concatenate(places), max(excess)


def _packed(n: int, excess: int) -> int:
    """A set's size (or own elements) and excess as a negative number."""
    return -1 - (n << 20 | min(max(excess + BIAS, 0), 2 * BIAS - 1))


def _unpacked() -> tuple[Column, Column]:
    """Size and excess from the column info."""
    return F.shiftright(-1 - F.col("info"), 20), F.expr(f"(-1 - info) % {2 * BIAS} - {BIAS}")


def _index_texts(n: int, percent: int, id_type: pa.DataType):
    """(id, text) to rows key, set, info, id, name: one for the document (info < 0), and for a set that is new to the task one for each key (info: the segment)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, sent = Bands(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                keys, sets, infos, names, take = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    grams = shingles(text, n)
                    name = set_name(grams)
                    if name in sent:
                        k = places = np.zeros(0, np.int64)
                        excess = -BIAS  # the set's first row in this task has its excess
                    else:
                        k, places, excess = keys_of(grams, bands, 0)
                        sent.add(name)
                    told = handle(name)
                    keys += [np.array([(told ^ (at + i) * 0x5851F42D4C957F2D) % 2**63], np.int64), k]
                    sets.append(np.full(len(k) + 1, told))
                    infos += [[_packed(len(grams), excess)], places]
                    names.append(name)
                    take += [np.array([i]), np.full(len(k), -1)]
                if len(sent) > SENT:
                    sent.clear()
                take = np.concatenate(take)
                take = pa.array(take, mask=take < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(sets).astype(np.int64)), pa.array(np.concatenate(infos).astype(np.int64)), part.column(0).take(take).cast(id_type), pa.array(names, pa.binary()).take(take)], names=["key", "set", "info", "id", "name"])

    return run


def _index_sets(percent: int, level: int):
    """(set, n, grams, mine: its own elements) to rows key, set (handle), info, name as above, and the sketch of the rest; size stands for the number of own elements."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for name, n, data, mine in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = np.array(mine or [], np.int64).astype(np.uint64)
                rest = np.setdiff1d(np.frombuffer(data, np.uint64), own, assume_unique=True)
                k, places, excess = keys_of(rest, bands, level, n, len(own))
                told = handle(name)
                bits = [pa.array([None] * len(k) + [int(x)], pa.int64()) for x in sketch(rest)]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[k, told]), pa.array(np.full(len(k) + 1, told)), pa.array(np.r_[places, _packed(len(own), excess)].astype(np.int64)), pa.array([None] * len(k) + [name], pa.binary()), *bits], names=["key", "set", "info", "name", *SKETCH])

    return run


def _stars(extra: list[str]):
    """From rows sorted by key and set: each row of a document or set, and (key, info, hub, set) for each set under a key but its hub."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = hub = last_set = None
        for batch in batches:
            key, name, info = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            mine = np.flatnonzero(info >= 0)
            k, s = key[mine], name[mine]
            hubs = np.zeros(0, np.int64)
            if len(k):
                new = np.r_[k[0] != last_key, k[1:] != k[:-1]]
                again = np.r_[k[0] == last_key and s[0] == last_set, (k[1:] == k[:-1]) & (s[1:] == s[:-1])]
                first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
                hubs = np.where(first >= 0, s[first], hub if hub is not None else 0)
                mine, hubs = mine[~new & ~again & (hubs != s)], hubs[~new & ~again & (hubs != s)]
                hub = s[first[-1]] if first[-1] >= 0 else hub
                last_key, last_set = k[-1], s[-1]
            docs = np.flatnonzero(info < 0)
            take = np.r_[docs, mine]
            if not len(take):
                continue
            hub_column = pa.array(np.r_[np.zeros(len(docs), np.int64), hubs], mask=np.r_[np.ones(len(docs), bool), np.zeros(len(mine), bool)])
            columns = [pa.array(key[take]), pa.array(info[take]), hub_column, pa.array(name[take])]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(3 + i).take(pa.array(take)) for i in range(len(extra))], names=["key", "info", "hub", "set", *extra])

    return run


def _distance(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, grams_a, grams_b) to a, b, n_a, n_b, common."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        out = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        n_a, n_b, common = (pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_a, n_b, common], names=["a", "b", "n_a", "n_b", "common"])


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Exact comparison of pairs a, b: a, b, new (elements of b that a lacks), gone (the reverse), linked; written once."""
    x = pairs.join(sets.select(F.col("set").alias("a"), F.col("grams").alias("grams_a"), F.col("n").alias("na")), "a")
    x = x.join(sets.select(F.col("set").alias("b"), F.col("grams").alias("grams_b"), F.col("n").alias("nb")), "b")
    x = x.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    x = x.select("a", "b", "grams_a", "grams_b").mapInArrow(_distance, "a binary, b binary, n_a long, n_b long, common long")
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return cut(x.select("a", "b", (F.col("n_b") - F.col("common")).alias("new"), (F.col("n_a") - F.col("common")).alias("gone"), (F.col("common") * 100 >= union * percent).alias("linked")), name)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Columns id, set (its name), n_shingles, component (the least id that links reach) for each row of docs."""
    members, named = _classes(docs, id_col, text_col, n, percent)
    # A set of one row without links names itself. Of the others, the hot ones are few and sent to all tasks, so that no key of the join is hot.
    least = named.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("sets"))
    named = named.join(least, "root").where("sets > 1 or rows > 1")
    named = cut(named.select(F.col("set").alias("told"), "component", "rows"), "jaccard-component")
    hot, out = F.col("rows") * HOT > members.count(), members
    for part in (F.broadcast(named.where(hot)), named.where(~hot)):
        part = part.select("told", F.struct("component").alias("found"))
        out = out.join(part, out["set"] == part["told"], "left")
        out = out.withColumn("known", F.coalesce("known", "found") if "known" in out.columns else F.col("found")).drop("told", "found")
    component = F.when(F.col("known").isNull(), F.col("id")).otherwise(F.col("known.component"))
    return out.select(F.col("id").alias(id_col), "set", F.col("n").alias("n_shingles"), component.alias("component"))


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Columns id, set, n (its size) for each row of docs; columns set, first (its least id), rows, root (of its class) for each set that isn't empty."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, kind = docs.schema[id_col].dataType, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    index = rows.mapInArrow(_index_texts(n, percent, to_arrow_type(id_type)), f"key long, set long, info long, id {kind}, name binary")
    index = index.repartition("key").sortWithinPartitions("key", "set")
    index = cut(index.mapInArrow(_stars(["id", "name"]), f"key long, info long, hub long, set long, id {kind}, name binary"), "jaccard-index")
    size, excess = _unpacked()
    members = cut(index.where("info < 0").select("id", F.col("name").alias("set"), F.col("set").alias("handle"), size.alias("n"), excess.alias("excess")), "jaccard-members")
    names = members.where("n > 0").groupBy("set", "handle").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"), F.max("excess").alias("excess"))
    names = cut(names, "jaccard-names")

    # The sets that may have a partner, from one row of each.
    stars = index.where("info >= 0").select("key", F.col("info").alias("place"), "hub", "set")
    keys = stars.select("key", "place", "set").unionByName(stars.select("key", "place", F.col("hub").alias("set")).distinct())
    keys = cut(keys.withColumnRenamed("set", "handle"), "jaccard-places")
    drop(index)
    shared = keys.groupBy("handle").agg(F.count_distinct("place").alias("shared"))
    needed = names.join(shared, "handle", "left").where((F.coalesce("shared", F.lit(0)) >= 1 - F.col("excess")) | (F.col("excess") > 0))
    needed = cut(needed.select("set", "handle", "first", "excess"), "jaccard-needed")
    carriers = needed.select(F.col("set").alias("told"), "first")
    # A list of a checked size is sent to the scan of the texts; a longer one is joined by a shuffle, which a run-time Bloom filter narrows.
    mine = carriers.where("first is not null")
    found = rows.join(small(mine, 40), rows["id"] == mine["first"]).select(F.col("told").alias("set"), "text")
    if not needed.where("first is null").isEmpty():
        # Rows without an id are told by their sets, or each would meet every set that has no id.
        nameless = rows.where("id is null").mapInArrow(_with_set(n, 1), f"id {kind}, text string, _set binary")
        nameless = nameless.join(carriers.where("first is null"), F.col("_set") == F.col("told"))
        found = found.unionAll(nameless.groupBy("told").agg(F.min("text").alias("text")))
    sets = cut(found.mapInArrow(_sets(n), f"set binary, n long, grams binary, {_BITS}"), "jaccard-sets")
    if sets.count() > needed.count():  # rows that share an id and a text
        repeated, sets = sets, cut(sets.dropDuplicates(["set"]), "jaccard-sets")
        drop(repeated)

    named = cut(keys.join(needed.select("handle", "set"), "handle").select("key", "place", "set"), "jaccard-keys")
    drop(keys)
    over = needed.select("set", "excess", F.lit(0).cast("long").alias("own")).join(sets.select("set", *SKETCH), "set")
    keys, links, level, before, room = named, None, 0, None, ROOM
    while True:
        new, over, waiting = _settle(keys, over, sets, percent, links, room)
        links = new if links is None else cut(links.unionByName(new), "jaccard-links")
        drop(keys)
        if not waiting:
            break
        last = level == LEVELS or level > 1 and 2 * waiting > before
        level, before = level + 1, waiting
        room = None if last else RARE_ROOM if level == 1 else ROOM
        keys, over = _by_rare_elements(sets, over, percent) if last or level == 1 else _allocate(sets, over, percent, level - 1)

    drop(sets)
    roots = components(links)
    named = names.join(roots, names["set"] == roots["node"], "left").select("set", "first", "rows", F.coalesce("root", "set").alias("root"))
    return members.select("id", "set", "n"), named


def _allocate(sets: DataFrame, crowd: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Index the sets of a crowd anew, without their own elements: (key, place, set of sets under keys that others have too; set, excess, own)."""
    owned, _ = _owned(sets, crowd)
    index = owned.join(_open(owned, percent), "set", "left_semi").select("set", "n", "grams", "mine").mapInArrow(_index_sets(percent, level), f"key long, set long, info long, name binary, {_BITS}")
    index = cut(index.repartition("key").sortWithinPartitions("key", "set").mapInArrow(_stars(["name", *SKETCH]), f"key long, info long, hub long, set long, name binary, {_BITS}"), "jaccard-index")
    count, excess = _unpacked()
    over = cut(index.where("info < 0").select(F.col("name").alias("set"), excess.alias("excess"), count.alias("own"), F.col("set").alias("handle"), *SKETCH), "jaccard-over")
    stars = index.where("info >= 0").select("key", F.col("info").alias("place"), "hub", F.col("set").alias("handle"))
    keys = stars.select("key", "place", "handle").unionByName(stars.select("key", "place", F.col("hub").alias("handle")).distinct())
    keys = cut(keys.join(over.select("handle", "set"), "handle").select("key", "place", "set"), "jaccard-keys")
    drop(index, owned)
    return keys, over.drop("handle")


def _owned(sets: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of a crowd (set, n, grams, mine: elements that no other of it has, own: their number), and (set, element, times) of each batch's elements."""
    chosen = cut(sets.select("set", "n", "grams").join(crowd.select("set"), "set", "left_semi"), "jaccard-crowd")
    counts = chosen.select("set", "grams").mapInArrow(_elements, "set binary, element long, times long")
    once = counts.groupBy("element").agg(F.sum("times").alias("sets"), F.min("set").alias("set")).where("sets = 1")
    own = once.groupBy("set").agg(F.collect_list("element").alias("mine"))
    return cut(chosen.join(own, "set", "left").withColumn("own", F.coalesce(F.size("mine"), F.lit(0)).cast("long")), "jaccard-owned"), counts


def _by_rare_elements(sets: DataFrame, crowd: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Index the sets of a crowd by their rarest elements, as _allocate does by segments: (key, place, set; set, excess, own, sketch).

    A set of n elements has percent of them in common with a partner at least. Of its elements that others of the crowd
    have, r in number and in one order for all sets, the first that both have is among the first r + 1 less those. The order is by COUNTERS
    counts of elements, of which each element has one, so rare elements come first but for those that share a counter with frequent ones.
    """
    owned, counts = _owned(sets, crowd)
    slots = counts.groupBy(F.col("element").bitwiseAND(COUNTERS - 1).alias("slot")).agg(F.sum("times").alias("times")).collect()
    often = np.zeros(COUNTERS, np.int64)
    for r in slots:
        often[r["slot"]] = r["times"]
    index = owned.join(_open(owned, percent), "set", "left_semi").select("set", "n", "grams", "mine").mapInArrow(_rare(percent, often), f"set binary, key long, own long, {_BITS}")
    index = cut(index, "jaccard-rare")
    keys = cut(index.where("key is not null").select("key", F.lit(0).cast("long").alias("place"), "set"), "jaccard-keys")
    # A set with a costly key waits.
    over = cut(index.where("key is null").select("set", F.lit(0).cast("long").alias("excess"), "own", *SKETCH), "jaccard-over")
    drop(index, owned)
    return keys, over


def _rare(percent: int, often: np.ndarray):
    """(set, n, grams, mine: its own elements) to rows set, key for each of its first elements in the order of often, and one without a key, with own and the sketch of the rest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, data, mine in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = np.array(mine or [], np.int64).astype(np.uint64)
                rest = np.setdiff1d(np.frombuffer(data, np.uint64), own, assume_unique=True)
                first = max(0, len(rest) + 1 - -(-n * percent // 100))
                k = rest[np.lexsort((rest, often[(rest & np.uint64(COUNTERS - 1)).astype(np.int64)]))][:first].astype(np.int64)
                bits = [pa.array([None] * len(k) + [int(x)], pa.int64()) for x in sketch(rest)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(k) + 1), pa.binary()), pa.array([*k.tolist(), None], pa.int64()), pa.array([None] * len(k) + [len(own)], pa.int64()), *bits], names=["set", "key", "own", *SKETCH])

    return run


def _open(owned: DataFrame, percent: int) -> DataFrame:
    """The sets of a crowd that may have a partner in it, by size and own elements.

    Sets with u and v own elements and sizes n and k differ in u + v + |(n - u) - (k - v)| elements at least, which
    doesn't fall as v rises. For each class of sizes within about a hundredth, the least v is held against all sets
    whose partners may have such sizes.
    """
    size_class = lambda n: F.floor(F.log(n) * 100).cast("long")
    classes = owned.groupBy(size_class(F.col("n")).alias("class")).agg(F.min("own").alias("v"), F.min("n").alias("least"), F.max("n").alias("most"))
    reach = F.sequence(size_class(F.col("n") * percent / 100), size_class(F.col("n") * 100 / percent))
    x = owned.select("set", "n", "own", F.explode(reach).alias("class")).join(classes, "class")
    shared = F.col("n") - F.col("own") + F.col("v")
    differ = F.col("own") + F.col("v") + F.greatest(F.lit(0), F.col("least") - shared, shared - F.col("most"))
    return x.where(differ * (100 + percent) <= (F.col("n") + F.col("most")) * (100 - percent)).select("set").distinct()


def _sets(n: int):
    """(set, text) to set, n, grams and sketch, for texts that make that set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                out = [(name, grams) for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if set_name(grams := shingles(text, n)) == name]
                bits = np.array([sketch(grams) for _, grams in out], np.int64).reshape(-1, len(SKETCH)).T
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([len(x[1]) for x in out], pa.int64()), pa.array([x[1].tobytes() for x in out], pa.binary()), *(pa.array(c, pa.int64()) for c in bits)], names=["set", "n", "grams", *SKETCH])

    return run


def _settle(keys: DataFrame, over: DataFrame, sets: DataFrame, percent: int, links: DataFrame | None, room: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Links that the keys of one level show, the sets that the next level must look at, and their number.

    over has the excess and number of own elements of each set. Keys with more possible pairs than room are costly and skipped; without a room, on the last level, none is, and no set goes on.
    """
    degree = keys.groupBy("set").agg(F.count(F.lit(1)).alias("degree"))
    hubs = keys.join(degree, "set").groupBy("key").agg(F.max_by("set", F.struct("degree", "set")).alias("hub"))
    placed = cut(keys.join(hubs, "key").select("key", "place", "hub", "set"), "jaccard-hubs")
    compared = _compare(placed.where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct(), sets, percent, "jaccard-stars")
    found = compared.where("linked").select("a", "b")
    roots = components(found if links is None else found.unionByName(links))
    root_of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    # Sets of very different sizes aren't in compared; they can be similar to others of the hub.
    stars = placed.where("set <> hub").select("hub", "set").distinct().join(compared.select(F.col("a").alias("hub"), F.col("b").alias("set"), "new", "gone"), ["hub", "set"], "left")
    stars = stars.join(root_of("set"), "set", "left").join(root_of("hub"), "hub", "left")
    stars = stars.withColumn("root", F.coalesce("set_root", "set")).withColumn("apart", F.col("root") != F.coalesce("hub_root", "hub"))
    stars = cut(stars.select("hub", "set", "new", "gone", "root", "apart"), "jaccard-apart")
    under = placed.join(stars, ["hub", "set"])
    odd = cut(under.groupBy("key").agg(F.count_if("apart").alias("odd"), F.count(F.lit(1)).alias("size")).where("odd > 0"), "jaccard-odd")
    dear = F.lit(False) if room is None else (F.col("odd") > COSTLY) & (F.col("odd") * F.col("size") > room)
    costly = odd.where(dear).select("key")
    # Segments under costly keys, and those without a key, are skipped: who has more than the spare ones of them looks again.
    hard = placed.join(costly, "key", "left_semi").select("set", "place").distinct()
    hard = hard.groupBy("set", F.shiftright("place", 20).alias("group")).agg(F.count(F.lit(1)).alias("hard")).groupBy("set").agg(F.max("hard").alias("hard"))
    pending = over.join(hard, "set", "left").where(F.col("excess") + F.coalesce("hard", F.lit(0)) > 0).select("set", "excess")
    pending = cut(pending, "jaccard-pending")
    waiting = pending.count()
    cheap = odd.where(~dear).select("key")

    # One of each pair is apart from the hub's class; the hub itself has been compared with all.
    rest = under.join(cheap, "key", "left_semi").join(over.select("set", "own", *SKETCH), "set").join(sets.select("set", "n"), "set")
    side = lambda x, end: x.select("key", "apart", *(F.col(c).alias(f"{c}_{end}") for c in ("set", "root", "new", "gone", "own", "n", *SKETCH)))
    one, two = side(rest.where("apart"), "a").drop("apart"), side(rest, "b")
    # Own elements differ. Of the other new ones, and of those gone, the numbers differ; the hub is in the crowd, so an own element is new to it.
    by_hub = F.abs(F.col("new_a") - F.col("own_a") - F.col("new_b") + F.col("own_b")) + F.abs(F.col("gone_a") - F.col("gone_b"))
    by_size = F.abs(F.col("n_a") - F.col("own_a") - F.col("n_b") + F.col("own_b"))
    by_sketch = sum(F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH)
    most = (F.col("n_a") + F.col("n_b")) * (100 - percent)
    near = (F.col("own_a") + F.col("own_b") + F.greatest(by_size, by_hub, by_sketch)) * (100 + percent) <= most
    size = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    once = ~F.col("apart") | (F.col("set_a") < F.col("set_b"))
    pairs = one.join(two, (one["key"] == two["key"]) & (F.col("root_a") != F.col("root_b")) & near & size & once)
    pairs = pairs.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).distinct()
    new = cut(found.unionByName(_compare(pairs, sets, percent, "jaccard-rest").where("linked").select("a", "b")), "jaccard-links")
    drop(placed, compared, stars)
    return new, pending, waiting


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, grams) to each element of a batch once, with the number of its sets there and one of them."""
    for batch in batches:
        grams = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if grams:
            element, first, times = np.unique(np.concatenate(grams), return_index=True, return_counts=True)
            owner = np.repeat(np.arange(len(grams)), [len(x) for x in grams])[first]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(element), pa.array(times)], names=["set", "element", "times"])


def op5_jaccard_classes(spark, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingles have a Jaccard similarity of 85 % or more, directly or through others."""
    x = jaccard_classes(read_documents(spark, sf_dir), n=4, percent=85)
    return x.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each class: one with the least id, and of that id's sets in the class the one with the least name.

    Rows are told apart by id and set, so rows of different classes never replace each other, whatever ids they share.
    Of rows with the same id and set, the one with the least text stays. Texts without words are their own classes:
    only rows with the same id, not null, and the same text become one.
    """
    members, named = _classes(docs, id_col, text_col, n, percent)
    chosen = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "set")).alias("least"))
    chosen = cut(chosen.select(F.col("least.first").alias("_first"), F.col("least.set").alias("_name")), "jaccard-chosen")
    of_id = members.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("set").alias("set"), F.max("n").alias("n"))
    of_id = cut(of_id, "jaccard-ids")

    # An id of one row tells the row; other rows are told by their sets, which are made again.
    single = of_id.where("id is not null and rows = 1").join(chosen, (F.col("id") == F.col("_first")) & (F.col("set") == F.col("_name")), "left")
    gone = single.where("_name is null and n > 0").select(F.col("id").alias("_gone"))
    gone = cut(gone.unionAll(of_id.where("rows > 1").select("id")).where("_gone is not null"), "jaccard-gone")
    # Those that go are fewer than those that stay.
    out = docs.where(F.col(id_col).isNotNull()).join(small(gone, 24), docs[id_col] == F.col("_gone"), "left_anti")
    shared = of_id.where("id is null or rows > 1")
    if shared.isEmpty():
        return out
    # Texts without words that have no id can't be told to be one document.
    nameless, words = docs.where(F.col(id_col).isNull()), F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    several = nameless.where(words).unionAll(docs.join(shared.select(F.col("id").alias("_kept")), docs[id_col] == F.col("_kept"), "left_semi"))
    several = several.mapInArrow(_with_set(n, docs.columns.index(text_col)), StructType([*docs.schema.fields, StructField("_set", BinaryType())]))
    # Copies meet in an aggregate, not in a window, so that each task reduces its own first.
    empty = F.col("_set") == F.lit(set_name(np.zeros(0, np.uint64)))
    alike = several.groupBy(F.col(id_col).alias("_id"), "_set", F.when(empty, F.struct(text_col)).alias("_text"))
    alike = cut(alike.agg(F.min_by(F.struct(*docs.columns), F.struct(text_col)).alias("_row")), "jaccard-alike")
    of_class = alike.where(~empty).join(chosen, (F.col("_set") == F.col("_name")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi")
    return out.unionAll(of_class.select("_row.*")).unionAll(alike.where(empty).select("_row.*")).unionAll(nameless.where(~words))


def _with_set(n: int, at: int):
    """Rows whose column number at is a text, to the same rows with the name of the text's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                names = pa.array([set_name(shingles(text, n)) for text in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, names], names=[*part.schema.names, "_set"])

    return run
