"""Fill-in-middle, conversation trie and URL filter against brute force, and on awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests import oracle
from tessera.llm import fim, prefix_trie, queries, url_filter

SF = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_rank_select_fim", "op12_prefix_trie", "op13_digest_filter"])
def test_queries_against_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF) is None


def arranged(doc, text):
    """(n, form, prefix, middle, output) by the contract, on code points."""
    text = text or ""
    h = [int(sha(f"1:{'' if doc is None else doc}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    p, m = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:p], text[p:m], text[m:]
    if h[3] % 100 < 20:
        return n, "spm", p, m - p, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", p, m - p, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    dice = random.Random(3)
    letters = "aé中\U0001f600<PSM>\n \u0301"
    texts = [None, "", "x", "\U0001f600", "<P>", "a<M>b", "<P", "S>", "中" * 700, "aé" * 400_000] + ["".join(dice.choices(letters, k=dice.randrange(60))) for _ in range(600)]
    rows = [(None if i == 5 else i // 2, t, "clash", "kept") for i, t in enumerate(texts)] * 2
    out = fim.transform(spark.createDataFrame(rows, "doc_id long, text string, n string, other string"))
    assert out.columns == ["doc_id", "text", "other", *fim.OUTPUT.names]
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((repr((d, t)), arranged(d, t)) for d, t, _, _ in rows)
    assert sorted((repr((r.doc_id, r.text)), (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)
    for r in (r for r in got if r.form != "plain"):
        data = r.text.encode()
        assert len(data[: r.prefix_bytes].decode()) == r.prefix_chars and len(data[r.prefix_bytes :][: r.middle_bytes].decode()) == r.middle_chars
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_rank_and_select():
    for seed in range(6):
        data = "".join(random.Random(seed).choices("aé中\U0001f600", k=(0, 1, 200, 511, 512, 3000)[seed])).encode()
        starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
        index = fim.Boundaries(np.frombuffer(data, np.uint8))
        assert index.before[-1] == len(starts)
        assert index.rank(np.arange(len(data) + 1)).tolist() == np.searchsorted(starts, np.arange(len(data) + 1)).tolist()
        assert index.select(np.arange(len(starts))).tolist() == starts


def trie(rows, share=True):
    """Nodes by the contract: {(conv_id, depth): (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    import math

    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * (len(node[-1][1].split()) if node else 0)
        below = [sums[c] for c in children[node]]
        sums[node] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    return {
        (min(m), len(node)): (min(members[node[:-1]]) if node else None, len(m), len(children[node]), *sums[node], sha(",".join(map(str, sorted(ends[node])))))
        for node, m in members.items()
    }


def nodes_of(x):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in x.collect()}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_trie_of_awkward_conversations(spark, tmp_path):
    dice = random.Random(7)
    rows = [(c, dice.choice([None, 0, 1, 2, 2]), dice.choice(["user", "bot", None]), dice.choice(["a b", "a", "", None, "é  x\ty"])) for c in [*range(-25, 45, 3), *range(100, 130)] for _ in range(dice.randrange(1, 6))]
    rows += [(None, 0, "user", "lost"), (7, 1, "user", "again"), (7, 1, "user", "again")] + [(200 + k, 0, "user", "same") for k in range(9)]
    rows += [(60, t, "user", f"w{t}") for t in range(1500)] + [(61, t, "user", f"w{t}") for t in range(700)]  # deep chains
    spark.createDataFrame(rows, CONVERSATIONS).withColumn("node", F.lit("clash")).withColumn("base", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path))
    assert nodes_of(got) == trie(rows)
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.QUERIES["op12_prefix_trie"](spark, f"{tmp_path}/none").count() == 0


def test_trie_of_copies_with_small_tables(spark, monkeypatch):
    """Many equal conversations, tables and ranges so small that nodes and end lists are merged many times."""
    import tessera.llm.prefix_trie as t

    rows = [(c, d, "user", f"{'hot' if c % 3 else c % 50} {d}") for c in range(900) for d in range(3 + (c % 7 == 0))]
    monkeypatch.setattr(t, "HOT", 3)
    got = nodes_of(t.prefix_trie(t.ordered_turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(5))))
    assert got == trie(rows, share=False)
    batches = list(t._partial_tries(iter(t._share_heads(iter([])))))
    assert sum(b.num_rows for b in batches) == 0
    import pyarrow as pa

    def batch(part):
        return pa.RecordBatch.from_pydict({"conv_id": [r[0] for r in part], "place": [r[1] for r in part], "role": [r[2] for r in part], "text": [r[3] for r in part]})

    ordered = [(c, p, "user", f"{c % 2} {p}") for c in range(40) for p in range(3)]
    once = [r for b in t._partial_tries(iter([batch(ordered)])) for r in b.to_pylist()]
    monkeypatch.setattr(t, "NODES", 3)
    often = [r for b in t._partial_tries(iter([batch(ordered[at : at + 7]) for at in range(0, len(ordered), 7)])) for r in b.to_pylist()]
    assert len(often) > len(once)
    assert sum(r["members"] or 0 for r in often) == sum(r["members"] or 0 for r in once) == len(ordered)
    assert sorted(x for r in often for x in r["ends"] or []) == list(range(40))


def test_ranges_of_end_lists(spark, monkeypatch):
    import tessera.llm.prefix_trie as t

    monkeypatch.setattr(t, "RANGE_BITS", 3)
    rows = [(c, 0, "user", "same") for c in range(-40, 200)]
    out = nodes_of(t.prefix_trie(t.ordered_turns(spark.createDataFrame(rows, CONVERSATIONS))))
    assert out == trie(rows, share=False) and out[(-40, 1)][1] == 240


def verdict(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        end = min((rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0), default=len(rest))
        path = rest[cut:end]

    def longest(entries):
        fit = [(len(e), e, v) for e, v in entries if host and (host == (h := e.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(e[len(h) :])]
        return max(fit)[1:] if fit else (None, None)

    rule, says = longest(rules)
    return host, path, rule, says or longest(listed)[1] or "allow"


def test_urls_against_plain_search(spark, monkeypatch):
    dice = random.Random(5)
    labels = ["org", "com", "example", "a-b", "spam-x", "é", "W"]
    urls = [None, "", "http:/x", "://", "://org", "a://ORG/", "x://org?/", "http://example.org:80/es/", "http://com/fr/?q=://com/de/", "http://org\n/x", "http://.org/", "http://org./"]
    urls += [f"http{'s' * dice.randrange(2)}://{'.'.join(dice.choices(labels, k=dice.randrange(1, 5)))}{''.join(dice.choices(['/', 'es/', 'en/1', 'é', '?', '#', 'fr/'], k=dice.randrange(5)))}" for _ in range(500)]
    urls += ["http://" + "a." * 3000 + "org/" + "x" * 10_000]
    listed = [("spam-x.com/", "block"), ("spam-x.com/fr/é", "allow"), ("é.example/é", "block"), ("a-b", "block"), (None, "block")]
    monkeypatch.setattr(url_filter, "SHARD", 2)
    rules_at = url_filter.build(spark.createDataFrame(url_filter.RULES + [("org/", "block")], "entry string, verdict string"), "rules")
    listed_at = url_filter.build(spark.createDataFrame(listed, "entry string, verdict string"), "listed")
    assert rules_at.shards == 4 and rules_at.lengths == (1, 4, 5)
    pages = spark.createDataFrame([(i, u, "clash", "kept") for i, u in enumerate(urls)], "page_id long, url string, host string, other string")
    out = url_filter.judge(pages, rules_at, listed_at)
    assert out.columns == ["page_id", "url", "other", "host", "path", "rule", "listed", "verdict"]
    for r in out.collect():
        assert (r.host, r.path, r.rule, r.verdict) == verdict(r.url, url_filter.RULES, listed[:-1]), r.url


def test_equal_digests_of_different_strings(tmp_path):
    """Strings that share a digest are told apart by what is stored."""
    import pyarrow as pa

    folder = f"file://{tmp_path}"
    rows = pa.RecordBatch.from_pydict({"shard": [0, 0, 0], "digest": [5, 5, 9], "entry": ["x/", "y/", "z/"], "verdict": ["block", "allow", "block"]})
    assert [b.to_pylist() for b in url_filter._write_shards(folder)(iter([rows]))] == [[{"shard": 0, "entries": 3}]]
    found = url_filter.Searcher(url_filter.DigestArray(folder, 1, (1,))).find(np.array([9, 5, 5, 5, 7]), [b"z/", b"y/", b"x/", b"other/", b"z/"])
    assert found == [b"bz/", b"ay/", b"bx/", None, None]


def test_digest_is_that_of_spark(spark):
    texts = ["", "a", "example.org/es/", "é" * 50]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] for r in got] == [url_filter.digest(t.encode()) for t in texts] and xxhash.xxh64_intdigest(b"a", 42) % 2**64 == got[1][0] % 2**64


def test_filter_of_nothing(spark, tmp_path):
    none = url_filter.build(spark.createDataFrame([], "entry string, verdict string"))
    pages = spark.createDataFrame([(1, "http://x.org/")] * 2, "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, none, none).collect()] == ["allow", "allow"]
