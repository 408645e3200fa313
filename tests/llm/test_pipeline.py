"""The pipeline against brute force on a small table, and on awkward and empty ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test-stage")
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and len(after) == docs.count()
        rows = [(d, r.text) for d, r in before.items()]
        if name == "language_id":
            assert set(after) == {d for d, t in rows if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            assert set(after) == {c for _, c in brute.classes(rows).values()}
        elif name == "decontamination":
            assert set(after) == {d for d, x in brute.contamination(rows, items).items() if not x[4]}
        else:
            assert set(after) == set(before)
            for d, r in after.items():
                assert (r.text == before[d].text) == (brute.secrets(before[d].text)[:3] == (0, 0, 0))
                assert brute.secrets(r.text)[:3] == (0, 0, 0) and r.n_chars == len(r.text)
    mixed = {r.doc_id: r.copies for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()}
    sizes = {r.doc_id: (r.source, len(brute.space_words(r.text))) for r in docs.collect()}
    total = {}
    for source, n in sizes.values():
        total[source] = total.get(source, 0) + n
    target = brute.targets(total)
    assert set(mixed) <= set(sizes) and all(1 <= c <= 3 for c in mixed.values())
    taken = {s: sum(sizes[d][1] * c for d, c in mixed.items() if sizes[d][0] == s) for s in total}
    assert sum(abs(taken[s] - target[s][1]) for s in total) < 0.06 * sum(total.values())


def test_near_duplicates_of_five_words_and_80_percent(spark):
    """Copies with an appended passage of a fifth of their length go; with one of a third of it, they stay."""
    words = lambda name, k: [f"{name}{i}" for i in range(k)]
    texts = [words("a", 104), words("a", 104) + words("x", 22), words("b", 104), words("b", 104) + words("y", 35), words("c", 104)[:84], words("c", 104)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = {c for _, c in brute.classes(rows, 5, 80).values()}
    assert want == {0, 2, 3, 4} and want != {c for _, c in brute.classes(rows).values()}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("repeat", [0, 2])
def test_stages_on_awkward_and_empty_tables(spark, tmp_path, repeat):
    """Nulls in any column, repeated rows, shared ids, a long text and a clashing column; and no rows at all."""
    passage = " ".join(f"bench{i}" for i in range(20))
    other = lambda name: " ".join(f"{name}{i} le" for i in range(30))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", "a", 5), (4, other("un"), "fr", None, 9), (4, other("un"), "fr", None, 9), (4, other("deux"), "fr", "b", 9),
        (None, other("trois"), None, "b", 9), (None, other("quatre"), "fr", "b", None), (5, passage, "fr", "b", 9), (6, "password=abcdefgh1 " + other("cinq"), "fr", "c", 9), (7, other("six") + " mot" * 50_000, "fr", "c", 9),
    ]
    docs = spark.createDataFrame(rows * repeat, "doc_id long, text string, lang string, source string, n_chars long").withColumn("unit", F.lit("clash"))
    spark.createDataFrame([(1, passage), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), "test-stage")
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        if not repeat:
            assert kept == []
        elif name == "language_id":
            assert sorted(t for _, t in kept) == sorted(t for _, t, *_ in rows * repeat if t and any(c.isalpha() for c in t))
        elif name == "near_duplicates":
            assert sorted((str(d), t) for d, t in kept) == sorted({(str(d), t) for d, t, *_ in rows if t and any(c.isalpha() for c in t)})
        elif name == "decontamination":
            assert len(kept) == 6 and all(t != passage for _, t in kept)
        elif name == "secrets":
            assert [t for d, t in kept if d == 6] == ["[SECRET] " + other("cinq")] and len(kept) == 6
        assert [c for c in docs.columns if c != "copies"] == [c for c in columns if c != "unit" or name != "mixing"]


def test_two_runs_side_by_side(spark, tmp_path):
    """Runs in two threads over two folders, and stages of two runs by turns, don't delete each other's tables."""
    import shutil
    import threading

    for name in ("one", "two"):
        shutil.copytree(SF, tmp_path / name)
    run = lambda folder: sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, str(folder)).collect())
    alone, got = run(SF), {}
    threads = [threading.Thread(target=lambda n=n: got.update({n: run(tmp_path / n)})) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == {"one": alone, "two": alone}
    by_turns = {n: spark.read.parquet(f"{tmp_path}/{n}/documents.parquet") for n in ("one", "two")}
    for _, stage in corpus_pipeline.STAGES[:2]:
        frames = {n: stage(spark, docs, f"{tmp_path}/{n}") for n, docs in by_turns.items()}
        by_turns = {n: corpus_pipeline.cut(df, "test-turn") for n, df in frames.items()}
    assert by_turns["one"].count() == by_turns["two"].count() > 0
