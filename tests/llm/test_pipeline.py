"""The pipeline's stages against brute force, and its edges."""

import random

import corpus_pipeline as pipeline
from tests.llm.test_texts import brute_print, brute_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int"


def corpus(spark, extra=()):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ther", "and", "ing", "sto", "lan") for b in ("a", "el", "ire", "on", "us")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notice = "all rights are reserved and this notice has to stay on every copy"
    texts = [f"{make(60)}\n{notice}\n{make(50)}" for _ in range(25)]
    texts += [texts[2], texts[2], texts[5].replace("ther", "thor", 1), "123 456 !!", "", None]
    rows = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, COLUMNS)


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages(spark, tmp_path):
    docs = corpus(spark, [(None, "no id but words here", None, None, None, None, None), (3, "a repeated id with words", "en", "s", 1, None, 2)])
    before = docs
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(spark, stage(spark, docs, "unused"), tmp_path / name)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        left, right = {r.doc_id: r for r in before.collect()}, docs.collect()
        ids = [r.doc_id for r in right]
        if name == "language_id":
            assert set(left) - set(ids) == {28, 29, 30}
        elif name == "line_dedup":
            assert sorted(ids, key=str) == sorted((r.doc_id for r in before.collect()), key=str)
            notice = [r.doc_id for r in right if "all rights" in r.text]
            assert 0 in notice and 1 not in notice
            assert {25, 26} <= set(notice)  # whole copies wait for the next stage
            assert all(r.n_chars == len(r.text) for r in right)
        elif name == "simhash_near_dedup":
            prints = {r.doc_id: brute_print(r.text) for r in before.collect() if r.doc_id is not None and r.doc_id != 3}
            lost = {i for i in prints if any(j < i and (prints[i] ^ prints[j]).bit_count() <= 2 for j in prints)}
            assert {25, 26} & lost and not lost & set(ids)
        elif name == "suffix_array_dedup":
            rows = [(r.doc_id, r.text.encode()) for r in before.collect()]
            want = sorted(x[3].decode(errors="ignore") for x in brute_spans(rows, 50))
            assert sorted(r.text for r in right) == want
    assert sum(r.length for r in docs.collect()) > 0


def test_pages_of_mostly_boilerplate(spark, tmp_path):
    """Repeated lines go from a page whatever their share of it; only copies of a
    whole document wait, and those go with the next stage."""
    rng = random.Random(8)
    own = lambda: "".join(rng.choice("abcdefghij ") for _ in range(100))
    menu = [f"menu entry {i} of the site: {'abcdefgh'[i] * 9}" for i in range(8)]
    texts = ["\n".join([*menu, own()]) for _ in range(6)]
    texts[4] = texts[4].replace("menu entry 3", "menu entri 3")
    texts += [texts[1], texts[1], texts[0]]
    rows = [(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 1, "x", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    lined = written(spark, pipeline.lines(spark, docs, "unused"), tmp_path / "lines")
    got = {r.doc_id: r.text for r in lined.collect()}
    assert got[None] == texts[3]  # a row without an id comes first
    assert [got[i] for i in range(6)] == [t.split("\n")[-1] if i != 3 else "" for i, t in enumerate(texts[:6])]
    assert [got[i] for i in (6, 7, 8)] == texts[6:]
    left = written(spark, pipeline.near_copies(spark, lined, "unused"), tmp_path / "near").collect()
    assert sorted((r.doc_id for r in left), key=str) == [0, 1, 2, 3, 4, 5, None]


def test_short_repeated_lines_go(spark):
    texts = ["Share on Facebook\n\nfirst of all words\n \nz\n}", "second one here\n\nShare on Facebook\n \nz", "Share on Facebooks\n\nfirst of all words"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(texts)], COLUMNS)
    got = {r.doc_id: r.text for r in pipeline.lines(spark, docs, "unused").collect()}
    assert got == {0: texts[0], 1: "second one here\n\n ", 2: "Share on Facebooks\n"}


def test_run_on_a_table(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < out.select("doc_id").distinct().count() <= documents
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_empty_table(spark, tmp_path):
    docs = corpus(spark).limit(0)
    for name, stage in pipeline.STAGES:
        docs = written(spark, stage(spark, docs, "unused"), tmp_path / name)
        assert docs.count() == 0
