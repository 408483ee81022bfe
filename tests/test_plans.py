"""End-to-end jobs on a small source tree."""

import pytest
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions import text as T
from quarry.operators.neighbours import nearest
from quarry.plans import prepare as P, search as Q
from quarry.session import WRITTEN, materialise_by
from quarry.sources import publication as B
from quarry.sources.catalogue import clear_cache


def line_functions(files):
    """A toy extractor: every ``def name`` line is a definition."""
    lines = files.select("*", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    name = F.regexp_extract("line", r"def (\w+)", 1)
    return lines.filter(name != "").select(
        "organization", "name", "commit_hash", "language", "path",
        name.alias("identifier"),
        F.regexp_extract("line", "# (.*)$", 1).alias("docstring"),
        F.regexp_extract("line", "# (.*)$", 1).alias("docstring_summary"),
        F.col("line").alias("code"),
        T.code_tokens(F.col("language"), F.col("line")).alias("code_tokens"),
        F.col("row").alias("start_row"),
        F.col("row").alias("end_row"),
    )


def line(i):
    verb, noun = ["read", "write", "sort", "merge"][i % 4], ["file", "list", "graph"][i % 3]
    return f"def {verb}_{noun}_{i}(a): return {verb}(a, {i})  # {verb} the {noun} number {i}"


def repository_files(spark, repos, commit="c0ffee"):
    """``repos`` maps a name to the numbers of its functions."""
    rows = []
    for name, numbers in repos.items():
        text = "\n".join(line(i) for i in numbers) + "\n" + line(numbers[0])
        rows += [("org", name, commit, "pkg/code.py", text), ("org", name, commit, "pkg/code_test.py", line(999))]
    return spark.createDataFrame(rows, "organization string, name string, commit_hash string, path string, text string")


OPTIONS = {"minimum": 50, "size": 120, "width": 8, "n_trees": 4}


@pytest.fixture(scope="module")
def refreshed(spark, tmp_path_factory):
    files = repository_files(spark, {"big": range(120), "other": range(90), "tiny": range(3)})
    base = spark.createDataFrame(
        [(s, k, t, i, 1) for s in ("python", "query") for k, t, i in
         [("word", C.PAD, 0), ("word", C.UNK, 1), ("word", "the", 2), ("bpe", C.SOW, 3), ("bpe", C.EOW, 4)]],
        "scope string, kind string, token string, id int, count long",
    )
    from quarry.operators.embedding import initial_model

    target = str(tmp_path_factory.mktemp("target"))
    status = P.update_repositories(
        files, line_functions, target, base, initial_model(base, 8), max_epochs=1, evaluation_batch=5,
        batch_size=64, **OPTIONS,
    )
    return status, B.Snapshot.current(spark, target)


def counts(snapshot, table="code_document"):
    return {r.name: r["count"] for r in snapshot.table(table).groupBy("name").count().collect()}


def test_gate_and_published_documents(spark, refreshed):
    status, snapshot = refreshed
    found = {r.name: r.update_status for r in status.collect()}
    assert found == {"big": C.UPDATE_FINISHED, "other": C.UPDATE_FINISHED, "tiny": C.UPDATE_ERROR}
    assert found == {r.name: r.update_status for r in snapshot.manifest.collect()}
    assert {r.name: r.commit_hash for r in snapshot.manifest.collect()} == {"big": "c0ffee", "other": "c0ffee", "tiny": None}
    stored = snapshot.table("code_document")
    assert counts(snapshot) == {"big": 120, "other": 90}  # the repeated function and the test file are left out
    assert stored.filter("name = 'big'").select("row_index").distinct().count() == 120
    assert stored.filter("identifier = 'read_file_0'").first().url.endswith("pkg/code.py#L1-L1")


def test_each_repository_has_its_own_vocabulary(spark, refreshed):
    _, snapshot = refreshed
    vocabulary = snapshot.table("vocabulary")
    scopes = {r.scope for r in vocabulary.select("scope").distinct().collect()}
    assert scopes == {f"org/{n}/{s}" for n in ("big", "other") for s in ("python", "query")}
    ids = vocabulary.groupBy("scope").agg(F.max("id").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n - 1 for r in ids)
    assert {r.id for r in vocabulary.filter("token = 'the'").collect()} == {2}


def test_search_what_is_published(spark, refreshed, tmp_path):
    """At full breadth the index gives what exact search over its vectors gives,
    each repository by its own model."""
    _, snapshot = refreshed
    queries = spark.createDataFrame(
        [(1, "org", "big", "sort the list"), (2, "org", "other", "read file"), (3, "org", "gone", "read file"),
         (4, "org", "big", " "), (5, "org", "big", "write +language=Python"), (6, "org", "big", "write +language=go")],
        "query_id long, organization string, name string, query string",
    )
    log = str(tmp_path / "log")
    found = Q.published_text_search(snapshot, queries, 7, search_k=10_000, log=log)
    index, model = P.published_index(snapshot), P.published_model(snapshot)
    vocabulary = snapshot.table("vocabulary").drop("organization", "name")
    good = queries.where("query_id in (1, 2, 5)").withColumn("scope", F.concat_ws("/", "organization", "name", F.lit("query")))
    vectors = Q.embed_queries(good, vocabulary, model).join(
        good.select("query_id", F.array(F.regexp_replace("scope", "query$", "python")).alias("languages")), "query_id"
    )
    exact = nearest(index.vectors, vectors, 7)
    pick = lambda df: sorted((r.query_id, r.rank, r.row_index) for r in df.collect())
    assert pick(found) == pick(exact) and len(pick(found)) == 21
    assert {r.query for r in spark.read.parquet(log).collect()} == {r.query for r in queries.collect()} - {" "}
    problems = {r.query_id: r.problem for r in Q.checked_queries(queries, Q.published_languages(snapshot), ["organization", "name"]).collect()}
    assert problems == {1: None, 2: None, 3: "unknown repository", 4: "invalid or missing", 5: None, 6: "no valid language in the filter"}
    snippets = queries.where("query_id < 4").select("query_id", "organization", "name", F.lit("python").alias("language"), F.col("query").alias("code"))
    assert {r.query_id for r in Q.published_code_search(snapshot, snippets, 3).collect()} == {1, 2}


def test_similar_stays_in_its_repository(spark, refreshed):
    _, snapshot = refreshed
    stored = snapshot.table("code_document").where("identifier = 'read_file_0'")
    assert stored.count() == 2  # the same function in both
    requests = stored.where("name = 'other'").select(F.lit(1).alias("query_id"), "organization", "name", "code_hash")
    found = Q.published_similar(snapshot, requests, 5, search_k=10_000).collect()
    assert len(found) == 5
    urls = {r.url for r in snapshot.table("code_document").where("name = 'other'").collect()}
    assert {r.url for r in found} <= urls and not {r.url for r in found} & {r.url for r in stored.collect()}


def test_searches_through_a_cache(spark, refreshed, tmp_path):
    _, snapshot = refreshed
    cache = str(tmp_path / "cache")
    clear_cache(spark, cache, Q.ANSWERS)
    queries = spark.createDataFrame(
        [(1, "org", "big", "sort the list"), (2, "org", "big", "sort the list"), (3, "org", "other", "sort the list"),
         (4, "org", "gone", "read file"), (5, "org", "big", "write it")],
        "query_id long, organization string, name string, query string",
    )
    plain = Q.published_text_search(snapshot, queries, 6, search_k=10_000)
    pick = lambda df: sorted((str(r.query_id), r.rank, r.row_index, r.url, round(r.distance, 9)) for r in df.collect())
    first = Q.cached_text_search(snapshot, queries.where("query_id < 4"), cache, 6, search_k=10_000)
    assert pick(first) == [r for r in pick(plain) if r[0] < "4"] and len(pick(first)) == 18
    again = Q.cached_text_search(snapshot, queries, cache, 6, search_k=10_000)
    assert pick(again) == pick(plain)
    held = spark.read.schema(Q.ANSWERS).parquet(cache)
    # Two requests were equal; the unknown repository is kept without results.
    assert held.select("cache_key").distinct().count() == 4 and held.count() == 19
    stored = snapshot.table("code_document").where("name = 'other'").limit(3)
    requests = stored.select(F.monotonically_increasing_id().alias("query_id"), "organization", "name", "code_hash")
    requests = spark.createDataFrame(requests.collect(), requests.schema)
    same = pick(Q.published_similar(snapshot, requests, 4, search_k=10_000))
    for _ in range(2):
        assert pick(Q.cached_similar(snapshot, requests, cache, 4, search_k=10_000)) == same and len(same) == 12


def test_refreshing_one_keeps_the_others(spark, tmp_path):
    target = str(tmp_path)
    refresh = lambda repos, **args: P.update_repositories(
        repository_files(spark, repos, args.pop("commit", "c")), line_functions, target, max_epochs=0, **OPTIONS, **args
    )
    refresh({"a": range(60), "b": range(70)}, commit="c1")
    held = B.Snapshot.current(spark, target)
    refresh({"b": range(80), "c": range(50)}, commit="c2")
    after = B.Snapshot.current(spark, target)
    for table in ("code_document", "index_vectors"):
        assert counts(after, table) == {"a": 60, "b": 80, "c": 50}
        assert counts(held, table) == {"a": 60, "b": 70}
    # A repository that fails keeps what it had, and is left out from then on.
    refresh({"b": range(5)}, commit="c3")
    refresh({"b": range(90)}, commit="c4")
    now = B.Snapshot.current(spark, target)
    assert counts(now) == {"a": 60, "b": 80, "c": 50}
    rows = {r.name: (r.update_status, r.commit_hash) for r in now.manifest.collect()}
    assert rows == {"a": (1, "c1"), "b": (2, "c2"), "c": (1, "c2")}
    refresh({"b": range(90)}, commit="c5", retry=True)
    assert counts(B.Snapshot.current(spark, target))["b"] == 90

    def broken(files):
        raise RuntimeError("no extractor")

    with pytest.raises(RuntimeError):
        P.update_repositories(repository_files(spark, {"a": range(60)}), broken, target, **OPTIONS)
    last = B.Snapshot.current(spark, target)
    assert {r.name: r.update_status for r in last.manifest.collect()} == {"a": 2, "b": 1, "c": 1}
    assert counts(last) == {"a": 60, "b": 90, "c": 50}
    gone = B.vacuum(spark, target, keep=1)
    assert gone and counts(B.Snapshot.current(spark, target)) == {"a": 60, "b": 90, "c": 50}
    assert len(B.versions(spark, target)) == 1


def test_commits_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    """Another refresh commits between reading the last version and committing."""
    target = str(tmp_path)
    schema = "organization string, name string, update_status int, commit_hash string"
    row = lambda name: spark.createDataFrame([("org", name, 1, "c")], schema)
    table = lambda name: {"t": spark.createDataFrame([("org", name, 1)], "organization string, name string, x int")}
    put, others = B._put, ["b", "c"]

    def late(spark, name, text):
        if others:
            B.publish(spark, target, table(others[-1]), row(others.pop()))
        put(spark, name, text)

    monkeypatch.setattr(B, "_put", late)
    B.publish(spark, target, table("a"), row("a"))
    assert counts(B.Snapshot.current(spark, target), "t") == {"a": 1, "b": 1, "c": 1}
    assert B.versions(spark, target) == [1, 2, 3]
    with pytest.raises(B.Conflict):
        put(spark, f"{target}/_commits/{3:010d}", "again")


def test_two_definitions_on_a_line_have_two_keys(spark, tmp_path):
    files = repository_files(spark, {"a": range(60)}).where("path = 'pkg/code.py'")
    twice = lambda f: line_functions(f).union(line_functions(f).withColumn("code", F.concat("code", F.lit(" # two"))))
    P.update_repositories(files, twice, str(tmp_path), max_epochs=0, **OPTIONS)
    snapshot = B.Snapshot.current(spark, str(tmp_path))
    assert counts(snapshot) == {"a": 120} == counts(snapshot, "index_vectors")
    assert snapshot.table("code_document").select("row_index").distinct().count() == 120


def test_preparation_steps(spark):
    documents = spark.createDataFrame(
        [(i, "train", "go", f"name{i}", ["get", "it"], ["x", ":=", str(i)]) for i in range(20)]
        + [(99, "all", "go", "n", [], ["x"])],
        "row_id long, set string, language string, identifier string, docstring_tokens array<string>, "
        "code_tokens array<string>",
    )
    done = P.prepare(documents, "row_id", size=40)
    assert set(done) == {"corpora", "vocabularies", "sequences"}
    rows = {r.row_id: r for r in done["sequences"].collect()}
    assert len(rows) == 21 and len(rows[0].code_ids) == 200 and len(rows[0].query_ids) == 30
    assert rows[99].query_ids is None
    only = P.prepare(documents, "row_id", steps=("corpora",))
    assert set(only) == {"corpora"}


def test_similar_documents_and_requests(spark):
    documents = spark.createDataFrame(
        [("go", i, f"u{i}", f"h{min(i, 3)}", f"a/b{i}.go") for i in range(6)],
        "language string, row_index long, url string, code_hash string, path string",
    )
    items = spark.createDataFrame(
        [("go", i, [1.0, float(i)]) for i in range(6)],
        "language string, row_index long, embedding array<double>",
    )
    requests = spark.createDataFrame([(7, "h0")], "query_id long, code_hash string")
    found = Q.similar_documents(requests, items, documents, 2).collect()
    assert [(r.row_index, r.filename) for r in found] == [(1, "b1.go"), (2, "b2.go")]
    assert found[0].distance < found[1].distance and found[0].rating > found[1].rating
    problems = spark.createDataFrame([("ok",), ("  ",), ("x" * 257,), (None,)], "q string")
    found = [r[0] for r in problems.select(Q.query_problem(F.col("q"))).collect()]
    assert found == [None, "invalid or missing", "too long", "invalid or missing"]


def test_train_and_judge(spark):
    from quarry.operators.embedding import initial_model
    from quarry.plans.train import train

    token = lambda salt: 2 + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(18)).cast("int")
    ids = F.array(*[token(s) for s in range(3)])
    name = F.when(F.col("id") % 4 < 2, "train").when(F.col("id") % 4 == 2, "valid").otherwise("test")
    sequences = spark.range(160).select(
        F.col("id").alias("row_id"), F.lit("go").alias("language"), name.alias("set"),
        ids.alias("code_ids"), ids.alias("query_ids"),
    )
    vocabulary = spark.createDataFrame(
        [(s, "word", f"t{i}", i, 1) for s in ("go", "query") for i in range(20)],
        "scope string, kind string, token string, id int, count long",
    )
    model = initial_model(vocabulary, 8, {"code": 3, "query": 3})
    _, history, scores = train(
        sequences, model, evaluation_batch=20, batch_size=40, max_epochs=1, batches_per_step=1
    )
    assert history.count() == 1
    found = {r.language: (r.mrr, r.n_batches) for r in scores.collect()}
    assert set(found) == {"go", None} and found["go"] == found[None] and found[None][1] == 2




def test_a_refresh_writes_texts_once_and_numbers_first_copies(spark, tmp_path):
    """Rows that come twice, copies at other places, two definitions on a line and
    null texts; texts and whole token lists are in one written table."""
    texts = [f"def f{i % 40}(a): return {i % 40}" for i in range(60)] + [None, "x"]
    rows = [("org", "r", "c1", f"p{i}.py", text) for i, text in enumerate(texts)] * 2
    rows += [("org", "r", "c1", "q.py", texts[3]), ("org", "s", "c1", "q.py", texts[3]), ("org", None, "c1", "q.py", texts[3])]
    files = spark.createDataFrame(rows, "organization string, name string, commit_hash string, path string, text string")

    def whole(df):
        tokens = T.code_tokens(F.col("language"), F.col("text"))
        return df.select(
            "organization", "name", "commit_hash", "language", "path", F.lit("a_long_identifier").alias("identifier"),
            F.lit("").alias("docstring"), F.lit("").alias("docstring_summary"), F.col("text").alias("code"),
            tokens.alias("code_tokens"), F.lit(0).alias("start_row"), F.lit(0).alias("end_row"),
        )

    before = len(WRITTEN)
    P.update_repositories(files, whole, str(tmp_path / "t"), minimum=1, size=60, width=4, n_trees=2, max_epochs=0)
    with_text = [p for p in WRITTEN[before:] if {"code", "code_tokens"} & set(spark.read.parquet(p).columns)]
    assert len(with_text) == 1
    snapshot = B.Snapshot.current(spark, str(tmp_path / "t"))
    found = sorted((r.name, r.row_index, r.path, r.code) for r in snapshot.table("code_document").collect())
    first = {}
    for path, text in sorted((r[3], r[4]) for r in rows if r[1] == "r" and r[4] and r[4] != "x"):
        first.setdefault(text, path)
    kept = sorted((path, text) for text, path in first.items())
    assert found == [("r", i, *row) for i, row in enumerate(kept)] + [("s", 0, "q.py", texts[3])]
    assert snapshot.table("index_vectors").count() == 41


def test_joins_by_the_key_leave_wide_rows_where_they_are(spark):
    wide = materialise_by(spark.range(300).select(F.col("id").cast("string").cast("binary").alias("key"), "id"), "key")
    joined = wide.join(wide.select("key").distinct().hint("merge"), "key").dropDuplicates(["key"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0 and joined.count() == 300
