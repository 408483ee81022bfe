"""Corpus steps from files to sets."""

from pyspark.sql import functions as F

from quarry.operators import corpus as K


def test_source_files(spark):
    paths = ["a/x.py", "a/Test/x.py", "v/vendor/x.go", "a/x.txt", "b/app.min.js", "b/app.js", "py", "c/d.rb"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {(r.path, r.language) for r in K.source_files(files).collect()}
    assert found == {("a/x.py", "python"), ("b/app.js", "javascript"), ("c/d.rb", "ruby")}


def test_size_and_body(spark):
    files = spark.createDataFrame([("x" * 100000,), ("x" * 100001,)], "text string")
    assert K.within_size(files).count() == 1
    definitions = spark.createDataFrame([(["a"],), (["a", "b"],)], "code_tokens array<string>")
    assert K.with_body(definitions).count() == 1


def test_blacklist_looks_at_the_bare_name(spark):
    rows = [("java", "A.toString"), ("java", "A.run"), ("php", "A.toString"), ("javascript", "valueOf")]
    df = spark.createDataFrame(rows, "language string, identifier string")
    found = {tuple(r) for r in K.without_blacklisted(df).collect()}
    assert found == {("java", "A.run"), ("php", "A.toString")}


def test_first_copies_with_a_hot_copy(spark):
    text = F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string"))
    df = spark.range(3000, numPartitions=6).select("id", F.lit("r").alias("repo"), text.alias("code"))
    kept = [r.id for r in K.first_copies(df, ["repo"], "code", ["id"]).collect()]
    assert len(kept) == 2001 and [i for i in kept if i % 3 == 0] == [0]


def test_split_is_stable_and_in_proportion(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    once = {r.k: r.set for r in K.split_into_sets(df, "k", 5).collect()}
    again = {r.k: r.set for r in K.split_into_sets(df.repartition(7), "k", 5).collect()}
    assert once == again
    for name, share in {"train": 0.8, "valid": 0.1, "test": 0.1}.items():
        assert abs(sum(s == name for s in once.values()) / 20000 - share) < 0.02


def test_row_index_is_dense(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).alias("repo"), F.concat(F.lit("p"), "id").alias("path"))
    rows = K.with_row_index(df, ["repo"], ["path"], ["id"]).collect()
    for repo in (0, 1):
        mine = sorted((r.path, r.row_index) for r in rows if r.repo == repo)
        assert [i for _, i in mine] == list(range(150))


def test_sample_gate(spark):
    rows = [("a", "go")] * 3 + [("a", "php")] * 2 + [("b", "go")] * 3
    df = spark.createDataFrame(rows, "repo string, language string")
    found = {r.repo: r.update_status for r in K.sample_gate(df, ["repo"], 3).collect()}
    assert found == {"a": 2, "b": 1}


def test_code_documents(spark):
    df = spark.createDataFrame(
        [("python", "p.py", "f", " Doc one.\n\nMore ", " Doc one.", "\n def f(): pass ", ["def", "f"], 0, 3)],
        "language string, path string, identifier string, docstring string, docstring_summary string, "
        "code string, code_tokens array<string>, start_row int, end_row int",
    )
    row = K.code_documents(df).first()
    assert (row.start_line, row.end_line) == (1, 4)
    assert row.docstring_tokens == ["Doc", "one", "."]
    assert (row.docstring, row.docstring_summary, row.code) == ("Doc one.\n\nMore", "Doc one.", "def f(): pass")


def test_imports(spark):
    raw = spark.createDataFrame([("f", "c", ["t"])], "identifier string, function string, function_tokens array<string>")
    assert set(K.import_deduplicated(raw).columns) == {"identifier", "code", "code_tokens", "set"}
    raw = spark.createDataFrame([("f",)], "func_name string")
    assert K.import_set(raw, "valid").first().asDict() == {"identifier": "f", "set": "valid"}


def test_first_copies_of_two_definitions_on_one_line(spark):
    rows = [("p", 1, "A"), ("p", 5, "B"), ("p", 5, "A"), ("q", 2, "B"), ("q", 2, "B")]
    df = spark.createDataFrame([("r", *row) for row in rows], "repo string, path string, line int, code string")
    found = K.first_copies(df, ["repo"], "code", ["path", "line"]).collect()
    assert sorted((r.path, r.line, r.code) for r in found) == [("p", 1, "A"), ("p", 5, "B")]
