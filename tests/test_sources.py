"""Round trips of every source and sink."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.operators.embedding import initial_model
from quarry.sources import catalogue as K, files as S


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("f", "ü", ["a", "b"], ["c"])], S.PREPROCESSED_SCHEMA)
    for name in ("jsonl", "jsonl-gzip", "table"):
        path = str(tmp_path / f"corpus-{name}")
        S.save(df, name, path)
        back = S.load(spark, name, path, S.PREPROCESSED_SCHEMA)
        assert back.collect() == df.collect()
    assert any((tmp_path / "corpus-jsonl-gzip.jsonl.gz").glob("*.json.gz"))
    with pytest.raises(ValueError):
        S.save(df, "pickle", str(tmp_path / "x"))
    with pytest.raises(ValueError):
        S.load(spark, "jsonl", str(tmp_path / "corpus-jsonl"))
    assert S.with_extension("jsonl-gzip", "a") == "a.jsonl.gz"


def test_matrix(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("row_index"), F.array("id", "id").alias("ids"))
    S.save(df, "matrix", str(tmp_path / "m"))
    assert S.load(spark, "matrix", str(tmp_path / "m")).orderBy("row_index").collect() == df.collect()


@pytest.mark.parametrize("between", ["", "final/jsonl"])
def test_shards(spark, tmp_path, between):
    for language, n in (("go", 3), ("ruby", 1)):
        folder = tmp_path / language / between / "train"
        folder.mkdir(parents=True)
        for i in range(n):
            with gzip.open(folder / f"{language}_train_{i}.jsonl.gz", "wt") as f:
                f.write(json.dumps({"func_name": f"{language}{i}", "docstring_tokens": ["a"]}) + "\n")
    found = S.load_shards(spark, str(tmp_path), "train")
    assert {(r.language, r.set, r.func_name) for r in found.collect()} == {
        ("go", "train", "go0"), ("go", "train", "go1"), ("go", "train", "go2"), ("ruby", "train", "ruby0"),
    }


def test_evaluation_queries_are_not_parsed(spark, tmp_path):
    path = tmp_path / "queries.csv"
    path.write_text('query\nsort, list\n "quoted" \nlast\n')
    found = S.evaluation_queries(spark, str(path)).orderBy("query_id").collect()
    assert [(r.query_id, r.query) for r in found] == [(0, "sort, list"), (1, '"quoted"'), (2, "last")]


def test_repository_list(spark, tmp_path):
    path = tmp_path / "repositories.csv"
    path.write_text('organization,name,description,commit_hash,languages\no,n,"a, b",abc,go|php\n')
    K.register_repositories(S.repository_list(spark, str(path)), str(tmp_path / "cat"))
    K.register_repositories(K.one_repository(spark, "p", "m", "java,ruby", "d"), str(tmp_path / "cat"))
    repositories = spark.read.parquet(str(tmp_path / "cat" / "repository"))
    languages = spark.read.parquet(str(tmp_path / "cat" / "repository_language"))
    assert {(r.organization, r.description, r.update_status) for r in repositories.collect()} == {
        ("o", "a, b", 0), ("p", "d", 0)
    }
    assert {(r.name, r.language) for r in languages.collect()} == {
        ("n", "go"), ("n", "php"), ("m", "java"), ("m", "ruby")
    }
    done = repositories.withColumn("update_status", F.lit(C.UPDATE_FINISHED))
    listing = {r.name: r.languages for r in K.repository_listing(done, languages).collect()}
    assert listing == {"n": ["go", "php"], "m": ["java", "ruby"]}
    names = spark.createDataFrame([("o/n",)], "repository string")
    assert [r.name for r in K.named_repositories(done, names).collect()] == ["n"]
    assert K.named_repositories(done).count() == 2
    assert K.matching_repositories(done, F.lit("")).count() == 2


def test_annotations_and_predictions(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"go": {"q 1": {"u": 2, "v": 0.5}}, "php": {}}))
    found = {tuple(r) for r in S.relevance_annotations(spark, str(path)).collect()}
    assert found == {("go", "q 1", "u", 2.0), ("go", "q 1", "v", 0.5)}
    predictions = spark.createDataFrame([("q", "go", "f", "u")], "query string, language string, identifier string, url string")
    S.save_predictions(predictions, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).collect() == predictions.collect()


def test_source_tree(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "deep" / "b.rb").write_text("y = 2")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "src" / "c.txt").write_text("no")
    found = {(r.path, r.text) for r in S.source_tree(spark, str(tmp_path / "src")).collect()}
    assert found == {("a.py", "x = 1"), ("deep/b.rb", "y = 2")}
    assert [r.path for r in S.source_tree(spark, str(tmp_path / "src"), "ruby").collect()] == ["deep/b.rb"]


def test_model_and_vocabulary(spark, tmp_path):
    vocabulary = spark.createDataFrame(
        [("go", "word", "a", 2, 5)], "scope string, kind string, token string, id int, count long"
    )
    K.save_table(vocabulary, str(tmp_path / "vocabulary"))
    assert spark.read.parquet(str(tmp_path / "vocabulary")).collect() == vocabulary.collect()
    model = initial_model(vocabulary, 4, {"code": 3, "query": 2})
    K.save_model(model, str(tmp_path / "model"))
    back = K.load_model(spark, str(tmp_path / "model"))
    assert back.tokens.collect() == model.tokens.collect() and back.norms.count() == 3


def documents(spark, rows):
    return spark.createDataFrame(
        [("o", name, "go", "p.go", "f", code, i, "c0ffee", 1, 2) for i, (name, code) in enumerate(rows)],
        "organization string, name string, language string, path string, identifier string, "
        "code string, row_index long, commit_hash string, start_line int, end_line int",
    )


def test_replacing_one_repository_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "docs")
    K.replace_documents(K.stored_documents(documents(spark, [("a", "1"), ("a", "2"), ("b", "3")])), path)
    K.replace_documents(K.stored_documents(documents(spark, [("a", "4")])), path)
    stored = spark.read.parquet(path)
    assert {(r.name, r.code) for r in stored.collect()} == {("a", "4"), ("b", "3")}
    wanted = stored.filter("code = '3'").select("organization", "name", "code_hash")
    assert K.documents_by_hash(stored, wanted).first().code == "3"


def test_languages_and_query_log(spark, tmp_path):
    for _ in range(2):
        K.refresh_languages(spark, str(tmp_path / "languages"))
    assert spark.read.parquet(str(tmp_path / "languages")).count() == 6
    queries = spark.createDataFrame([("a",), ("b",)], "query string")
    for _ in range(2):
        K.log_queries(queries, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert K.queries_per_day(log).agg(F.sum("n_logs")).first()[0] == 4


def test_cache_computes_only_misses(spark, tmp_path):
    path, schema, seen = str(tmp_path / "cache"), "cache_key string, value int", []
    K.clear_cache(spark, path, schema)

    def compute(misses):
        seen.append(sorted(r.cache_key for r in misses.collect()))
        return misses.select("cache_key", F.length("cache_key").alias("value"))

    ask = lambda *keys: spark.createDataFrame([(k,) for k in keys], "cache_key string")
    K.with_cache(ask("a", "bb"), path, schema, compute)
    found = K.with_cache(ask("bb", "ccc"), path, schema, compute)
    assert {tuple(r) for r in found.collect()} == {("bb", 2), ("ccc", 3)}
    assert seen == [["a", "bb"], ["ccc"]]
    K.clear_cache(spark, path, schema)
    assert spark.read.schema(schema).parquet(path).count() == 0


def test_cache_keeps_empty_results(spark, tmp_path):
    path, schema, seen = str(tmp_path / "cache"), "cache_key string, value int", []
    K.clear_cache(spark, path, schema)

    def compute(misses):
        seen.append(misses.count())
        return misses.select("cache_key", F.lit(1).alias("value")).limit(0)

    ask = spark.createDataFrame([("none",)], "cache_key string")
    for _ in range(2):
        assert K.with_cache(ask, path, schema, compute).count() == 0
    assert seen == [1, 0]


def test_compacted_cache_answers_alike(spark, tmp_path):
    path, schema, seen = str(tmp_path / "cache"), "cache_key string, value int", []
    K.clear_cache(spark, path, schema)

    def compute(misses):
        seen.append(misses.count())
        return misses.where("cache_key <> 'none'").select("cache_key", F.length("cache_key").alias("value"))

    ask = lambda *keys: spark.createDataFrame([(k,) for k in keys], "cache_key string")
    for key in ("a", "bb", "none"):
        K.with_cache(ask(key), path, schema, compute)
    K.compact_cache(spark, path, schema)
    found = K.with_cache(ask("a", "bb", "none", "a"), path, schema, compute)
    assert {tuple(r) for r in found.collect()} == {("a", 1), ("bb", 2)} and seen == [1, 1, 1, 0]
    K.clear_cache(spark, path, schema)
    K.compact_cache(spark, path, schema)
    assert spark.read.schema(schema).parquet(path).count() == 0


def test_source_paths_are_below_the_root(spark, tmp_path):
    for name in ("src/x/src/y/f.py", "src/y/f.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("pass")
    found = [r.path for r in S.source_tree(spark, str(tmp_path / "src")).collect()]
    assert sorted(found) == ["x/src/y/f.py", "y/f.py"]
