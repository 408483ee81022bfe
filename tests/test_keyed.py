"""Tables looked up by a hash."""

import pytest
from pyspark.sql import functions as F

from quarry import session
from quarry.sources import catalogue as K, keyed

SCHEMA = "key string, value long"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """3,000 keys, one of which owns a third of the rows, and rows without one."""
    place = str(tmp_path_factory.mktemp("keyed") / "table")
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.col("id").cast("string"))
    keyed.save_keyed(spark.range(6000).select(key.alias("key"), F.col("id").alias("value")), "key", place, ["value"])
    return place


def lookup(spark, path, keys):
    wanted = spark.createDataFrame([(k,) for k in keys], "key string")
    read = keyed.read_keyed(spark, path, SCHEMA, "key", wanted)
    return read, read.join(wanted, "key", "left_semi")


def scan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters"):]


def test_one_key_reads_one_folder(spark, path):
    read, found = lookup(spark, path, ["7"])
    assert [r.value for r in found.collect()] == [7]
    assert len({f for f in (r.f for r in read.select(F.input_file_name().alias("f")).collect())}) <= 1
    plan = scan(read)
    assert plan.count("key_prefix") >= 1 and "PushedFilters: [" in plan and "EqualTo(key,7)" in plan or "In(key" in plan


def test_hot_missing_and_null_keys(spark, path):
    _, found = lookup(spark, path, ["hot", "no such key", None])
    assert found.count() == 2000
    assert lookup(spark, path, [None])[1].count() == 0
    assert lookup(spark, path, [])[1].count() == 0


def test_many_keys_are_all_found(spark, path):
    keys = [str(i) for i in range(6000) if i % 3 and i % 1000 != 1]
    _, found = lookup(spark, path, keys)
    assert sorted(r.value for r in found.collect()) == [int(k) for k in keys]


def test_ten_and_eleven_keys_alike(spark, path):
    for n in (keyed.POINTS, keyed.POINTS + 1):
        keys = [str(i) for i in range(1, 3 * n) if i % 3 and i % 1000 != 1][:n]
        assert lookup(spark, path, keys)[1].count() == n


def test_empty_table_and_append(spark, tmp_path):
    place = str(tmp_path / "t")
    keyed.save_keyed(spark.createDataFrame([], SCHEMA), "key", place)
    assert lookup(spark, place, ["a"])[1].count() == 0
    for _ in range(2):
        keyed.save_keyed(spark.createDataFrame([("a", 1)], SCHEMA), "key", place, mode="append")
    assert lookup(spark, place, ["a"])[1].count() == 2


def test_hash_index_by_repository_or_in_all(spark, tmp_path):
    rows = [("o", name, f"{i % 5:040x}", "go", i) for i, name in enumerate(["a", "b"] * 20)]
    docs = spark.createDataFrame(rows, K.HASH_INDEX)
    place = str(tmp_path / "index")
    K.save_hash_index(docs, place)
    wanted = docs.where("row_index = 3").select("code_hash")
    assert {r.row_index for r in K.places_by_hash(spark, place, wanted).collect()} == {i for i in range(40) if i % 5 == 3}
    own = docs.where("row_index = 3").select("organization", "name", "code_hash")
    found = K.places_by_hash(spark, place, own.unionByName(own)).collect()
    assert sorted(r.row_index for r in found) == [i for i in range(40) if i % 5 == 3 and i % 2]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return "file:/warehouse" if "warehouse" in name else default

    class Cluster:
        conf, _jvm, _jsc = Conf(), spark._jvm, spark._jsc
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Cluster())
