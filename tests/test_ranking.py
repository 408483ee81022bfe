"""Numbering and top-k on data in which one group owns most rows."""

from pyspark.sql import functions as F

from quarry.operators import ranking as R


def skewed(spark, n=4000):
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50))
    return spark.range(n, numPartitions=8).select(
        "id", group.alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v")
    )


def test_row_numbers_equal_a_plain_sort(spark):
    df = skewed(spark)
    rows = R.row_numbers(df, ["g"], [F.col("v").desc(), "id"]).collect()
    expected = {}
    for row in sorted(df.collect(), key=lambda r: (r.g, -r.v, r.id)):
        expected.setdefault(row.g, []).append(row.id)
    assert len(rows) == 4000
    assert all(expected[r.g][r.row_index] == r.id for r in rows)


def test_row_numbers_without_groups(spark):
    rows = R.row_numbers(skewed(spark, 500), [], ["id"]).collect()
    assert all(r.row_index == r.id for r in rows)


def test_row_numbers_of_nothing(spark):
    assert R.row_numbers(skewed(spark).filter("id < 0"), ["g"], ["id"]).count() == 0


def test_top_k_is_exact_under_skew(spark):
    df = skewed(spark)
    found = R.top_k(df, ["g"], [F.col("v").desc(), F.col("id")], 10, ["id"]).collect()
    groups = {}
    for row in sorted(df.collect(), key=lambda r: (r.g, -r.v, r.id)):
        groups.setdefault(row.g, []).append(row.id)
    assert {(r.g, r["rank"], r.id) for r in found} == {
        (g, i + 1, id_) for g, ids in groups.items() for i, id_ in enumerate(ids[:10])
    }


def test_batches_are_full_and_repeatable(spark):
    df = skewed(spark)
    once = R.batches(df, ["g"], "id", 60, seed=3)
    again = R.batches(df.repartition(3), ["g"], "id", 60, seed=3)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    sizes = once.groupBy("g", "batch_id").count().collect()
    assert all(r["count"] == 60 for r in sizes)
    whole = {r.g: r["count"] // 60 for r in df.groupBy("g").count().collect()}
    assert sum(whole.values()) == len(sizes)


def test_proportional_batches_mix_all_groups(spark):
    df = skewed(spark)
    rows = R.proportional_batches(df, "g", "id", 400, seed=3)
    assert rows.count() == 4000
    share = rows.filter("g = 'hot'").groupBy("batch_id").count().collect()
    assert len(share) == 10 and all(abs(r["count"] - 133.4) < 2 for r in share)
