import pytest
from pyspark.sql import functions as F

from rankwell.operators import rows


def test_dense_id_follows_the_order(spark, workspace):
    df = spark.range(0, 500).select((F.col("id") * 37 % 500).alias("key")).repartition(7)
    got = rows.dense_id(df, ["key"], workspace, "placed").collect()
    assert {r.key: r.id for r in got} == {i: i for i in range(500)}


def test_dense_id_with_a_hot_key(spark, workspace):
    """A third of the rows share the first key column; the second settles the order."""
    df = spark.range(0, 300).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), "id"
    ).withColumnRenamed("id", "b")
    got = rows.dense_id(df, ["a", "b"], workspace, "placed").orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)
    assert [r.id for r in got] == list(range(300))


def test_dedup_keeps_the_first_row(spark):
    df = spark.createDataFrame(
        [(0, "x", "a"), (1, "y", "b"), (2, "x", "c"), (3, "y", "d"), (4, "z", "e")],
        "id long, question string, other string",
    ).repartition(5)
    got = rows.dedup_first(df, "question", "id").collect()
    assert {(r.id, r.other) for r in got} == {(0, "a"), (1, "b"), (4, "e")}


@pytest.fixture
def clustered(spark):
    """20 rows; cluster 9 occurs only in the last tenth."""
    return spark.range(20).select(
        F.col("id").alias("pos"), F.when(F.col("id") >= 18, 9).otherwise(F.col("id") % 3).alias("cluster")
    )


def test_split_is_positional_and_then_covered(clustered):
    split = rows.split_positional(clustered, "pos")
    assert {r.pos for r in split.where("split = 'test'").collect()} == {18, 19}
    assert [r.cluster for r in rows.missing_clusters(split, "pos").collect()] == [9]
    covered = rows.cover_clusters(split, "pos")
    assert {r.pos for r in covered.where("split = 'test'").collect()} == {19}
    assert rows.missing_clusters(covered, "pos").count() == 0


def test_hashed_split_does_not_depend_on_layout(spark):
    df = spark.range(1000)
    one, two = (rows.split_hashed(x, "id") for x in (df.repartition(1), df.repartition(9)))
    assert sorted(one.collect()) == sorted(two.collect())
    assert 60 < one.where("split = 'test'").count() < 140
