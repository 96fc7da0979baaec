"""Tables of many copies: what is worked out once a class of records, and joins that must not broadcast exploded rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from recolink.operators import blocking
from recolink.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def records(spark, ident="id"):
    """Copies, an id with rows in two partitions, an id with two rows in one, rows without grams and one without an id."""
    rows = [("fr", i, ["aa", "bb", "cc"][: 1 + i % 3] + ["dd"] * (i % 4)) for i in range(48)]
    rows += [("be", i, ["aa", "bb"]) for i in range(40, 56)] + [("fr", 3, ["bb"]), ("fr", 90, None), ("fr", 91, []), ("fr", None, ["aa", "dd"])]
    return spark.createDataFrame(rows, f"country string, {ident} long, grams array<string>")


def plain_weights(rows, vocabulary):
    """Weights record by record, as the operator had them before it knew classes."""
    tf = rows.where("id IS NOT NULL").select("country", "id", F.explode("grams").alias("gram")).groupBy("country", "id", "gram").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(vocabulary, ["country", "gram"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("country", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["country", "id"]).select("country", "gram", "id", (F.col("w") / F.col("norm")).alias("weight"))


def counted(df, *columns):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def joins(df):
    """The joins of the planned query, before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(kind for kind in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") for _ in range(plan.count(kind)))


def test_copies_are_one_class(spark):
    rows = spark.createDataFrame([("fr", i, ["aa", "bb"] if i % 2 else ["bb", "aa"]) for i in range(500)] + [("fr", 500, ["aa", "aa", "bb"])], "country string, id long, grams array<string>")
    members, classes = blocking.gram_classes(rows, "id", "grams")
    assert counted(classes, "size", "country", "gram", "tf") == Counter({(500, "fr", "aa", 1): 1, (500, "fr", "bb", 1): 1, (1, "fr", "aa", 2): 1, (1, "fr", "bb", 1): 1})
    assert members.count() == 501 and members.select("class").distinct().count() == 2


def test_weights_of_copies(spark):
    rows = records(spark)
    vocabulary = blocking.fit_vocabulary(rows.where("id % 2 = 0"), "id", "grams", max_share=1.0)
    assert {(r.country, r.gram): r.df for r in vocabulary.collect()}["be", "aa"] == 8
    assert counted(blocking.tfidf_weights(rows, "id", "grams", vocabulary), "country", "gram", "id", "weight") == counted(plain_weights(rows, vocabulary), "country", "gram", "id", "weight")


def test_weights_are_not_broadcast(spark):
    assert set(joins(catalogue.QUERIES["tfidf_weights"](spark, SMALL))) == {"SortMergeJoin"}


def test_pair_table_does_not_broadcast_records(spark):
    assert set(joins(catalogue.QUERIES["pair_table"](spark, SMALL))) == {"SortMergeJoin"}


@pytest.mark.parametrize("name", ["pair_table", "pass_c_topk", "pass_c_full_text", "pass_union", "pass_overlap", "coverage_check"])
def test_passes_of_copies(spark, tmp_path, name):
    """Two copies of each part under other keys: the rows of the SQL, by joins that merge."""
    import duckdb

    con = duckdb.connect()
    con.execute("create table part as select * replace (p_partkey + 2000 * i as p_partkey) from '/root/testdata/sf0.01/part.parquet', range(2) r(i)")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    assert set(joins(df)) == {"SortMergeJoin"}
    if name in catalogue.ORACLES:
        columns = sorted(df.columns)
        want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalogue.ORACLES[name]})").fetchall()
        assert want and counted(df, *columns) == Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want)
