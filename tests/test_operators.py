"""Operators on small fixtures and against brute force, and every query against its SQL."""

import itertools
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recolink.operators import blocking, diagnostics, evaluation, features, scoring
from recolink.plans import catalogue, linkage, reports  # noqa: F401
from recolink.sources import tables
from recolink.streaming import resolver

SMALL = "/root/testdata/sf0.001"


def expected(p, chosen, miss_rate, h):
    """Expected F0.5 of predicting ``chosen`` by enumerating every outcome."""
    pm = [math.exp(-miss_rate) * miss_rate**m / math.factorial(m) for m in range(5)]
    pm = [x / sum(pm) for x in pm]
    total = 0.0
    for truth in itertools.product([0, 1], repeat=len(p)):
        weight = math.prod(x if t else 1 - x for x, t in zip(p, truth))
        for m, w in enumerate(pm):
            n, hit = sum(truth) + m, sum(truth[:chosen])
            f = float(chosen == 0) if n == 0 else 1.25 * hit / (chosen + 0.25 * n) if chosen else 0.0
            total += weight * w * f
    return total if h is None else h * total + (1 - h) * (chosen == 0)


@pytest.mark.parametrize("h,miss", [(None, 0.0), (None, 0.2), (0.7, 0.05), (0.3, 0.1)])
def test_decoder_is_optimal(h, miss):
    rng = random.Random(7)
    for _ in range(25):
        p = sorted((rng.random() for _ in range(5)), reverse=True)
        q = p if h is None else [min(x / h, 1.0) for x in p]
        rate = miss / (1 - miss) * sum(q)
        values = [expected(q, k, rate, h) for k in range(6)]
        assert values[scoring.best_prefix(p, h, miss)] == pytest.approx(max(values), abs=1e-9)


def test_decode_rows(spark):
    pairs = spark.createDataFrame([(1, 1, 0.95), (2, 1, 0.9), (3, 1, 0.05), (4, 2, 0.1), (5, 3, 0.99)], "query_id long, s1_id long, p double")
    assert sorted((r.query_id, r.s1_id) for r in scoring.decode(pairs).collect()) == [(1, 1), (2, 1), (5, 3)]


def test_adaptive_top_k(spark):
    rows = [(1, i, 1.0 - 0.005 * i) for i in range(10)] + [(2, i, 1.0 - 0.1 * i) for i in range(10)] + [(3, i, 0.5) for i in range(4)]
    pairs = spark.createDataFrame(rows, "query_id long, s1_id long, cheap double")
    got = Counter(r.query_id for r in blocking.adaptive_top_k(pairs).collect())
    assert got == {1: 8, 2: 5, 3: 4}


def test_shared_keys_and_cap(spark):
    s1 = spark.createDataFrame([("fr", "k1", i) for i in range(3)] + [("fr", "hot", i) for i in range(60)], "country string, key string, s1_id long")
    q = spark.createDataFrame([("fr", "k1", 100), ("fr", "hot", 100), ("de", "k1", 101)], "country string, key string, query_id long")
    got = blocking.shared_key_candidates(q, s1, ["country", "key"]).collect()
    assert sorted((r.query_id, r.s1_id, r.score) for r in got) == [(100, 0, 1), (100, 1, 1), (100, 2, 1)]


def test_union_of_passes(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "query_id long, s1_id long, score double")
    c = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4)], "query_id long, s1_id long, score double")
    got = {r.s1_id: (r.score_a, r.score_c, r.in_a, r.in_c) for r in blocking.union_passes(a=a, c=c).collect()}
    assert got == {1: (2.0, None, True, False), 2: (1.0, 0.5, True, True), 3: (None, 0.4, False, True)}


def test_mined_dictionary(spark):
    rows = [("phuds", "foods")] * 4 + [("phuds", "food")] + [("12", "x")] * 9 + [("same", "same")] * 5 + [("rare", "once")] * 2
    got = blocking.mine_dictionary(spark.createDataFrame(rows, "x string, y string")).collect()
    assert [(r.x, r.y, r.support, r.occ) for r in got] == [("phuds", "foods", 4, 5)]


def test_rule_score(spark):
    row = spark.range(1).select(
        scoring.rule_score(F.lit(1.0), F.lit(None).cast("double"), F.lit(1), F.lit(0), F.lit(0)).alias("a"),
        scoring.rule_score(F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(1), F.lit(0)).alias("b"),
        scoring.rule_score(F.lit(1.0), F.lit(1.0), F.lit(1), F.lit(0), F.lit(9)).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (pytest.approx(1.0), -1.0, pytest.approx(0.9))


def test_weight_grid():
    grid = scoring.weight_grid()
    assert len(grid) == 55 and all(sum(w) == pytest.approx(1) for w in grid)


def test_isotonic_values(spark):
    rows = spark.createDataFrame([(1.0, 0.1), (2.0, 0.4), (3.0, 0.3), (4.0, 0.9)], "p double, y double")
    got = [r.calibrated for r in scoring.fit_isotonic(rows, "p", "y").transform(rows).orderBy("p").collect()]
    assert got == pytest.approx([0.1, 0.35, 0.35, 0.9])


def test_metric_examples(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (2, 0, 0), (2, 2, 2), (2, 2, 1), (3, 1, 1)], "t int, p int, h int")
    got = [r[0] for r in rows.select(evaluation.f05(F.col("t"), F.col("p"), F.col("h"))).collect()]
    assert got == pytest.approx([1, 0, 0, 1, 0.5, 1.25 / 1.75])


def test_budget_sums_to_loss(spark):
    row = catalogue.error_budget(spark, SMALL).first().asDict()
    total = row.pop("total")
    assert sum(row.values()) == pytest.approx(total, abs=1e-5)


def test_context_features(spark):
    rows = [(1, 9, 0.9, 0, "2007"), (2, 9, 0.8, 0, "007"), (3, 9, 0.7, 1, "55")]
    pairs = spark.createDataFrame(rows, "query_id long, s1_id long, base_score double, extra_q int, main_q string")
    got = {r.query_id: (r.s1_claims, r.extra_vs_min, r.num_agree_major) for r in features.context_features(pairs).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (3, 0), 2: (3, 0), 3: (3, 1)}


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "b" N/A\t\tfr\n', encoding="utf-8")
    row = tables.read_source(spark, str(path)).first()
    assert (row.business_name, row.business_address) == ('A "b" N/A', "")
    path.write_text("entity_id\twrong\tbusiness_address\tcountry\nS1-1\tA\t\tfr\n", encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017
        tables.read_source(spark, str(path)).collect()


def test_truth_and_lists(spark, tmp_path):
    truth = spark.createDataFrame([("S1-1", "S2-1,S3-2,S2-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    pairs = tables.explode_truth(truth)
    assert sorted(tuple(r) for r in pairs.collect()) == [("S1-1", "S2-1", "S2"), ("S1-1", "S3-2", "S3")]
    lists = tables.id_lists(truth.select(F.col("source1_entity_id").alias("s1_id")), pairs, "s1_id", "other_id", F.lit(0), "ids")
    assert sorted(tuple(r) for r in lists.collect()) == [("S1-1", "S2-1,S3-2"), ("S1-2", "")]
    tables.write_id_list_tsv(lists, str(tmp_path / "out"), "s1_id", "ids")
    with pytest.raises(ValueError):
        tables.write_id_list_tsv(lists.unionByName(lists), str(tmp_path / "bad"), "s1_id", "ids")


def test_validation_findings(spark):
    required = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    listed = spark.createDataFrame([("a", "1,1"), ("b", "1,9"), ("b", ""), ("z", "2")], "s1_id string, ids string")
    known = spark.createDataFrame([("1",), ("2",)], "id string")
    got = {r.finding: r["rows"] for r in evaluation.validate_submission(required, listed, known).collect()}
    assert got == {"repeated_key": 1, "missing_key": 1, "stray_key": 1, "repeated_id_in_list": 1, "id_in_two_lists": 1, "unknown_id": 1}


def test_stream_resolves_each_batch(spark, tmp_path):
    spark.createDataFrame([(i, f"k{i % 3}") for i in range(9)], "query_id long, key string").write.parquet(str(tmp_path / "in"))
    s1 = spark.createDataFrame([(i, f"k{i}") for i in range(2)], "s1_id long, key string")
    stream = spark.readStream.schema("query_id long, key string").parquet(str(tmp_path / "in"))
    q = resolver.resolve_stream(stream, lambda batch: batch.join(s1, "key"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_fixed_top_k_is_limited_before_the_shuffle(spark, capsys):
    catalogue.topk_fixed(spark, SMALL).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_scan_pushes_filter_and_columns(spark, capsys):
    catalogue.scan_pushdown(spark, SMALL).explain()
    plan = capsys.readouterr().out
    assert "EqualTo(o_orderpriority" in plan and "o_custkey" not in plan


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def plain(row):
    return tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in row)


def test_joined_once(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "c"), (2, "d"), (3, "e")], "k int, y string")
    assert sorted(tuple(r) for r in diagnostics.joined_once(left, right, "k").collect()) == [(1, "a", "c"), (2, "b", "d")]
    for wrong in (right.where("k <> 2"), right.unionByName(right.where("k = 1"))):
        with pytest.raises(Exception, match="not one to one"):
            diagnostics.joined_once(left, wrong, "k").collect()


def test_balance_fails_on_a_gap(spark):
    rows = [("fr", "train", i % 2) for i in range(20)] + [("fr", "val", i % 2) for i in range(4)]
    entities = spark.createDataFrame(rows, "country string, fold string, n_matches int")
    diagnostics.assert_balanced(entities)
    with pytest.raises(ValueError, match="not balanced"):
        diagnostics.assert_balanced(entities.unionByName(spark.createDataFrame([("fr", "val", 9)], entities.schema)))


def test_rescue_needs_a_compatible_mate(spark):
    rows = [(1, 7, 0.9, True, True, "acme", "road", 5), (2, 7, 0.5, True, False, "acme", "road", 5), (3, 7, 0.5, True, False, "acme", "road", 6),
            (4, 7, 0.5, True, False, "acme", "road", None), (5, 7, 0.1, True, False, "acme", "road", 5), (6, 8, 0.5, True, False, "acme", "road", 5)]
    pairs = spark.createDataFrame(rows, "query_id long, s1_id long, p double, kept boolean, selected boolean, name string, addr string, number int")
    assert sorted(r.query_id for r in diagnostics.rescue(pairs, reports.edit_similarity).collect()) == [2, 4]


def test_cross_validation_holds_folds_out(spark):
    """A label that one fold alone flips is learnt from the others, so the flipped fold is predicted wrongly."""
    rows = [(i, float(i % 2), int((i % 2) ^ (i % 5 == 3)), i % 5) for i in range(400)]
    data = spark.createDataFrame(rows, "id long, x double, label int, fold int")
    got = {r.id: r.p for r in scoring.cross_validated(data, ["x"], "p", trees=5, depth=2).collect()}
    assert len(got) == 400
    assert all((got[i] > 0.5) == bool(x) for i, x, _, f in rows if f in (0, 3))


def test_empty_tables_give_no_rows(spark):
    pairs = spark.createDataFrame([], "query_id long, s1_id long, p double, label int, kept boolean, selected boolean, name string, addr string, source string, number int")
    assert diagnostics.missed_pairs(pairs).count() == diagnostics.rescue(pairs, reports.edit_similarity).count() == 0
    assert diagnostics.closest_sibling(pairs, pairs, reports.edit_similarity).count() == 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(plain(r) for r in df.select(*columns).collect())
    if name in catalogue.ORACLES:
        assert got == Counter(plain(r) for r in duck.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalogue.ORACLES[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
