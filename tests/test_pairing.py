"""The pair table, encodings, what is learnt from records, tuning grids and the checks of finished parts, on small fixtures."""

import itertools

import pytest
from pyspark.sql import functions as F

from recolink.functions import kernels, text
from recolink.operators import blocking, evaluation, features, pairing, scoring


def test_majority_number_ties_to_the_smallest_and_empty_is_no_vote(spark):
    # S1 9: votes 5 and 7, an empty one, and a rival of query 4; S1 8 has no claim at all
    rows = [(1, 9, 0.9, 3, "5"), (2, 9, 0.9, 2, "7"), (3, 9, 0.9, 4, ""), (4, 7, 0.9, 0, "5"), (4, 9, 0.2, 1, "5"), (4, 8, 0.1, 4, "5"), (5, 9, 0.8, 2, "55")]
    pairs = spark.createDataFrame(rows, "query_id long, s1_id long, base_score double, extra_q int, main_q string")
    got = {(r.query_id, r.s1_id): (r.s1_claims, r.extra_vs_min, r.num_agree_major) for r in features.context_features(pairs).collect()}
    assert got[1, 9] == (4, 1, None)  # its own vote is the only one for 5
    assert got[2, 9] == (4, 0, 0) and got[3, 9] == (4, 2, None) and got[4, 9] == (4, -1, 1) and got[5, 9] == (4, 0, 1)
    assert got[4, 8] == (0, 4, None)


def test_group_features_count_compatible_streets(spark):
    rows = [(1, 1, 0.9, 0.9, None, "a", 1, 1, 0), (1, 2, 0.8, 0.8, 0.5, "a", 1, 1, 2), (1, 3, 0.1, 0.1, 0.5, "b", 0, 1, 1)]
    pairs = spark.createDataFrame(rows, "query_id long, s1_id long, base_score double, v2 double, addr_tsort double, source string, no_conflict int, no_extra int, st_compat int")
    assert {r.q_n_compat for r in features.group_features(pairs).collect()} == {2}


def test_votes_need_a_total(spark):
    rows = [("k", "r")] * 4 + [("k", "x")] + [("few", "r")] * 4
    got = evaluation.pure_votes(spark.createDataFrame(rows, "key string, value string"), "key", "value", 5, 0.8).collect()
    assert [(r.key, r.value, r.n, r.total) for r in got] == [("k", "r", 4, 5)]


def test_rarest_word_may_hold_digits(spark):
    s1 = spark.createDataFrame([("fr", 2, "3rd avenue cafe", ["3rd", "avenue", "cafe"]), ("fr", 3, "avenue cafe", ["avenue", "cafe"]), ("fr", 4, "12 avenue", ["12", "avenue"])], "country string, s1_id long, name string, words array<string>")
    q = spark.createDataFrame([("fr", 1, "3rd avenue cafe 12", ["3rd", "avenue", "cafe", "12"])], "country string, query_id long, name string, words array<string>")
    got = blocking.rare_token_candidates(q, s1, "words", "name", kernels.pairwise(kernels.token_sort_ratio)).collect()
    assert [(r.s1_id, r.token) for r in got] == [(2, "3rd")] and 0.5 < got[0].score <= 1


def test_vocabulary_is_cut_by_occurrences(spark):
    rows = [("fr", i, ["aa"] + ["bb"] * 5 * (i < 2)) for i in range(3)]
    got = blocking.fit_vocabulary(spark.createDataFrame(rows, "country string, id long, grams array<string>"), "id", "grams", max_share=1.0, most=1).collect()
    assert [(r.gram, r.df) for r in got] == [("bb", 2)]


def test_adaptive_top_k_with_rows_that_stay(spark):
    rows = [(1, i, 1.0 - 0.1 * i, i in (2, 9)) for i in range(10)] + [(2, i, 1.0 - 0.001 * i, False) for i in range(10)]
    pairs = spark.createDataFrame(rows, "query_id long, s1_id long, cheap double, stay boolean")
    got = sorted((r.query_id, r.s1_id, r["rank"], r.k) for r in blocking.adaptive_top_k(pairs, always=F.col("stay")).collect())
    assert got == [(1, i, i + 1, 5) for i in (0, 1, 2, 3, 4, 9)] + [(2, i, i + 1, 8) for i in range(8)]


def test_has_match_table(spark):
    pairs = spark.createDataFrame(
        [(1, 7, 0.9, 1, 1, 1, 0.8, None, 0.7, 0.6), (2, 7, 0.9, 1, 0, 1, 0.3, 0.2, 0.1, None), (2, 8, 0.4, 1, 1, 0, 0.5, 0.5, 0.5, 0.5), (3, 7, 0.2, 0, 1, 1, 0.9, 0.9, 0.9, 0.9)],
        "query_id long, s1_id long, p2 double, is_claimant int, no_conflict int, no_extra int, name_tsort double, addr_tsort double, v2 double, twin_combo double",
    )
    s1 = spark.createDataFrame([(7, "acme", "road"), (8, "acme", ""), (9, "zen", None)], "s1_id long, name string, addr string")
    got = {r.s1_id: r.asDict() for r in features.has_match_table(s1, pairs).collect()}
    assert (got[7]["hm_max"], got[7]["hm_second"], got[7]["hm_cnt"], got[7]["hm_claimants"], got[7]["hm_noconf"], got[7]["hm_noextra"]) == (0.9, 0.9, 3, 2, 1, 2)
    assert (got[7]["hm_best_name"], got[7]["hm_best_addr"], got[7]["hm_best_v2"], got[7]["hm_best_twin"]) == (0.8, None, 0.7, 0.6)
    assert (got[8]["hm_max"], got[8]["hm_cnt"], got[8]["hm_n_pairs"], got[8]["hm_best_name"], got[8]["s1_addr_missing"]) == (None, 0, 1, None, 1)
    assert (got[9]["hm_n_pairs"], got[9]["s1_addr_missing"]) == (0, 1) and got[7]["s1_name_freq"] == pytest.approx(1.0986123) and len(got[7]) == 18


def test_rule_score_modes(spark):
    one = F.lit(1.0)
    score = lambda conflict, **mode: scoring.rule_score(one, one, F.lit(1), F.lit(conflict), F.lit(0), **mode)
    row = spark.range(1).select(
        score(0, agree_major=F.lit(0), major_pen=0.15), score(0, agree_major=F.lit(1), major_pen=0.15), score(0, agree_major=F.lit(None).cast("int"), major_pen=0.15),
        score(1, conflict_pen=0.4), score(1, agree_major=F.lit(0), major_pen=0.15),
    ).first()
    assert list(row) == pytest.approx([0.85, 1.0, 1.0, 0.6, -1.0])


def test_word_encodings(spark):
    rows = spark.createDataFrame([(1, 10, 1, ["a", "a", "new"]), (2, 10, 0, ["rare"]), (3, 10, 2, []), (4, 10, 7, ["a"])], "query_id long, s1_id long, fold int, xq array<string>")
    vocabulary = spark.createDataFrame([(1, "a", 9, 0.9), (0, "a", 9, 0.4), (0, "rare", 1, 0.1)], "fold int, token string, n long, score double")
    priors = spark.createDataFrame([(f, 0.5) for f in range(5)], "fold int, prior double")
    got = {r.query_id: (r.te_q_max, r.te_q_mean, r.te_q_sum, r.te_q_unseen) for r in pairing.encoded(rows, "xq", vocabulary, priors, "q", least=2).collect()}
    assert got[1] == pytest.approx((0.9, 2.3 / 3, 2.3, 1)) and got[2] == pytest.approx((0.5, 0.5, 0.5, 1))
    assert got[3] == (None, None, 0.0, 0) and got[4] == pytest.approx((0.4, 0.4, 0.4, 0))


def test_encoding_priors_leave_their_fold_out(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (9, 1)], "fold int, label int")
    assert {r.fold: r.prior for r in scoring.encoding_priors(rows, folds=(1, 2)).collect()} == {0: 0.75, 1: 1.0, 2: 0.5}


RECORD = "name_core string, name_compact string, addr_clean string, numbers array<string>, num_keys array<string>"


def test_pair_table_and_labels(spark):
    queries = spark.createDataFrame([(1, "grain fils", "grainfils", "12 main street, lyon", ["012"], ["012"]), (2, "acme", "acme", "", [], [])], f"query_id long, {RECORD}")
    s1 = spark.createDataFrame([(5, "grain files shop", "grainfilesshop", "12 main road, lyon", ["12", "7"], ["012", "007"]), (6, "acme", "acme", "1 a road", ["1"], ["001"])], f"s1_id long, {RECORD}")
    candidates = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 6, 1)], "query_id long, s1_id long, rank int")
    truth = spark.createDataFrame([(1, 5), (2, None)], "query_id long, true_s1 long")
    folds = spark.createDataFrame([(5, 0), (6, 3)], "s1_id long, fold int")
    rows = {(r.query_id, r.s1_id): r for r in pairing.labelled(pairing.pair_table(candidates, queries, s1), truth, folds).collect()}
    r = rows[1, 5]
    assert r.addr_tsort == pytest.approx(kernels.token_sort_ratio("main street lyon", "main road lyon") / 100)
    assert r.b_name_sim == pytest.approx(max(kernels.token_set_ratio("grain fils", "grain files shop"), kernels.ratio("grainfils", "grainfilesshop")) / 100)
    assert r.b_addr_sim == pytest.approx(kernels.token_set_ratio("12 main street, lyon", "12 main road, lyon") / 100)
    assert (r.num_equal, r.num_missing, r.b_num_match, r.xq, r.xs, r.extra_s1, r.label, r.q_true_s1, r.fold, r.q_rank) == (1, 0, 1.0, [], ["shop"], 1, 1, 5, 0, 1)
    r = rows[2, 6]
    assert (r.addr_tsort, r.addr_empty_any, r.b_addr_sim, r.num_missing, r.main_q, r.label, r.q_true_s1, r.base_score) == (None, 1, 0.0, 1, "", 0, -1, 0.5)


def test_cross_script_words_need_exactly_one_side(spark):
    schema = ", ".join(f"{p}_{c} string" for p in "qs" for c in ("business_name", "business_address", "name_core", "addr_clean"))
    rows = [
        ("शर्मा", "a", "sharma phuds", "mena rod, dilli", "Sharma", "b", "sharma foods", "main road, dilli"),
        ("Sharma", "b", "sharma foods", "x", "Sharma", "दिल्ली", "sharma phuds", "x"),
        ("Sharma", "b", "sharma foods", "x", "Sharma", "é", "sharma phuds", "x"),
        ("शर्मा", "a", "one two", None, "x", "दिल्ली", "three four", ""),
    ]
    got = sorted((r.x, r.y) for r in pairing.cross_script_words(spark.createDataFrame(rows, schema)).collect())
    assert got == [("mena", "main"), ("phuds", "foods"), ("phuds", "foods"), ("rod", "road")]


def test_postal_lengths(spark):
    rows = [("a, lyon 69001",)] * 3 + [("a, b 123456, c",), ("9999",), ("",), (None,), ("12345,",)] + [("road",)] * 30
    got = pairing.learn_postal_lengths(spark.createDataFrame(rows, "addr string"), "addr").collect()
    assert [(r.length, r.n, r.total) for r in got] == [(5, 3, 36)]


def test_place_keys(spark):
    rows = [(i, "in", ["new delhi", f"sector {i}"]) for i in range(4)] + [(9, "in", ["delhi"])]
    s1 = spark.createDataFrame(rows, "s1_id long, country string, parts array<string>")
    got = {r.key: (r.n, r.top, r.is_region) for r in pairing.gazetteer(s1, generic=3, frequent=3).collect()}
    assert got["new delhi"] == (4, 4, True) and "sector 1" not in got and len(got) == 1


def test_residual_queries(spark):
    queries = spark.createDataFrame([(1, ["5"], False), (2, [], False), (3, ["5"], True), (4, ["5"], False), (5, ["5"], False)], "query_id long, numbers array<string>, addr_empty boolean")
    found = [(q, 90.0) for q in (1, 1, 1, 2, 2, 2, 3, 3, 3)] + [(4, 59.0)] * 3 + [(5, 90.0)]
    got = pairing.residual_queries(queries, spark.createDataFrame(found, "query_id long, name_ratio double"))
    assert sorted(r.query_id for r in got.collect()) == [2, 3, 4, 5]


PAIRS = [(1, 1, 0.9, 1), (2, 1, 0.6, 0), (3, 1, 0.3, 1), (4, 2, 0.7, 1), (5, 3, 0.4, 0)]


def brute_f(n_true, n_pred, n_hit):
    return float(n_pred == 0) if n_true == 0 else 1.25 * n_hit / (n_pred + 0.25 * n_true) if n_pred and n_hit else 0.0


def test_grids_equal_loops(spark):
    pairs = spark.createDataFrame(PAIRS, "query_id long, s1_id long, p double, label int")
    truth = {1: 2, 2: 2, 3: 0, 4: 1}
    entities = spark.createDataFrame(list(truth.items()), "s1_id long, n_true int")
    own = {s: sorted(((p, label) for _, x, p, label in PAIRS if x == s), reverse=True) for s in truth}
    got = {(r.temperature, r.miss): r.macro_f05 for r in pairing.decoder_grid(pairs, entities, (0.7, 1.0), (0.0, 0.05)).collect()}
    for t, miss in itertools.product((0.7, 1.0), (0.0, 0.05)):
        f = [brute_f(n, k := scoring.best_prefix([p for p, _ in own[s]], None, miss, t), sum(x for _, x in own[s][:k])) for s, n in truth.items()]
        assert got[t, miss] == pytest.approx(sum(f) / len(f), abs=1e-6)
    got = {(r.t_accept, r.t_keep): r.macro_f05 for r in pairing.threshold_grid(pairs, entities, (0.2, 0.5, 0.8), (0.0, 0.2)).collect()}
    for t, k in itertools.product((0.2, 0.5, 0.8), (0.0, 0.2)):
        keep = round(t + k, 3)
        chosen = {s: [x for p, x in own[s] if p >= t] if own[s] and own[s][0][0] >= keep else [] for s in truth}
        assert got[t, keep] == pytest.approx(sum(brute_f(n, len(chosen[s]), sum(chosen[s])) for s, n in truth.items()) / len(truth), abs=1e-6)


def test_assembly_report(spark):
    schema = "s1_id string, matches array<string>, candidates array<string>"
    parts = [spark.createDataFrame([("a", ["S2-1"], ["S2-1", "S3-2"]), ("b", ["S2-9"], ["S2-1"])], schema), spark.createDataFrame([("b", ["S2-1", "S2-1"], None), ("z", [], ["S1-1"])], schema)]
    required = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    got = {r.finding: r["rows"] for r in pairing.assembly_report(pairing.assembled(parts), required).collect()}
    assert got == {"repeated_match": 1, "repeated_candidate": 0, "match_not_candidate": 2, "wrong_prefix": 1, "repeated_key": 1, "missing_key": 1, "stray_key": 1}


def test_address_texts(spark):
    c = F.col("x")
    rows = spark.createDataFrame([("12a main st, 5 lyon, new  delhi-x",), ("",), ("日本 1",)], "x string").select(
        text.strip_digits(c), text.components(c), text.numbered_components(c), text.beyond_latin(c), text.word_count(c),
        text.mapped_text(c, F.create_map(F.lit("main"), F.lit("grand"))), text.pass_c_text(c, F.lit(None).cast("string"), F.lit("z")),
    ).collect()
    assert tuple(rows[0])[:5] == ("a main st lyon new delhi-x", ["new delhi x"], ["12a main st", "5 lyon"], False, 7)
    assert rows[0][5] == "12a grand st, 5 lyon, new delhi-x"
    assert tuple(rows[1])[:5] == ("", [], [], False, 0) and rows[1][6] == "  z" and rows[2][3]
