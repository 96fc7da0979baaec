"""Queries of the diagnostics operators, beside the catalogue's; importing this module registers them there."""

from __future__ import annotations

from pyspark.sql import functions as F

from recolink.operators import diagnostics, evaluation, features, scoring
from recolink.plans.catalogue import ENTITIES, PAIRS, SCORED, STAGE1, UNION, WORDS, _labelled_pairs, _pass_c, match_evidence, parts, pass_a_candidates, query, r6, read, scored_pairs, truth_tables

# ------------------------------------------------------------------ fixtures
ACCEPT = 0.64


def decided_pairs(spark, sf):
    """Scored pairs with a label, the query's best one (kept), whether it is selected, and the query's texts."""
    rows = scored_pairs(spark, sf).withColumn("label", (F.col("num_q") % 3 == 0).cast("int"))
    rows = rows.withColumns({"kept": features.ranked(features.by_query(), F.col("base_score"), "s1_id") == 1, "unmatched": F.max("label").over(features.by_query()) == 0})
    return rows.withColumn("selected", F.col("kept") & (F.col("base_score") >= ACCEPT)).withColumnRenamed("base_score", "p")


DECIDED = f"""{SCORED}, labelled AS (SELECT *, CAST(num_q % 3 = 0 AS INTEGER) AS label, base_score AS p FROM scored),
decided AS (SELECT *, kept AND p >= {ACCEPT} AS selected FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base_score DESC, s1_id) = 1 AS kept,
  max(label) OVER (PARTITION BY query_id) = 0 AS unmatched FROM labelled))"""


def with_texts(spark, sf, pairs):
    texts = read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("name"), F.col("o_custkey").cast("string").alias("addr"))
    return pairs.join(texts, "query_id")


TEXTS = f"""{DECIDED}, texts AS (SELECT d.*, concat_ws(' ', o_orderpriority, o_orderstatus) AS name, CAST(o_custkey AS VARCHAR) AS addr FROM decided d JOIN orders ON o_orderkey = query_id)"""


def edit_similarity(a, b):
    a, b = F.col(a), F.col(b)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


SIMILAR = "(1 - levenshtein({0}.{2}, {1}.{2}) / greatest(length({0}.{2}), length({1}.{2})))"


def suppliers(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("s1_id"), F.col("s_nationkey").alias("country"))


# ------------------------------------------------------------------ folds and samples
@query(f"""WITH {ENTITIES} SELECT CAST(s1_id % 5 AS INTEGER) AS fold, count(*) AS entities, round(avg(f), 6) AS macro_f05,
  round(avg(CASE WHEN n_pred = 0 THEN 1.0 ELSE n_hit / n_pred END), 6) AS precision, round(avg(CASE WHEN n_true = 0 THEN 1.0 ELSE n_hit / n_true END), 6) AS recall,
  round(avg(n_pred), 6) AS pred_per_s1, round(avg(CAST(n_pred = 0 AS DOUBLE)), 6) AS empty_share, round(avg(CAST(n_true = 0 AS DOUBLE)), 6) AS singleton_share,
  round(coalesce(avg(CASE WHEN n_true = 0 THEN f END), 1), 6) AS f05_singletons, round(coalesce(avg(CASE WHEN n_true > 0 THEN f END), 1), 6) AS f05_non_singletons FROM es GROUP BY 1""")
def fold_metrics(spark, sf):
    return diagnostics.fold_metrics(evaluation.entity_scores(*truth_tables(spark, sf)).withColumn("fold", (F.col("s1_id") % 5).cast("int")))


@query(f"""WITH {ENTITIES}, s AS (SELECT s1_id, country, n_true, row_number() OVER (PARTITION BY country ORDER BY md5(CAST(s1_id AS VARCHAR)), s1_id) <= floor(count(*) OVER (PARTITION BY country) * 0.15 + 0.5) AS v FROM es),
g AS (SELECT country, count(CASE WHEN NOT v THEN 1 END) AS train, count(CASE WHEN v THEN 1 END) AS val,
  round(avg(CASE WHEN NOT v THEN CAST(n_true = 0 AS DOUBLE) END), 6) AS rate_train, round(avg(CASE WHEN v THEN CAST(n_true = 0 AS DOUBLE) END), 6) AS rate_val,
  round(avg(CASE WHEN NOT v THEN n_true END), 6) AS mean_train, round(avg(CASE WHEN v THEN n_true END), 6) AS mean_val FROM s GROUP BY GROUPING SETS ((country), ()))
SELECT *, abs(rate_train - rate_val) <= 0.002 AND abs(mean_train - mean_val) <= 0.01 AS balanced FROM g""")
def fold_balance(spark, sf):
    entities, truth, predicted = truth_tables(spark, sf)
    rows = evaluation.entity_scores(entities, truth, predicted).withColumnRenamed("n_true", "n_matches")
    return diagnostics.fold_balance(evaluation.stratified_split(rows, ["country"], "s1_id", 0.15))


@query("""WITH t AS (SELECT DISTINCT o_custkey AS s1_id, o_orderkey AS query_id FROM orders WHERE o_orderstatus = 'F'),
o AS (SELECT query_id, CASE WHEN s1_id % 5 = 0 THEN 'val' ELSE 'train' END AS role FROM t),
r AS (SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey NOT IN (SELECT query_id FROM o) ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500)
SELECT query_id, role FROM o UNION ALL SELECT query_id, 'distractor' FROM r""")
def query_roles(spark, sf):
    entities, truth, _ = truth_tables(spark, sf)
    split = entities.select("s1_id", F.when(F.col("s1_id") % 5 == 0, "val").otherwise("train").alias("fold"))
    return diagnostics.query_roles(read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id")), truth, split, 500)


@query(f"""WITH {WORDS}, n AS (SELECT token, country, count(*) AS n FROM word_rows GROUP BY ALL),
b AS (SELECT token, max({{'n': n, 'country': country}}) AS b, sum(n) AS total FROM n GROUP BY 1), m AS (SELECT token, b.country AS country, b.n AS n FROM b WHERE b.n >= 5 AND b.n >= 0.05 * total),
v AS (SELECT id, m.country, CAST(sum(n) AS BIGINT) AS votes FROM word_rows w JOIN m USING (token) GROUP BY ALL)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, country DESC) = 1""")
def voted_region(spark, sf):
    words = parts(spark, sf).select("id", "country", F.explode(F.array_distinct("words")).alias("token"))
    votes = evaluation.pure_votes(words.select("country", "token"), "token", "country", 5, 0.05)
    return diagnostics.voted_region(words.select("id", "token"), votes, "id", "token", "country")


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT min(s_suppkey) FROM supplier GROUP BY s_nationkey)")
def joined_once(spark, sf):
    """The first supplier of each nation with the nation's name; the join fails unless both sides hold each nation once."""
    first = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return diagnostics.joined_once(first, names, "s_nationkey").select("s_suppkey", "s_nationkey", "n_name")


# ------------------------------------------------------------------ decoys and missed pairs
@query(f"""WITH {DECIDED}, r AS (SELECT *, round(0.3 * name_tsort + 0.6 * coalesce(addr_tsort, 0) + 0.1 * compat, 6) AS s FROM decided),
k AS (SELECT *, CASE WHEN label = 1 THEN 'true_pairs' WHEN unmatched AND row_number() OVER (PARTITION BY query_id ORDER BY s DESC, s1_id) = 1 AND s >= 0.6400001 THEN 'accepted_decoys' END AS kind FROM r)
SELECT kind, count(*) AS pairs, round(100 * avg(CAST(num_q = num_s AS DOUBLE)), 4) AS num_equal, round(100 * avg(compat), 4) AS num_compatible, round(100 * avg(conflict), 4) AS num_conflict,
  round(100 * avg(CAST(extra_q > 0 AS DOUBLE)), 4) AS extra_words, round(100 * avg(CAST(conflict = 1 OR extra_q > 0 AS DOUBLE)), 4) AS conflict_or_extra FROM k WHERE kind IS NOT NULL GROUP BY 1""")
def decoy_rates(spark, sf):
    score = r6(scoring.baseline_score(F.col("name_tsort"), F.col("addr_tsort"), F.col("compat")))
    rows = decided_pairs(spark, sf).withColumns({"s": score, "equal": (F.col("num_q") == F.col("num_s")).cast("int"), "extra": F.col("extra_q")})
    return diagnostics.decoy_rates(rows, "s", 0.6400001)


@query(f"""WITH {DECIDED}, e AS (SELECT *, bool_or(selected) OVER (PARTITION BY query_id) AS elsewhere FROM decided)
SELECT CASE WHEN kept THEN 'decoder' WHEN elsewhere THEN 'other_s1_selected' ELSE 'other_s1_unselected' END AS bucket, count(*) AS pairs,
  round(quantile_cont(p, 0.5), 6) AS median_p, round(avg(p), 6) AS mean_p FROM e WHERE label = 1 AND NOT selected GROUP BY 1""")
def missed_pairs(spark, sf):
    return diagnostics.missed_pairs(decided_pairs(spark, sf))


@query(f"""WITH {DECIDED}, e AS (SELECT s1_id, max(p) AS best, count(CASE WHEN selected THEN 1 END) AS n_pred, count(CASE WHEN kept THEN 1 END) AS n_kept, count(CASE WHEN kept AND p >= 0.3 AND p < 0.7 THEN 1 END) AS n_undecided FROM decided GROUP BY 1),
r AS (SELECT s_nationkey AS country, coalesce(best, 0) AS best, coalesce(n_pred, 0) AS n_pred, coalesce(n_kept, 0) AS n_kept, coalesce(n_undecided, 0) AS n_undecided FROM supplier LEFT JOIN e ON s_suppkey = s1_id)
SELECT country, count(*) AS s1, round(avg(n_pred), 6) AS pred_per_s1, round(avg(CAST(n_pred = 0 AS DOUBLE)), 6) AS empty_share, round(sum(n_pred) / nullif(sum(n_kept), 0), 6) AS assigned_share,
  round(sum(n_undecided) / nullif(sum(n_kept), 0), 6) AS undecided_share, round(quantile_cont(best, 0.1), 6) AS best_q10, round(quantile_cont(best, 0.5), 6) AS best_median,
  round(avg(CAST(best < 0.3 AS DOUBLE)), 6) AS best_lt_03, round(avg(CAST(best >= 0.3 AND best < 0.7 AS DOUBLE)), 6) AS best_03_07, round(avg(CAST(best >= 0.9 AS DOUBLE)), 6) AS best_ge_09 FROM r GROUP BY 1""")
def run_gap(spark, sf):
    return diagnostics.run_gap(suppliers(spark, sf), decided_pairs(spark, sf).select("s1_id", "p", "kept", "selected"))


@query(f"""WITH {TEXTS}, c AS (SELECT d.query_id, d.s1_id, o.query_id AS sibling, d.source = o.source AS same_source,
  ({SIMILAR.format('d', 'o', 'name')} + {SIMILAR.format('d', 'o', 'addr')}) / 2 AS combo
  FROM texts d JOIN texts o ON d.s1_id = o.s1_id AND d.query_id <> o.query_id WHERE d.selected AND d.label = 0 AND d.unmatched AND o.kept AND o.label = 1)
SELECT query_id, s1_id, sibling, round(combo, 6) AS combo, same_source, count(*) OVER (PARTITION BY query_id, s1_id) AS siblings FROM c
QUALIFY row_number() OVER (PARTITION BY query_id, s1_id ORDER BY combo DESC, sibling) = 1""")
def closest_sibling(spark, sf):
    rows = with_texts(spark, sf, decided_pairs(spark, sf)).select("query_id", "s1_id", "name", "addr", "source", "label", "unmatched", "kept", "selected")
    return diagnostics.closest_sibling(rows.where("selected AND label = 0 AND unmatched"), rows.where("kept AND label = 1"), edit_similarity)


@query(f"""WITH {TEXTS}, c AS (SELECT d.query_id, d.s1_id, d.p, round(max(least({SIMILAR.format('d', 'o', 'name')}, {SIMILAR.format('d', 'o', 'addr')})), 6) AS similarity
  FROM texts d JOIN texts o ON d.s1_id = o.s1_id AND d.num_q = o.num_q WHERE d.kept AND NOT d.selected AND d.p >= 0.3 AND o.selected GROUP BY ALL)
SELECT * FROM c WHERE similarity >= 0.5""")
def sibling_rescue(spark, sf):
    rows = with_texts(spark, sf, decided_pairs(spark, sf)).withColumn("number", F.col("num_q")).select("query_id", "s1_id", "p", "kept", "selected", "name", "addr", "number")
    return diagnostics.rescue(rows, edit_similarity, 0.3, 0.5)


# ------------------------------------------------------------------ tuning
ACCEPTS, DELTAS = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9], [0.0, 0.05, 0.1]


@query(f"""WITH {DECIDED}, g AS (SELECT * FROM (SELECT unnest({ACCEPTS}) AS a), (SELECT unnest({DELTAS}) AS d)),
n AS (SELECT s_suppkey AS s1_id, (SELECT count(*) FROM decided x WHERE x.s1_id = s_suppkey AND label = 1) AS n_true FROM supplier),
k AS (SELECT a, d, s1_id, max(p) AS best, count(CASE WHEN p >= a THEN 1 END) AS k, count(CASE WHEN p >= a AND label = 1 THEN 1 END) AS t FROM decided, g WHERE kept GROUP BY ALL),
r AS (SELECT g.a, g.d, n_true, CASE WHEN best >= round(g.a + g.d, 6) THEN k ELSE 0 END AS k, CASE WHEN best >= round(g.a + g.d, 6) THEN t ELSE 0 END AS t FROM n CROSS JOIN g LEFT JOIN k ON k.s1_id = n.s1_id AND k.a = g.a AND k.d = g.d)
SELECT CAST(a AS DOUBLE) AS t_accept, CAST(round(a + d, 6) AS DOUBLE) AS t_keep,
  round(avg(CASE WHEN n_true = 0 THEN CAST(k = 0 AS DOUBLE) WHEN k = 0 OR t = 0 THEN 0.0 ELSE 1.25 * t / (k + 0.25 * n_true) END), 6) AS macro_f05 FROM r GROUP BY ALL""")
def tune_thresholds(spark, sf):
    pairs = decided_pairs(spark, sf)
    n_true = pairs.where("label = 1").groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true"))
    entities = suppliers(spark, sf).select("s1_id").join(n_true, "s1_id", "left").na.fill(0)
    return diagnostics.tune_thresholds(entities, pairs.where("kept").select("s1_id", "p", "label"), ACCEPTS, DELTAS)


WEIGHTS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0]


@query(f"""WITH {PAIRS}, t AS (SELECT query_id, max(s1_id) AS s1_id FROM pairs GROUP BY 1), w AS (SELECT CAST(unnest({WEIGHTS}) AS DOUBLE) AS weight),
r AS (SELECT weight, query_id, s1_id, row_number() OVER (PARTITION BY weight, query_id ORDER BY round(name_tsort + weight * shared, 6) DESC, s1_id) AS rank FROM pairs, w)
SELECT weight, round(avg(CAST(rank <= 2 AS DOUBLE)), 6) AS recall FROM t JOIN r USING (query_id, s1_id) GROUP BY 1""")
def tune_union_weight(spark, sf):
    pairs = scored_pairs(spark, sf).select("query_id", "s1_id", "shared", "name_tsort")
    truth = pairs.groupBy("query_id").agg(F.max("s1_id").alias("s1_id"))
    return diagnostics.tune_union_weight(truth, pairs, WEIGHTS, "shared", "name_tsort", 2)


# ------------------------------------------------------------------ distributions and coverage
@query(f"""WITH {ENTITIES}, n AS (SELECT s1_id, (SELECT count(*) FROM pred WHERE pred.s1_id = ent.s1_id) AS n FROM ent)
SELECT CASE WHEN n >= 12 THEN '12+' WHEN n >= 10 THEN '10-11' WHEN n >= 8 THEN '8-9' ELSE CAST(n AS VARCHAR) END AS size, count(*) AS entities FROM n GROUP BY 1""")
def list_sizes(spark, sf):
    entities, _, predicted = truth_tables(spark, sf)
    return diagnostics.list_sizes(entities, predicted.distinct())


@query("""WITH c AS (SELECT o_custkey AS s1_id, o_orderpriority AS source, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT unnest(['1-URGENT', '2-HIGH']) AS source)
SELECT s.source, coalesce(n, 0) AS n, count(*) AS entities FROM customer CROSS JOIN s LEFT JOIN c ON c.s1_id = c_custkey AND c.source = s.source GROUP BY ALL""")
def sizes_per_source(spark, sf):
    entities = read(spark, sf, "customer").select(F.col("c_custkey").alias("s1_id"))
    pairs = read(spark, sf, "orders").select(F.col("o_custkey").alias("s1_id"), F.col("o_orderpriority").alias("source"))
    return diagnostics.sizes_per_source(entities, pairs, ["1-URGENT", "2-HIGH"])


@query(f"""WITH {ENTITIES}, o AS (SELECT o_orderkey AS query_id, CAST(o_custkey % 3 AS INTEGER) AS country FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT CAST(e.s1_id % 3 AS INTEGER) AS country, o.country AS theirs, count(*) OVER (PARTITION BY p.query_id) AS uses FROM pred p JOIN ent e USING (s1_id) LEFT JOIN o USING (query_id)),
f AS (SELECT country, count(*) AS pairs, count(CASE WHEN theirs IS NULL THEN 1 END) AS unknown_ids, count(CASE WHEN theirs <> country THEN 1 END) AS other_part, count(CASE WHEN uses > 1 THEN 1 END) AS used_twice FROM r GROUP BY 1),
c AS (SELECT country, count(*) AS others, round(avg(CAST(query_id IN (SELECT query_id FROM pred) AS DOUBLE)), 6) AS coverage FROM o GROUP BY 1)
SELECT c.country, others, coverage, coalesce(pairs, 0) AS pairs, coalesce(unknown_ids, 0) AS unknown_ids, coalesce(other_part, 0) AS other_part, coalesce(used_twice, 0) AS used_twice FROM c LEFT JOIN f USING (country)""")
def audit_coverage(spark, sf):
    entities, _, predicted = truth_tables(spark, sf)
    third = lambda c: (F.col(c) % 3).cast("int").alias("country")
    others = read(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("query_id"), third("o_custkey"))
    return diagnostics.audit_pairs(predicted.distinct(), entities.select("s1_id", third("s1_id")), others)


@query(f"""WITH {UNION}, t AS (SELECT p_partkey, CAST(p_partkey IN (SELECT query_id FROM pass_a) AS INTEGER) + CAST(p_partkey IN (SELECT query_id FROM pass_c) AS INTEGER) AS n FROM part WHERE p_partkey % 2 = 1)
SELECT CAST(n AS BIGINT) AS times, count(*) AS keys FROM t GROUP BY 1""")
def coverage_check(spark, sf):
    required = read(spark, sf, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("query_id"))
    return diagnostics.coverage_check(required, {"a": pass_a_candidates(spark, sf), "c": _pass_c(spark, sf)})


@query(f"""WITH {UNION} SELECT (SELECT count(*) FROM (SELECT query_id, s1_id FROM pass_a UNION SELECT query_id, s1_id FROM pass_c)) AS either,
  (SELECT count(*) FROM (SELECT query_id, s1_id FROM pass_a INTERSECT SELECT query_id, s1_id FROM pass_c)) AS both,
  (SELECT count(*) FROM (SELECT query_id, s1_id FROM pass_c EXCEPT SELECT query_id, s1_id FROM pass_a)) AS only_c""")
def pass_overlap(spark, sf):
    """Sizes of the union, intersection and difference of two candidate sets, in one aggregation of their union."""
    one = lambda df, a, c: df.select("query_id", "s1_id", F.lit(a).alias("a"), F.lit(c).alias("c"))
    sides = one(pass_a_candidates(spark, sf), 1, 0).unionByName(one(_pass_c(spark, sf), 0, 1)).groupBy("query_id", "s1_id").agg(F.max("a").alias("a"), F.max("c").alias("c"))
    return sides.agg(F.count(F.lit(1)).alias("either"), F.count_if((F.col("a") == 1) & (F.col("c") == 1)).alias("both"), F.count_if(F.col("a") == 0).alias("only_c"))


# ------------------------------------------------------------------ models
STAGE2 = [*STAGE1, "p1", "p1_s1_max", "p1_s1_second", "p1_s1_sum", "p1_s1_cnt05", "p1_s1_rank", "p1_minus_s1max", "p1_s1_other_max", "p1_q_other_max", "p1_q_margin", "p1_q_rank"]
HAS_MATCH = ["hm_max", "hm_second", "hm_sum", "hm_cnt", "hm_cnt05", "hm_all_max", "hm_all_sum", "hm_n_pairs", "hm_claimants", "hm_noconf", "hm_noextra", "hm_best_name", "hm_best_addr", "hm_best_v2", "hm_best_twin", "s1_name_freq", "s1_addr_missing"]


@query()
def match_pipeline(spark, sf):
    """All models in a row: stage 1, its aggregates, stage 2, one-to-one, has-match, and the decoder's choice."""
    first = scoring.cross_validated(_labelled_pairs(spark, sf), STAGE1, "p1", trees=4, depth=3)
    staged = features.stage_features(first).cache()
    second = scoring.cross_validated(staged, STAGE2, "p2", trees=4, depth=3).select("query_id", "s1_id", "label", "fold", "p2").cache()
    s1 = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("s1_id"), F.col("s_nationkey").cast("string").alias("name"), F.col("s_name").alias("addr"))
    evidence = match_evidence(scored_pairs(spark, sf)).drop("label").join(second.select("query_id", "s1_id", "p2"), ["query_id", "s1_id"])
    matched = second.where("label = 1").groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    table = features.has_match_table(s1, evidence).join(matched, "s1_id", "left")
    table = table.withColumns({"label": (F.coalesce("n", F.lit(0)) > 180).cast("int"), "fold": (F.col("s1_id") % 5).cast("int")}).select("s1_id", "label", "fold", *[F.col(c).cast("double") for c in HAS_MATCH])
    h = scoring.cross_validated(table, HAS_MATCH, "h", trees=4, depth=3).select("s1_id", "h")
    chosen = scoring.one_to_one(second, "p2").select("query_id", "s1_id", F.col("p2").alias("p"))
    return scoring.decode(chosen, h).withColumn("p", r6("p"))


@query()
def feature_importance(spark, sf):
    """Share of each feature in a model's gains, in percent; a feature and the mark of its absence are summed."""
    model = scoring.fit_gbt(_labelled_pairs(spark, sf), STAGE1, trees=8, depth=4)
    return scoring.importance(spark, model, STAGE1)
