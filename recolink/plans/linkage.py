"""Queries of the pair table and of what is learnt from records, beside the catalogue's; importing this module registers them there."""

from __future__ import annotations

from pyspark.sql import functions as F

from recolink.functions import numbers, text
from recolink.operators import blocking, evaluation, pairing, scoring
from recolink.plans.catalogue import ENTITIES, PAIRS, PASS_A, SCORED, WORDS, candidate_pairs, parts, pass_a_candidates, query, r6, read, scored_pairs, similar_parts, truth_tables


# ------------------------------------------------------------------ candidates
FULL_TEXT = """pw AS (SELECT p_partkey AS id, p_brand AS country, ' ' || unnest(string_split(concat_ws(' ', replace(lower(p_name), ' ', ''), lower(p_name), lower(p_type)), ' ')) || ' ' AS w FROM part),
grams AS (SELECT id, country, unnest(CASE WHEN length(w) < 4 THEN [w] ELSE list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) END) AS gram FROM pw),
sizes AS (SELECT country, count(DISTINCT id) AS n FROM grams WHERE id % 2 = 0 GROUP BY 1),
vocab AS (SELECT country, gram, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT country, gram, count(DISTINCT id) AS df FROM grams WHERE id % 2 = 0 GROUP BY ALL) JOIN sizes USING (country)
  WHERE df >= 2 AND df <= greatest(2, floor(n * 0.1))),
raw AS (SELECT g.country, gram, id, (1 + ln(tf)) * idf AS w FROM (SELECT country, id, gram, count(*) AS tf FROM grams GROUP BY ALL) g JOIN vocab USING (country, gram)),
weights AS (SELECT country, gram, id, w / norm AS weight FROM raw JOIN (SELECT country, id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL) USING (country, id))"""


@query(f"""WITH {FULL_TEXT} SELECT query_id, s1_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s1_id) AS INTEGER) AS rank FROM (
  SELECT q.id AS query_id, s.id AS s1_id, round(sum(q.weight * s.weight), 6) AS score FROM weights q JOIN weights s ON q.country = s.country AND q.gram = s.gram
  WHERE q.id % 2 = 1 AND s.id % 2 = 0 GROUP BY ALL) QUALIFY rank <= 10""")
def pass_c_full_text(spark, sf):
    """Pass C over the compact name, the name and the address."""
    name, kind = F.lower("p_name"), F.lower("p_type")
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("country"), text.char_grams(text.pass_c_text(F.replace(name, F.lit(" "), F.lit("")), name, kind)).alias("grams"))
    return similar_parts(rows, 0.1)


@query(f"""WITH {PASS_A}, names AS (SELECT p_partkey AS id, lower(p_name) AS name, p_size AS n FROM part),
c AS (SELECT query_id, count(*) AS k, max(100 * (1 - levenshtein(q.name, s.name) / greatest(length(q.name), length(s.name)))) AS best
  FROM pass_a JOIN names q ON q.id = query_id JOIN names s ON s.id = s1_id GROUP BY 1)
SELECT id AS query_id FROM names LEFT JOIN c ON id = query_id
WHERE id % 2 = 1 AND (coalesce(k, 0) < 3 OR n % 5 = 0 OR id % 11 = 0 OR coalesce(best, 0) < 60)""")
def residual_queries(spark, sf):
    """Queries that pass A leaves open."""
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name"), F.col("p_size").alias("n"))
    asked = rows.where("id % 2 = 1").select(F.col("id").alias("query_id"), F.when(F.col("n") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("n").cast("string"))).alias("numbers"), (F.col("id") % 11 == 0).alias("addr_empty"))
    met = pass_a_candidates(spark, sf).join(rows.select(F.col("id").alias("query_id"), F.col("name").alias("q")), "query_id").join(rows.select(F.col("id").alias("s1_id"), F.col("name").alias("s")), "s1_id")
    alike = 100 * (1 - F.levenshtein("q", "s") / F.greatest(F.length("q"), F.length("s")))
    return pairing.residual_queries(asked, met.withColumn("name_ratio", alike))


# ------------------------------------------------------------------ the pair table
def _records(spark, sf):
    """Parts as records with normalised fields; odd ones ask, even ones answer."""
    name = F.lower("p_name")
    number = F.when(F.col("p_size") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")))
    rows = read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), name.alias("name_core"), F.replace(name, F.lit(" "), F.lit("")).alias("name_compact"),
        F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.concat_ws(" ", F.col("p_size"), F.lower("p_type"))).alias("addr_clean"), number.alias("numbers"),
    ).withColumn("num_keys", F.transform("numbers", text.num_key))
    return rows.where("id % 2 = 1").withColumnRenamed("id", "query_id"), rows.where("id % 2 = 0").withColumnRenamed("id", "s1_id")


def _pair_table(spark, sf):
    queries, s1 = _records(spark, sf)
    rows = pairing.pair_table(pass_a_candidates(spark, sf).select("query_id", "s1_id", "rank"), queries, s1)
    truth = queries.select("query_id", F.when(F.col("query_id") % 3 > 0, F.col("query_id") + 1).alias("true_s1"))
    return pairing.labelled(rows, truth, s1.select("s1_id", (F.col("s1_id") % 5).cast("int").alias("fold")))


@query()
def pair_table(spark, sf):
    """Pass A's candidates with every pair feature, the context and the label."""
    rows = _pair_table(spark, sf)
    return rows.withColumns({c: r6(c) for c, kind in rows.dtypes if kind == "double"}).withColumns({"xq": F.array_join("xq", " "), "xs": F.array_join("xs", " ")})


@query(f"""WITH {PASS_A}, rec AS (SELECT p_partkey AS id, lower(p_name) AS name, CASE WHEN p_size % 9 = 0 THEN [] ELSE [CAST(p_size AS VARCHAR), CAST(p_partkey % 7 AS VARCHAR)] END AS ns FROM part),
j AS (SELECT query_id, s1_id, q.name AS qn, s.name AS sn, q.ns AS qs, s.ns AS ss, coalesce(q.ns[1], '') AS a, coalesce(s.ns[1], '') AS b,
  list_transform(q.ns, lambda x: right('00' || x, 3)) AS qk, list_transform(s.ns, lambda x: right('00' || x, 3)) AS sk FROM pass_a JOIN rec q ON q.id = query_id JOIN rec s ON s.id = s1_id),
r AS (SELECT *, a <> '' AND b <> '' AS known, a <> '' AND b <> '' AND (starts_with(a, b) OR ends_with(a, b) OR starts_with(b, a) OR ends_with(b, a)) AS fits FROM j)
SELECT query_id, s1_id, a AS main_q, CAST(known AND a = b AS INTEGER) AS num_equal, CAST(fits AS INTEGER) AS num_compatible, CAST(known AND NOT fits AS INTEGER) AS num_conflict,
  CAST(CAST(a = '' AS INTEGER) + CAST(b = '' AS INTEGER) AS INTEGER) AS num_missing, CAST(len(list_intersect(qs, ss)) > 0 AS INTEGER) AS any_shared_number,
  CASE WHEN known THEN CAST(levenshtein(a, b) AS INTEGER) END AS num_edit, round(jaro_winkler_similarity(qn, sn), 6) AS name_jw,
  CASE WHEN len(qk) = 0 OR len(sk) = 0 THEN 0.0 ELSE round(len(list_intersect(qk, sk)) / least(len(qk), len(sk)), 6) END AS b_num_match,
  CAST(query_id % 3 > 0 AND s1_id = query_id + 1 AS INTEGER) AS label, CASE WHEN query_id % 3 > 0 THEN query_id + 1 ELSE -1 END AS q_true_s1, CAST(s1_id % 5 AS INTEGER) AS fold FROM r""")
def pair_table_numbers(spark, sf):
    """The pair table's number features, label and fold."""
    return _pair_table(spark, sf).select(
        "query_id", "s1_id", "main_q", "num_equal", "num_compatible", "num_conflict", "num_missing", "any_shared_number", "num_edit", r6("name_jw").alias("name_jw"), r6("b_num_match").alias("b_num_match"), "label", "q_true_s1", "fold"
    )


@query("""SELECT query_id, query_id // 1000 AS source, query_id % 1000 AS row FROM (SELECT o_orderkey AS query_id FROM orders)""")
def query_id_decode(spark, sf):
    """The source and the row that a query id is made of."""
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), *numbers.decoded(F.col("o_orderkey"), 1000))


# ------------------------------------------------------------------ scores and encodings
AGREES = "CASE num_q % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END"


@query(f"""WITH {SCORED}, m AS (SELECT *, 0.3 * name_tsort + 0.5 * coalesce(addr_tsort, name_tsort) + 0.2 * compat - 0.1 * least(extra_q, 3) / 3 AS plain, {AGREES} AS agree FROM scored)
SELECT query_id, s1_id, round(CASE WHEN conflict = 1 THEN -1 ELSE plain - CASE WHEN agree = 0 THEN 0.15 ELSE 0 END END, 6) AS with_major,
  round(plain - 0.3 * conflict, 6) AS with_conflict, round(plain - CASE WHEN agree = 0 THEN 0.15 ELSE 0 END - 0.3 * conflict, 6) AS with_both FROM m""")
def rule_score_modes(spark, sf):
    """The rule score with a penalty for disagreeing with the other claimants, and with one for conflicts instead of the veto."""
    rest = F.col("num_q") % 4
    agree = F.when(rest == 0, F.lit(None)).when(rest == 1, 0).otherwise(1)
    score = lambda **mode: r6(scoring.rule_score(F.col("name_tsort"), F.col("addr_tsort"), F.col("compat"), F.col("conflict"), F.col("extra_q"), **mode))
    return scored_pairs(spark, sf).select(
        "query_id", "s1_id", score(agree_major=agree, major_pen=0.15).alias("with_major"), score(conflict_pen=0.3).alias("with_conflict"), score(agree_major=agree, major_pen=0.15, conflict_pen=0.3).alias("with_both")
    )


@query(f"""WITH {WORDS}, lab AS (SELECT l_partkey AS id, max(CAST(l_returnflag = 'R' AS INTEGER)) AS label FROM lineitem GROUP BY 1),
rows_ AS (SELECT id, token, label, CAST(id % 5 AS INTEGER) AS fold FROM word_rows JOIN lab USING (id)), used AS (SELECT * FROM rows_ WHERE fold BETWEEN 1 AND 4 AND id % 3 > 0),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold), prior AS (SELECT f.fold, avg(CAST(1 - label AS DOUBLE)) AS prior FROM f JOIN used u ON u.fold <> f.fold GROUP BY 1),
vocab AS (SELECT f.fold, u.token, count(*) AS n, (sum(1 - label) + 20 * any_value(prior)) / (count(*) + 20) AS score FROM f JOIN prior USING (fold) JOIN used u ON u.fold <> f.fold GROUP BY ALL),
met AS (SELECT r.id, v.score AS own, coalesce(v.score, p.prior) AS score FROM rows_ r JOIN prior p ON p.fold = r.fold LEFT JOIN vocab v ON v.fold = r.fold AND v.token = r.token AND v.n >= 20)
SELECT l.id, round(max(score), 6) AS te_q_max, round(avg(score), 6) AS te_q_mean, round(coalesce(sum(score), 0), 6) AS te_q_sum, count(CASE WHEN m.id IS NOT NULL AND own IS NULL THEN 1 END) AS te_q_unseen
FROM lab l JOIN part_words w USING (id) LEFT JOIN met m ON m.id = l.id GROUP BY 1""")
def te_features(spark, sf):
    """A record's word encodings out of fold, fitted on claimants only (here by id), words of 20 occurrences or more being known."""
    label = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    rows = parts(spark, sf).select("id", F.array_distinct("words").alias("words")).join(label, "id").withColumn("fold", (F.col("id") % 5).cast("int"))
    each = rows.where("id % 3 > 0").select("fold", "label", F.explode("words").alias("token"))
    out = pairing.encoded(rows, "words", scoring.target_encoding(each), scoring.encoding_priors(each), "q", 20, ("id",))
    return out.select("id", *[r6(f"te_q_{c}").alias(f"te_q_{c}") for c in ("max", "mean", "sum")], "te_q_unseen")


# ------------------------------------------------------------------ learnt from records
@query(f"""WITH {WORDS}, w AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS a FROM part),
j AS (SELECT q.id, list_filter(q.a, lambda x: NOT list_contains(s.a, x)) AS u, list_filter(s.a, lambda x: NOT list_contains(q.a, x)) AS v FROM w q JOIN w s ON s.id = q.id + 1 WHERE q.id % 3 > 0),
z AS (SELECT unnest(list_zip(CASE WHEN id % 3 = 1 THEN u ELSE v END, CASE WHEN id % 3 = 1 THEN v ELSE u END)) AS p FROM j WHERE len(u) > 0 AND len(u) = len(v)),
n AS (SELECT p[1] AS x, p[2] AS y, count(*) AS support FROM z GROUP BY ALL), o AS (SELECT *, sum(support) OVER (PARTITION BY x) AS occ FROM n)
SELECT x, y, support, CAST(occ AS BIGINT) AS occ FROM o WHERE support >= 2 AND support / occ >= 0.05 QUALIFY row_number() OVER (PARTITION BY x ORDER BY support DESC, y) = 1""")
def cross_script_dictionary(spark, sf):
    """Words mined from pairs of which exactly one side is in another script: the query's for one third, the S1's for one, neither's for the rest."""
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("core"))
    other, latin = F.lit("हॉट"), F.lit("hôtel")
    pairs = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("core").alias("s_name_core")), "id").select(
        F.when(F.col("id") % 3 == 1, other).otherwise(latin).alias("q_business_name"), F.when(F.col("id") % 3 == 2, other).otherwise(latin).alias("s_business_name"),
        F.lit("").alias("q_business_address"), F.lit("").alias("s_business_address"), F.col("core").alias("q_name_core"), "s_name_core", F.lit("").alias("q_addr_clean"), F.lit("").alias("s_addr_clean"),
    )
    return blocking.mine_dictionary(pairing.cross_script_words(pairs), least=2, purity=0.05)


@query("""WITH a AS (SELECT CASE WHEN p_partkey % 8 = 0 THEN '' WHEN p_partkey % 8 = 1 THEN concat(p_name, ', ', p_type) ELSE concat(p_partkey, ' ', p_name, ', ', p_brand, ' ', CAST(p_partkey AS BIGINT) * 9973 % 10000019) END AS addr FROM part),
l AS (SELECT length(regexp_extract(addr, '(?:^|[ ,])([0-9]+)$', 1)) AS length FROM a WHERE addr <> '')
SELECT CAST(length AS INTEGER) AS length, count(*) AS n, (SELECT count(*) FROM l) AS total FROM l WHERE length >= 5 GROUP BY 1 HAVING count(*) >= 0.05 * (SELECT count(*) FROM l)""")
def postal_lengths(spark, sf):
    n, key = F.col("p_partkey") % 8, F.col("p_partkey")
    code = (key.cast("bigint") * 9973 % 10000019).cast("string")
    addr = F.when(n == 0, "").when(n == 1, F.concat_ws(", ", "p_name", "p_type")).otherwise(F.concat(key.cast("string"), F.lit(" "), "p_name", F.lit(", "), "p_brand", F.lit(" "), code))
    return pairing.learn_postal_lengths(read(spark, sf, "part").select(addr.alias("addr")), "addr")


@query("""WITH s AS (SELECT p_partkey AS s1_id, p_brand AS country, [lower(p_name), lower(p_type)] AS parts FROM part), c AS (SELECT DISTINCT country, unnest(parts) AS component FROM s),
g AS (SELECT country, word FROM (SELECT country, unnest(list_distinct(string_split(component, ' '))) AS word FROM c) GROUP BY ALL HAVING count(*) >= 12),
k AS (SELECT country, component, list_filter(string_split(component, ' '), lambda w: NOT list_contains(coalesce(ws, []), w)) AS kept FROM c LEFT JOIN (SELECT country, list(word) AS ws FROM g GROUP BY 1) USING (country)),
o AS (SELECT DISTINCT s.country, s1_id, CASE WHEN len(kept) = 0 THEN k.component ELSE array_to_string(kept, ' ') END AS key FROM (SELECT country, s1_id, unnest(parts) AS component FROM s) s JOIN k USING (country, component)),
f AS (SELECT country, key, count(*) AS n FROM o GROUP BY ALL), m AS (SELECT country, key FROM o JOIN f USING (country, key) QUALIFY row_number() OVER (PARTITION BY country, s1_id ORDER BY n DESC, key DESC) = 1),
t AS (SELECT country, key, count(*) AS top FROM m GROUP BY ALL)
SELECT country, key, n, coalesce(top, 0) AS top, n >= 8 AND coalesce(top, 0) >= 0.5 * n AS is_region FROM f LEFT JOIN t USING (country, key) WHERE n >= 2""")
def place_keys(spark, sf):
    s1 = read(spark, sf, "part").select(F.col("p_partkey").alias("s1_id"), F.col("p_brand").alias("country"), F.array(F.lower("p_name"), F.lower("p_type")).alias("parts"))
    return pairing.gazetteer(s1, generic=12, frequent=8)


# ------------------------------------------------------------------ tuning and finished parts
def _decided(spark, sf):
    rows = scoring.one_to_one(candidate_pairs(spark, sf), "base_score").select("s1_id", "query_id", F.col("base_score").alias("p"), (F.col("num_q") % 3 == 0).cast("int").alias("label"))
    return rows, rows.groupBy("s1_id").agg((F.sum("label") + F.col("s1_id") % 2).alias("n_true"))


@query(f"""WITH {PAIRS}, o AS (SELECT s1_id, base_score AS p, CAST(num_q % 3 = 0 AS INTEGER) AS label FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY base_score DESC, s1_id) = 1),
e AS (SELECT s1_id, sum(label) + s1_id % 2 AS n_true, max(p) AS best FROM o GROUP BY 1), t AS (SELECT round(0.2 + 0.025 * i, 3) AS t FROM range(0, 31) x(i)), m AS (SELECT 0.05 * i AS m FROM range(0, 5) y(i)),
c AS (SELECT e.s1_id, any_value(n_true) AS n_true, t, round(t + m, 3) AS k, count(CASE WHEN p >= t AND best >= round(t + m, 3) THEN 1 END) AS np, coalesce(sum(CASE WHEN p >= t AND best >= round(t + m, 3) THEN label END), 0) AS nh
  FROM e JOIN o USING (s1_id), t, m GROUP BY e.s1_id, t, k)
SELECT CAST(t AS DOUBLE) AS t_accept, CAST(k AS DOUBLE) AS t_keep, round(avg(CASE WHEN n_true = 0 THEN CAST(np = 0 AS DOUBLE) WHEN np = 0 OR nh = 0 THEN 0.0 ELSE 1.25 * nh / (np + 0.25 * n_true) END), 6) AS macro_f05 FROM c GROUP BY ALL""")
def threshold_grid(spark, sf):
    return pairing.threshold_grid(*_decided(spark, sf))


@query()
def decoder_grid(spark, sf):
    return pairing.decoder_grid(*_decided(spark, sf))


@query(f"""WITH {ENTITIES}, c AS (SELECT s1_id, list_distinct(list(concat('S', CASE WHEN query_id % 50 = 0 THEN 1 ELSE 2 END, '-', query_id))) AS ids FROM pred GROUP BY 1),
m AS (SELECT s1_id, list(concat('S', CASE WHEN query_id % 50 = 0 THEN 1 ELSE 2 END, '-', query_id)) AS ids FROM truth GROUP BY 1),
r AS (SELECT coalesce(m.s1_id, c.s1_id) AS s1_id, coalesce(m.ids, []) AS matches, coalesce(c.ids, []) AS candidates FROM m FULL JOIN c ON m.s1_id = c.s1_id)
SELECT 'repeated_match' AS finding, 0 AS rows UNION ALL SELECT 'repeated_candidate', 0 UNION ALL SELECT 'repeated_key', 0
UNION ALL SELECT 'match_not_candidate', (SELECT count(*) FROM r WHERE len(list_filter(matches, lambda x: NOT list_contains(candidates, x))) > 0)
UNION ALL SELECT 'wrong_prefix', (SELECT count(*) FROM r WHERE len(list_filter(matches || candidates, lambda x: starts_with(x, 'S1-'))) > 0)
UNION ALL SELECT 'missing_key', (SELECT count(*) FROM ent WHERE s1_id NOT IN (SELECT s1_id FROM r)) UNION ALL SELECT 'stray_key', (SELECT count(*) FROM r WHERE s1_id NOT IN (SELECT s1_id FROM ent))""")
def assembly_report(spark, sf):
    """Two parts put together and checked: keys, lists, and matches against candidates."""
    entities, truth, predicted = truth_tables(spark, sf)
    ident = F.concat(F.when(F.col("query_id") % 50 == 0, "S1-").otherwise("S2-"), F.col("query_id").cast("string"))
    lists = lambda df, name: df.select("s1_id", ident.alias("id")).distinct().groupBy("s1_id").agg(F.collect_list("id").alias(name))
    whole = lists(truth, "matches").join(lists(predicted, "candidates"), "s1_id", "full")
    rows = pairing.assembled([whole.where("s1_id % 2 = 0"), whole.where("s1_id % 2 = 1")])
    return pairing.assembly_report(rows, entities)


@query(f"""WITH {ENTITIES} SELECT country, count(*) AS s1, CAST(sum(p) AS BIGINT) AS queries, round(sum(p) / count(*), 3) AS queries_per_s1, CAST(sum(u) AS BIGINT) AS unmatched FROM (
  SELECT e.s1_id, e.country, (SELECT count(*) FROM pred p WHERE p.s1_id = e.s1_id) AS p, (SELECT count(*) FROM pred p WHERE p.s1_id = e.s1_id AND p.query_id NOT IN (SELECT query_id FROM truth)) AS u FROM ent e) GROUP BY 1""")
def realism_report(spark, sf):
    """Per partition its S1 records, the queries they get, and how many of these have no true S1."""
    entities, truth, predicted = truth_tables(spark, sf)
    return evaluation.realism(entities, predicted.distinct(), truth.select("query_id").distinct())
