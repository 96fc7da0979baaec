"""Reports on folds, decoys, missed pairs, coverage and thresholds. Every report is one or two aggregations of its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recolink.operators.evaluation import f05


def _r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def _share(flag: Column) -> Column:
    return _r(F.avg(F.coalesce(flag, F.lit(False)).cast("double")))


def fold_metrics(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """Macro figures per fold, from entity scores. An entity without prediction has precision 1, one without truth recall 1."""
    n, k, t = F.col("n_true"), F.col("n_pred"), F.col("n_hit")
    return scored.groupBy(fold).agg(
        F.count(F.lit(1)).alias("entities"), _r(F.avg("f")).alias("macro_f05"),
        _r(F.avg(F.when(k == 0, 1.0).otherwise(t / k))).alias("precision"), _r(F.avg(F.when(n == 0, 1.0).otherwise(t / n))).alias("recall"),
        _r(F.avg(k)).alias("pred_per_s1"), _share(k == 0).alias("empty_share"), _share(n == 0).alias("singleton_share"),
        _r(F.coalesce(F.avg(F.when(n == 0, F.col("f"))), F.lit(1.0))).alias("f05_singletons"),
        _r(F.coalesce(F.avg(F.when(n > 0, F.col("f"))), F.lit(1.0))).alias("f05_non_singletons"),
    )


def fold_balance(entities: DataFrame, part: str = "country", rate_gap: float = 0.002, mean_gap: float = 0.01) -> DataFrame:
    """Train against val, per partition and over all (null): singleton rates, mean matches, and whether they are close enough.

    entities: part, fold (train or val), n_matches. Without rows of a fold its figures are null, and so is ``balanced``.
    """
    side = lambda name, value: F.avg(F.when(F.col("fold") == name, value))
    single, n = (F.col("n_matches") == 0).cast("double"), F.col("n_matches").cast("double")
    rows = entities.groupingSets([[part], []], part).agg(
        F.count_if(F.col("fold") == "train").alias("train"), F.count_if(F.col("fold") == "val").alias("val"),
        _r(side("train", single)).alias("rate_train"), _r(side("val", single)).alias("rate_val"),
        _r(side("train", n)).alias("mean_train"), _r(side("val", n)).alias("mean_val"),
    )
    return rows.withColumn("balanced", (F.abs(F.col("rate_train") - F.col("rate_val")) <= rate_gap) & (F.abs(F.col("mean_train") - F.col("mean_val")) <= mean_gap))


def assert_balanced(entities: DataFrame, part: str = "country", **gaps: float) -> None:
    """Fails if train and val differ by more than the tolerances anywhere."""
    off = fold_balance(entities, part, **gaps).where("NOT balanced").limit(1).collect()
    if off:
        raise ValueError(f"train and val are not balanced: {off[0]}")


def decoy_rates(pairs: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rates of features among true pairs and among decoys.

    A decoy is the best pair of a query that matches nobody, where its score reaches the threshold.
    pairs: query_id, s1_id, label, unmatched (the query matches nobody), equal, compat, conflict, extra.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "s1_id"))
    rows = pairs.withColumn("__rank", rank)
    kind = F.when(F.col("label") == 1, "true_pairs").when(F.col("unmatched") & (F.col("__rank") == 1) & (F.col(score) >= threshold), "accepted_decoys")
    rows = rows.withColumn("kind", kind).where(F.col("kind").isNotNull())
    percent = lambda flag: F.round(100 * F.avg(flag.cast("double")), 4)
    extra = F.col("extra") > 0
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("pairs"), percent(F.col("equal") == 1).alias("num_equal"), percent(F.col("compat") == 1).alias("num_compatible"),
        percent(F.col("conflict") == 1).alias("num_conflict"), percent(extra).alias("extra_words"), percent((F.col("conflict") == 1) | extra).alias("conflict_or_extra"),
    )


def missed_pairs(pairs: DataFrame, p: str = "p") -> DataFrame:
    """True pairs that were not selected, by where they got lost, with the number and the median of p.

    Lost by the decoder though the query's best; to another S1 that was selected; to another S1 that was not.
    pairs: query_id, s1_id, label, kept (the query's best pair), selected.
    """
    elsewhere = F.max(F.col("selected").cast("int")).over(Window.partitionBy("query_id")) == 1
    bucket = F.when(F.col("kept"), "decoder").when(F.col("__elsewhere"), "other_s1_selected").otherwise("other_s1_unselected")
    rows = pairs.withColumn("__elsewhere", elsewhere).where((F.col("label") == 1) & ~F.col("selected"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pairs"), _r(F.percentile(p, 0.5)).alias("median_p"), _r(F.avg(p)).alias("mean_p"))


def run_gap(s1: DataFrame, pairs: DataFrame, part: str = "country", p: str = "p") -> DataFrame:
    """Signs of a run that differs from another, per partition: predictions per S1, empty S1, undecided queries, best p of an S1.

    s1: s1_id and the partition; pairs: query_id, s1_id, p, kept, selected. An S1 without pairs has a best p of 0.
    """
    kept = lambda flag: F.count_if(F.col("kept") & flag)
    each = pairs.groupBy("s1_id").agg(
        F.max(p).alias("best"), F.count_if("selected").alias("n_pred"), F.count_if("kept").alias("n_kept"), kept((F.col(p) >= 0.3) & (F.col(p) < 0.7)).alias("n_undecided"),
    )
    rows = s1.select("s1_id", part).join(each, "s1_id", "left").na.fill(0)
    best = F.col("best")
    return rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("s1"), _r(F.avg("n_pred")).alias("pred_per_s1"), _share(F.col("n_pred") == 0).alias("empty_share"),
        _r(F.sum("n_pred") / F.nullif(F.sum("n_kept"), F.lit(0))).alias("assigned_share"), _r(F.sum("n_undecided") / F.nullif(F.sum("n_kept"), F.lit(0))).alias("undecided_share"),
        _r(F.percentile("best", 0.1)).alias("best_q10"), _r(F.percentile("best", 0.5)).alias("best_median"),
        _share(best < 0.3).alias("best_lt_03"), _share((best >= 0.3) & (best < 0.7)).alias("best_03_07"), _share(best >= 0.9).alias("best_ge_09"),
    )


def tune_thresholds(entities: DataFrame, pairs: DataFrame, accepts: list[float], deltas: list[float], p: str = "p") -> DataFrame:
    """t_accept, t_keep and macro F0.5 of every combination, from one aggregation of the pairs by S1.

    entities: s1_id, n_true; pairs: the one-to-one pairs with p and label. An S1 keeps its pairs from t_accept on if its
    best one reaches t_keep = t_accept + delta.
    """
    counts = [c for i, t in enumerate(accepts) for c in (
        F.count_if(F.col(p) >= t).alias(f"k{i}"), F.count_if((F.col(p) >= t) & (F.col("label") == 1)).alias(f"t{i}"),
    )]
    each = pairs.groupBy("s1_id").agg(F.max(p).alias("best"), *counts)
    rows = entities.join(each, "s1_id", "left").na.fill(0)
    cells = []
    for i, t in enumerate(accepts):
        for d in deltas:
            holds = F.col("best") >= round(t + d, 6)
            k, hit = F.when(holds, F.col(f"k{i}")).otherwise(0), F.when(holds, F.col(f"t{i}")).otherwise(0)
            cells.append(F.avg(f05(F.col("n_true"), k, hit)).alias(f"f{i}_{len(cells)}"))
    whole = rows.agg(*cells)
    grid = [(t, round(t + d, 6)) for t in accepts for d in deltas]
    return whole.select(F.explode(F.array(*[F.struct(F.lit(a).alias("t_accept"), F.lit(b).alias("t_keep"), _r(F.col(c)).alias("macro_f05")) for (a, b), c in zip(grid, whole.columns)])).alias("x")).select("x.*")


def tune_union_weight(truth: DataFrame, pairs: DataFrame, weights: list[float], a: str, c: str, k: int = 5) -> DataFrame:
    """weight and recall at k of c + weight * a, all weights in one aggregation. A true pair that is no candidate is missed.

    truth: query_id, s1_id (one S1 per query); pairs: query_id, s1_id, a, c. A true pair is found if fewer than k pairs
    of its query are ahead of it (ties to the smaller S1).
    """
    own = truth.join(pairs.select("query_id", "s1_id", F.col(a).alias("__a"), F.col(c).alias("__c")), ["query_id", "s1_id"], "left")
    met = own.join(pairs.select("query_id", F.col("s1_id").alias("__o"), F.col(a).alias("__oa"), F.col(c).alias("__oc")), "query_id", "left")
    ahead = []
    for i, w in enumerate(weights):
        mine, other = _r(F.col("__c") + w * F.col("__a")), _r(F.col("__oc") + w * F.col("__oa"))
        ahead.append(F.count_if((other > mine) | ((other == mine) & (F.col("__o") < F.col("s1_id")))).alias(f"n{i}"))
    each = met.groupBy("query_id", "s1_id").agg(F.max(F.col("__c").isNotNull()).alias("known"), *ahead)
    whole = each.agg(*[_share(F.col("known") & (F.col(f"n{i}") < k)).alias(f"r{i}") for i in range(len(weights))])
    return whole.select(F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"r{i}").alias("recall")) for i, w in enumerate(weights)])).alias("x")).select("x.*")


def count_bucket(n: Column) -> Column:
    """0 to 7 as they are, then 8-9, 10-11 and 12+."""
    return F.when(n >= 12, "12+").when(n >= 10, "10-11").when(n >= 8, "8-9").otherwise(n.cast("string"))


def list_sizes(entities: DataFrame, pairs: DataFrame, key: str = "s1_id") -> DataFrame:
    """How many entities have lists of which size; entities without pairs count as 0."""
    sizes = entities.select(key).join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").na.fill(0, ["n"])
    return sizes.groupBy(count_bucket(F.col("n")).alias("size")).agg(F.count(F.lit(1)).alias("entities"))


def sizes_per_source(entities: DataFrame, pairs: DataFrame, sources: list[str], key: str = "s1_id", source: str = "source") -> DataFrame:
    """Distribution of each source's number of matches per entity, zeros too: source, n, entities."""
    each = pairs.groupBy(key).agg(*[F.count_if(F.col(source) == s).alias(s) for s in sources])
    rows = entities.select(key).join(each, key, "left").na.fill(0, sources)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("n")) for s in sources])).alias("x")).select("x.*")
    return long.groupBy("source", "n").agg(F.count(F.lit(1)).alias("entities"))


def audit_pairs(pairs: DataFrame, entities: DataFrame, others: DataFrame, part: str = "country") -> DataFrame:
    """Predicted pairs per partition of their S1: unknown ids, other partitions, ids used twice, and coverage of the other side.

    pairs: s1_id, query_id; entities: s1_id and the partition; others: query_id and the partition.
    """
    theirs = others.select("query_id", F.col(part).alias("__part"))
    rows = pairs.join(entities.select("s1_id", part), "s1_id").join(theirs, "query_id", "left")
    uses = rows.withColumn("__uses", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    found = uses.groupBy(part).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("__part").isNull()).alias("unknown_ids"),
        F.count_if(F.col("__part") != F.col(part)).alias("other_part"), F.count_if(F.col("__uses") > 1).alias("used_twice"),
    )
    used = others.join(pairs.select("query_id").distinct().withColumn("__used", F.lit(True)), "query_id", "left")
    covered = used.groupBy(part).agg(F.count(F.lit(1)).alias("others"), _share(F.col("__used")).alias("coverage"))
    return covered.join(found, part, "left").na.fill(0, ["pairs", "unknown_ids", "other_part", "used_twice"])


def coverage_check(required: DataFrame, passes: dict[str, DataFrame], key: str = "query_id") -> DataFrame:
    """How often required keys are covered by the given tables together: times (0, 1, ...), keys. Exactly once is one row."""
    seen = None
    for name, df in passes.items():
        one = df.select(key).distinct().withColumn("__pass", F.lit(name))
        seen = one if seen is None else seen.unionByName(one)
    times = required.select(key).distinct().join(seen.groupBy(key).agg(F.count(F.lit(1)).alias("times")), key, "left").na.fill(0, ["times"])
    return times.groupBy("times").agg(F.count(F.lit(1)).alias("keys"))


def query_roles(queries: DataFrame, truth: DataFrame, split: DataFrame, distractors: int) -> DataFrame:
    """queries with their role: val or train by the fold of their S1, or distractor (the first so many others by MD5).

    truth: s1_id, query_id; split: s1_id, fold. Other queries are left out.
    """
    owned = truth.join(split, "s1_id").groupBy("query_id").agg(F.max("fold").alias("role"))
    rows = queries.join(owned, "query_id", "left")
    rest = rows.where(F.col("role").isNull()).orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(distractors).withColumn("role", F.lit("distractor"))
    return rows.where(F.col("role").isNotNull()).unionByName(rest)


def voted_region(records: DataFrame, votes: DataFrame, ident: str, key: str, value: str) -> DataFrame:
    """The value that a record's keys vote for, each with the weight n it was learnt with (ties to the greater value)."""
    met = records.join(votes.select(key, F.col(value).alias("__v"), "n"), key)
    total = met.groupBy(ident, "__v").agg(F.sum("n").alias("votes"))
    best = total.groupBy(ident).agg(F.max(F.struct("votes", "__v")).alias("b"))
    return best.select(ident, F.col("b.__v").alias(value), F.col("b.votes").alias("votes"))


def joined_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns, one to one: a missing key fails the job, and so does one that either side repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    a = left.withColumn("__a", n)
    b = right.withColumn("__b", n)
    out = a.join(b, key, "left")
    bad = F.col("__b").isNull() | (F.col("__a") > 1) | (F.col("__b") > 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not one to one at "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return out.where(checked).drop("__a", "__b")


def closest_sibling(decoys: DataFrame, matched: DataFrame, similarity) -> DataFrame:
    """For each wrongly accepted pair the true query of the same S1 that resembles its query most: query_id, s1_id, sibling, combo, same_source.

    decoys and matched: query_id, s1_id, name, addr, source. The greatest similarity wins, then the smaller sibling.
    The pairs are reduced in the same stage that makes them, so only one row per decoy and task is shuffled.
    """
    other = matched.select("s1_id", *[F.col(c).alias(f"o_{c}") for c in ("query_id", "name", "addr", "source")])
    met = decoys.join(other, "s1_id").where(F.col("query_id") != F.col("o_query_id"))
    combo = (similarity("name", "o_name") + similarity("addr", "o_addr")) / 2
    best = met.withColumn("combo", combo).groupBy("query_id", "s1_id").agg(
        F.max(F.struct("combo", (-F.col("o_query_id")).alias("o"), (F.col("source") == F.col("o_source")).alias("same"))).alias("b"), F.count(F.lit(1)).alias("siblings")
    )
    return best.select("query_id", "s1_id", (-F.col("b.o")).alias("sibling"), _r(F.col("b.combo")).alias("combo"), F.col("b.same").alias("same_source"), "siblings")


def rescue(pairs: DataFrame, similarity, least_p: float = 0.3, least_similarity: float = 0.9) -> DataFrame:
    """Unselected best pairs to add: their S1 has a selected match with a compatible number that they resemble.

    pairs: query_id, s1_id, p, kept, selected, name, addr, number (null: none). Similarity is the lesser of name's and address's.
    """
    open_pairs = pairs.where(F.col("kept") & ~F.col("selected") & (F.col("p") >= least_p)).select("query_id", "s1_id", "p", "name", "addr", "number")
    mates = pairs.where("selected").select("s1_id", *[F.col(c).alias(f"o_{c}") for c in ("query_id", "name", "addr", "number")])
    agree = F.col("number").isNull() | F.col("o_number").isNull() | (F.col("number") == F.col("o_number"))
    met = open_pairs.join(mates, "s1_id").where(agree)
    best = met.groupBy("query_id", "s1_id", "p").agg(_r(F.max(F.least(similarity("name", "o_name"), similarity("addr", "o_addr")))).alias("similarity"))
    return best.where(F.col("similarity") >= least_similarity)
