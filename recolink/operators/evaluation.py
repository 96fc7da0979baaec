"""Metrics, error attribution, sampling and output checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05(true: Column, predicted: Column, hits: Column) -> Column:
    """F0.5 of one entity; without truth, 1 for an empty prediction and 0 else."""
    return (
        F.when(true == 0, (predicted == 0).cast("double"))
        .when((predicted == 0) | (hits == 0), F.lit(0.0))
        .otherwise(1.25 * hits / (predicted + 0.25 * true))
    )


def entity_scores(entities: DataFrame, truth: DataFrame, predicted: DataFrame, key: str = "s1_id", member: str = "query_id") -> DataFrame:
    """entities with n_true, n_pred, n_hit and f. Missing predictions are empty; keys that are no entities are ignored."""
    rows = truth.select(key, member, F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(predicted.select(key, member, F.lit(0).alias("t"), F.lit(1).alias("p")))
    pairs = rows.groupBy(key, member).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = pairs.groupBy(key).agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.col("t") * F.col("p")).alias("n_hit"))
    out = entities.join(counts, key, "left").na.fill(0, ["n_true", "n_pred", "n_hit"])
    return out.withColumn("f", f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")))


def macro_f05(scored: DataFrame) -> DataFrame:
    return scored.agg(F.round(F.avg("f"), 6).alias("macro_f05"), F.count(F.lit(1)).alias("entities"))


def breakdown(scored: DataFrame, part: str = "country") -> DataFrame:
    """Macro figures per partition and over all (null partition), in one aggregation by grouping sets."""
    micro = lambda a, b: F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6)
    return scored.groupingSets([[part], []], part).agg(
        F.count(F.lit(1)).alias("entities"), F.round(F.avg("f"), 6).alias("macro_f05"),
        micro("n_hit", "n_pred").alias("precision"), micro("n_hit", "n_true").alias("recall"),
    )


def error_budget(entities: DataFrame) -> DataFrame:
    """Losses by cause, from n_true, n_pred, n_hit, n_found (true pairs among the candidates), fp_decoy and fp_other per entity."""
    t, n, k = F.col("n_hit"), F.col("n_true"), F.col("n_pred")
    clean = F.when(t > 0, 1.25 * t / (t + 0.25 * n)).otherwise(F.lit(0.0))
    fp, missed = F.greatest(F.col("fp_decoy") + F.col("fp_other"), F.lit(1)), F.greatest(n - t, F.lit(1))
    rows = entities.withColumn("f", f05(n, k, t))
    share = lambda x: F.when(n > 0, x).otherwise(F.lit(0.0))
    parts = {
        "singleton_nonempty": F.when((n == 0) & (k > 0), 1.0).otherwise(0.0),
        "fp_decoy_loss": share((clean - F.col("f")) * F.col("fp_decoy") / fp),
        "fp_other_loss": share((clean - F.col("f")) * F.col("fp_other") / fp),
        "fn_blocking_loss": share((1 - clean) * (n - F.col("n_found")) / missed),
        "fn_scoring_loss": share((1 - clean) * (F.col("n_found") - t) / missed),
    }
    return rows.agg(*[F.round(F.avg(v), 6).alias(c) for c, v in parts.items()], F.round(1 - F.avg("f"), 6).alias("total"))


def recall_at(truth: DataFrame, candidates: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of true pairs among the candidates, over all and within each rank; candidates have one row per pair."""
    found = truth.join(candidates.select("query_id", "s1_id", "rank"), ["query_id", "s1_id"], "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return found.agg(F.count(F.lit(1)).alias("pairs"), share(F.col("rank").isNotNull()).alias("recall"), *[share(F.col("rank") <= c).alias(f"recall_{c}") for c in cuts])


def stratified_split(rows: DataFrame, strata: list[str], key: str, share: float) -> DataFrame:
    """fold val or train: in each stratum the given share in the order of the id's MD5."""
    w = Window.partitionBy(*strata)
    rank = F.row_number().over(w.orderBy(F.md5(F.col(key).cast("string")), key))
    return rows.withColumn("fold", F.when(rank <= F.floor(F.count(F.lit(1)).over(w) * share + 0.5), "val").otherwise("train"))


def sample_regions(records: DataFrame, part: str, region: str, share: float, folds: int) -> DataFrame:
    """Whole regions in hash order until a share of the partition's records is drawn; each gets a fold in turn."""
    sizes = records.groupBy(part, region).agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(part).orderBy(F.md5(F.col(region).cast("string")), region)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sizes.withColumns({"before": before, "total": F.sum("size").over(Window.partitionBy(part)), "fold": (F.row_number().over(order) - 1) % folds})
    return rows.where(F.col("before") < share * F.col("total")).select(part, region, "size", "fold")


def pure_votes(votes: DataFrame, key: str, value: str, least: int = 5, purity: float = 0.9) -> DataFrame:
    """The value a key stands with most, for keys that occur at least so often and whose value is pure enough. Ties go to the greatest value."""
    counts = votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.max(F.struct(F.col("n"), F.col(value))).alias("b"), F.sum("n").alias("total"))
    return best.where((F.col("total") >= least) & (F.col("b.n") >= purity * F.col("total"))).select(key, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"), "total")


def validate_submission(required: DataFrame, listed: DataFrame, known: DataFrame, key: str = "s1_id", member: str = "ids") -> DataFrame:
    """finding and rows: repeated, missing and stray keys, ids repeated in a list, ids in two lists, unknown ids."""
    ids = listed.select(key, F.explode(F.filter(F.split(member, ","), lambda x: x != "")).alias("id"))
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("finding"), "rows")
    checks = [
        count("repeated_key", listed.groupBy(key).count().where("count > 1")),
        count("missing_key", required.join(listed, key, "left_anti")),
        count("stray_key", listed.join(required, key, "left_anti")),
        count("repeated_id_in_list", ids.groupBy(key, "id").count().where("count > 1")),
        count("id_in_two_lists", ids.groupBy("id").agg(F.count_distinct(key).alias("n")).where("n > 1")),
        count("unknown_id", ids.join(known, "id", "left_anti")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two sets of (s1_id, query_id) pairs: shared, only in one, and intersection over union."""
    both = a.select("s1_id", "query_id").distinct().withColumn("a", F.lit(1)).join(b.select("s1_id", "query_id").distinct().withColumn("b", F.lit(1)), ["s1_id", "query_id"], "full")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
        F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count(F.lit(1)), 6).alias("jaccard"),
    )


def realism(entities: DataFrame, asked: DataFrame, matched: DataFrame, part: str = "country") -> DataFrame:
    """Per partition: s1 records, queries that were dealt to them, queries per S1, and queries that have no true S1. asked: s1_id, query_id; matched: query_id."""
    flags = asked.join(matched.withColumn("__m", F.lit(1)), "query_id", "left")
    own = flags.groupBy("s1_id").agg(F.count(F.lit(1)).alias("__q"), F.count_if(F.col("__m").isNull()).alias("__u"))
    rows = entities.join(own, "s1_id", "left").na.fill(0, ["__q", "__u"])
    return rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("s1"), F.sum("__q").alias("queries"), F.round(F.sum("__q") / F.count(F.lit(1)), 3).alias("queries_per_s1"), F.sum("__u").alias("unmatched")
    )


def histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts of equal bins over [0, 1], the last one closed."""
    return rows.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
