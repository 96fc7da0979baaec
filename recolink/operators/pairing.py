"""The pair table, its labels and word encodings, what is learnt from true pairs, and the checks of finished parts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from recolink.functions import kernels, numbers, text
from recolink.operators import features
from recolink.operators.blocking import merged
from recolink.operators.evaluation import f05
from recolink.operators.scoring import best_prefix

TEXTS = ["name_core", "name_compact", "addr_clean", "numbers", "num_keys"]


def pair_table(candidates: DataFrame, queries: DataFrame, s1: DataFrame) -> DataFrame:
    """candidates (query_id, s1_id and any others) with similarities, baseline similarities, number features, extra words and context.

    queries and s1 have their id and TEXTS (the last two are arrays). Two equi-joins by id; kernels run once a pair.
    """
    side = lambda df, ident, p: df.select(ident, *[F.col(c).alias(f"{p}_{c}") for c in TEXTS])
    rows = candidates.join(merged(side(queries, "query_id", "q")), "query_id").join(merged(side(s1, "s1_id", "s")), "s1_id")
    bare = lambda c: text.strip_digits(F.coalesce(c, F.lit("")))
    rows = rows.withColumn("__sim", kernels.pair_similarities("q_name_core", "s_name_core", bare(F.col("q_addr_clean")), bare(F.col("s_addr_clean"))))
    rows = rows.select("*", "__sim.*").drop("__sim")
    whole = kernels.pairwise(kernels.token_set_ratio)
    missing = (F.col("q_addr_clean") == "") | (F.col("s_addr_clean") == "")
    made = numbers.number_features(F.col("q_numbers"), F.col("s_numbers"))
    rows = rows.withColumns(made).withColumns({
        "addr_empty_any": F.col("addr_tsort").isNull().cast("int"),
        "xq": kernels.extra_word_list("q_name_core", "s_name_core"),
        "xs": kernels.extra_word_list("s_name_core", "q_name_core"),
        "b_name_sim": F.greatest("name_tset", "name_compact_ratio"),
        "b_addr_sim": F.when(missing, F.lit(0.0)).otherwise(whole("q_addr_clean", "s_addr_clean") / 100),
        "b_num_match": numbers.num_match(F.col("q_num_keys"), F.col("s_num_keys")),
        "name_len_q": text.word_count(F.col("q_name_core")), "name_len_s1": text.word_count(F.col("s_name_core")),
        "main_q": F.coalesce(numbers.main_number(F.col("q_numbers")), F.lit("")),
        "base_score": 0.5 * F.col("name_tsort") + 0.5 * F.coalesce("addr_tsort", F.lit(0.0)),
    })
    rows = rows.withColumns({"extra_q": F.size("xq"), "extra_s1": F.size("xs")})
    return features.context_features(rows).drop(*[f"{p}_{c}" for p in "qs" for c in TEXTS])


def labelled(pairs: DataFrame, truth: DataFrame, folds: DataFrame) -> DataFrame:
    """pairs with label (1 if the query's true S1 is the pair's), q_true_s1 (-1: none) and the S1's fold; truth: query_id, true_s1; folds: s1_id, fold."""
    rows = pairs.join(merged(truth.select("query_id", F.col("true_s1").alias("q_true_s1"))), "query_id", "left").join(merged(folds.select("s1_id", "fold")), "s1_id", "left")
    return rows.withColumns({"label": F.coalesce((F.col("q_true_s1") == F.col("s1_id")).cast("int"), F.lit(0)), "q_true_s1": F.coalesce("q_true_s1", F.lit(-1).cast("long"))})


def encoded(rows: DataFrame, words: str, vocabulary: DataFrame, priors: DataFrame, prefix: str, least: int = 1, keys: tuple[str, ...] = ("query_id", "s1_id"), fold: str = "fold", folds: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """rows with te_<prefix>_max, _mean, _sum and _unseen of a column of words, each occurrence counted.

    vocabulary (fold, token, n, score) and priors (fold, prior; one row for each) are those of target_encoding. Rows of
    other folds use that of fold 0. A word that is unknown or has under ``least`` occurrences scores the prior. Rows
    without words have null, null, 0 and 0.
    """
    of = F.when(F.col(fold).isin(*folds), F.col(fold)).otherwise(0)
    known = vocabulary.where(F.col("n") >= least).select(F.col(fold).alias("__f"), "token", "score")
    prior = priors.select(F.col(fold).alias("__f"), "prior")
    each = rows.select(*keys, of.alias("__f"), F.explode(words).alias("token")).join(known, ["__f", "token"], "left").join(F.broadcast(prior), "__f", "left")
    score = F.coalesce("score", "prior")
    said = each.groupBy(*keys).agg(
        F.max(score).alias(f"te_{prefix}_max"), F.avg(score).alias(f"te_{prefix}_mean"), F.sum(score).alias(f"te_{prefix}_sum"), F.count_if(F.col("score").isNull()).alias(f"te_{prefix}_unseen")
    )
    return rows.join(said, list(keys), "left").na.fill(0, [f"te_{prefix}_sum", f"te_{prefix}_unseen"])


def residual_queries(queries: DataFrame, candidates: DataFrame, best: str = "name_ratio", least: int = 3, ratio: float = 60.0) -> DataFrame:
    """query_id of those that pass A hasn't settled: few candidates, no numbers, no address, or no candidate whose name is alike.

    queries: query_id, numbers (array), addr_empty; candidates: query_id and the names' ratio (to 100).
    """
    seen = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"), F.max(best).alias("__best"))
    rows = queries.join(seen, "query_id", "left")
    few = F.coalesce("__n", F.lit(0)) < least
    return rows.where(few | (F.size("numbers") == 0) | F.col("addr_empty") | (F.coalesce("__best", F.lit(0.0)) < ratio)).select("query_id")


# ------------------------------------------------------------------ learnt from records and true pairs
def cross_script_words(pairs: DataFrame) -> DataFrame:
    """x, y: words of the other script beside Latin ones, from true pairs of which exactly one side is in another script.

    pairs: q_ and s_ business_name, business_address, name_core and addr_clean. Names give the words that only one
    side has, if both have as many; addresses those of the best matching components.
    """
    other = lambda p: text.beyond_latin(F.col(f"{p}_business_name")) | text.beyond_latin(F.col(f"{p}_business_address"))
    rows = pairs.fillna("", [f"{p}_{c}" for p in "qs" for c in ("business_name", "business_address", "name_core", "addr_clean")])
    rows = rows.withColumns({"__q": other("q"), "__s": other("s")}).where(F.col("__q") != F.col("__s"))
    pick = lambda own, c: F.when(F.col("__q") == own, F.col(f"q_{c}")).otherwise(F.col(f"s_{c}"))
    words = F.concat(kernels.aligned_tokens(pick(True, "name_core"), pick(False, "name_core")), kernels.aligned_components(pick(True, "addr_clean"), pick(False, "addr_clean")))
    return rows.select(F.explode(words).alias("w")).select("w.x", "w.y")


def learn_postal_lengths(records: DataFrame, address: str, min_len: int = 5, share: float = 0.05) -> DataFrame:
    """length, n, total: digit lengths that end the last address component in at least a share of the records with an address."""
    rows = records.where(F.col(address) != "")
    last = F.regexp_extract(address, r"(?:^|[\s,])([0-9]+)\s*$", 1)
    size = F.when(F.length(last) >= min_len, F.length(last))
    counts = rows.groupBy(size.alias("length")).agg(F.count(F.lit(1)).alias("n"))  # one row per length
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).where(F.col("length").isNotNull() & (F.col("n") >= share * F.col("total")))


def gazetteer(s1: DataFrame, parts: str = "parts", part: str = "country", generic: int = 150, frequent: int = 500, top_share: float = 0.5, least: int = 2) -> DataFrame:
    """(partition, key, n, top, is_region): place keys of records, from the digit-free components of their addresses (an array).

    Words in at least ``generic`` distinct components of a partition are left out of the keys, unless nothing else is in
    them. A key is a region if ``frequent`` records have it and it is the commonest key (ties to the greatest) of a
    share of these; others are kept from ``least`` records on.
    """
    distinct = s1.select(part, F.explode(parts).alias("component")).distinct()
    words = distinct.select(part, F.explode(F.array_distinct(F.split("component", " "))).alias("word")).groupBy(part, "word").agg(F.count(F.lit(1)).alias("__n"))
    plain = words.where(F.col("__n") >= generic).select(part, "word", F.lit(True).alias("__generic"))
    spelled = distinct.select(part, "component", F.posexplode(F.split("component", " ")).alias("__at", "word")).join(plain, [part, "word"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("__generic").isNull(), F.struct("__at", "word"))))  # a component's own words
    keys = spelled.groupBy(part, "component").agg(kept.alias("__w")).select(part, "component", F.when(F.size("__w") > 0, F.array_join("__w.word", " ")).otherwise(F.col("component")).alias("key"))
    own = s1.select(part, "s1_id", F.explode(parts).alias("component")).join(keys, [part, "component"]).select(part, "s1_id", "key").distinct()
    freq = own.groupBy(part, "key").agg(F.count(F.lit(1)).alias("n"))
    first = own.join(freq, [part, "key"]).groupBy(part, "s1_id").agg(F.max(F.struct("n", "key")).alias("m"))
    top = first.groupBy(part, F.col("m.key").alias("key")).agg(F.count(F.lit(1)).alias("top"))
    out = freq.join(top, [part, "key"], "left").na.fill(0, ["top"])
    region = (F.col("n") >= frequent) & (F.col("top") >= top_share * F.col("n"))
    return out.withColumn("is_region", region).where(region | (F.col("n") >= least))


# ------------------------------------------------------------------ tuning on held-out folds
def decoder_grid(pairs: DataFrame, entities: DataFrame, temps: tuple[float, ...] = (0.7, 0.85, 1.0, 1.2, 1.5), misses: tuple[float, ...] = (0.0, 0.015, 0.03, 0.05), most: int = 12) -> DataFrame:
    """temperature, miss, macro_f05 of the expected-F0.5 decoder for every setting. pairs: s1_id, query_id, p, label; entities: s1_id, n_true[, h].

    One shuffle by S1; a setting costs a decoder call per S1, not a pass over the pairs.
    """
    listed = pairs.groupBy("s1_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("p", (-F.col("query_id")).alias("q"), "label")), asc=False), 1, most).alias("l"))
    h = F.col("h") if "h" in entities.columns else F.lit(None).cast("double")
    rows = entities.select("s1_id", "n_true", h.alias("h")).join(listed, "s1_id", "left")
    grid = [(t, m) for t in temps for m in misses]

    @F.pandas_udf(ArrayType(IntegerType()))
    def sizes(ps: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([[best_prefix([] if x is None else x, None if pd.isna(v) else float(v), m, t, most) for t, m in grid] for x, v in zip(ps, hs)])

    settings = F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(m).alias("miss")) for t, m in grid])
    each = rows.withColumn("ks", sizes(F.col("l.p"), F.col("h"))).select("n_true", "l", F.explode(F.arrays_zip("ks", settings.alias("g"))).alias("x"))
    hits = F.aggregate(F.slice(F.coalesce(F.col("l.label"), F.array().cast("array<int>")), F.lit(1), F.col("x.ks")), F.lit(0), lambda a, b: a + b)
    return each.select(F.col("x.g.temperature").alias("temperature"), F.col("x.g.miss").alias("miss"), f05(F.col("n_true"), F.col("x.ks"), hits).alias("f")).groupBy("temperature", "miss").agg(F.round(F.avg("f"), 6).alias("macro_f05"))


def threshold_grid(pairs: DataFrame, entities: DataFrame, accepts: tuple[float, ...] | None = None, margins: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2)) -> DataFrame:
    """t_accept, t_keep, macro_f05 for every pair of thresholds on one-to-one pairs (s1_id, p, label); entities: s1_id, n_true.

    An S1's counts above each threshold are columns of one aggregation, so pairs are shuffled once.
    """
    accepts = tuple(float(round(x, 3)) for x in np.arange(0.2, 0.951, 0.025)) if accepts is None else accepts
    stats = pairs.groupBy("s1_id").agg(F.max("p").alias("best"), *[F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(accepts)], *[F.sum(F.when(F.col("p") >= t, F.col("label")).otherwise(0)).alias(f"h{i}") for i, t in enumerate(accepts)])
    rows = entities.select("s1_id", "n_true").join(stats, "s1_id", "left").na.fill(0)
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{i}").alias("n"), F.col(f"h{i}").alias("h")) for i, t in enumerate(accepts)])
    each = rows.select("n_true", "best", F.explode(cells).alias("c")).select("n_true", "best", "c.*", F.explode(F.array(*[F.lit(float(m)) for m in margins])).alias("margin"))
    keep = F.round(F.col("t") + F.col("margin"), 3)
    stays = F.col("best") >= keep
    f = f05(F.col("n_true"), F.when(stays, F.col("n")).otherwise(0), F.when(stays, F.col("h")).otherwise(0))
    return each.groupBy(F.col("t").alias("t_accept"), keep.alias("t_keep")).agg(F.round(F.avg(f), 6).alias("macro_f05"))


# ------------------------------------------------------------------ finished parts
def assembled(parts: list[DataFrame]) -> DataFrame:
    """The parts as one table; columns are matched by name."""
    return reduce(DataFrame.unionByName, parts)


def assembly_report(rows: DataFrame, required: DataFrame, key: str = "s1_id", matches: str = "matches", candidates: str = "candidates") -> DataFrame:
    """finding and rows of an assembled table with two id lists (arrays) per key: repeated, missing and stray keys, ids repeated in a
    list, matches that are no candidates of their key, and ids of the wrong kind (no ``S2-`` or ``S3-`` before them)."""
    ids = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    kind: Column = F.exists(F.concat(ids(matches), ids(candidates)), lambda x: ~x.rlike("^S[23]-"))
    own = rows.agg(
        F.count_if(F.size(F.array_distinct(ids(matches))) < F.size(ids(matches))).alias("repeated_match"),
        F.count_if(F.size(F.array_distinct(ids(candidates))) < F.size(ids(candidates))).alias("repeated_candidate"),
        F.count_if(F.size(F.array_except(ids(matches), ids(candidates))) > 0).alias("match_not_candidate"),
        F.count_if(kind).alias("wrong_prefix"),
    )
    said = own.select(F.inline(F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).alias("rows")) for c in own.columns])))
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("finding"), "rows")
    keys = [
        count("repeated_key", rows.groupBy(key).count().where("count > 1")),
        count("missing_key", required.join(rows, key, "left_anti")),
        count("stray_key", rows.join(required, key, "left_anti")),
    ]
    return reduce(DataFrame.unionByName, [said, *keys])
