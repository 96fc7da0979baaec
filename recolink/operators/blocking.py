"""Candidate generation: shared rare keys, TF-IDF similarity, rare tokens; union and top-k.

Nothing here broadcasts a side that grows with the data; every join is an
equi-join on (partition key, token), whose heaviest tokens are cut by document
frequency first, as the method itself asks. Spark takes exploded rows to be as
small as the file they come from, so joins right after an explode are told to merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_df(records: DataFrame, items: str, part: str = "country") -> DataFrame:
    """Records per (partition, token)."""
    return records.select(part, F.explode(F.array_distinct(items)).alias("token")).groupBy(part, "token").agg(F.count(F.lit(1)).alias("df"))


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """df, of which the planner no longer knows that it is partitioned by its (string) keys.

    A join on them then gets an exchange of its own on both sides, which is what lets adaptive execution split the other
    side's hot keys; df is an aggregate and small beside that.
    """
    return df.withColumns({k: F.concat(F.col(k), F.lit("")) for k in keys})


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts and merges, whatever size the planner takes it to have; never broadcast."""
    return df.hint("merge")


def rarest_tokens(records: DataFrame, ident: str, items: str, df: DataFrame, keep: int = 2, part: str = "country") -> DataFrame:
    """The tokens of each record with the least document frequency (ties by token); tokens without one are skipped."""
    rows = records.select(part, ident, F.explode(F.array_distinct(items)).alias("token")).join(merged(dealt_anew(df, "token")), [part, "token"])
    rank = F.row_number().over(Window.partitionBy(part, ident).orderBy("df", "token"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def cap_blocks(keys: DataFrame, key: list[str], most: int) -> DataFrame:
    """Rows whose key has at most so many rows. Counted by aggregation: a hot key is one row after the map side, and split in the join."""
    small = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= most).drop("__n")
    return keys.join(merged(dealt_anew(small, *[k for k in key if keys.schema[k].dataType.simpleString() == "string"])), key, "left_semi")


def shared_key_candidates(queries: DataFrame, s1: DataFrame, key: list[str], most: int = 50, keep: int = 20) -> DataFrame:
    """query_id, s1_id, score (shared keys) and rank; keys with more than ``most`` S1 rows make no pair."""
    right = cap_blocks(s1.select(*key, "s1_id").distinct(), key, most)
    pairs = queries.select(*key, "query_id").distinct().join(merged(right), key).groupBy("query_id", "s1_id").agg(F.count(F.lit(1)).alias("score"))
    return top_k(pairs, "score", keep)


def top_k(pairs: DataFrame, score: str, k: int, by: str = "query_id", tie: str = "s1_id", name: str = "rank") -> DataFrame:
    """row_number under a constant, which Spark limits within each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return pairs.withColumn(name, rank).where(F.col(name) <= k)


def gram_classes(records: DataFrame, ident: str, grams: str, part: str = "country") -> tuple[DataFrame, DataFrame]:
    """(class, id) of each record and (class, size, partition, gram, tf) of each class: records with the same partitions and grams.

    What hangs on the grams alone is worked out once a class. Rows that repeat an id are one record; ids of null are none.
    """
    rows = records.where(F.col(ident).isNotNull()).select(ident, F.struct(part, F.array_sort(grams).alias("grams")).alias("__row"))
    whole = rows.groupBy(ident).agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    name = F.md5(F.to_json("__rows")).alias("class")
    each = whole.groupBy("__rows").agg(F.count(F.lit(1)).alias("size")).select(name, "size", F.inline("__rows")).select("class", "size", part, F.explode("grams").alias("gram"))
    return whole.select(name, ident), each.groupBy("class", "size", part, "gram").agg(F.count(F.lit(1)).alias("tf"))


def class_weights(classes: DataFrame, vocabulary: DataFrame, part: str = "country") -> DataFrame:
    """(class, partition, gram, weight): sublinear tf times smooth idf of the vocabulary, scaled to unit length per class and partition."""
    raw = classes.join(merged(dealt_anew(vocabulary, "gram")), [part, "gram"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("class", part).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(merged(norm), ["class", part]).select("class", part, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_weights(records: DataFrame, ident: str, grams: str, vocabulary: DataFrame, part: str = "country") -> DataFrame:
    """(partition, gram, id, weight): each record's weights are its class's."""
    members, classes = gram_classes(records, ident, grams, part)
    weights = dealt_anew(class_weights(classes, vocabulary, part), "class")
    return members.join(merged(weights), "class").select(part, "gram", ident, "weight")


def fit_vocabulary(records: DataFrame, ident: str, grams: str, min_df: int = 2, max_share: float = 0.03, most: int = 600_000, part: str = "country") -> DataFrame:
    """(partition, gram, df, idf) of the grams in at least min_df and at most a share of the partition's records.

    Of more than ``most`` grams those stay that occur most often, counting every occurrence (ties by gram).
    """
    sizes = records.groupBy(part).agg(F.count_distinct(ident).alias("n"))
    _, classes = gram_classes(records, ident, grams, part)
    df = classes.groupBy(part, "gram").agg(F.sum("size").alias("df"), F.sum(F.col("size") * F.col("tf")).alias("__tf"))
    kept = df.join(merged(sizes), part).where((F.col("df") >= min_df) & (F.col("df") <= F.greatest(F.lit(min_df), F.floor(F.col("n") * max_share))))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(F.desc("__tf"), "gram"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return kept.withColumn("__r", rank).where(F.col("__r") <= most).select(part, "gram", "df", idf.alias("idf"))


def cosine_candidates(q: DataFrame, s: DataFrame, keep: int = 10, part: str = "country", digits: int | None = None) -> DataFrame:
    """The most similar S1 of each query: a join of posting lists, summed per pair; not a cross join.

    With ``digits`` the score is rounded, so that ties don't hang on the order of a sum.
    """
    return top_k(cosines(q, s, "query_id", "s1_id", part, digits), "score", keep)


def cosines(q: DataFrame, s: DataFrame, left: str, right: str, part: str, digits: int | None) -> DataFrame:
    pairs = q.withColumnRenamed("weight", "wq").join(merged(s.withColumnRenamed("weight", "ws")), [part, "gram"])
    score = F.sum(F.col("wq") * F.col("ws"))
    return pairs.groupBy(left, right).agg((F.round(score, digits) if digits else score).alias("score"))


def similar_records(queries: DataFrame, s1: DataFrame, grams: str, vocabulary: DataFrame, keep: int = 10, part: str = "country", digits: int | None = None) -> DataFrame:
    """cosine_candidates of records (query_id or s1_id, partition, grams): the posting lists hold classes, not records.

    All S1 of a class score alike, so only its ``keep`` smallest ids can be among a query's best; a query class's best
    are those of each of its queries. Copies therefore cost a row each, and work grows with pairs of different records.
    """
    asking, left = gram_classes(queries, "query_id", grams, part)
    said, right = gram_classes(s1, "s1_id", grams, part)
    pairs = cosines(class_weights(left, vocabulary, part).withColumnRenamed("class", "__q"), class_weights(right, vocabulary, part).withColumnRenamed("class", "__s"), "__q", "__s", part, digits)
    first = said.withColumn("__r", F.row_number().over(Window.partitionBy("class").orderBy("s1_id"))).where(F.col("__r") <= keep).select(F.col("class").alias("__s"), "s1_id")
    best = top_k(pairs.join(merged(first), "__s").select("__q", "s1_id", "score"), "score", keep, by="__q").withColumnRenamed("__q", "class")
    return asking.join(merged(dealt_anew(best, "class")), "class").select("query_id", "s1_id", "score", "rank")


def rare_token_candidates(queries: DataFrame, s1: DataFrame, items: str, text: str, similarity, most: int = 50, least: float = 0.5, keep: int = 3, part: str = "country") -> DataFrame:
    """S1 records that hold the query's rarest word, if 1 to ``most`` do and the texts are alike enough; the best few.

    Words that are pure numbers don't count; similarity is on the scale to 100, score and least on that to 1.
    """
    word = F.filter(items, lambda t: ~t.rlike("^[0-9]+$"))
    df = token_df(s1.withColumn("__i", word), "__i", part).where(F.col("df").between(1, most))
    rare = rarest_tokens(queries.withColumn("__i", word), "query_id", "__i", df, 1, part).select(part, "query_id", "token")
    right = s1.select(part, "s1_id", F.col(text).alias("__s"), F.explode(F.array_distinct(word)).alias("token"))
    texts = queries.select(part, "query_id", F.col(text).alias("__q"))
    pairs = rare.join(right, [part, "token"]).join(texts, [part, "query_id"])
    scored = pairs.withColumn("score", similarity("__q", "__s") / 100).where(F.col("score") >= least)
    return top_k(scored, "score", keep).select("query_id", "s1_id", "token", "score", "rank")


def union_passes(**passes: DataFrame) -> DataFrame:
    """One row per pair with each pass's score (score_<name>) and whether it made the pair (in_<name>); one shuffle."""
    names, rows = list(passes), None
    for name, df in passes.items():
        own = df.select("query_id", "s1_id", *[(F.col("score").cast("double") if n == name else F.lit(None).cast("double")).alias(f"score_{n}") for n in names])
        rows = own if rows is None else rows.unionByName(own)
    out = rows.groupBy("query_id", "s1_id").agg(*[F.max(f"score_{n}").alias(f"score_{n}") for n in names])
    return out.withColumns({f"in_{n}": F.col(f"score_{n}").isNotNull() for n in names})


def cheap_score(a: Column, c: Column, weight: float = 0.2) -> Column:
    return F.coalesce(c, F.lit(0.0)) + weight * F.coalesce(a, F.lit(0.0))


def adaptive_top_k(pairs: DataFrame, score: str = "cheap", base: int = 5, wide: int = 8, gap: float = 0.1, always: Column | None = None) -> DataFrame:
    """``base`` candidates per query, ``wide`` where the first and the base-th lie closer than gap; ``always`` rows stay.

    The first ``wide`` of a query are limited by Spark within each task before the shuffle, and only these meet in the
    second window. Rows that stay always join by a union; only the queries that have any are ranked in full.
    """
    ordered, whole = Window.partitionBy("query_id").orderBy(F.desc(score), "s1_id"), Window.partitionBy("query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(ordered))
    rows = ranked.where(F.col("rank") <= max(wide, base + 1))
    last = F.min(F.when(F.col("rank") <= base, F.col(score))).over(whole)
    close = (F.count(F.lit(1)).over(whole) > base) & (F.max(score).over(whole) - last < gap)
    rows = rows.withColumn("k", F.when(close, wide).otherwise(base))
    best = rows.where(F.col("rank") <= F.col("k"))
    if always is None:
        return best
    stay = F.coalesce(always, F.lit(False))
    asking = pairs.where(stay).select("query_id").distinct()
    full = pairs.join(asking, "query_id", "left_semi").withColumn("rank", F.row_number().over(ordered)).where(stay)
    rest = full.join(rows.where("rank = 1").select("query_id", "k"), "query_id").where(F.col("rank") > F.col("k"))
    return best.unionByName(rest)


def mine_dictionary(pairs: DataFrame, least: int = 3, purity: float = 0.6) -> DataFrame:
    """x, y from aligned words (x, y): the y that x stands beside most, if often and purely enough."""
    words = pairs.where((F.length("x") >= 2) & ~F.col("x").rlike("^[0-9]+$"))
    support = words.groupBy("x", "y").agg(F.count(F.lit(1)).alias("support"))
    best = support.groupBy("x").agg(F.sum("support").alias("occ"), F.max_by(F.struct("y", "support"), F.struct(F.col("support"))).alias("b"), F.max("support").alias("top"))
    first = support.join(best.select("x", "occ", "top"), "x").where(F.col("support") == F.col("top")).groupBy("x", "occ", "top").agg(F.min("y").alias("y"))
    return first.where((F.col("top") >= least) & (F.col("top") / F.col("occ") >= purity) & (F.col("x") != F.col("y"))).select("x", "y", F.col("top").alias("support"), "occ")
