"""Jaccard self-join on word n-grams by chosen paths.

Texts with the same n-gram set form one class, and classes are joined. A class
is represented by TOKENS (position, least hash) tokens, which two sets share
with a chance equal to their similarity. A run samples, by a hash of run and
token, FIRST tokens of each class on average; classes that share a sampled
token meet in a bucket. All runs go through the same jobs, as the run is part
of a path. Buckets above ``LIMIT`` are split:

* Where members are alike on average (probe: the bucket's least class), all
  that resemble the probe are connected to it at once, in one pass. Those near
  it leave the bucket; only if some don't resemble it do the others go on. By
  the triangle inequality of Jaccard distance no partner of a leaving class is
  among those that weren't connected.
* All others go on to paths that are longer by LATER sampled tokens on average.
  Pairs under similarity 1/LATER share less than one of these and thin out, so
  texts that have only a passage in common stop meeting after a few levels.

Small buckets are compared by brute force on the tokens. What looks alike (well
under the asked similarity) is connected into components, and within each
component all pairs of classes are compared on their whole n-gram sets, block
by block, each pair once. So every link of a candidate pair is exact, and no
pair is materialised: tasks return each class's number of links and a star of
what is connected.

Runs are repeated until a pair at the threshold, all of whose buckets are split
DEEP times, is found with a chance of ``TARGET`` (`runs_needed`; one that meets
in a bucket that isn't split is missed far less often). A pair is besides
screened out, in every run alike, with a chance of about 1e-5, if it has
under ALIKE equal tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolink.llm.components import components
from recolink.llm.shared import bounded_batches, discard, fresh, save
from recolink.llm.wordhash import Words, mixed

WORDS, SIMILARITY = 5, 0.8
#: Tokens per class; tokens sampled on average by a run, and for each longer path; chance to find a pair that is split DEEP times.
TOKENS, FIRST, LATER, TARGET, DEEP = 128, 5, 1.5, 0.999, 4
#: Largest bucket that is compared at once, and level from which larger ones are compared too, block by block.
LIMIT, DEPTH = 1000, 12
#: Share of equal tokens from which two classes are candidates: 4.4 deviations under 0.8.
ALIKE = 0.645
#: Average share from which a bucket is alike; shares from which its members are connected to the probe, and leave.
CLOSE, STAR, LEAVE = 0.55, 0.35, 0.7
#: Classes, and n-grams, in a block when whole sets are compared; classes when tokens are.
BLOCK, BLOCK_GRAMS, TOKEN_BLOCK = 3072, 1_000_000, 1000
#: Buckets up to this size are compared many at a time. Large buckets, of some 300 bytes each, that are broadcast at most.
TINY, FEW = 8, 4096

_SEEDS = (np.random.default_rng(7).integers(0, 2**32, TOKENS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SIG = "binary"


def runs_needed(target: float = TARGET, similarity: float = SIMILARITY, levels: int = DEEP) -> int:
    """Runs until a pair at the similarity whose paths are split so often is found with the target chance."""
    lost = 0.0  # chance that none of a shared path's longer paths is shared down to the last level
    for _ in range(levels):
        lost = (1 - similarity * LATER / TOKENS * (1 - lost)) ** TOKENS
    missed = (1 - similarity * FIRST / TOKENS * (1 - lost)) ** TOKENS
    return max(1, int(np.ceil(np.log(1 - target) / np.log(missed))))


def ngram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of n words; a shorter text is one run of all its words, one without words has none."""
    words = Words(text)
    return np.unique(words.grams(n if len(words) >= n else max(1, len(words))))


def tokens(grams: np.ndarray) -> np.ndarray:
    """The least of each of TOKENS hashes over the set, 32 bits each."""
    own = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, 2**32 - 1, np.uint32)
    for at in range(0, len(own), 1 << 14):
        for lo in range(0, TOKENS, 32):
            part = own[at : at + (1 << 14), None] * _SEEDS[None, lo : lo + 32]
            part ^= part >> np.uint32(16)
            part *= np.uint32(0x7FEB352D)
            np.minimum(out[lo : lo + 32], part.min(axis=0), out=out[lo : lo + 32])
    return out


def first_paths(values: np.ndarray, runs: int) -> list[np.ndarray]:
    """Per row of tokens the paths that the runs sample: hashes of run, position and token."""
    place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
    own = mixed(values.astype(np.uint64) | place[None, :])
    bound = np.uint64(int(2**32 * FIRST / TOKENS))
    rows, paths = [], []
    for run in range(runs):
        path = mixed(own ^ mixed(np.array([run + 1], np.uint64)))
        row, at = np.nonzero((mixed(path) >> np.uint64(32)) < bound)
        rows.append(row)
        paths.append(path[row, at].view(np.int64))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return np.split(np.concatenate(paths)[order], np.searchsorted(row[order], np.arange(1, len(values))))


def longer_paths(path: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the longer paths that each row's path and tokens lead to, LATER of them on average."""
    place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(16)
    longer = mixed(mixed(sigs.astype(np.uint64) | place[None, :]) ^ path.view(np.uint64)[:, None])
    row, at = np.nonzero((mixed(longer) >> np.uint64(32)) < np.uint64(int(2**32 * LATER / TOKENS)))
    return row, longer[row, at].view(np.int64)


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), TOKENS)


def summaries(rows: DataFrame, n: int, runs: int) -> DataFrame:
    """id, set key (empty for texts without words), size, tokens (16 bits each) and first paths of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys, sizes, values = [], [], np.zeros((len(batch), TOKENS), np.uint32)
            for i, text in enumerate(batch["text"]):
                grams = ngram_set(text, n)
                sizes.append(len(grams))
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else b"")
                if len(grams):
                    values[i] = tokens(grams)
            sigs = [x.tobytes() if size else b"" for x, size in zip(values.astype(np.uint16), sizes)]
            paths = [x if size else x[:0] for x, size in zip(first_paths(values, runs), sizes)]
            columns = {"key": keys, "sig": sigs, "paths": paths}
            out = {name: pd.Series(x, dtype=object, index=batch.index) for name, x in columns.items()}
            yield pd.DataFrame({"id": batch["id"], "size": sizes} | out)[["id", "key", "size", "sig", "paths"]]

    return rows.select("id", "text").mapInPandas(run, f"id long, key binary, size long, sig {_SIG}, paths array<long>")


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of whole groups of consecutive rows with equal keys, and where the groups begin and end. Holds one batch and one group."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        keys = batch[by].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield batch.iloc[: cuts[-1]], np.concatenate([[0], cuts])
        rest = batch.iloc[cuts[-1] if len(cuts) else 0 :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def star_edges(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, least id) for each member that the symmetric matrix connects, over any number of steps, to a lesser one."""
    out, waiting = [], np.ones(len(ids), bool)
    for i in np.argsort(ids, kind="stable").tolist():
        if not waiting[i]:
            continue
        waiting[i] = False
        edge = np.array([i])
        while len(edge):
            reached = linked[edge].any(axis=0) & waiting
            waiting &= ~reached
            edge = np.flatnonzero(reached)
            out += [(int(ids[j]), int(ids[i])) for j in edge.tolist()]
    return out


def _equal_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _alike(sigs: np.ndarray) -> np.ndarray:
    """Which pairs of rows have the share ALIKE of equal tokens."""
    same = np.zeros((len(sigs), len(sigs)), np.uint8)
    for t in range(TOKENS):
        column = sigs[:, t]
        same += column[:, None] == column[None, :]
    return same >= ALIKE * TOKENS


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _compared(rows: DataFrame) -> DataFrame:
    """Edges (u, v) between members of a bucket with alike tokens; rows: cid, sig, path, n (members of the bucket)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[tuple[int, int]] = set()
        for batch, cuts in _groups(batches, ["path", "a", "b"]):
            cids, sigs, sizes = batch["cid"].to_numpy(), _matrix(batch["sig"]), np.diff(cuts)
            for size in range(2, TINY + 1):
                at = cuts[:-1][sizes == size]
                for i in range(size):
                    for j in range(i):
                        hit = _equal_share(sigs[at + i], sigs[at + j]) >= ALIKE
                        found.update(zip(cids[at[hit] + i].tolist(), cids[at[hit] + j].tolist()))
            for k in np.flatnonzero(sizes > TINY).tolist():
                own = slice(cuts[k], cuts[k + 1])
                found.update(star_edges(_alike(sigs[own]), cids[own]))
            if len(found) > 50_000:
                yield pd.DataFrame(sorted(found), columns=["u", "v"])
                found = set()
        if found:
            yield pd.DataFrame(sorted(found), columns=["u", "v"])

    count = F.ceil(F.col("n") / TOKEN_BLOCK).cast("int")
    dealt = _dealt(rows.withColumn("blocks", F.when(F.col("n") > LIMIT, count).otherwise(1))).select("path", "a", "b", "cid", "sig")
    return dealt.repartition(_parts(rows), "path", "a", "b").sortWithinPartitions("path", "a", "b").mapInPandas(run, "u long, v long")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (with cid and blocks, the blocks of their group) dealt to every pair of blocks a <= b of their group; own: the row's block."""
    own = F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return dealt.withColumn("a", F.least("own", "other")).withColumn("b", F.greatest("own", "other")).drop("other")


def _resemblance(rows: DataFrame) -> DataFrame:
    """rows: cid, sig, path, pid, probe -> with the share of tokens equal to the probe's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                share = _equal_share(_matrix(batch["sig"]), _matrix(batch["probe"]))
                yield batch[["cid", "sig", "path", "pid"]].assign(share=share)

    return rows.select("cid", "sig", "path", "pid", "probe").mapInPandas(run, f"cid long, sig {_SIG}, path long, pid long, share double")


def _split(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, longer = longer_paths(batch["path"].to_numpy(), _matrix(batch["sig"]))
                yield pd.DataFrame({"cid": batch["cid"].to_numpy()[row], "sig": batch["sig"].to_numpy()[row], "path": longer})

    return rows.select("cid", "sig", "path").mapInPandas(run, f"cid long, sig {_SIG}, path long")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _with(rows: DataFrame, buckets: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to a saved table of buckets on path: broadcast if it was counted to be small, so that hot paths stay spread; else by a merge join."""
    return rows.join(buckets.hint("broadcast" if buckets.count() <= FEW else "merge"), "path", how)


def _probed(rows: DataFrame) -> DataFrame:
    """path, pid and probe (its least class) of buckets above the limit; saved."""
    found = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("cid", "sig")).alias("least")).where(F.col("n") > LIMIT)
    return save(found.select("path", "n", F.col("least.cid").alias("pid"), F.col("least.sig").alias("probe")), "probes")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect classes (cid, sig, paths) which may be similar; of saved tables."""
    drawn = classes.select("cid", F.explode("paths").alias("path"))
    # saved, so that both sides of the join come straight from a shuffle and a hot path's rows can be split
    sizes = save(drawn.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "paths")
    met = drawn.join(sizes.hint("merge"), "path").groupBy("cid").agg(F.collect_list(F.struct("path", "n")).alias("met"))  # at most a class's own paths
    level = save(met.join(classes.select("cid", "sig").hint("merge"), "cid").select("cid", "sig", F.inline("met")), "level")
    edges, small = [], [level.where(F.col("n") <= LIMIT)]
    large = level.where(F.col("n") > LIMIT)
    probes = _probed(large)
    used = [sizes, level, probes]
    for depth in range(DEPTH):
        if probes.isEmpty():
            break
        near = save(_resemblance(_with(large.select("cid", "sig", "path"), probes)), "near")
        alike = save(near.groupBy("path").agg(F.avg("share").alias("close"), F.min("share").alias("worst")), "alike")
        judged, same = _with(near, alike), F.col("close") >= CLOSE
        edges.append(save(judged.where(same & (F.col("share") >= STAR) & (F.col("cid") != F.col("pid"))).select(F.col("cid").alias("u"), F.col("pid").alias("v")), "stars"))
        longer = save(_split(judged.where(~same | ((F.col("worst") < STAR) & (F.col("share") < LEAVE)))), "longer")
        discard(near, alike)
        probes = _probed(longer)
        large = _with(longer, probes.select("path", "n"), "left_semi")
        small.append(_with(longer, probes.select("path"), "left_anti").withColumn("n", F.lit(1).cast("long")))
        used += [longer, probes]
    if not probes.isEmpty():  # beyond the last level large buckets are compared as well
        small.append(_with(large, probes.select("path", "n")))
    edges.append(save(_compared(_union([x.select("cid", "sig", "path", "n") for x in small])), "candidates"))
    discard(*used)
    return _union(edges)


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each pair of sets. Elements of one set only are left out; rare ones are counted pair by pair, others by products of slices."""
    sizes = [len(s) for s in sets]
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    several = count[place] > 1
    place, row = place[several], row[several]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    both = np.zeros((len(sets), len(sets)), np.int32)
    if not len(place):
        return both
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    df = np.diff(np.append(starts, len(place)))
    for size in range(2, 9):
        at = starts[df == size]
        for i in range(size):
            for j in range(i):
                np.add.at(both, (row[at + i], row[at + j]), 1)
    both += both.T
    often = np.repeat(df > 8, df)
    row, number = row[often], np.repeat(np.cumsum(df > 8) - 1, df)[often]
    for lo in range(0, int((df > 8).sum()), 1024):
        a, b = np.searchsorted(number, [lo, lo + 1024])
        part = np.zeros((len(sets), 1024), np.float32)
        part[row[a:b], number[a:b] - lo] = 1
        both += (part @ part.T).astype(np.int32)
    return both


def _exact(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have at least the similarity; a matrix with a false diagonal."""
    sizes = np.array([len(s) for s in sets], np.int64)
    both = _shared_counts(sets)
    linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _links(members: DataFrame, similarity: float) -> DataFrame:
    """members: cid, comp, blocks, grams. Rows (u, v, links, blocks): v is the least class of what u is linked to here (or u), links counts u's links seen here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, cuts in _groups(batches, ["comp", "a", "b"]):
            rows = []
            for lo, hi in zip(cuts, cuts[1:]):
                group = batch.iloc[lo:hi].drop_duplicates("cid")  # rows that repeat an id and its text
                if len(group) < 2:
                    continue
                ids, own, blocks = group["cid"].to_numpy(), group["own"].to_numpy(), int(group["blocks"].iloc[0])
                linked = _exact(list(group["grams"]), similarity)
                if group["a"].iloc[0] != group["b"].iloc[0]:
                    linked &= own[:, None] != own[None, :]
                rows += [(int(i), int(i), int(c), blocks) for i, c in zip(ids, linked.sum(axis=1)) if c]
                rows += [(u, v, 0, blocks) for u, v in star_edges(linked, ids)]
            if rows:
                yield pd.DataFrame(rows, columns=["u", "v", "links", "blocks"])

    dealt = _dealt(members).select("comp", "a", "b", "own", "blocks", "cid", "grams")
    return dealt.repartition(_parts(members), "comp", "a", "b").sortWithinPartitions("comp", "a", "b").mapInPandas(run, "u long, v long, links long, blocks int")


def _groups_of(linked: DataFrame) -> DataFrame:
    """node and root for what links connect. Components of one block are complete already; only others need rounds."""
    edges = linked.where("u <> v")
    alone, spread = edges.where("blocks = 1").select("u", "v"), edges.where("blocks > 1").select("u", "v")
    found = alone.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(alone.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return found if spread.isEmpty() else found.unionByName(components(spread))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, class_id, set_id, n_links.

    set_id is the smallest id with the same n-gram set, n_links the number of other sets with at least the similarity,
    class_id the smallest id that a chain of links reaches. Words are runs of non-blanks, unchanged. A text of fewer
    than n words is one n-gram of all of them; texts without words (null, empty, blank) share a set and link to
    nothing. Rows of one id with different texts are judged one by one. An empty table gives no rows. Other columns
    are not looked at.
    """
    bounded_batches(docs)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    own = save(summaries(rows, n, runs_needed(similarity=similarity)), "sets")
    grouped = own.groupBy("key").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    classes = save(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    edges = candidate_edges(classes.where("size > 0").select("cid", "sig", "paths"))
    comps = components(edges).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    found = save(comps.join(classes.select("cid", "key", "rep", "size"), "cid"), "found")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")
    several = save(found.groupBy("comp").agg(blocks.alias("blocks")).where("blocks > 1"), "blocks")
    cut = found.join(several.hint("broadcast" if several.count() <= FEW else "merge"), "comp", "left")
    members = cut.withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [ngram_set(t, n) for t in batch["text"]]
            keys = [hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in grams]
            right = np.array([a == bytes(b) for a, b in zip(keys, batch["key"])], bool)  # an id can have several texts
            out = batch.loc[right, ["cid", "comp", "blocks"]]
            yield out.assign(grams=pd.Series([g.view(np.int64) for g, ok in zip(grams, right) if ok], index=out.index, dtype=object))

    texts = rows.join(members.hint("merge"), rows["id"].eqNullSafe(members["rep"]))
    grams = texts.select("cid", "comp", "blocks", "key", "text").mapInPandas(sets, "cid long, comp long, blocks int, grams array<long>")
    linked = save(_links(grams, similarity), "links")
    counts = linked.groupBy("u").agg(F.sum("links").alias("links"))
    groups = _groups_of(linked)
    answer = save(
        classes.select("cid", "key", "rep")
        .join(counts, classes["cid"] == counts["u"], "left")
        .join(groups, classes["cid"] == groups["node"], "left")
        .select("key", "rep", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), "root"),
        "answer",
    )
    discard(classes, found, several, linked)
    heads = answer.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("rep").alias("head"))
    named = answer.join(heads, "root", "left").select("key", F.col("rep").alias("set_id"), "n_links", F.coalesce("head", "rep").alias("class_id"))
    return own.select("id", "key").join(named, "key").select("id", "class_id", "set_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that lead their group of near-duplicates; texts without words stay, and so do rows that repeat a leading id.

    Null ids and empty or very long texts are treated as near_duplicates does; an empty table gives none. Any other
    columns pass through, whatever their names.
    """
    found = near_duplicates(docs, id_col, text_col)
    lead, mark = fresh("lead"), fresh("mark")
    leads = found.where(F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("id").alias(lead)).distinct().withColumn(mark, F.lit(True))
    empty = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    flagged = docs.join(leads, F.col(id_col).cast("long").eqNullSafe(F.col(lead)), "left")
    return flagged.where(F.col(mark) | empty).select(*[f"`{c}`" for c in docs.columns])
