"""Toxicity by weak supervision.

1. Terms (words and word beginnings) that occur in labelled toxic rows and
   hardly elsewhere are mined; together with a short fixed lexicon and a few
   patterns they are voters, which vote toxic or abstain.
2. A generative label model with the true class as its hidden variable: the
   voters' accuracies and their correlations within a class are its parameters.
   The correlations form a forest of the strongest dependences (most mutual
   information given the class); a voter's rates depend on the class and on
   what its parent votes, so a repeated signal counts once. The labels of the
   training rows are one more voter, whose accuracy is estimated like the
   others'. EM fits all of it and gives each training row a posterior label.
3. A logistic regression on the terms and patterns is trained on the posterior
   labels, and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolink.llm.shared import bounded_batches, discard, save

#: Fixed lexicon: insults that need no label to be suspected.
LEXICON = ["idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown"]
#: Fixed patterns, each one voter.
PATTERNS = {
    "shouting": r"(?:\b[A-Z]{3,}\b[^\w]*){4,}",
    "marks": r"[!?]{3,}",
    "masked": r"\b\w+\*{2,}\w*\b",
    "address": r"\b(?:you|u)(?:'re| are)? (?:an? )?(?:such |total |complete )?(?:idiot|moron|loser|clown)\b",
}
#: Labelled rows learnt from, and terms kept, at most.
TRAIN_ROWS, KEPT = 12_000, 500
#: Odds of a term in toxic rows from which it is kept, and terms that a task counts at once before it gives them out.
ODDS, COUNTED = 8, 200_000
#: Lengths of word beginnings that are terms.
PREFIXES = (4, 5, 6, 7)
#: What EM starts from for the accuracy of the labels, and the least that it may come to.
LABEL_ACCURACY, LEAST_ACCURACY = 0.95, 0.7
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = [re.compile(x) for x in PATTERNS.values()]


#: A term counts as dense (``term+``) in a text that has it at least twice, and once in so many characters.
DENSE_CHARS = 1200


def with_dense(counts: dict, length: int) -> set:
    """The counted terms, and again with a mark those that are dense in a text of that length."""
    return set(counts) | {f"{t}+" for t, n in counts.items() if n >= 2 and n * DENSE_CHARS >= length}


def terms_of(text: str) -> set[str]:
    """Words as ``=word``, beginnings of longer words as ``^beg``, and the dense ones of both."""
    counts: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        counts[f"={word}"] += n
        for k in PREFIXES:
            if len(word) > k:
                counts[f"^{word[:k]}"] += n
    return with_dense(counts, len(text))


class TermFinder:
    """Which of the given terms a text has; one pass of an automaton, whatever their number."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.machine = ahocorasick.Automaton()
        by_text: dict[str, set[str]] = {}
        for term in terms:
            bare = term.removesuffix("+")
            by_text.setdefault(bare[1:], set()).add(bare)
        for word, uses in by_text.items():
            self.machine.add_word(word, (len(word), f"={word}" if f"={word}" in uses else None, f"^{word}" if f"^{word}" in uses else None))
        if by_text:
            self.machine.make_automaton()
        self.any = bool(by_text)

    def find(self, text: str) -> set[int]:
        if not self.any or not text:
            return set()
        low, counts = text.lower(), {}
        size = len(low)
        for end, (length, whole, beginning) in self.machine.iter(low):
            start = end - length
            if start >= 0 and low[start].isalpha():
                continue
            term = beginning if end + 1 < size and low[end + 1].isalpha() else whole
            if term:
                counts[term] = counts.get(term, 0) + 1
        return {self.number[t] for t in with_dense(counts, len(text)) if t in self.number}


def _features(text: str | None, finder: TermFinder, n_terms: int) -> list[int]:
    if not text:
        return []
    return sorted(finder.find(text)) + [n_terms + i for i, p in enumerate(_PATTERNS) if p.search(text)]


def _count(rows: DataFrame) -> DataFrame:
    """Documents of each class with each term, counted per partition (some terms at a time), then summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def given_out() -> Iterator[pd.DataFrame]:
            names = list(count[0].keys() | count[1].keys())
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                yield pd.DataFrame({"term": pd.Series(some, dtype=object), "clean": [count[0][x] for x in some], "toxic": [count[1][x] for x in some]})
            for counter in count.values():
                counter.clear()

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                count[int(toxic)].update(terms_of(text or ""))
                if len(count[0]) + len(count[1]) > COUNTED:
                    yield from given_out()
        yield from given_out()

    return rows.mapInPandas(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def telling(rows: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """term, clean, toxic, odds and gain of every term that is frequent enough in toxic rows and has the odds, however rare it is among all."""
    least = max(2, n_toxic // 200)
    odds = ((F.col("toxic") + 0.5) / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    return _count(rows).where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") >= ODDS).withColumn("gain", F.col("toxic") * F.log("odds"))


def dependences(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Parent of each voter (-1: none) in the forest of greatest mutual information given the class.

    A dependence stays out unless it explains more than its two parameters cost by the Bayesian information criterion.
    """
    m, n = votes.shape[1], len(votes)
    if not m or not n:
        return np.full(m, -1)
    v = votes.astype(np.float32)
    info = np.zeros((m, m))
    for weight in (post, 1 - post):
        total = float(weight.sum()) + 1.0
        both = (v * weight[:, None].astype(np.float32)).T @ v + 0.25
        one = np.diag(both) + 0.25
        for a in (0, 1):
            for b in (0, 1):
                pa, pb = (one if a else total - one), (one if b else total - one)
                cell = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): total - one[:, None] - one[None, :] + both}[a, b]
                cell = np.maximum(cell, 0.05)
                info += cell * np.log(cell * total / (pa[:, None] * pb[None, :]))
    np.fill_diagonal(info, -np.inf)
    parent, waiting = np.full(m, -1), np.ones(m, bool)
    best, via = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):  # Prim's algorithm; a new tree begins where no dependence pays
        score = np.where(waiting, best, -np.inf)
        at = int(score.argmax())
        if score[at] > np.log(n):
            parent[at] = via[at]
        else:
            at = int(np.flatnonzero(waiting)[v[:, waiting].sum(axis=0).argmax()])
        waiting[at] = False
        closer = waiting & (info[at] > best)
        best[closer], via[closer] = info[at][closer], at
    return parent


def label_model(votes: np.ndarray, gold: np.ndarray, steps: int = 40) -> np.ndarray:
    """Posterior P(toxic) per row from votes (rows x voters, 0/1) and gold labels (-1: none)."""
    known, m = gold >= 0, votes.shape[1]
    v = votes.astype(np.float64)
    right = LABEL_ACCURACY
    gold_odds = lambda x: np.where(known, np.where(gold > 0, 1, -1) * math.log(x / (1 - x)), 0.0)
    # the first guess is the label where there is one, else it rises with the number of votes
    post = np.where(known, np.where(gold > 0, right, 1 - right), 0.97 - 0.95 * 0.1 ** v.sum(axis=1))
    prior = float(np.clip(post.mean(), 0.001, 0.9))
    parent = np.full(m, -1)
    for step in range(steps):
        if step in (0, 5, 15):
            parent = dependences(votes, np.where(known, np.clip(gold, 0, 1), post) if step == 0 and known.any() else post)
            above = np.where(parent[None, :] >= 0, v[:, parent], 0.0) if m else v
        logit = np.full(len(v), math.log(prior / (1 - prior)))
        rates = []
        for weight, most in ((post, 0.99), (1 - post, 0.5)):
            total = weight.sum()
            plain = np.clip((weight @ v + 0.5 * (most > 0.5) + 0.05) / (total + 2), 1e-4, most)
            rates.append((weight, total, plain))
        hit, miss = np.maximum(rates[0][2], rates[1][2] * 1.01), rates[1][2]
        for sign, (weight, total, _), plain in ((1, rates[0], hit), (-1, rates[1], miss)):
            up, both = weight @ above, weight @ (above * v)
            given = np.clip((both + 2 * plain) / (up + 2), 1e-4, 0.999)  # rate where the parent votes
            alone = np.clip((weight @ v - both + 2 * plain) / (total - up + 2), 1e-4, 0.999)
            logit += sign * (v @ np.log(alone) + (1 - v) @ np.log(1 - alone))
            logit += sign * ((above * v) @ (np.log(given) - np.log(alone)) + (above * (1 - v)) @ (np.log(1 - given) - np.log(1 - alone)))
        if known.any():
            agree = np.where(gold > 0, post, 1 - post)[known]
            right = float(np.clip(agree.mean(), LEAST_ACCURACY, 0.999))
            logit += gold_odds(right)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, post = float(np.abs(new - post).max(initial=0)), new
        prior = float(np.clip(post.mean(), 0.001, 0.9))
        if moved < 1e-4 and step > 15 or step == 10 and not known.any():  # without labels only the first guess says which class is which
            break
    return post


def fit_linear(x: np.ndarray, target: np.ndarray, decay: float = 0.02, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft targets (the last is the intercept), by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    ridge = np.full(x.shape[1], decay)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Terms and weights (terms, patterns, intercept) from rows (text, toxic); what reaches the driver is bounded by the parameters above."""
    n_toxic, n = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    lexicon = [f"={w}" for w in LEXICON]
    if not n or not n_toxic or n_toxic == n:
        return lexicon, np.array([3.0] * len(lexicon) + [0.5] * len(_PATTERNS) + [-3.0])
    kept = telling(rows, n_toxic, n - n_toxic).orderBy(F.desc("gain"), "term").limit(KEPT)
    names = [r.term for r in kept.select("term").collect()]
    terms = sorted({*names, *lexicon})
    width = len(terms) + len(_PATTERNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = TermFinder(terms)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "found": [_features(t, finder, len(terms)) for t in batch["text"]]})

    got = rows.mapInPandas(run, "toxic int, found array<int>").toPandas()
    votes = np.zeros((len(got), width), bool)
    for i, found in enumerate(got["found"]):
        votes[i, list(found)] = True
    post = label_model(votes, got["toxic"].to_numpy())
    return terms, fit_linear(votes.astype(np.float64), post)


def learnt(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, train_rows: int) -> tuple[list[str], np.ndarray]:
    """Terms and weights from at most train_rows labelled rows, in the order of a hash of the id."""
    bounded_batches(docs)
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.where(learn).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text"))
    sample = save(rows.join(some, F.col("__doc") == F.col("__id")).select("text", "toxic"), "toxic-sample")
    model = train(sample)
    discard(sample)
    return model


def scores_of(texts, finder: TermFinder, n_terms: int, weights: np.ndarray) -> np.ndarray:
    logits = [weights[-1] + sum(weights[i] for i in _features(t, finder, n_terms)) for t in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(logits, float), -30, 30)))


def score(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id and score (0 to 1) of each row of docs; labels (id_col, toxic) are learnt from only where learn (of column __id) holds.

    Null and empty texts get the score of a text without any term. Null labels are not learnt from; of a row labelled
    twice the greater label counts. Without labels of both classes the fixed lexicon alone scores.
    """
    terms, weights = learnt(docs, labels, learn, id_col, text_col, train_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = TermFinder(terms)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": scores_of(batch["text"], finder, len(terms), weights)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"id {kind}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns, whatever their names; scores are those of score()."""
    terms, weights = learnt(docs, labels, learn, id_col, text_col, train_rows)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = TermFinder(terms)
        for texts in parts:
            yield pd.Series(scores_of(texts, finder, len(terms), weights))

    return docs.where(scored(F.col(text_col).cast("string")) < threshold)
