"""Boosted trees on weighted rows and in plain form, against MLlib on every row."""

import random

from pyspark.sql import functions as F

from recolink.operators import scoring


def labelled(spark, copies=1):
    random.seed(3)
    rows = [(float(random.randrange(9)), random.choice([None, 0.0, 1.0, 2.5]), random.randrange(2), i % 5) for i in range(400)]
    rows = [(x, y, int(x + (y or 0) > 5) if random.random() < 0.9 else z, f) for x, y, z, f in rows]
    return spark.createDataFrame([(i, c, *r) for c in range(copies) for i, r in enumerate(rows)], "id long, copy int, x double, y double, label int, fold int")


def by_mllib(rows, features, **options):
    """id and probability by MLlib's own models, trained on and applied to every row."""
    models = {k: scoring.fit_gbt(rows.where(F.col("fold").isin(1, 2, 3, 4) & (F.col("fold") != k)), features, **options) for k in (1, 2, 3, 4)}
    each = {k: {(r.id, r.copy): (r.fold, r.p) for r in scoring.predict(m, rows, "p").collect()} for k, m in models.items()}
    return {i: each[f][i][1] if f else sum(e[i][1] for e in each.values()) / 4 for i, (f, _) in each[1].items()}


def test_cross_validated_is_mllib_on_every_row(spark):
    rows = labelled(spark, copies=3)
    want = by_mllib(rows, ["x", "y"], trees=4, depth=3)
    got = {(r.id, r.copy): r.p for r in scoring.cross_validated(rows, ["x", "y"], "p", trees=4, depth=3).collect()}
    assert got.keys() == want.keys() and len({round(p, 6) for p in got.values()}) > 20
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_copies_are_learnt_from_once(spark, monkeypatch):
    seen, fit = [], scoring.fit_gbt
    monkeypatch.setattr(scoring, "fit_gbt", lambda rows, *args, **options: seen.append(rows.count()) or fit(rows, *args, **options))
    one, many = (scoring.cross_validated(labelled(spark, n), ["x", "y"], "p", trees=2, depth=2).count() for n in (1, 5))
    assert many == 5 * one and seen[:4] == seen[4:]
