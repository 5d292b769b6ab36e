"""What a query keeps in the executors' memory when it is done."""

from pedolake.operators import modelling
from pedolake.plans import registry


def test_family_scores_hold_no_rows(spark, sf):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert registry.queries()["model_family_scores"](spark, sf).count() == 4
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_elimination_holds_no_rows_and_fits_all_predictors_once(spark, sf, monkeypatch):
    before, fits, plain = spark.sparkContext._jsc.getPersistentRDDs().size(), [], modelling.forest
    monkeypatch.setattr(modelling, "forest", lambda *a, **k: fits.append(1) or plain(*a, **k))
    rows = registry.queries()["rfe_profile"](spark, sf).collect()
    assert sorted((r["fold"], r["size"]) for r in rows) == [(f, k) for f in range(3) for k in (1, 2, 3)]
    assert len(fits) == 9 and spark.sparkContext._jsc.getPersistentRDDs().size() <= before
