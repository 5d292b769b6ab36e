"""Monte-Carlo Shapley values: the background is drawn from as a whole, at every size."""

import pytest
from pyspark.sql import functions as F

from pedolake.operators import scoring


def test_shapley_draws_from_the_whole_background(spark):
    # 20,000 distinct rows and 5,000 copies of one, which count as often as they occur
    i = F.col("id")
    rows = spark.range(20_000).select("id", (i / 20_000).alias("b1"), (F.pmod(i * 7919, F.lit(20_000)) / 20_000).alias("b2"))
    copies = spark.range(5_000).select((i + 20_000).alias("id"), F.lit(3.0).alias("b1"), F.lit(1.0).alias("b2"))
    rows = rows.unionByName(copies)
    score = lambda c: c["b1"] * c["b2"] + c["b1"]
    phi = scoring.shapley_monte_carlo(rows, rows, score, ["b1", "b2"], "id", 8, 5)
    sums = phi.groupBy("id").agg(F.sum("phi").alias("s"))
    base = rows.agg(F.avg(score({"b1": F.col("b1"), "b2": F.col("b2")}))).first()[0]
    both = sums.join(rows, "id").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("s"), F.avg(score({"b1": F.col("b1"), "b2": F.col("b2")}) - base).alias("want")).first()
    print("rows", both["n"], "mean sum(phi)", both["s"], "mean score minus mean background score", both["want"])
    assert both["n"] == 25_000
    # 200,000 draws of deviation 2.2
    assert both["s"] == pytest.approx(both["want"], abs=0.025)


def test_numbers_are_dense(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id") * 1.0).alias("v"), (F.col("id") % 3).alias("w"))
    for deal in (1, 7):
        out, n = scoring.numbered(df.repartition(deal), ["v", "w"])
        got = [(r["number"], r["v"], r["w"]) for r in out.orderBy("number").collect()]
        assert n == 1000 and [g[0] for g in got] == list(range(1000))
        first = got if deal == 1 else first
        assert got == first
    empty, n = scoring.numbered(df.limit(0), ["v", "w"])
    assert n == 0 and empty.count() == 0


def test_python_models_pass_as_column_expressions_do(spark):
    i = F.col("id")
    rows = spark.range(300).select("id", F.when(i % 50 != 7, (i % 7) / 7).alias("b1"), ((i * 31) % 19 / 19).alias("b2"))
    full = rows.na.drop()
    plain = lambda c: c["b1"] * c["b2"] + c["b1"]
    model = scoring.python_scorer(spark, plain, ["b1", "b2"])
    for delta in (False, True):
        want, got = (sorted(scoring.partial_dependence(full, "b1", s, ["b1", "b2"], 0.1, 0.9, delta).collect()) for s in (plain, model))
        assert len(got) == 7 and all(a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    want, got = (sorted(scoring.shapley_monte_carlo(full, full, s, ["b1", "b2"], "id", 4, 5).collect()) for s in (plain, model))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(a[2:] == pytest.approx(b[2:]) for a, b in zip(got, want, strict=True))
    # nulls reach the model as NaN and come back as null; no rows are no rows
    assert rows.select(model({"b1": F.col("b1"), "b2": F.col("b2")}).alias("s")).where("s is null").count() == 6
    assert rows.limit(0).select(model({"b1": F.col("b1"), "b2": F.col("b2")})).count() == 0


def test_python_models_are_bounded(spark):
    with pytest.raises(ValueError, match="bytes"):
        scoring.python_scorer(spark, lambda rows, held=bytes(5000): [0.0] * len(rows), ["a"], most_bytes=4000)


def test_shapley_exchanges_no_differences(spark):
    """A row's features are summed up where it is: nothing is exchanged by feature; equal keys and rows without one are kept."""
    rows = spark.createDataFrame([(1, 0.5, 2.0), (1, 0.5, 2.0), (2, 1.0, 3.0), (None, 4.0, 1.0), (None, 4.0, 1.0)], "id long, b1 double, b2 double")
    phi = scoring.shapley_monte_carlo(rows, rows, lambda c: c["b1"] + 2 * c["b2"], ["b1", "b2"], "id", 6, 5)
    exchanged = [x for x in phi._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanged and not any("feature" in x for x in exchanged)
    got = sorted(((r["id"] or 0, r["feature"]) for r in phi.collect()))
    assert got == [(k, f) for k in (0, 1, 2) for f in ("b1", "b2")]


def test_shapley_takes_blocks_by_their_rows_and_exchanges_no_draw(spark, monkeypatch):
    """Small blocks, a background row that fills several of them, and another number of partitions: as a whole and as before."""
    monkeypatch.setattr(scoring, "HELD", 1024)
    i = F.col("id")
    rows = spark.range(30_000).select("id", F.when(i < 24_000, i / 24_000).otherwise(3.0).alias("b1"), F.when(i < 24_000, F.pmod(i * 7919, F.lit(24_000)) / 24_000).otherwise(1.0).alias("b2"))
    score = lambda c: c["b1"] * c["b2"] + c["b1"]
    phi = scoring.shapley_monte_carlo(rows, rows, score, ["b1", "b2"], "id", 8, 5)
    assert phi._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    base = rows.agg(F.avg(score({"b1": F.col("b1"), "b2": F.col("b2")}))).first()[0]
    both = phi.groupBy("id").agg(F.sum("phi").alias("s")).join(rows, "id").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("s"), F.avg(score({"b1": F.col("b1"), "b2": F.col("b2")}) - base).alias("want")).first()
    assert both["n"] == 30_000 and both["s"] == pytest.approx(both["want"], abs=0.04)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = scoring.shapley_monte_carlo(rows.repartition(5), rows.repartition(2), score, ["b1", "b2"], "id", 8, 5)
        far = phi.join(again.withColumnsRenamed({"phi": "p2", "var": "v2"}), ["id", "feature"]).agg(F.count(F.lit(1)), F.max(F.abs(F.col("phi") - F.col("p2"))), F.max(F.abs(F.col("var") - F.col("v2")))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert far[0] == 60_000 and far[1] < 1e-12 and far[2] < 1e-12
    assert scoring.shapley_monte_carlo(rows, rows.limit(0), score, ["b1", "b2"], "id", 8, 5).count() == 0
