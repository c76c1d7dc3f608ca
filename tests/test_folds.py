"""Leave-one-out fits of all folds together, against one Spark ML fit a fold and areas by all pairs."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from hearthwave.operators import mldata


def _area(pos, neg):
    return float(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_folds_equal_separate_fits(spark):
    e = np.random.default_rng(4)
    rows = []
    for i, (a, b, c) in enumerate(e.normal(size=(420, 3))):
        own = i % 6
        rows.append((f"r{own}", float(a + 0.3 * own), float(1000 + 50 * b), float(c), int(a + 0.5 * b + e.normal() * 0.8 > 0.2)))
    df = spark.createDataFrame(rows, "recording string, a double, b double, c double, label int").repartition(3)
    columns = ["a", "b", "c"]
    got = {r["recording"]: r for r in mldata.leave_one_out(df, columns, "recording").collect()}
    table = VectorAssembler(inputCols=columns, outputCol="raw").transform(df).withColumn("y", F.col("label").cast("double"))
    share = df.agg(F.avg("label")).first()[0]
    table = table.withColumn("w", F.when(F.col("label") == 1, 1 - share).otherwise(share)).persist()
    for held in ("r0", "r3", "r5"):
        train, test = table.where(F.col("recording") != held), table.where(F.col("recording") == held)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        model = LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, tol=1e-10, maxIter=300).fit(scaler.transform(train))
        scored = [(r["label"], r["z"]) for r in model.transform(scaler.transform(test)).select("label", F.col("rawPrediction").cast("string").alias("z")).collect()]
        z = [(y, float(v.strip("[]").split(",")[1])) for y, v in scored]
        assert got[held]["n"] == len(z)
        assert got[held]["auc"] == pytest.approx(_area([v for y, v in z if y], [v for y, v in z if not y]), abs=1e-6)


def test_cases(spark):
    rows = [("a", 1.0, 1), ("a", 0.0, 0), ("b", 2.0, 1), ("b", None, 0), ("c", 1.0, 1), ("c", float("nan"), 1), ("c", -1.0, 0), ("d", 0.5, None), ("e", 3.0, 1)]
    got = {r["recording"]: (r["n"], r["auc"]) for r in mldata.leave_one_out(spark.createDataFrame(rows, "recording string, x double, label int"), ["x"], "recording").collect()}
    assert got == {"a": (2, 1.0), "b": (1, None), "c": (2, 1.0), "e": (1, None)}
    one = [("a", 1.0, 1), ("a", 0.0, 0), ("b", 2.0, 1)]
    got = {r["recording"]: r["auc"] for r in mldata.leave_one_out(spark.createDataFrame(one, "recording string, x double, label int"), ["x"], "recording").collect()}
    assert got == {"a": 0.5, "b": None}  # the other recording has one class only: all score alike


def test_areas_of_ties(spark):
    rows = [("a", 1.0, 0.5), ("a", 0.0, 0.5), ("a", 1.0, 0.7), ("a", 0.0, 0.1), ("b", 1.0, 0.2)]
    got = {r["g"]: (r["n"], r["auc"]) for r in mldata.areas(spark.createDataFrame(rows, "g string, _y double, _z double"), "g").collect()}
    assert got == {"a": (4, _area([0.5, 0.7], [0.5, 0.1])), "b": (1, None)}


def test_jobs_do_not_grow_with_recordings(spark):
    """The same rows dealt to 3 and to 30 recordings take as many jobs, but for a step or two."""
    e = np.random.default_rng(1)
    points = [(float(a), int(a + e.normal() > 0)) for a in e.normal(size=300)]
    context, counts = spark.sparkContext, []
    for n in (3, 30):
        df = spark.createDataFrame([(i % n, x, y) for i, (x, y) in enumerate(points)], "recording int, x double, label int")
        context.setJobGroup(f"folds{n}", "")
        assert mldata.leave_one_out(df, ["x"], "recording").count() == n
        counts.append(len(context.statusTracker().getJobIdsForGroup(f"folds{n}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 12
