"""The classifier of tables: held-out accuracy, its means against numpy, header tokens and bands."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyweave.operators import classifier as C
from tallyweave.plans import classifier as plans


def test_tables_that_were_not_learned_from(spark, sf):
    """All plain tables are known again; a table without a value is unknown; the mixed ones are the least confident persons."""
    got = plans.answers(spark, sf).collect()
    plain = [r for r in got if r["table"] != "garbage-24" and not (r["kind"] == "person" and int(r["table"].split("-")[1]) % 9 == 8)]
    assert len(plain) >= 25 and sum(r["label"] == r["kind"] for r in plain) / len(plain) >= 0.95
    assert {(r["label"], r["confidence"]) for r in got if r["table"] == "garbage-24"} == {("unknown", 0.0)}


def test_a_tables_probabilities_are_the_means_of_its_first_cells(spark):
    rows = [("person", f"ann roe{i}", ["First name"]) for i in range(30)] + [("org", f"acme freight llc {i}", ["value"]) for i in range(30)]
    model = C.fitted(spark.createDataFrame(rows, "label string, text string, headers array<string>"))
    cells = [("t", i, "acme roe3" if i < 150 else "ann roe1", ["value"]) for i in range(260)] + [("t", 1000, None, ["value"]), ("t", -1, " NaN ", ["value"]), ("u", 0, None, None), ("v", 0, "ann", None)]
    df = spark.createDataFrame(cells, "table string, at long, text string, headers array<string>")
    got = {r["table"]: r for r in C.classified(df, model).collect()}
    scored = model.transform(C._terms(df.where("table = 't' AND at BETWEEN 0 AND 199").withColumn("label", F.lit("org")))).select(vector_to_array("probability").alias("p")).collect()
    means = np.mean([r["p"] for r in scored], axis=0)
    labels = model.stages[0].labels
    assert (got["t"]["label"], got["t"]["confidence"]) == (labels[int(means.argmax())], round(float(means.max()), 4))
    assert (got["u"]["label"], got["u"]["confidence"]) == ("unknown", 0.0) and got["v"]["label"] == "person"


def test_header_tokens(spark):
    of = lambda h: spark.createDataFrame([(h,)], "h array<string>").select(C.header_tokens(F.col("h"))).collect()[0][0]
    assert of([" Vendor ID", "City", "Last Name"]) == ["header:id", "header:vendor", "header:last"]
    assert of([]) == [] and of(None) == []


def test_bands(spark):
    rows = [("person", 0.8, "company"), ("person", 0.79, "company"), ("person", 0.5, "person"), ("org", 0.6, "company"), ("org", 0.49, "company"), ("garbage", 0.9, "mixed"), ("unknown", 0.0, "mixed")]
    df = spark.createDataFrame(rows, "label string, confidence double, heuristic string").select(C.decided(F.col("label"), F.col("confidence"), F.col("heuristic")).alias("d"))
    assert [tuple(r["d"]) for r in df.collect()] == [("classifier", "person"), ("abstained", "company"), ("classifier", "person"), ("classifier", "company"), ("heuristic", "company"), ("classifier", "garbage"), ("heuristic", "mixed")]
