"""What a table of names holds, by a classifier of its cells that may abstain: persons, organizations or garbage.

Cells are words and pairs of words weighed by TF-IDF, with a token for each header word that speaks for a kind; a multinomial
logistic regression gives a cell's class probabilities, and a table's are their means over SAMPLE cells at most. The
heuristic route is kept where the classifier is unsure: a confident label stands, one of middle confidence only if the
heuristic says the same, any other gives way.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of header words that speak for persons and for organizations.
PERSON_TOKENS = ["nombre", "apellido", "first", "last", "edad", "age", "sexo", "gender", "id", "carne", "employee", "staff", "surname", "given", "dob", "nationality", "person"]
ORG_TOKENS = ["company", "corp", "inc", "empresa", "organization", "legal", "imo", "vessel", "vendor", "supplier", "entity", "account", "business", "firm", "subsidiary", "trading"]
#: Most features, most cells of a table, texts of cells without a value, and the bounds of confidence.
FEATURES, SAMPLE, NOTHING, HIGH, MIDDLE = 5000, 200, ["nan", "none", ""], 0.80, 0.50
#: What the heuristic calls a label.
AS_HEURISTIC = {"person": "person", "org": "company", "garbage": "garbage"}


def header_tokens(headers: Column) -> Column:
    """A token for every part that one of a table's headers holds, header by header."""
    parts = F.array(*map(F.lit, [*PERSON_TOKENS, *ORG_TOKENS]))
    held = lambda h: F.transform(F.filter(parts, lambda p: F.contains(F.lower(F.trim(h)), p)), lambda p: F.concat(F.lit("header:"), p))
    return F.flatten(F.transform(F.coalesce(headers, F.array().cast("array<string>")), held))


def _terms(cells: DataFrame) -> DataFrame:
    """cells (text, headers) that hold a value, with terms: words of two characters and more, and pairs of neighbours."""
    text = F.trim(F.col("text"))
    rows = cells.where(text.isNotNull() & ~F.lower(text).isin(NOTHING))
    words = F.concat(header_tokens(F.col("headers")), F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)))
    rows = rows.withColumn("words", words)
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("terms", F.concat("words", pairs)).drop("words")


def fitted(labelled: DataFrame) -> PipelineModel:
    """A classifier of cells from text, headers and label."""
    steps = [
        StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc"), CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=FEATURES), IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="class", family="multinomial", regParam=0.01, maxIter=50, probabilityCol="probability"),
    ]
    return Pipeline(stages=steps).fit(_terms(labelled))


def classified(cells: DataFrame, model: PipelineModel) -> DataFrame:
    """table, label, confidence from cells (table, at, text, headers): the mean probabilities of a table's first SAMPLE cells with a value; unknown where it has none."""
    first = Window.partitionBy("table").orderBy("at", "text")
    rows = _terms(cells).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE).drop("nth")
    names = model.stages[0].labels
    scorer = PipelineModel(model.stages[1:])  # the first step only names the labels
    p = vector_to_array("probability")
    means = scorer.transform(rows).groupBy("table").agg(*(F.avg(p[i]).alias(f"p{i}") for i in range(len(names))))
    best = F.sort_array(F.array(*(F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("order"), F.lit(n).alias("label")) for i, n in enumerate(names))), asc=False)[0]
    found = means.select("table", best.alias("best")).select("table", "best.label", F.round("best.p", 4).alias("confidence"))
    return cells.select("table").distinct().join(found, "table", "left").select("table", F.coalesce("label", F.lit("unknown")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def decided(label: Column, confidence: Column, heuristic: Column) -> Column:
    """decision (classifier, abstained or heuristic) and label, in the heuristic's words, of a table."""
    same = F.coalesce(F.create_map(*(F.lit(x) for kv in AS_HEURISTIC.items() for x in kv))[label], F.lit("mixed"))
    decision = F.when(label == "unknown", "heuristic").when((confidence >= HIGH) | (confidence >= MIDDLE) & (same == heuristic), "classifier").when(confidence >= MIDDLE, "abstained").otherwise("heuristic")
    return F.struct(decision.alias("decision"), F.when(decision == "classifier", same).otherwise(heuristic).alias("label"))
