"""Queries on persons, companies and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import persons as P
from .inputs import table
from .names import names

FIRST = ["Amara", "Boris", "Chiara", "Dmitri", "Elena", "Farid", "Greta", "Hassan", "Ingrid", "Jorge", "Katya", "Luis"]
LAST = ["Abernathy", "Bogdanov", "Castellano", "Dlamini", "Eriksson", "Ferreira", "Gonzalez", "Hovhannisyan", "Ivanenko", "Jankowski", "Kowalczyk", "Lindqvist"]
PARENTS = {"acme": "Acme Group", "northern trust": "Northern Trust Corporation", "global trading": "Global Trading International", "gamma": "Gamma Holdings"}


def watchlist(spark: SparkSession) -> DataFrame:
    """A list of 144 persons with aliases, made from the name tables."""
    rows = spark.range(len(FIRST) * len(LAST)).select(F.col("id").alias("ordinal"))
    first = F.element_at(F.array(*map(F.lit, FIRST)), (F.col("ordinal") % len(FIRST) + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, LAST)), (F.floor(F.col("ordinal") / len(FIRST)) + 1).cast("int"))
    rows = rows.select("ordinal", F.concat(F.lit("P"), F.col("ordinal").cast("string")).alias("id"), first.alias("first_name"), last.alias("last_name"))
    return rows.withColumn("canonical_name", F.concat_ws(" ", "first_name", "last_name")).withColumn("aliases", F.array(F.concat(F.substring("first_name", 1, 2), F.lit(" the "), F.lower("last_name"))))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under names that are those of the list, in several disguises, by their key."""
    k = F.col("c_custkey")
    first = F.element_at(F.array(*map(F.lit, FIRST)), (k * 7 % len(FIRST) + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, LAST)), (k * 5 % len(LAST) + 1).cast("int"))
    swapped = F.concat(F.substring(last, 1, 3), F.substring(last, 5, 1), F.substring(last, 4, 1), F.substring(last, 6, 40))
    forms = [F.concat_ws(" ", first, last), F.concat(F.upper(last), F.lit(", "), first), F.concat(F.lit("Dr. "), first, F.lit(" "), last, F.lit(" Jr.")), F.concat(F.substring(first, 1, 2), F.lit(" The "), last), F.concat(F.substring(first, 1, 3), F.lit(" "), last), F.concat_ws(" ", first, swapped), F.col("c_name"), k.cast("string")]
    return table(spark, sf_dir, "customer").select(k.alias("row_index"), F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("original"))


def person_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exact(P.keyed(screened(spark, sf_dir)), watchlist(spark))


def person_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.alias(P.keyed(screened(spark, sf_dir)), watchlist(spark))


def person_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.initial(P.keyed(screened(spark, sf_dir)), watchlist(spark))


def person_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and customers' names of one nation by likeness of the numbers' digits."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    names = s.select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("key"), F.lower("s_name").alias("name"))
    found = P.closest(names, c.select(F.col("c_nationkey").alias("group"), F.lower("c_name").alias("name")), 0.75)
    return found.select(F.col("key").alias("s_suppkey"), F.round("best", 6).alias("best"), "close")


def person_fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers against the list, each different name looked up once."""
    rows = screened(spark, sf_dir)
    once = rows.select(F.col("original").alias("row_index"), "original").distinct()
    found = P.fuzzy(P.keyed(once), watchlist(spark)).withColumnRenamed("row_index", "original")
    return rows.join(found, "original").select("row_index", "k", "id", F.round("score", 6).alias("score"))


def person_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole waterfall over all customers, each different name resolved once."""
    rows = screened(spark, sf_dir)
    once = rows.select(F.col("original").alias("row_index"), "original").distinct()
    found = P.resolve(once, watchlist(spark)).withColumnRenamed("row_index", "name")
    return rows.join(found, F.col("original").eqNullSafe(F.col("name"))).select("row_index", "original", "match_id", "match_type", "layer", F.round("confidence", 6).alias("confidence"))


def watchlist_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources that name the same persons in their own ways, merged."""
    base = watchlist(spark).withColumn("dob", F.concat((F.lit(1950) + F.col("ordinal") % 40).cast("string"), F.lit("-03-04")))
    a = base.select("ordinal", F.lit("LIST_A").alias("source"), "id", "canonical_name", "aliases", "dob")
    b = base.where("ordinal % 2 = 0").select(F.col("ordinal") + 1000, F.lit("LIST_B"), F.concat(F.lit("B"), "id"), F.concat(F.upper("last_name"), F.lit(", "), "first_name"), F.array(F.lower("first_name")), F.concat(F.lit("born "), F.substring("dob", 1, 4))).toDF(*a.columns)
    c = base.where("ordinal % 3 = 0").select(F.col("ordinal") + 2000, F.lit("LIST_C"), F.concat(F.lit("C"), "id"), F.lower("canonical_name"), F.col("aliases"), F.lit(None).cast("string")).toDF(*a.columns)
    out = P.merged(a.unionByName(b).unionByName(c))
    return out.select("key", "id", "canonical_name", "source", F.array_join("aliases", ";").alias("aliases"), F.col("merged").cast("long").alias("merged"))


def canonical_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organizations looked up by their name without legal suffix among the aliases of known parents."""
    o = names(spark, sf_dir).select("id", N.sanitize_organization(F.col("name")).alias("o")).select("id", F.lower("o.org_name").alias("alias"))
    known = spark.createDataFrame(list(PARENTS.items()), "alias string, parent string")
    return o.join(F.broadcast(known), "alias", "left").select("id", "parent")


def mixed_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all kinds: classified, organizations looked up first, the rest sanitized by kind."""
    n = names(spark, sf_dir).withColumn("c", N.classify_entity(F.col("name")))
    kind = F.col("c.entity_type")
    clean = F.when(kind == "PERSON", N.sanitize_person(F.col("name"))["sanitized"]).when(kind == "ORGANIZATION", N.sanitize_organization(F.col("name"))["sanitized_name"]).when(kind == "VESSEL", N.sanitize_vessel(F.col("name"))["sanitized_name"])
    rows = n.select("id", kind.alias("entity_type"), clean.alias("sanitized")).join(canonical_parent(spark, sf_dir), "id")
    found = (F.col("entity_type") == "ORGANIZATION") & F.col("parent").isNotNull()
    layer = F.when(found, "L1_CANONICAL").when(F.col("entity_type") == "ORGANIZATION", "L1_ORG").when(F.col("entity_type") == "PERSON", "L1_PERSON").when(F.col("entity_type") == "VESSEL", "L1_VESSEL").otherwise("L0_GARBAGE")
    return rows.select("id", "entity_type", F.when(found, F.col("parent")).otherwise(F.col("sanitized")).alias("resolved"), layer.alias("layer"))


def _unit(v: str) -> F.Column:
    return F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vector_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest centroid of the labels, by cosine, and the match type of that likeness."""
    e = table(spark, sf_dir, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("d", "x"))
    centre = dims.groupBy("label", "d").agg(F.avg(F.col("x").cast("decimal(20,12)")).cast("double").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("centre"))
    centre = centre.withColumn("len", _unit("centre"))
    rows = e.select("vec_id", "embedding", _unit("embedding").alias("own")).join(F.broadcast(centre))  # one row for each label
    dot = F.aggregate(F.zip_with("embedding", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    scored = rows.select("vec_id", "label", (dot / (F.col("own") * F.col("len"))).alias("cosine"))
    best = scored.groupBy("vec_id").agg(F.max_by(F.struct("label", "cosine"), F.struct(F.round("cosine", 9), -F.col("label"))).alias("b"))
    kind = F.when(F.col("b.cosine") >= 0.85, "FUZZY_MATCH").when(F.col("b.cosine") >= 0.55, "POSSIBLE_MATCH").otherwise("NO_MATCH")
    return best.select("vec_id", F.col("b.label").alias("nearest"), F.round("b.cosine", 4).alias("cosine"), kind.alias("match_type"))


LIST = (person_exact, person_alias, person_initial, person_jaro_winkler, person_fuzzy_topk, person_screening, watchlist_merge, canonical_parent, mixed_resolution, vector_top1)
QUERIES = {f.__name__: f for f in LIST}

_F, _L = (f"[{', '.join(repr(x) for x in v)}]" for v in (FIRST, LAST))
SCREENED = f"""watch AS (SELECT i AS ordinal, 'P' || i AS id, {_F}[(i % 12 + 1)::INT] AS f, {_L}[(i // 12 + 1)::INT] AS l FROM (SELECT unnest(range(144)) AS i)),
parts AS (SELECT c_custkey AS k, c_name, {_F}[(c_custkey * 7 % 12 + 1)::INT] AS f, {_L}[(c_custkey * 5 % 12 + 1)::INT] AS l FROM customer)"""
ORACLE = {
    "person_exact": f"WITH {SCREENED} SELECT k AS row_index, id FROM parts JOIN watch USING (f, l) WHERE k % 8 IN (0, 1, 2)",
    "person_alias": f"WITH {SCREENED}, first AS (SELECT substr(f, 1, 2) AS f2, l, arg_min(id, ordinal) AS id FROM watch GROUP BY 1, 2) SELECT k AS row_index, id FROM parts p JOIN first ON f2 = substr(p.f, 1, 2) AND first.l = p.l WHERE k % 8 = 3",
    "person_initial": f"""WITH {SCREENED}, cand AS (SELECT k, p.f AS pf, w.ordinal, w.id, w.f AS wf, k % 8 AS form FROM parts p JOIN watch w ON w.l = p.l WHERE k % 8 < 5)
SELECT k AS row_index, arg_min(id, ordinal) AS id FROM cand WHERE CASE WHEN form = 3 THEN substr(pf, 1, 2) = substr(wf, 1, 2) WHEN form = 2 THEN false ELSE substr(pf, 1, 3) = substr(wf, 1, 3) END GROUP BY 1""",
    "person_jaro_winkler": "SELECT s_suppkey, max(round(jw, 6)) AS best, count_if(round(jw, 6) >= 0.75)::BIGINT AS close FROM (SELECT s_suppkey, jaro_winkler_similarity(lower(s_name), lower(c_name)) AS jw FROM supplier JOIN customer ON s_nationkey = c_nationkey) GROUP BY 1",
    "watchlist_merge": f"""WITH {SCREENED.split("parts AS")[0].rstrip().rstrip(",")}, a AS (SELECT *, 1950 + ordinal % 40 AS y, lower(f || ' ' || l) AS n FROM watch),
k AS (SELECT n || '|' || y AS key, id, f || ' ' || l AS canonical_name, CASE WHEN ordinal % 2 = 0 THEN 'LIST_A+LIST_B' ELSE 'LIST_A' END AS source, substr(f, 1, 2) || ' the ' || lower(l) || CASE WHEN ordinal % 2 = 0 THEN ';' || lower(f) ELSE '' END AS aliases, (1 + (ordinal % 2 = 0)::INT)::BIGINT AS merged FROM a
  UNION ALL SELECT n || '|', 'C' || id, n, 'LIST_C', substr(f, 1, 2) || ' the ' || lower(l), 1 FROM a WHERE ordinal % 3 = 0) SELECT * FROM k""",
    "vector_top1": """WITH d AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, d, avg(x::DECIMAL(20,12))::DOUBLE AS x FROM d GROUP BY ALL), c AS (SELECT label, list(x ORDER BY d) AS centre FROM m GROUP BY 1),
s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], centre) AS cosine FROM embeddings, c)
SELECT vec_id, label AS nearest, round(cosine, 4) AS cosine, CASE WHEN cosine >= 0.85 THEN 'FUZZY_MATCH' WHEN cosine >= 0.55 THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS match_type FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 9) DESC, label) = 1""",
}
