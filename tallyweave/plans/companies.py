"""Queries on company names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import companies as C
from .inputs import table

#: Parts that the listed names are put together from.
A = ["Alpine", "Borealis", "Crescent", "Delmar", "Eastgate", "Fairview", "Granite", "Harbor", "Ironwood", "Juniper"]
B = ["Freight", "Metals", "Foods", "Textiles", "Energy", "Optics", "Timber"]
PARENTS = {"fast mail": "Alpine Freight Group", "old mill": "Ironwood Timber Holdings"}


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 names for each of two tenants; the second has a list of its own."""
    rows = table(spark, sf_dir, "part").where("p_partkey < 140").select(F.col("p_partkey").alias("i"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    first, second = pick(A, F.col("i") % 10), pick(B, F.floor(F.col("i") / 10) % 7)
    name = F.when(F.col("i") < 70, F.concat_ws(" ", first, second, F.lit("Inc."))).otherwise(F.concat_ws(" ", second, F.lit("of"), first))
    return rows.select(F.when(F.col("i") < 70, "t1").otherwise("t2").alias("tenant"), F.col("i").alias("listed_id"), name.alias("listed_name"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as customers put them: equal, otherwise written, misspelt, those of parents, and no names."""
    k = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    first, second = pick(A, k % 10), pick(B, k % 7)
    plain = F.concat_ws(" ", first, second)
    forms = [F.concat(plain, F.lit(" Inc.")), F.concat(F.upper(plain), F.lit(", LLC")), F.concat(F.substring(plain, 1, 5), F.substring(plain, 5, 40)), pick(["Fast Mail Ltd", "old-mill", "Unheard Of Name"], k % 3), F.when(k % 2 == 0, "12345"), F.concat(second, F.lit(" of "), first)]
    form = F.coalesce(*(F.when(k % 6 == i, v) for i, v in enumerate(forms)))
    return table(spark, sf_dir, "customer").select(F.when(k % 4 == 0, "t2").otherwise("t1").alias("tenant"), k.alias("key"), form.alias("name"))


def company_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = spark.createDataFrame(list(PARENTS.items()), "alias string, parent string")
    return C.resolve(asked(spark, sf_dir), listed(spark, sf_dir), parents).withColumn("confidence", F.round("confidence", 6))


def vector_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five listed names of its tenant that are most like each name."""
    out = C.nearest(asked(spark, sf_dir).where("name IS NOT NULL"), listed(spark, sf_dir), 0.3, 5)
    return out.select("tenant", "key", "listed_id", F.round("likeness", 6).alias("likeness"), F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (company_waterfall, vector_candidates)}

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NORMAL = rf"trim(regexp_replace(trim(regexp_replace(lower({{}}), '[^\p{{{{L}}}}\p{{{{N}}}}]+', ' ', 'g')), '(\s+({C.ENDINGS}))+$', ''))"
NAMES = rf"""listed AS (SELECT CASE WHEN i < 70 THEN 't1' ELSE 't2' END AS tenant, i AS listed_id, CASE WHEN i < 70 THEN a || ' ' || b || ' Inc.' ELSE b || ' of ' || a END AS listed_name
  FROM (SELECT p_partkey AS i, {_LIST(A)}[(p_partkey % 10 + 1)::INT] AS a, {_LIST(B)}[(p_partkey // 10 % 7 + 1)::INT] AS b FROM part WHERE p_partkey < 140)),
asked AS (SELECT CASE WHEN k % 4 = 0 THEN 't2' ELSE 't1' END AS tenant, k AS key, CASE k % 6 WHEN 0 THEN plain || ' Inc.' WHEN 1 THEN upper(plain) || ', LLC' WHEN 2 THEN substr(plain, 1, 5) || substr(plain, 5, 40) WHEN 3 THEN ['Fast Mail Ltd', 'old-mill', 'Unheard Of Name'][(k % 3 + 1)::INT] WHEN 4 THEN CASE WHEN k % 2 = 0 THEN '12345' END ELSE b || ' of ' || a END AS name
  FROM (SELECT c_custkey AS k, {_LIST(A)}[(c_custkey % 10 + 1)::INT] AS a, {_LIST(B)}[(c_custkey % 7 + 1)::INT] AS b, a || ' ' || b AS plain FROM customer)),
lr AS (SELECT tenant, listed_id, substr(p, i, 3) AS run, count(*) AS n FROM (SELECT tenant, listed_id, ' ' || {_NORMAL.format("listed_name").replace("{{", "{").replace("}}", "}")} || ' ' AS p, unnest(range(1, length(p) - 1)) AS i FROM listed) GROUP BY ALL),
idf AS (SELECT tenant, run, ln((max(size) + 1) / (count(*) + 1)::DOUBLE) + 1 AS idf FROM lr JOIN (SELECT tenant, count(*) AS size FROM listed GROUP BY 1) USING (tenant) GROUP BY 1, 2),
ar AS (SELECT tenant, key, substr(p, i, 3) AS run, count(*) AS n FROM (SELECT tenant, key, ' ' || {_NORMAL.format("name").replace("{{", "{").replace("}}", "}")} || ' ' AS p, unnest(range(1, length(p) - 1)) AS i FROM asked WHERE name IS NOT NULL) GROUP BY ALL),
bv AS (SELECT tenant, listed_id, run, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY tenant, listed_id)) AS v FROM lr JOIN idf USING (tenant, run)),
av AS (SELECT tenant, key, run, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY tenant, key)) AS w FROM ar JOIN idf USING (tenant, run)),
likely AS (SELECT tenant, key, listed_id, sum(w * v) AS likeness FROM av JOIN bv USING (tenant, run) GROUP BY ALL)"""
ORACLE = {
    "vector_candidates": f"""WITH {NAMES} SELECT tenant, key, listed_id, round(likeness, 6) AS likeness, row_number() OVER (PARTITION BY tenant, key ORDER BY round(likeness, 9) DESC, listed_id) AS rank FROM likely WHERE round(likeness, 9) >= 0.3 QUALIFY rank <= 5""",
    "company_waterfall": f"""WITH {NAMES}, best AS (SELECT tenant, key, listed_id, round(likeness, 9) AS likeness FROM likely WHERE round(likeness, 9) >= 0.55 QUALIFY row_number() OVER (PARTITION BY tenant, key ORDER BY round(likeness, 9) DESC, listed_id) = 1),
norms AS (SELECT *, {_NORMAL.format("listed_name").replace("{{", "{").replace("}}", "}")} AS normal FROM listed), a AS (SELECT *, {_NORMAL.format("name").replace("{{", "{").replace("}}", "}")} AS normal FROM asked),
met AS (SELECT a.*, e.listed_name AS exact, m.listed_name AS norm, CASE a.normal WHEN 'fast mail' THEN 'Alpine Freight Group' WHEN 'old mill' THEN 'Ironwood Timber Holdings' END AS parent, n.listed_name AS near, b.likeness
  FROM a LEFT JOIN listed e ON a.tenant = e.tenant AND a.name = e.listed_name LEFT JOIN norms m ON a.tenant = m.tenant AND a.normal = m.normal LEFT JOIN best b ON a.tenant = b.tenant AND a.key = b.key LEFT JOIN listed n ON n.tenant = b.tenant AND n.listed_id = b.listed_id),
l AS (SELECT *, CASE WHEN name IS NULL OR length(trim(name)) < 2 OR NOT regexp_matches(name, '[a-zA-Z]') THEN 'L0_GARBAGE' WHEN exact IS NOT NULL THEN 'L1_EXACT' WHEN norm IS NOT NULL THEN 'L1_NORM' WHEN parent IS NOT NULL THEN 'L1_KNOWN_PARENT' WHEN near IS NOT NULL THEN 'L2_VECTOR' ELSE 'L4_HUMAN' END AS layer FROM met)
SELECT tenant, key, name, CASE layer WHEN 'L1_EXACT' THEN exact WHEN 'L1_NORM' THEN norm WHEN 'L1_KNOWN_PARENT' THEN parent WHEN 'L2_VECTOR' THEN near END AS resolved, layer, round(CASE WHEN starts_with(layer, 'L1') THEN 1.0::DOUBLE WHEN layer = 'L2_VECTOR' THEN likeness ELSE 0.0 END, 6) AS confidence,
  CASE WHEN starts_with(layer, 'L1') THEN 'EXACT_MATCH' WHEN layer = 'L2_VECTOR' AND likeness >= 0.85 THEN 'FUZZY_MATCH' WHEN layer = 'L2_VECTOR' THEN 'POSSIBLE_MATCH' ELSE 'NO_MATCH' END AS match_type FROM l""",
}
