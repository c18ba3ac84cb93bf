"""Queries on names and personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import pii
from ..functions import words as W
from .inputs import table

FIXTURE = [
    "Acme Holdings LLC", "ACME FREIGHT  Co.", "Northern Trust Bank", "Ministry of Transport", "M/V Ocean Star", "M/T Blue Whale IMO 9074729", "MV. Sea Queen", "Vessel Aurora", "Dr. Jane Roe", "John Q Public Jr.", "Ivan Petrovich Sidorov", "Sidorov Ivan Petrovich",
    "ROE, JANE ANN", "Madonna", "x", "", "   ", "n/a", "aaaa", "12345678", "INV-2024-001234", "José García", "Müller, Jörg", "Acme Support Services", "a.b.smith", "Beta  Insurance,, Ltd.", "Gamma S.A.", "Delta Sdn Bhd", "One Two Three Four Five", "O'Brien, Pat", "IMO 9074729",
    "Ryskin Markovich", "Oleg Tsaryov Anatolevich", "99 Red 88 Balloons 77", "Prof Mr Smith PhD", "S/S Minnow", "Prince", "Global Trading", "The", "J Smith", "STATE OIL", "Lines & Lines", "Zed Limited", "tbd", "--",
]


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all kinds: those of the tables, and some that show each rule."""
    fixed = spark.createDataFrame([(f"f{i}", n) for i, n in enumerate(FIXTURE)] + [("f-", None)], "id string, name string")
    out = fixed
    for t, key, col in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name")):
        out = out.unionByName(table(spark, sf_dir, t).select(F.concat(F.lit(t[0]), F.col(key).cast("string")).alias("id"), F.col(col).alias("name")))
    return out


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


NAMES = f"""names AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 'p' || p_partkey, p_name FROM part UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'f' || (i - 1), x FROM (SELECT unnest([{_quoted(FIXTURE)}]) AS x, unnest(range(1, {len(FIXTURE) + 1})) AS i) UNION ALL SELECT 'f-', NULL),
w AS (SELECT id, name, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS w FROM names)"""


def classify_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("id", N.classify_entity(F.col("name")).alias("c")).select("id", "c.entity_type", "c.confidence", F.array_join("c.flags", ",").alias("flags"))


def org_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = names(spark, sf_dir).select("id", N.sanitize_organization(F.col("name")).alias("c"))
    return out.select("id", "c.sanitized_name", "c.org_name", "c.legal_suffix", "c.org_category", F.round("c.confidence", 3).alias("confidence"), "c.decision_path")


def vessel_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = names(spark, sf_dir).select("id", N.sanitize_vessel(F.col("name")).alias("c"))
    return out.select("id", "c.sanitized_name", "c.vessel_name", "c.imo_number", "c.vessel_prefix", "c.confidence", "c.decision_path")


def person_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = names(spark, sf_dir).select("id", N.sanitize_person(F.col("name")).alias("c"))
    return out.select("id", "c.sanitized", "c.first_name", "c.middle_name", "c.last_name", "c.suffix", "c.format_standardized", "c.confidence", F.array_join("c.flags", ",").alias("flags"))


def person_match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return names(spark, sf_dir).select("id", N.match_name(n).alias("match_name"), N.index_name(n).alias("index_name"), N.last_name(n).alias("last_name"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(k.lower()) for k, c in pii.counts(F.col("text")).items()))


def pii_severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.create_map(*(x for k, c in pii.counts(F.col("text")).items() for x in (F.lit(k), c)))).alias("category", "n"))
    return d.where("n > 0").groupBy("category").agg(F.sum("n").alias("finds"), F.count(F.lit(1)).alias("documents")).withColumn("severity", pii.severity(F.col("category")))


def log_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(pii.scrub_log(F.col("text"))).alias("scrubbed_md5"))


def pii_mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking leaves no find, and unmasking gives the text back."""
    m = pii.mask(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), (pii.unmask(F.col("masked"), F.col("tokens")) == F.col("text")).alias("restored"))


LIST = (classify_entity_names, org_sanitize, vessel_sanitize, person_name_parts, person_match_keys, pii_counts, pii_severity_report, log_scrub, pii_mask_roundtrip)
QUERIES = {f.__name__: f for f in LIST}

_KEY = W.CORPORATE + W.GOVERNMENT + W.LOGISTICS + W.INSURANCE + W.FINANCE + W.INDICATORS
CLASSIFY = f"""WITH {NAMES},
a AS (SELECT *, upper(w) AS u, string_split(w, ' ') AS t, translate(w, ' .-,', '') AS c, lower(replace(w, ' ', '')) AS solid, regexp_extract(w, '(?i)\\bIMO[:\\s]?(\\d{{7}})\\b', 1) AS imo FROM w),
b AS (SELECT *, list_filter(list_transform(t, lambda x: rtrim(upper(x), '.,;:')), lambda x: x IN ({_quoted(_KEY)}))[1] AS k, rtrim(upper(t[1]), '.') AS f, rtrim(upper(t[-1]), '.,') AS l,
  CASE {" ".join(f"WHEN starts_with(u, '{p}') OR starts_with(u, '{p.replace('/', ' ')}') THEN '{p}'" for p in W.VESSEL_SLASH)} END AS slash FROM a),
d AS (SELECT *, coalesce(slash, CASE WHEN f IN ({_quoted(W.VESSEL_WORDS)}) THEN f END) AS prefix,
  CASE WHEN k IN ({_quoted(W.CORPORATE)}) THEN 'CORPORATE' WHEN k IN ({_quoted(W.GOVERNMENT)}) THEN 'GOVERNMENT' WHEN k IN ({_quoted(W.LOGISTICS)}) THEN 'LOGISTICS' WHEN k IN ({_quoted(W.INSURANCE + W.FINANCE)}) THEN 'FINANCE' ELSE 'INDICATOR' END AS kind,
  length(regexp_replace(c, '\\D', '', 'g'))::DOUBLE / nullif(length(c), 0) AS digits, length(regexp_replace(w, '[^\\p{{L}}]', '', 'g'))::DOUBLE / nullif(length(replace(w, ' ', '')), 0) AS letters FROM b),
e AS (SELECT id, CASE WHEN name IS NULL THEN 'GARBAGE|0.0|NULL_INPUT' WHEN w = '' THEN 'GARBAGE|0.0|EMPTY' WHEN length(w) < 2 THEN 'GARBAGE|0.1|TOO_SHORT' WHEN imo <> '' THEN 'VESSEL|0.95|IMO_PRESENT,IMO_' || imo WHEN regexp_matches(w, '(?i)\\bIMO\\b') THEN 'VESSEL|0.95|IMO_PRESENT'
  WHEN digits > 0.35 THEN 'GARBAGE|0.2|NUMERIC_HEAVY' WHEN regexp_matches(w, '\\d{{5,}}') OR regexp_matches(u, '^[A-Z]{{2,4}}[-/]?\\d{{4,}}') OR regexp_matches(u, '^[0-9A-F]{{8}}-[0-9A-F]{{4}}-') THEN 'GARBAGE|0.3|ID_LIKE'
  WHEN lower(w) IN ({_quoted(W.PLACEHOLDERS + W.DASHES)}) THEN 'GARBAGE|0.0|GARBAGE_VALUE' WHEN replace(solid, solid[1], '') = '' THEN 'GARBAGE|0.1|REPEATED_CHAR' WHEN prefix IS NOT NULL THEN 'VESSEL|0.9|VESSEL_PREFIX_' || prefix
  WHEN k IS NOT NULL THEN 'ORGANIZATION|' || CASE WHEN kind IN ('CORPORATE', 'GOVERNMENT') THEN '0.95' ELSE '0.85' END || '|ORG_' || kind || ',KEYWORD_' || k WHEN f IN ({_quoted(W.TITLES)}) THEN 'PERSON|0.95|TITLE_' || f WHEN l IN ({_quoted(W.SUFFIXES)}) THEN 'PERSON|0.9|SUFFIX_' || l
  WHEN len(list_filter(t, lambda x: regexp_matches(upper(x), '.{{3,}}({"|".join(W.PATRONYMICS)})$'))) > 0 THEN 'PERSON|0.9|PATRONYMIC' WHEN len(t) BETWEEN 2 AND 4 AND letters >= 0.8 THEN 'PERSON|0.75|TOKEN_COUNT_PERSON_RANGE,ALPHABETIC'
  WHEN len(t) > 4 THEN 'ORGANIZATION|0.5|LOW_CERTAINTY,LONG_NAME' WHEN len(t) = 1 THEN 'ORGANIZATION|0.4|LOW_CERTAINTY,SINGLE_TOKEN' ELSE 'PERSON|0.5|LOW_CERTAINTY' END AS x FROM d)
SELECT id, split_part(x, '|', 1) AS entity_type, split_part(x, '|', 2)::DOUBLE AS confidence, split_part(x, '|', 3) AS flags FROM e"""

_SQUEEZE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\.\\.+', '.', 'g'), ',,+', ',', 'g'), ';;+', ';', 'g'), '::+', ':', 'g'), '!!+', '!', 'g'), '\\?\\?+', '?', 'g')"
_LEGAL = _quoted(W.LEGAL_SUFFIXES)
ORG = f"""WITH {NAMES},
a AS (SELECT id, trim(coalesce(name, '')) AS raw, upper(trim({_SQUEEZE.format("coalesce(w, '')")})) AS u FROM w),
b AS (SELECT *, list_filter(string_split(u, ' '), lambda x: x <> '') AS t FROM a),
c AS (SELECT *, CASE WHEN len(t) >= 2 THEN t[-2] || ' ' || t[-1] END AS pair, t[-1] AS one, rtrim(t[-1], '.,') AS bare FROM b),
d AS (SELECT *, CASE WHEN pair IN ({_LEGAL}) OR translate(pair, '.,', '') IN ({_LEGAL}) THEN pair WHEN one IN ({_LEGAL}) OR translate(one, '.,', '') IN ({_LEGAL}) THEN one WHEN bare IN ({_LEGAL}) THEN bare END AS found,
  CASE WHEN pair IN ({_LEGAL}) OR translate(pair, '.,', '') IN ({_LEGAL}) THEN 2 ELSE 1 END AS used,
  CASE WHEN regexp_matches(u, '{N.one_of(W.GOVERNMENT + W.BANKS)}') THEN 'GOVERNMENT' WHEN regexp_matches(u, '{N.one_of(W.INSURANCE + W.INSURANCE_MORE)}') THEN 'INSURANCE' WHEN regexp_matches(u, '{N.one_of(W.FINANCE)}') THEN 'FINANCE' WHEN regexp_matches(u, '{N.one_of(W.LOGISTICS + W.LOGISTICS_PHRASES)}') THEN 'LOGISTICS' ELSE 'COMPANY' END AS cat FROM c),
e AS (SELECT *, array_to_string(t[1:greatest(len(t) - used, 0)], ' ') AS rest, CASE found {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.LEGAL_SHORT.items())} ELSE translate(found, '.,', '') END AS short FROM d)
SELECT id, CASE WHEN length(raw) < 2 THEN raw ELSE u END AS sanitized_name, CASE WHEN length(raw) < 2 THEN raw WHEN found IS NOT NULL AND rest <> '' THEN rest ELSE u END AS org_name, CASE WHEN length(raw) < 2 THEN '' ELSE coalesce(short, '') END AS legal_suffix, CASE WHEN length(raw) < 2 THEN 'OTHER' ELSE cat END AS org_category,
  (CASE WHEN raw = '' THEN 0.0 WHEN length(raw) < 2 THEN 0.1 WHEN found IS NOT NULL AND cat <> 'COMPANY' THEN 1.0 WHEN found IS NOT NULL THEN 0.9 WHEN cat <> 'COMPANY' THEN 0.8 ELSE 0.7 END)::DOUBLE AS confidence, CASE WHEN length(raw) < 2 THEN 'GARBAGE' WHEN found IS NOT NULL THEN 'SUFFIX_EXTRACTED' ELSE 'NORMALIZED' END AS decision_path FROM e"""

_P = {k: p.replace("'", "''") for k, p in pii.PATTERNS.items()}
_SCRUB = "text"
for _name, _kind in pii.LOG_ORDER:
    _SCRUB = f"regexp_replace({_SCRUB}, '{_P[_kind]}', '[{_name}_REDACTED]', 'g')"
ORACLE = {
    "classify_entity_names": CLASSIFY,
    "org_sanitize": ORG,
    "pii_counts": "SELECT doc_id, " + ", ".join(f"coalesce(len(regexp_extract_all(text, '{p}')), 0)::BIGINT AS {k.lower()}" for k, p in _P.items()) + " FROM documents",
    "pii_severity_report": "SELECT category, sum(n)::BIGINT AS finds, count(*)::BIGINT AS documents, severity FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS category, '{pii.SEVERITY[k]}' AS severity, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in _P.items()) + ") WHERE n > 0 GROUP BY ALL",
    "log_scrub": f"SELECT doc_id, md5({_SCRUB}) AS scrubbed_md5 FROM documents",
}
