"""Watch lists in their published forms, all as ordinal, source, id, canonical_name, aliases, dob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["ordinal", "source", "id", "canonical_name", "aliases", "dob"]


def _listed(df: DataFrame, source: str, id_: Column, name: Column, aliases: Column, dob: Column) -> DataFrame:
    kept = F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    out = df.select(id_.cast("string").alias("id"), F.trim(name).alias("canonical_name"), kept.alias("aliases"), dob.cast("string").alias("dob"))
    out = out.where("canonical_name <> ''").withColumn("source", F.lit(source)).withColumn("ordinal", F.monotonically_increasing_id())
    return out.select(*COLUMNS)


def read_csv_list(spark: SparkSession, path: str, source: str = "CSV") -> DataFrame:
    """Columns id, canonical_name, aliases (parted by |), dob."""
    df = spark.read.option("header", True).csv(path)
    return _listed(df, source, F.col("id"), F.col("canonical_name"), F.split("aliases", r"\|"), F.col("dob") if "dob" in df.columns else F.lit(None))


def read_json_list(spark: SparkSession, path: str, source: str = "JSON") -> DataFrame:
    df = spark.read.option("multiLine", True).schema("id string, canonical_name string, aliases array<string>, metadata struct<dob:string>").json(path)
    return _listed(df, source, F.col("id"), F.col("canonical_name"), F.col("aliases"), F.col("metadata.dob"))


def read_sdn(spark: SparkSession, path: str) -> DataFrame:
    """The headerless 12-column list: individuals only; birth date and further names stand in the remarks."""
    df = spark.read.schema(", ".join(f"_c{i} string" for i in range(12))).csv(path)
    df = df.where(F.lower(F.trim("_c2")) == "individual")
    remarks = F.coalesce("_c11", F.lit(""))
    dob = F.nullif(F.regexp_extract(remarks, r"DOB ([^;]+)", 1), F.lit(""))
    aka = F.regexp_extract_all(remarks, F.lit(r"a\.k\.a\. '([^']+)'"), F.lit(1))
    return _listed(df, "OFAC_SDN", F.trim("_c0"), F.col("_c1"), aka, F.trim(dob))


def read_un_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, INDIVIDUAL_ALIAS array<struct<ALIAS_NAME:string>>, INDIVIDUAL_DATE_OF_BIRTH array<struct<DATE:string,YEAR:string>>"
    df = spark.read.format("xml").option("rowTag", "INDIVIDUAL").schema(schema).load(path)
    born = F.try_element_at(F.col("INDIVIDUAL_DATE_OF_BIRTH"), F.lit(1))
    return _listed(df, "UN", F.col("DATAID"), F.concat_ws(" ", "FIRST_NAME", "THIRD_NAME", "SECOND_NAME"), F.transform("INDIVIDUAL_ALIAS", lambda a: a["ALIAS_NAME"]), F.coalesce(born["DATE"], born["YEAR"]))


def read_eu_xml(spark: SparkSession, path: str) -> DataFrame:
    """Persons only; the first strong alias is the name, ten others at most are kept."""
    schema = "_logicalId string, subjectType struct<_code:string>, nameAlias array<struct<_wholeName:string,_strong:string>>, birthdate array<struct<_birthdate:string,_year:string>>"
    df = spark.read.format("xml").option("rowTag", "sanctionEntity").option("ignoreNamespace", True).schema(schema).load(path).where(F.col("subjectType._code") == "person")
    names = F.filter("nameAlias", lambda a: F.coalesce(a["_wholeName"], F.lit("")) != "")
    strong = F.try_element_at(F.filter(names, lambda a: F.lower(a["_strong"]) == "true"), F.lit(1))["_wholeName"]
    first = F.coalesce(strong, F.try_element_at(names, F.lit(1))["_wholeName"])
    others = F.slice(F.filter(F.transform(names, lambda a: a["_wholeName"]), lambda n: n != first), 1, 10)
    born = F.try_element_at(F.col("birthdate"), F.lit(1))
    return _listed(df, "EU", F.col("_logicalId"), first, others, F.coalesce(born["_birthdate"], born["_year"]))
