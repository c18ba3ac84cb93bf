"""Queries on canonical JSON and on rounding by binary value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as J
from ..shared import spread
from .inputs import table

#: A private-use key sorts after one beyond the basic plane by UTF-16 units, and before it by code points.
HIGH, ASTRAL = "", "\U0001f600"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested values: lists in lists, tiny and huge doubles, null fields, control characters, keys of all planes."""
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    scales = [1.0, 1e-9, 1e-300, 1e15, 1e30, -1.0 / 3]
    note = F.concat(F.lit('a "quoted" \\ line\n\x01\x1f\x7f é'), F.col("o_orderpriority"))
    return spread(table(spark, sf_dir, "orders")).select(
        k.alias("id"),
        F.struct(
            F.struct(k.alias("key"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("Status"), (k % 3 == 0).alias("é")).alias("order"), F.array(*(x * s for s in scales)).alias("amounts"),
            F.array(F.array((k % 1000 / 8.0)), F.array(F.lit(-0.0), F.when(k % 5 > 0, x / 7e6)), F.array().cast("array<double>")).alias("lists"), F.create_map(F.lit(HIGH), k, F.lit(ASTRAL), -k, F.lit("a"), F.lit(None).cast("long")).alias("by_key"), note.alias("note"),
        ).alias("v"),
    )


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values in all three forms, and their hashes."""
    rows = nested(spark, sf_dir)
    kind = rows.schema["v"].dataType
    forms = {form: J.value(F.col("v"), kind, form) for form in (J.JCS, J.SIGNED, J.PLAIN)}
    return rows.select("id", *(c.alias(f) for f, c in forms.items())).withColumn("jcs_hash", F.sha2(J.JCS, 256))


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values given as JSON text of any layout."""
    text = F.concat(F.lit('{ "z": [1, 2.50, {"b": '), (F.col("o_totalprice") * 1e15).cast("string"), F.lit(', "a": [[], {}, null, true]}],\n "note": "\\u0041\\t\\u001F", "id" : '), F.col("o_orderkey").cast("string"), F.lit(', "price": '), F.col("o_totalprice").cast("string"), F.lit("}"))
    return spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("id"), J.json_value(text).alias("jcs"), F.sha2(J.json_value(text, J.SIGNED), 256).alias("signed_hash"))


def half_even_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighths lie between two hundredths in half of all cases; other ties are none by their binary value."""
    x = F.col("o_totalprice")
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", *(J.rounded(c, n).alias(name) for name, c, n in (("eighths", F.col("o_orderkey") / 8.0, 2), ("thousandths", F.col("o_orderkey") / 1000.0, 2), ("price", x, 1), ("share", x / 7e6, 6), ("whole", x / 2, 0))))


QUERIES = {f.__name__: f for f in (canonical_values, canonical_json, half_even_values)}

_NOTE = r"""'a \"quoted\" \\ line\n\u0001\u001f' || chr(127) || chr(8232) || 'é' || o_orderpriority"""
_SPELT = {"jcs": "CASE WHEN {x} = 0 THEN '0' ELSE regexp_replace(({x})::VARCHAR, '\\.0$', '') END", "plain": "({x})::VARCHAR"}
_DIGITS = "CASE WHEN {x} = floor({x}) THEN {x}::HUGEINT::VARCHAR ELSE printf('%.10f', {x})::DOUBLE::VARCHAR END"
_SPELT["signed"] = f"CASE WHEN {{x}} = 0 THEN '0' ELSE {_DIGITS} END"


def _twin(form: str) -> str:
    x = lambda e: f"coalesce({_SPELT[form].format(x=f'({e})')}, 'null')"
    scales = ["1.0", "1e-9", "1e-300", "1e15", "1e30", repr(-1.0 / 3)]
    amounts = " || ',' || ".join(x(f"o_totalprice * {s}::DOUBLE") for s in scales)
    key = lambda k: f"chr({ord(k)})"
    high, astral = f"'\"' || {key(HIGH)} || '\":' || o_orderkey", f"'\"' || {key(ASTRAL)} || '\":' || -o_orderkey"
    keys = f"{astral} || ',' || {high}" if form == "jcs" else f"{high} || ',' || {astral}"
    lists = f"'[[' || {x('(o_orderkey % 1000) / 8.0::DOUBLE')} || '],[' || {x('-0.0::DOUBLE') if form != 'plain' else chr(39) + '-0.0' + chr(39)} || ',' || {x('CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 7e6::DOUBLE END')} || '],[]]'"
    status = "CASE WHEN o_orderkey % 2 = 0 THEN '\"' || o_orderstatus || '\"' ELSE 'null' END"
    order = f"'{{\"Status\":' || {status} || ',\"key\":' || o_orderkey || ',\"é\":' || (o_orderkey % 3 = 0) || '}}'"
    return f"'{{\"amounts\":[' || {amounts} || '],\"by_key\":{{\"a\":null,' || {keys} || '}},\"lists\":' || {lists} || ',\"note\":\"' || {_NOTE} || '\",\"order\":' || {order} || '}}'"


_JSON = '\'{{"id":\' || o_orderkey || \',"note":"A\\t\\u001f","price":\' || {p} || \',"z":[1,2.5,{{"a":[[],{{}},null,true],"b":\' || {b} || \'}}]}}\''
ORACLE = {
    "canonical_values": f"SELECT *, sha256(jcs) AS jcs_hash FROM (SELECT o_orderkey AS id, {_twin('jcs')} AS jcs, {_twin('signed')} AS signed, {_twin('plain')} AS plain FROM orders)",
    "canonical_json": "SELECT o_orderkey AS id, {} AS jcs, sha256({}) AS signed_hash FROM orders".format(*(_JSON.format(p=_SPELT[f].format(x="o_totalprice"), b=_SPELT[f].format(x="(o_totalprice * 1e15::DOUBLE)")) for f in ("jcs", "signed"))),
    "half_even_values": "SELECT o_orderkey, " + ", ".join(f"printf('%.{n}f', {x})::DOUBLE AS {name}" for name, x, n in (("eighths", "o_orderkey / 8.0::DOUBLE", 2), ("thousandths", "o_orderkey / 1000.0::DOUBLE", 2), ("price", "o_totalprice", 1), ("share", "o_totalprice / 7e6::DOUBLE", 6), ("whole", "o_totalprice / 2::DOUBLE", 0))) + " FROM orders",
}
