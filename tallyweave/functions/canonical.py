"""Canonical JSON as columns: keys in order, no spaces, one spelling for each value.

Three forms differ in numbers and the order of keys. JCS: doubles in their shortest spelling without trailing zeros, keys by
UTF-16 units. SIGNED: doubles rounded to ten places, whole ones as integers, keys by code points. PLAIN: doubles in their
shortest spelling, keys by code points. A double's exponent is written from 1e16 up and below 1e-4.
"""

from __future__ import annotations

import json
import math
from json.encoder import encode_basestring as quote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import let

JCS, SIGNED, PLAIN = "jcs", "signed", "plain"
#: Places of the SIGNED form.
PLACES = 10

#: Characters that JSON escapes with a letter, and the letters.
SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
ESCAPES = {chr(i): f"\\u{i:04x}" for i in range(32)} | SHORT


def _quoted(c: Column, clean: str, escape) -> Column:
    escapes = F.from_json(F.lit(json.dumps(ESCAPES)), "map<string,string>")  # a constant
    slow = F.array_join(F.transform(F.split(c, ""), lambda ch: escape(ch, F.coalesce(F.try_element_at(escapes, ch), ch))), "")
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), F.when(c.rlike(clean), c).otherwise(slow), F.lit('"')))


def text(c: Column) -> Column:
    """A string, or null, as JSON."""
    return _quoted(c, r'\A[^\x00-\x1F"\\]*\z', lambda ch, known: known)


def ascii_text(c: Column) -> Column:
    """A string, or null, as JSON in which all but printable ASCII characters are escaped by their UTF-16 units."""
    units = lambda ch: F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return _quoted(c, r'\A[\x20-\x7E&&[^"\\]]*\z', lambda ch, known: F.when(known.rlike(r"\A[\x20-\x7E]*\z"), known).otherwise(units(ch)))


def _exact(a: Column) -> Column:
    """All digits of a positive double, without its point and zeros before them: those of m * 2^k, or of m * 5^-k for a fraction."""
    limb = 10**9

    def times(limbs: Column, by: Column) -> Column:
        """The limbs (nine digits each, least first) by a number below 2^20."""
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))

        def one(acc: Column, v: Column) -> Column:
            n = v * by + acc["carry"]
            return F.struct(F.array_append(acc["out"], n % limb).alias("out"), F.floor(n / limb).cast("long").alias("carry"))

        return F.aggregate(limbs, start, one, lambda acc: F.when(acc["carry"] > 0, F.array_append(acc["out"], acc["carry"])).otherwise(acc["out"]))

    def powers(base: int, step: int, n: Column) -> Column:
        """Factors below 2^20 that make base^n."""
        return F.concat(F.array_repeat(F.lit(base**step).cast("long"), F.floor(n / step).cast("int")), F.array(F.pow(F.lit(float(base)), (n % step).cast("double")).cast("long")))

    def digits(v: Column) -> Column:
        m, k = v["m"], v["k"]
        by = F.when(k >= 0, powers(2, 19, F.greatest(k, F.lit(0)))).otherwise(powers(5, 8, F.greatest(-k, F.lit(0))))
        limbs = F.aggregate(by, F.array(m % limb, F.floor(m / limb).cast("long")), lambda acc, b: times(acc, b))
        return F.ltrim(F.array_join(F.transform(F.reverse(limbs), lambda v: F.lpad(v.cast("string"), 9, "0")), ""), F.lit("0"))

    def parts(k: Column) -> Column:
        up = F.least(-k, F.lit(600))  # in two steps, since 2^-k may be beyond a double
        two = lambda n: F.pow(F.lit(2.0), n.cast("double"))
        return F.struct((a * two(up) * two(-k - up)).cast("long").alias("m"), k.alias("k"))

    return let(let(F.floor(F.log2(a)).cast("int") - 53, parts), digits)


def _digits(a: Column) -> Column:
    """The fewest digits that tell a positive double from all others, as d.ddde+XX; zeros may follow."""
    spelt = lambda n: F.format_string(f"%.{n}e", a)
    same = lambda n: let(spelt(n), lambda t: F.when(t.cast("double") == a, t))

    def nearer(long: Column) -> Column:
        """16 digits of 17 that end in 5, which may have been rounded up to it: by all digits. None where a 9 would be carried on.

        All digits are worked out only where both ways of rounding give the same double; where one does, it is the nearer.
        """
        head, tail = F.substring(long, 1, 16), F.substring(long, F.lit(19), F.length(long))
        last = F.substring(long, 17, 1).cast("int")
        cut = lambda up: F.concat(head, (last + up).cast("string"), tail)
        down, up = cut(0).cast("double") == a, (last < 9) & (cut(1).cast("double") == a)
        both = F.when(F.substring(_exact(a), 17, 1) >= "5", F.when(last < 9, cut(1))).otherwise(cut(0))
        return F.when(F.substring(long, 18, 1) == "5", F.when(down & (up | (last == 9)), both).when(down, cut(0)).when(up, cut(1)))

    few = F.when(a < 1e-300, F.coalesce(*(same(n) for n in range(14))))  # the smallest doubles have few digits
    return F.coalesce(few, same(14), let(spelt(16), nearer), same(15), spelt(16))


def double_text(x: Column) -> Column:
    """A double in its shortest spelling, with .0 where it is whole; nan, inf and -inf."""

    def parted(sci: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(sci, "e", 1), r"\.", ""), "0+$", "")
        return F.struct(digits.alias("d"), F.substring_index(sci, "e", -1).cast("int").alias("p"))

    def placed(d: Column, p: Column) -> Column:
        n = F.length(d)
        whole = F.concat(F.substring(d, F.lit(1), p + 1), F.repeat(F.lit("0"), p + 1 - n), F.lit("."), F.when(n > p + 1, F.substring(d, p + 2, n)).otherwise("0"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), d)
        sci = F.concat(F.substring(d, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(p < 0, "-").otherwise("+"), F.lpad(F.abs(p).cast("string"), 2, "0"))
        return F.when((p >= 0) & (p < 16), whole).when((p < 0) & (p >= -4), small).otherwise(F.when(F.abs(p) > 99, F.regexp_replace(sci, r"\d\d$", F.abs(p).cast("string"))).otherwise(sci))

    def spelt(x: Column) -> Column:
        sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
        body = let(let(_digits(F.abs(x)), parted), lambda s: placed(s["d"], s["p"]))
        return F.when(F.isnan(x), "nan").otherwise(F.concat(sign, F.when(F.abs(x) == float("inf"), "inf").when(x == 0, "0.0").otherwise(body)))

    return let(x.cast("double"), spelt)


def rounded(x: Column, places: int) -> Column:
    """A double rounded to places (12 at most) by its exact binary value, ties to even.

    |x| is m / 2^s for whole m and s. m * 10^places and 2^s are compared as decimals of 38 digits, so nothing is lost.
    Doubles that lie further apart than the places do stay as they are.
    """
    if not 0 <= places <= 12:
        raise ValueError("places must be 0 to 12")
    scale = 10**places

    def nearest(v: Column) -> Column:
        over = v["m"].cast("decimal(19,0)") * F.lit(scale).cast("decimal(13,0)")
        half = (v["s"] / 2).cast("int")
        power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n).cast("decimal(19,0)")
        return let(F.struct(over.alias("o"), (power(half) * power(v["s"] - half)).alias("u")), lambda w: let(F.struct((w["o"] % w["u"]).alias("r"), w["o"].alias("o"), w["u"].alias("u")), whole))

    def whole(w: Column) -> Column:
        q = ((w["o"] - w["r"]) / w["u"]).cast("long")
        twice = w["r"] * 2
        return F.when(twice > w["u"], q + 1).when(twice == w["u"], q + q % 2).otherwise(q).cast("double") / float(scale)

    def of(x: Column) -> Column:
        a, sign = F.abs(x), F.when(x.cast("string").startswith("-"), -1.0).otherwise(1.0)
        s = F.lit(53) - F.floor(F.log2(a)).cast("int")
        exact = let(let(s, lambda s: F.struct((a * F.pow(F.lit(2.0), s.cast("double"))).cast("long").alias("m"), s.alias("s"))), nearest)
        return F.when(x.isNull() | F.isnan(x) | (x == 0) | (a * float(scale) >= 2.0**53), x).when(a < 2.0**-50, x * F.lit(0.0)).otherwise(sign * exact)

    return let(x.cast("double"), of)


def integer_text(x: Column) -> Column:
    """All digits of a double that is whole: by a product of two whole numbers as long as it has 38 digits at most."""

    def product(a: Column) -> Column:
        n = F.floor(F.log2(a)).cast("int") - 61
        m = (a * F.pow(F.lit(2.0), -n.cast("double"))).cast("long").cast("decimal(19,0)")
        return (m * F.call_function("shiftleft", F.lit(1).cast("long"), n).cast("decimal(19,0)")).cast("string")

    def digits(a: Column) -> Column:
        return F.when(a < 2.0**122, product(a)).otherwise(_exact(a))

    return let(x, lambda x: F.when(F.abs(x) < 2.0**63, x.cast("long").cast("string")).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), let(F.abs(x), digits))))


def double(x: Column, form: str = PLAIN) -> Column:
    """A double, or null, as JSON. SIGNED has no spelling for nan and inf: they raise."""

    def signed(x: Column) -> Column:
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        whole = (F.abs(x) >= 2.0**53) | (x % 1.0 == 0)
        return F.when(odd, F.raise_error(F.lit("no canonical number")).cast("string")).when(whole, integer_text(x)).otherwise(double_text(rounded(x, PLACES)))

    if form == SIGNED:
        out = let(x, signed)
    elif form == JCS:
        out = F.when(x == 0, "0").otherwise(F.regexp_replace(double_text(x), r"\.0$", ""))
    else:
        out = double_text(x)
    return F.when(x.isNull(), "null").otherwise(out)


def whole(c: Column) -> Column:
    """A whole number or boolean, or null, as JSON."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def plain(c: Column) -> Column:
    """A number or boolean of any type, or null, as JSON; a double in its shortest spelling. whole and double make smaller plans where the type is known."""
    kind = F.typeof(c)
    return F.when(kind.isin("double", "float"), double(c.cast("double"))).otherwise(F.coalesce(c.cast("string"), F.lit("null")))


def _in_order(keys: Column, form: str) -> Column:
    if form != JCS:
        return F.array_sort(keys)
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct(F.hex(F.encode(k, "UTF-16BE")).alias("u"), k.alias("k")))), lambda s: s["k"])


def value(c: Column, kind: T.DataType, form: str = JCS) -> Column:
    """A column of any nested type as canonical JSON; kind is its type (df.schema[...].dataType). Null fields stay, as null."""
    if isinstance(kind, T.StructType):
        order = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be") if form == JCS else f.name)
        parts = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), value(c.getField(f.name), f.dataType, form)) for f in order]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = items(F.transform(c, lambda v: value(v, kind.elementType, form)))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys of canonical JSON are strings")
        pairs = F.transform(_in_order(F.map_keys(c), form), lambda k: F.concat(text(k), F.lit(":"), value(F.try_element_at(c, k), kind.valueType, form)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = text(c)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = double(c.cast("double"), form)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, T.NullType):
        out = F.lit("null")
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(out)


def _clean(s: str) -> str:
    """Halves of surrogate pairs, which escapes can make, as question marks."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def _members(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if not "".join(out).isascii():
        out = {_clean(k): v for k, v in pairs}
    if len(out) < len(pairs):
        raise ValueError("a key of JSON is repeated")
    return out


def _no_json(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _number(x: float, form: str) -> str:
    if form == PLAIN:
        return repr(x)
    if form == JCS:
        return "0" if x == 0 else repr(x).removesuffix(".0")
    if math.isinf(x):
        raise ValueError("no canonical number")
    return str(int(x)) if x.is_integer() else repr(round(x, PLACES))


def _writer(form: str, depth: int):
    """Canonical JSON from the text of a document."""
    # A whole number of more than 38 digits is a double.
    whole = lambda t: int(t) if len(t.lstrip("-")) <= 38 else float(t)
    read = json.JSONDecoder(object_pairs_hook=_members, parse_int=whole, parse_constant=_no_json).decode
    names = {None: "null", True: "true", False: "false"}
    scalars = {str: lambda v: quote(_clean(v)), float: lambda v: _number(v, form), int: str, bool: names.get, type(None): names.get}

    def in_order(keys: dict[str, object]) -> list[str]:
        return sorted(keys, key=None if form != JCS or "".join(keys).isascii() else lambda k: k.encode("utf-16-be"))

    def spelt(v: object, left: int) -> str:
        scalar = scalars.get(type(v))
        if scalar:
            return scalar(v)
        if not left:
            raise ValueError(f"JSON is nested deeper than {depth}")
        if type(v) is list:
            return f"[{','.join([spelt(x, left - 1) for x in v])}]"
        return "{" + ",".join([f"{quote(k)}:{spelt(v[k], left - 1)}" for k in in_order(v)]) + "}"

    return lambda text: "null" if text is None else spelt(read(text), depth)


def json_value(c: Column, form: str = JCS, depth: int = 6) -> Column:
    """The text of any JSON document as canonical JSON; lists and objects nested deeper than depth raise, and so does what is no JSON.

    Spark has no function for documents of unknown shape, so each text is read and written in Python, in one pass. A number with a
    point or an exponent is a double; repeated keys raise.
    """

    @F.arrow_udf(T.StringType())
    def written(texts: pa.Array) -> pa.Array:
        return pa.array(map(_writer(form, depth), texts.to_pylist()), pa.string())

    return written(c)


def record(fields: dict[str, Column]) -> Column:
    """An object of values that are JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def items(values: Column) -> Column:
    """A list of values that are JSON already."""
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def record_of(values: Column, keys: Column, raw: Column) -> Column:
    """An object of text and numbers rebuilt with its keys in order. values: its values as text by key; raw tells text from numbers by its quotes."""
    quoted = lambda k: F.contains(raw, F.concat(F.lit('"'), k, F.lit('":"')))
    one = lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.when(quoted(k), text(values[k])).otherwise(F.coalesce(values[k], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(keys), one), ","), F.lit("}"))
