"""Canonical JSON, rounding by binary value, folds over null keys, and similar precedents, against plain Python."""

import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import canonical as J
from tallyweave.operators import documents as D
from tallyweave.operators import ordered as O


def doubles():
    rng = random.Random(11)
    out = [0.0, -0.0, 1.0, -1.5, 0.0005, 1e-4, 1e-5, 12345678.0, 1e15, 1e16, 1.5e16, 1e22, 1e23, 2e23, 8.41e21, 2.0**-44, 5e-324, 4e-323, 6.979959093662484e17, 1.7976931348623157e308, 2.2250738585072014e-308, 1 / 3, 0.125, 2.5, 2.675, 2.0**53, 2.0**63, -(2.0**70), 1e-323]
    for _ in range(700):
        out += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0], rng.choice([1, -1]) * rng.random() * 10 ** rng.randint(-12, 18), rng.randint(0, 9999) / 8, round(rng.random() * 1000, rng.randint(0, 9))]
    return [x for x in out if math.isfinite(x)]


def jcs(x):
    return "0" if x == 0 else repr(x).removesuffix(".0")


def signed(x):
    return str(int(x)) if x == int(x) else json.dumps(round(x, 10))


def test_doubles_are_spelt_and_rounded_as_in_python(spark):
    xs = doubles()
    df = spark.createDataFrame(list(enumerate(xs)), "i long, x double").repartition(4)
    cols = {"r": J.double_text(F.col("x")), "j": J.double(F.col("x"), J.JCS), "s": J.double(F.col("x"), J.SIGNED)} | {f"r{n}": J.rounded(F.col("x"), n) for n in (0, 2, 10)}
    got = {r["i"]: r for r in df.select("i", *(c.alias(k) for k, c in cols.items())).collect()}
    for i, x in enumerate(xs):
        assert (got[i]["r"], got[i]["j"], got[i]["s"]) == (repr(x), jcs(x), signed(x))
        assert [repr(got[i][f"r{n}"]) for n in (0, 2, 10)] == [repr(round(x, n)) for n in (0, 2, 10)]
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert [r[0] for r in odd.select(J.double(F.col("x"))).collect()] == ["nan", "inf", "-inf", "null"]
    with pytest.raises(Exception, match="no canonical number"):
        odd.select(J.double(F.col("x"), J.SIGNED)).collect()


def test_all_digits_are_worked_out_only_where_they_decide(spark, monkeypatch):
    """Doubles of 17 digits that end in 5, and whole ones up to 2^122, in the same spelling; the digits are those of few."""
    rng = random.Random(5)
    xs = [x for x in (rng.uniform(1, 10) * 10.0 ** rng.randint(-300, 300) for _ in range(20000)) if len(r := repr(x).split("e")[0].replace(".", "")) == 17 and r[-1] == "5"]
    xs += [float(rng.getrandbits(64) << rng.randint(0, 58)) for _ in range(300)] + [2.0**63, 2.0**122 - 2.0**69, 2.0**122, 2.0**125]
    slow = J._exact
    monkeypatch.setattr(J, "_exact", lambda a: F.when(F.lit(True), F.raise_error(F.lit("all digits")).cast("string")))
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    got = df.where("x < 9e9").select(J.double_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [repr(x) for x in xs if x < 9e9]
    whole = [x for x in xs[-304:] if x < 2.0**122]
    got = spark.createDataFrame([(x,) for x in whole], "x double").select(J.integer_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [str(int(x)) for x in whole]
    monkeypatch.setattr(J, "_exact", slow)
    assert [tuple(r) for r in df.select(J.double_text(F.col("x")), J.double(F.col("x"), J.SIGNED)).collect()] == [(repr(x), signed(x)) for x in xs]


def plain(v, form):
    if isinstance(v, list):
        return f"[{','.join(plain(x, form) for x in v)}]"
    if isinstance(v, dict):
        order = sorted(v, key=(lambda k: k.encode("utf-16-be")) if form == J.JCS else None)
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain(v[k], form)}" for k in order) + "}"
    if isinstance(v, float):
        return {J.JCS: jcs, J.SIGNED: signed, J.PLAIN: repr}[form](v)
    return json.dumps(v, ensure_ascii=False)


@pytest.mark.parametrize("form", [J.JCS, J.SIGNED])
def test_any_json_text(spark, form):
    docs = [
        r'{"b":[1,2.50,{"z":null,"a":true}],"a":"x\u0001\u001f \u007f","😀":1e-7,"＀":1e30,"é":[]}', "[]", " {} ", "null", "3", "-0.0", r'"q\"\\\n"', "[[[[1.0,12345678.0]]]]", '{"k":{"k":{"k":[{"k":5e-324}]}}}', "1E5", "12345678901234567890", "0.1234567890123456789",
        '[false,"",[{}],-1]',
    ]
    got = spark.createDataFrame([(d,) for d in docs], "d string").select("d", J.json_value(F.col("d"), form, 5).alias("t")).collect()
    assert {r["d"]: r["t"] for r in got} == {d: plain(json.loads(d), form) for d in docs}


def test_json_nested_too_deep_raises(spark):
    with pytest.raises(Exception, match="nested deeper"):
        spark.createDataFrame([("[[[1]]]",)], "d string").select(J.json_value(F.col("d"), J.JCS, 2)).collect()


def test_json_text_is_read_once_whatever_its_depth(spark):
    """The plan had each level's work in it many times over; now it is small, and deep documents go through."""
    deep = '{"k":[' * 40 + "1.50" + "]}" * 40
    docs = [deep, '{"😀":9007199254740993.0,"":1.0,"a":"\\ud800"}', "1" * 39, None]
    df = spark.createDataFrame(list(enumerate(docs)), "i long, d string")
    for form in (J.JCS, J.SIGNED, J.PLAIN):
        out = df.select("i", J.json_value(F.col("d"), form).alias("t"))
        assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 2000
        got = dict(df.select("i", J.json_value(F.col("d"), form, 80).alias("t")).collect())
        fixed = {"": 1.0, "😀": float(2**53), "a": "?"}
        assert got == {0: plain(json.loads(deep), form), 1: plain(fixed, form), 2: plain(float(docs[2]), form), 3: "null"}
    for odd in ("1 2", "[1]]", "NaN", '{"a":1,"a":1}', ""):
        with pytest.raises(Exception, match="Error"):
            spark.createDataFrame([(odd,)], "d string").select(J.json_value(F.col("d"))).collect()


def test_typed_values_and_their_json_agree(spark):
    rows = [(1, [{"b": [1.0, None], "a": "x "}], {"\U0001f600": 1e-9, "": 2.5}), (2, None, {}), (None, [], None)]
    df = spark.createDataFrame(rows, "n long, l array<struct<b:array<double>,a:string>>, m map<string,double>").select(F.struct("n", "l", "m").alias("v"))
    want = [{"n": n, "l": l, "m": m} for n, l, m in rows]
    for form in (J.JCS, J.SIGNED, J.PLAIN):
        assert [r[0] for r in df.select(J.value(F.col("v"), df.schema["v"].dataType, form)).collect()] == [plain(w, form) for w in want]
    with pytest.raises(TypeError, match="no canonical JSON"):
        J.value(F.col("v"), spark.range(1).select(F.current_date().alias("d")).schema["d"].dataType)


def test_strings_with_controls(spark):
    texts = ["".join(map(chr, range(0x30))), "\x7f  ", "back\\u000Bslash", '"', "", "é\n", "日本 😀", None, "plain "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(J.text(F.col("t"))).collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]
    assert [r[0] for r in df.select(J.ascii_text(F.col("t"))).collect()] == [json.dumps(t) for t in texts]


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_null_is_a_key_of_its_own(spark, kind):
    """Whole-number keys with nulls in between: one chain and one digest for each, null among them."""
    big = 2**53
    keys = [big, big + 1, None] if kind == "long" else [1.0, math.nan, None] if kind == "double" else ["a", "", None]
    rows = spark.createDataFrame([(keys[i % 3], i, f"c{i}") for i in range(60)], f"k {kind}, pos long, c string").repartition(5)
    chains, texts = [O.GENESIS] * 3, [[] for _ in keys]
    for i in range(60):
        chains[i % 3] = hashlib.sha256(f"{chains[i % 3]}:c{i}".encode()).hexdigest()
        texts[i % 3].append(f"c{i}")
    got = O.hash_chain(rows, "k", ["pos"], "c").groupBy("k").agg(F.max_by("event_hash", "pos").alias("h")).collect()
    assert sorted(r["h"] for r in got) == sorted(chains) and len(got) == 3
    got = O.digests(rows, "k", ["pos"], "c").collect()
    assert sorted(r["digest"] for r in got) == sorted(hashlib.sha256("\n".join(t).encode()).hexdigest() for t in texts)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.95, 1.0])
def test_similar_precedents_by_both_ways(spark, least):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "q", "xy"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "!")], "key long, text string")
    precedents = spark.createDataFrame([(f"p{i}", i, t) for i, t in enumerate(texts[::3][::-1])] + [("dup", 500, texts[0])], "precedent string, ordinal long, content string")
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else {t} - {""}
    want = {}
    for i, t in enumerate(texts):
        scored = [(2 * len(grams(t) & grams(p)) / (len(grams(t)) + len(grams(p))), -o, n) for n, o, p in [tuple(r) for r in precedents.collect()] if grams(t) and grams(p)]
        if scored and max(scored)[0] >= least:
            want[i] = (max(scored)[2], pytest.approx(max(scored)[0]))
    for most in (D.MOST_GRAMS, 0):
        got = {r["key"]: (r["precedent"], r["similarity"]) for r in D.similar_precedents(docs, precedents, least, most).collect()}
        assert got == want
    assert D.similar_precedents(docs, precedents.limit(0), least).count() == 0


def test_normal_forms_in_tasks_are_those_of_columns(spark):
    texts = ["Ünïcode ñ ß 漢字 ½ ² x_y", "İstanbul ΣΑΣ ﬁ", "a\u0301b\u200dc\u2019d", "Ⅻ ⓐ 𝔘 😀!", "--", "", "  a  ", "١٢٣ ‿ x", "".join(map(chr, range(0x20, 0x530)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.normal_text(F.col("t")).alias("n"))
    for r in df.collect():
        grams = {r["n"][i : i + 2] for i in range(len(r["n"]) - 1)} if len(r["n"]) > 1 else {r["n"]} - {""}
        codes = {ord(g) if len(g) == 1 else ord(g[0]) << 21 | ord(g[1]) for g in grams}
        assert set(D._gram_codes(r["t"]).tolist()) == codes, r["t"][:40]
