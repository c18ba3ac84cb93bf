"""Names, personal data, similarity and canonical text on single values."""

import hashlib
import hmac
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import canonical as J
from tallyweave.functions import names as N
from tallyweave.functions import pii
from tallyweave.functions.similarity import jaro_winkler_of, metaphone_of
from tallyweave.operators import documents as D
from tallyweave.operators import evidence as E
from tallyweave.operators import ordered as O
from tallyweave.operators import persons as P
from tallyweave.operators import rollups as R


def of(spark, values, column, kind="string"):
    """The column over values of v, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}").select("i", column(F.col("v")).alias("x")).orderBy("i")
    return [r["x"] for r in rows.collect()]


def test_classification_cascade(spark):
    cases = {
        None: ("GARBAGE", 0.0), "": ("GARBAGE", 0.0), "x": ("GARBAGE", 0.1), "IMO 9074729": ("VESSEL", 0.95), "12-34": ("GARBAGE", 0.2), "order 1234567 of something": ("GARBAGE", 0.3), "N/A": ("GARBAGE", 0.0), "zz zz": ("GARBAGE", 0.1), "M/V Star": ("VESSEL", 0.9), "MV. Star": ("VESSEL", 0.9),
        "Acme Ltd.": ("ORGANIZATION", 0.95), "Ministry of Arts": ("ORGANIZATION", 0.95), "Star Shipping": ("ORGANIZATION", 0.85), "World Peace": ("ORGANIZATION", 0.85), "Dr. Ann Roe": ("PERSON", 0.95), "Ann Roe Jr.": ("PERSON", 0.9), "Ivan Petrovich": ("PERSON", 0.9), "Ann Roe": ("PERSON", 0.75),
        "Ann": ("ORGANIZATION", 0.4), "one two three four five": ("ORGANIZATION", 0.5), "### @@@ a": ("PERSON", 0.5),
    }
    got = of(spark, list(cases), N.classify_entity)
    assert [(g["entity_type"], g["confidence"]) for g in got] == list(cases.values())


def test_organizations(spark):
    got = of(spark, ["Beta  Insurance,, Ltd.", "Delta Sdn Bhd", "Support House", "Gamma Limited", None, "q"], N.sanitize_organization)
    assert [(g["org_name"], g["legal_suffix"], g["org_category"]) for g in got] == [("BETA INSURANCE,", "LTD", "INSURANCE"), ("DELTA SDN", "BHD", "COMPANY"), ("SUPPORT HOUSE", "", "LOGISTICS"), ("GAMMA", "LTD", "COMPANY"), ("", "", "OTHER"), ("q", "", "OTHER")]
    assert round(got[0]["confidence"], 3) == 1.0 and got[4]["decision_path"] == "GARBAGE"


def test_vessels(spark):
    got = of(spark, ["M/T Blue IMO:9074729", "m / v  Star", "F V Gull", "Star", "", "Tanker"], N.sanitize_vessel)
    assert [(g["sanitized_name"], g["imo_number"], g["decision_path"]) for g in got] == [("M/T BLUE", "9074729", "IMO_AND_PREFIX"), ("M/V STAR", "", "PREFIX_ONLY"), ("F/V GULL", "", "PREFIX_ONLY"), ("STAR", "", "NAME_ONLY"), ("", "", "GARBAGE"), ("TANKER TANKER", "", "PREFIX_ONLY")]


@pytest.mark.parametrize(
    ("raw", "out", "flags"),
    [
        ("Dr. Jane Roe", "ROE, JANE", ["TITLE_STRIPPED", "FORMAT_STANDARDIZED"]), ("John Q Public Jr.", "PUBLIC, JOHN Q", ["SUFFIX_STRIPPED", "FORMAT_STANDARDIZED"]), ("Sidorov Ivan Petrovich", "SIDOROV, IVAN PETROVICH", ["SLAVIC_FORMAT", "FORMAT_STANDARDIZED"]),
        ("Oleg Tsaryov Anatolevich", "TSARYOV, OLEG ANATOLEVICH", ["SLAVIC_FORMAT", "FORMAT_STANDARDIZED"]), ("Müller, Jörg", "MULLER, JORG", ["UNICODE_NORMALIZED"]), ("a.b.smith", "SMITH, A B", ["DOT_NORMALIZED", "FIRST_INITIAL_ONLY", "FORMAT_STANDARDIZED"]), ("Madonna", "MADONNA", ["LAST_NAME_ONLY", "FORMAT_STANDARDIZED"]),
        ("", "", ["BLANK"]), ("tbd", "tbd", ["GARBAGE"]), ("12 34 a", "12 34 a", ["NUMERIC"]), ("Mr.", "", ["TITLE_STRIPPED", "TOO_SHORT", "PARSE_FAILED"]),
    ],
)
def test_persons(spark, raw, out, flags):
    (got,) = of(spark, [raw], N.sanitize_person)
    assert (got["sanitized"], got["flags"]) == (out, flags)


def test_match_names(spark):
    assert of(spark, ["Dr. José O'Neil, Jr.", "Roe, Jane", None, "SMITH John", "Ann Ma"], N.match_name) == ["jose o'neil", "jane roe", "", "smith john", "ann"]
    assert of(spark, ["Roe, Jane-Ann", "Dr. X"], N.index_name) == ["jane ann roe", "dr x"]
    assert of(spark, ["Roe, Jane", "John SMITH jr", "John Smith", ""], N.last_name) == ["roe", "smith", "smith", ""]


def test_masking_and_back(spark):
    texts = ["call (555) 123-4567 or 555.123.4567", "ssn 123-45-6789, again 123-45-6789; mail a.b@c.org", "none", "", None, "card 4111 1111 1111 1111 on 01/02/1990 from 10.0.0.1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    out = pii.mask(rows).withColumn("back", pii.unmask(F.col("masked"), F.col("tokens"))).orderBy("i").collect()
    assert [r["back"] for r in out] == texts
    assert out[1]["masked"] == "ssn [SSN_1], again [SSN_1]; mail [EMAIL_1]"
    assert out[0]["masked"] == "call [PHONE_2] or [PHONE_1]"


@settings(max_examples=60, deadline=None)
@given(st.text("ab1 .-@\n", max_size=60))
def test_masks_come_off_again(text):
    masked, tokens = pii.mask_text(text)
    for token, value in tokens:
        masked = masked.replace(token, value)
    assert masked == text


def test_similar_strings():
    for a, b, want in (("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("dwayne", "duane", 0.84), ("", "", 0.0), ("a", "", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0)):
        assert jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-6)
    assert metaphone_of("Smith") == metaphone_of("Smyth") and metaphone_of("Knight") == "NT" and metaphone_of("Philip") == "FLP" and metaphone_of("") == ""


@settings(max_examples=50, deadline=None)
@given(st.text("abcde", max_size=12), st.text("abcde", max_size=12))
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    assert 0.0 <= jaro_winkler_of(a, b) <= 1.0 and jaro_winkler_of(a, b) == pytest.approx(jaro_winkler_of(b, a))


def test_bigrams_and_dice(spark):
    assert of(spark, ["", "a", "abab"], D.bigrams) == [[], ["a"], ["ab", "ba"]]
    assert of(spark, ["", "abab", "xy"], lambda v: D.dice(D.bigrams(v), D.bigrams(F.lit("abc")))) == [0.0, 0.5, 0.0]


def test_rule_trees(spark):
    tree = {"all_of": [{"any_of": [{"content_contains": "ALPHA"}, {"content_pattern": r"b\d+"}]}, {"document_type_equals": "t"}]}
    assert of(spark, ["Alpha", "x B12", "x", None], lambda v: D.condition(tree, v, F.lit("t"))) == [True, True, False, False]
    assert of(spark, ["Alpha"], lambda v: D.condition({"nonsense": 1}, v, F.lit("t"))) == [False]


def test_numbers_in_canonical_json(spark):
    values = [0.0, 1.0, 0.5, 0.123456789, 0.00001, 0.000012, 0.0001, -0.25, 100.0]
    assert of(spark, values, E.json_number, "double") == ["0", "1", "0.5", "0.123457", "1e-05", "1.2e-05", "0.0001", "-0.25", "100"]
    texts = ['a"b', "é\n", None]
    assert of(spark, texts, J.text) == [json.dumps(t, ensure_ascii=False) for t in texts]
    texts += ["plain", "日本 😀 \\ /", ""]
    assert of(spark, texts, J.ascii_text) == [json.dumps(t) for t in texts]


def test_hmac(spark):
    assert of(spark, ["x", ""], lambda v: E.hmac_sha256(b"key", v)) == [hmac.new(b"key", t.encode(), hashlib.sha256).hexdigest() for t in ("x", "")]


def slow_root(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256(b"\x01" + hashes[i] + hashes[i + 1]).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20])
def test_merkle(spark, n):
    leaves = [hashlib.sha256(b"\x00" + bytes([i])).digest() for i in range(n)]
    rows = spark.createDataFrame([(i, h.hex()) for i, h in enumerate(leaves)], "idx long, hash string")
    root = slow_root(leaves)
    assert E.merkle_root(rows, leaf_bits=2, rounds=3).collect()[0]["root"] == root
    proofs = E.inclusion_proofs(rows, leaf_bits=2, rounds=3).select(E.proven_root(F.col("hash"), F.col("proof")).alias("r")).collect()
    assert {p["r"] for p in proofs} == {root} and len(proofs) == n


def test_chains_do_not_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("id % 3 AS k", "id AS pos", "CAST(id AS string) AS c")
    want = {}
    for i in range(500):
        want[i % 3] = hashlib.sha256(f"{want.get(i % 3, O.GENESIS)}:{i}".encode()).hexdigest()
    for parts in (1, 7):
        out = O.hash_chain(rows.repartition(parts), "k", ["pos"], "c").groupBy("k").agg(F.max_by("event_hash", "pos").alias("h")).collect()
        assert {r["k"]: r["h"] for r in out} == want


def test_places_in_hot_and_small_keys(spark):
    rows = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 = 1 END AS k", "id % 7 AS a", "id AS b", "'x' AS __range_")
    out = O.placed(rows, "k", ["a", "b"], "pos").collect()
    for key in (None, True, False):
        own = sorted((r for r in out if r["k"] is key), key=lambda r: (r["a"], r["b"]))
        assert [r["pos"] for r in own] == list(range(1, len(own) + 1))


def test_times_of_other_zones_are_refused(spark):
    assert of(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.1234567+00:00"], E.rfc3339) == ["2024-01-02T03:04:05.000000Z", "2024-01-02T03:04:05.123456Z"]
    for bad in ("2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "soon"):
        with pytest.raises(Exception, match="not a UTC time"):
            of(spark, [bad], E.rfc3339)


def test_closed_chains_and_held_batches_are_left_alone(spark):
    from tallyweave.operators import control as C

    held = spark.createDataFrame([("a", 9999, True)], "t string, age int, held boolean")
    with pytest.raises(Exception, match="held batch"):
        C.purged(held, "age", "held", 2555).collect()
    with pytest.raises(Exception, match="needs a tenant"):
        of(spark, ["unknown"], lambda t: C.cache_key(t, F.lit("n"), F.lit("h")))


def test_limiters(spark):
    rows = spark.createDataFrame([("t", i, float(s)) for i, s in enumerate([0, 1, 2, 3, 11, 12, 13])], "k string, i long, s double")
    out = O.sliding_limiter(rows, "k", ["i"], "s", 2, 10.0).orderBy("i").collect()
    assert [r["allowed"] for r in out] == [True, True, False, False, True, True, False]
    out = O.token_bucket(rows, "k", ["i"], "s", 6.0, 2.0).orderBy("i").collect()
    assert [r["allowed"] for r in out] == [True, True, False, False, True, False, False]
    rows = rows.withColumn("bad", F.col("i") < 2)
    out = O.circuit_breaker(rows, "k", ["i"], "s", "bad", 2, 5.0, 1).orderBy("i").collect()
    assert [r["state"] for r in out] == ["closed", "closed", "open", "open", "half_open", "closed", "closed"]
    out = O.ledger(rows.withColumn("a", F.col("i") + 1), "k", ["i"], "a", 7).orderBy("i").collect()
    assert [(r["status"], r["remaining"]) for r in out] == [("applied", 6), ("applied", 4), ("applied", 1), ("rejected", 1), ("rejected", 1), ("rejected", 1), ("rejected", 1)]


def test_retention_at_its_bounds(spark):
    days = [0, 89, 90, 2190, 2555]
    rows = spark.createDataFrame([(d, False) for d in days] + [(3000, True)], "d int, held boolean").selectExpr("timestamp'2024-01-01' - make_interval(0, 0, 0, d) AS finished_at", "held", "d")
    out = R.retention(rows, F.lit("2024-01-01").cast("timestamp")).orderBy("held", "d").collect()
    assert [r["status"] for r in out] == ["HOT", "HOT", "COLD", "ARCHIVE", "PURGE_ELIGIBLE", "HELD"]
    assert [r["days_until_cold"] for r in out] == [None, 1, 0, 0, 0, None]


def test_unknown_energy_stays_unknown(spark):
    rows = spark.createDataFrame([(True, 1000.0), (True, None), (False, None)], "llm boolean, tokens double")
    wh, co2 = R.energy(F.col("llm"), F.col("tokens"), 0.5, 0.1, None)
    assert [tuple(r) for r in rows.select(wh, co2).collect()] == [(0.6, None), (None, None), (0.1, None)]


def test_similar_persons_are_those_of_the_whole_list(spark):
    """Last names that nobody has are held against everyone, whatever their sound: as by scoring every pair."""
    from tallyweave.plans import persons as plans

    names = ["cuis windqvist", "dmitri janokwski", "Luis Lindqvist", "LINDQVIST, Luiz", "Ingrid Jnakowski", "jorge", "Dr. Farid Derreira", "8", "Customer#000000007", "Jankowski", "", None, "cuis windqvist", "Xmara Bbernathy"]
    rows = P.keyed(spark.createDataFrame(list(enumerate(names)), "row_index long, original string"))
    people = plans.watchlist(spark).select("id", "ordinal", "canonical_name", N.match_name(F.col("canonical_name")).alias("p_norm"), N.last_name(F.col("canonical_name")).alias("p_last"))
    pairs = rows.crossJoin(people).withColumn("score", P.similarity(F.col("norm"), F.col("p_norm"), F.col("last"), F.col("p_last"), P.sounds(F.col("norm")), P.sounds(F.col("p_norm")))).collect()
    lasts = {r["p_last"] for r in pairs}
    want = []
    for i in range(len(names)):
        mine = [r for r in pairs if r["row_index"] == i and r["norm"] and (r["last"] not in lasts or r["last"] == r["p_last"]) and r["score"] >= 0.7]
        mine.sort(key=lambda r: (-r["score"], r["ordinal"]))
        want += [(i, k, r["id"], r["score"]) for k, r in enumerate(mine[:5], 1)]
    got = sorted(tuple(r) for r in P.fuzzy(rows, plans.watchlist(spark)).select("row_index", "k", "id", "score").collect())
    assert got == want and {i for i, *_ in got} >= {0, 1, 2, 3, 4, 6, 12, 13}


def test_names_of_one_kind_are_scored_once(spark, monkeypatch):
    """Names that differ only in what no listed name holds, as their numbers, are one kind with one score; a list with digits or the placeholder keeps them apart."""
    from tallyweave.plans import persons as plans

    inputs = [f"Customer#{i:09d}" for i in range(300)] + [str(10_000 + i) for i in range(300)] + ["luiz lindquist 1", "luiz lindquist 2", "Luiz \uffffindqvist"]
    rows = P.keyed(spark.createDataFrame(list(enumerate(inputs)), "row_index long, original string"))
    seen, true = [], P.candidates
    monkeypatch.setattr(P, "candidates", lambda names, *rest: seen.append(names.count()) or true(names, *rest))
    people = plans.watchlist(spark)
    more = spark.createDataFrame([(200, "D1", "Luis", "Lindqvist 2", "Luis Lindqvist 2", ["x"]), (201, "D2", "Luiz", "\uffffindqvist", "Luiz \uffffindqvist", ["x"])], people.schema)
    for watched in (people, people.unionByName(more)):
        p = P.listed(watched)
        pairs = rows.where("norm <> ''").withColumn("sounds", P.sounds(F.col("norm"))).crossJoin(p).withColumn("score", P.similarity(F.col("norm"), F.col("p_norm"), F.col("last"), F.col("p_last"), F.col("sounds"), F.col("p_sounds"))).where("score >= 0.7").collect()
        lasts = {r["p_last"] for r in p.collect()}
        want = sorted((r["row_index"], r["id"], round(r["score"], 9)) for r in pairs if r["last"] not in lasts or r["last"] == r["p_last"])
        got = sorted((r["row_index"], r["id"], round(r["score"], 9)) for r in P.fuzzy(rows, watched, 1000).collect())
        assert got == want and got
    assert seen[0] <= 6


def test_waterfall_is_one_pass(spark, monkeypatch):
    """Each row gets the first layer that knows it, as by the layers one after the other; names are normalized once, and the result's plan does not go back to the inputs."""
    from tallyweave.plans import persons as plans

    names = [None, "", "8", "12.3-4", "Luis Lindqvist", "LINDQVIST, Luis", "Lu The lindqvist", "Lui Lindqvist", "Luiz Lindqwist", "Customer#000000007", "Boris", "Mr."]
    seen, true = [], P.keyed
    monkeypatch.setattr(P, "keyed", lambda df: seen.append(df) or true(df))
    got = P.resolve(spark.createDataFrame(list(enumerate(names)), "row_index long, original string"), plans.watchlist(spark))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 0 and len(seen) == 1
    rows = {r["row_index"]: (r["match_id"], r["match_type"], r["layer"], r["confidence"]) for r in got.collect()}
    garbage, left = (None, "NO_MATCH", "L0_GARBAGE", 0.0), (None, "NO_MATCH", "L4_HUMAN", 0.0)
    assert len(rows) == len(names) and all(rows[i] == garbage for i in range(4)) and rows[9] == left and rows[11] == left
    assert [rows[i] for i in (4, 5)] == [("P143", "EXACT_MATCH", "L1_PERSON_EXACT", 1.0)] * 2
    assert rows[6] == ("P143", "EXACT_MATCH", "L1_PERSON_ALIAS", 1.0) and rows[7] == ("P143", "EXACT_MATCH", "L1_PERSON_INITIAL", 0.95)
    assert rows[8][0] == "P143" and rows[8][2] == "L2_PERSON_FUZZY"


def test_closest_names_in_blocks(spark):
    """Against all pairs: repeated and missing names, blocks smaller than a group, names too long for bits, a group without others."""
    import random

    from tallyweave.functions.similarity import encoded, jaro_winkler_of, jaro_winkler_to_all

    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcd\U0001f600 1") for _ in range(rng.choice([0, 1, 4, 9, 33, 64, 70])))
    pool = [name() for _ in range(60)]
    for a in pool:
        assert jaro_winkler_to_all(a, pool, encoded(pool)).tolist() == pytest.approx([jaro_winkler_of(a, b) for b in pool], abs=1e-12)
    names = [(i % 4, i // 2, rng.choice([*pool, None])) for i in range(80)]
    others = [(i % 3, rng.choice([*pool, None])) for i in range(150)]
    want = {}
    for g, k, a in names:
        likes = [jaro_winkler_of(a, b) if a is not None and b is not None else None for h, b in others if h == g]
        if likes:
            best, close = want.get(k, (None, 0))
            likes = [x for x in likes if x is not None]
            want[k] = (max([*([best] if best is not None else []), *likes], default=None), close + sum(round(x, 6) >= 0.6 for x in likes))
    got = P.closest(spark.createDataFrame(names, "group long, key long, name string"), spark.createDataFrame(others, "group long, name string"), 0.6, 7, 11).collect()
    assert {r["key"]: (r["best"] and round(r["best"], 9), r["close"]) for r in got} == {k: (b and round(b, 9), c) for k, (b, c) in want.items()}


def test_chain_roots_move_rows_once(spark):
    """The same roots as the whole chains', a null key among them, from a plan with a single exchange."""
    df = spark.createDataFrame([(None if i % 3 == 0 else f"b{i % 3}", 50 - i, f"t{i}") for i in range(50)], "k string, i long, t string").repartition(5)
    got = O.chain_roots(df, "k", ["i"], "t")
    want = {r["k"]: (r["root"], r["n"]) for r in O.hash_chain(df, "k", ["i"], "t").groupBy("k").agg(F.max_by("event_hash", "i").alias("root"), F.count(F.lit(1)).alias("n")).collect()}
    assert {r["k"]: (r["root"], r["n"]) for r in got.collect()} == want and len(want) == 3
    rows = spark.range(10).selectExpr("id % 2 AS k", "id AS i", "'x' AS t")
    assert O.chain_roots(rows, "k", ["i"], "t")._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + O.chain_roots(rows, "k", ["i"], "t")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_places_come_from_ranges_that_are_moved_once(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 10 = 0 THEN id % 7 END AS k", "(id * 7919) % 3000 AS i")
    out = O.placed(df, "k", ["i"], "pos")
    assert "Window [row_number" not in out._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in out.collect():
        by.setdefault(r["k"], []).append((r["i"], r["pos"]))
    assert len(by) == 8 and all([p for _, p in sorted(v)] == [*range(1, len(v) + 1)] for v in by.values())


def test_equal_company_names_are_compared_once(spark):
    from tallyweave.operators import companies as C

    names = spark.createDataFrame([("t", i, ["Alpine Freight Inc.", "ALPINE FREIGHT", "alpin freight", None][i % 4]) for i in range(400)], "tenant string, key long, name string")
    listed = spark.createDataFrame([("t", 1, "Alpine Freight"), ("t", 2, "Granite Foods")], "tenant string, listed_id long, listed_name string")
    got = C.nearest(names, listed, 0.3, 5)
    assert {(r["key"], r["listed_id"], r["rank"]) for r in got.collect()} == {(i, 1, 1) for i in range(400) if i % 4 < 3}
    assert "RepartitionByExpression" not in got._jdf.queryExecution().toString() and got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_manifests_of_one_file_are_dealt_over_all_cores(spark, sf):
    from tallyweave.plans import manifests

    assert manifests.checked(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
