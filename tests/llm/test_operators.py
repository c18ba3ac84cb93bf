"""Each operator on small tables: defined cases, and against a plain version of the same rule."""

import hashlib
import math
import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import chat, decontam, html, langid, linedup, media, mixing, simhash, tokens, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang"), more.get("source", f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   ", "a", "a", "one two", "x" * 3000, "many " * 400, "Ünïcode ñ ß 漢字", "line\nline\nline"]


# Token ids


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32 - 1])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    if n > 3:
        ids[3] = 2**32 - 1
    image = tokens.write_segment([1, None], [ids[: n // 2].tobytes(), ids[n // 2 :].tobytes()])
    assert (tokens.read_ids(image) == ids).all()
    for a, b in combinations(sorted({0, n // 3, n // 2, n}), 2):
        assert (tokens.read_ids(image, a, b) == ids[a:b]).all()


def test_tokens_are_the_librarys(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [*ODD, "it's Don't I'LL", "a\x7fb c", "x\x1cy z", " ́abc", "<|endoftext|> a<|endoftext|>b", "İstanbul ΣΑΣ ﬁ"]
    got = tokens.read_tokens(spark, tokens.write_tokens(docs(spark, texts), path, segment_ids=50)).toPandas().sort_values("doc_id")
    start = 0
    for text, row in zip(texts, got.itertuples(), strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_tokens_of_no_repeated_and_null_rows(spark):
    assert tokens.token_table(docs(spark, ["a"]).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "b", 0), (1, "a", 0), (None, "c", 0)], "doc_id long, text string, start long")
    got = tokens.token_table(twice).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(None, 0), (1, 2), (1, 4)]


# Decontamination


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def brute_matches(texts, items):
    out = set()
    for i, item in items:
        a = decontam.words(item)
        limit = decontam.Items.limit(len(a))
        for d, text in enumerate(texts):
            w = decontam.words(text)
            for s in range(len(w)):
                b = (w[s : s + len(a)] + [None] * len(a))[: len(a)]
                row = list(range(len(b) + 1))
                for x, ca in enumerate(a, 1):
                    prev, row = row, [x]
                    for y, cb in enumerate(b, 1):
                        row.append(min(prev[y] + 1, row[y - 1] + 1, prev[y - 1] + (ca != cb)))
                if a and row[-1] <= limit:
                    out.add((d, i))
    return out


def test_matches_are_those_of_brute_force(spark):
    w = ITEM.split()
    edited = [*w[:5], "other", *w[6:12], "more", *w[12:]]
    far = [x if i % 3 else "zzz" for i, x in enumerate(w)]
    texts = [None, "", ITEM, f"before {ITEM.upper()}! after", " ".join(edited), " ".join(far), " ".join(w[:-2]), "alpha beta gamma", ITEM, "short item here now", "unrelated words only"]
    items = [(0, ITEM), (1, "short item here"), (2, None), (3, "..."), (4, "word " * 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs(spark, texts), bench).collect()}
    assert got == brute_matches(texts, [(i, t) for i, t in items if t])
    clean = decontam.clean(docs(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert clean.columns == docs(spark, [""]).columns


def test_recall_of_noisy_items():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(15, 50)))) for i in range(60)]
    block = decontam.Items(items)
    texts = []
    for _, t in items:
        w = t.split()
        for p in rng.choice(len(w), int(0.2 * len(w)), replace=False):
            w[p] = "zzz"
        texts.append(" ".join([*rng.choice(vocab, 50), *w, *rng.choice(vocab, 50)]))
    found = {(r, block.ids[k]) for r, k, *_ in block.find(texts)}
    assert sum((i, i) in found for i in range(60)) >= 59


def test_matches_of_repeats_long_texts_and_other_columns(spark):
    filler = "unrelated word " * 300_000
    rows = [(1, ITEM, 5, "a"), (1, ITEM, 5, "a"), (None, f"{filler} {ITEM} {filler}", 6, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id long, distance string")
    bench = spark.createDataFrame([(0, ITEM, "x"), (0, ITEM, "x"), (None, ITEM, "y")], "item_id long, text string, position string")
    got = sorted((r["doc_id"] or -1, -1 if r["item_id"] is None else r["item_id"], r["position"], r["distance"]) for r in decontam.matches(d, bench).collect())
    assert got == [(-1, -1, 600_000, 0), (-1, 0, 600_000, 0), (1, -1, 0, 0), (1, -1, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0)]
    assert decontam.clean(d, bench).count() == 0


def test_recall_holds_for_every_length():
    rng = np.random.default_rng(7)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, n))) for i, n in enumerate([10, 20, 40, 80, 160, 320, 640] * 3)]
    block = decontam.Items(items)
    assert all(block.repeats[len(a)] >= 1 for a in block.items)
    edits = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" if x else "zzz" for x in block._edited(a, edits)) for a in block.items]
    names = {v: k for k, v in block.vocab.items()}
    texts = [" ".join(names.get(int(x), "zzz") for x in block._edited(a, edits)) for a in block.items]
    found = {(r, block.ids[k]) for r, k, *_ in block.find(texts)}
    assert sum((i, i) in found for i in range(len(items))) >= len(items) - 1


def test_bands_beyond_the_recall_are_compared_exactly(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_REPEATS", 1)
    w = ITEM.split()
    block = decontam.Items([(0, ITEM)])
    assert block.repeats == {20: 0}
    assert [k for _, k, *_ in block.find([" ".join([*w[:3], "x", *w[4:9], "y", *w[10:]])])] == [0]


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(docs(spark, ODD), none).count() == 0
    assert decontam.clean(docs(spark, ODD), none).count() == len(ODD)
    assert decontam.matches(docs(spark, ["a"]).limit(0), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0


# HTML


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>First   long paragraph\nwith <b>bold</b> text.<p>Second paragraph, longer than the menu."
    "<script>var x='<p>no</p>'</script><form><input> Sign up</form><div id=comments><p>Nice one</p></div></article><aside>Related</aside><footer>&copy; 2024</footer></body></html>"
)


def test_main_text_is_the_article():
    assert html.main_text(PAGE) == "Title & more First long paragraph with bold text. Second paragraph, longer than the menu."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("<body><p>cut off <b>here", "cut off here"), ("<div><p>x</p></div><", "x <")])
def test_odd_pages(page, text):
    assert html.main_text(page) == text


NAMED = [
    ("<article><div class='share-price'><p>Price today</p></div><figure><figcaption>A caption</figcaption></figure><p>foo<img>bar <math><mi>x</mi></math></p></article>", "Price today A caption foobar x"),
    ("<div class='layout sidebar-right'><div class='ad-box'>Buy</div><article><p>Words of the article.</p></article><div class=sidebar-right>side</div></div>", "Words of the article."),
    ("<body class=has-sidebar><div class=has-sidebar><p>Words of the text.</p></div></body>", "Words of the text."),
    ("<article><p>Words of the article, many of them.</p></article><section class=comments><article class=comment><p>nice</p></article></section>", "Words of the article, many of them."),
    ("<div class=ad><p>An advert that is longer than all of the article.</p></div><article><p>Short.</p></article>", "Short."),
]


@pytest.mark.parametrize(("page", "text"), NAMED)
def test_names_take_out_parts_only(page, text):
    assert html.main_text(page) == text


def slow_density(page):
    """Each node's density by the formula, from sums over all of its descendants."""
    p = html.Page(page)
    kept, n = p._kept(), len(p.tags)
    below = lambda k, top: k == top or k > 0 and below(p.parents[k], top)
    linked = lambda k: k > 0 and (p.tags[k] == "a" or linked(p.parents[k]))
    size = [0] * n
    for k, t in p.texts:
        if k >= 0 and kept[k]:
            size[k] += len("".join(t.split()))

    def figures(top):
        nodes = [k for k in range(n) if kept[k] and below(k, top)]
        inner = [k for k in nodes if k != top]
        return sum(size[k] for k in nodes), sum(size[k] for k in nodes if linked(k)), len(inner), sum(p.tags[k] == "a" for k in inner)

    cb, lcb, *_ = figures(p.body)
    out = []
    for k in range(n):
        c, lc, t, lt = figures(k)
        t, lt = t or 1, lt or 1
        out.append(c / t * math.log(c / (lc or 1) * t / lt) / math.log(math.log(c / ((c - lc) or 1) * lc + lcb / (cb or 1) * c + math.e)) if kept[k] and c and math.log(c / ((c - lc) or 1) * lc + lcb / (cb or 1) * c + math.e) > 1.000000001 else None)
    return p, kept, out


def test_densest_subtree_is_that_of_the_formula():
    page = "<body><div><p>" + "long prose without links " * 9 + "</p><p>" + "more of that prose " * 8 + "</p></div><div>" + "<a href=x>link</a> word " * 6 + "</div></body>"
    p, kept, dense = slow_density(page)
    sums = {}
    for k in range(1, len(p.tags)):
        if kept[k] and p.tags[k] not in html.INLINE:
            sums[p.parents[k]] = sums.get(p.parents[k], 0) + (dense[k] or 0)
    best = max((k for k in sums if p.tags[k] in ("body", "div")), key=lambda k: (sums[k], -k))
    text = html.main_text(page)
    assert p.tags[best] in ("body", "div") and text.startswith("long prose") and "more of that prose" in text
    assert ("link" in text.split("more")[1]) == (p.tags[best] == "body" and (dense[len(p.tags) - 1] or 0) > 1e9)


def test_pages_as_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 6)], "page_id long, url string, html string, text long")
    got = html.extract(pages).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(pages.limit(0)).count() == 0


def test_deep_and_long_pages():
    for page in ("<div>" * 50_000 + "text", "<span><p>" * 50_000 + "text", "<span>" * 50_000 + "</b>" * 50_000 + "text"):
        assert html.main_text(page) == "text"
    assert len(html.main_text("<p>" + "word " * 100_000)) == 499_999


# Language ID


def test_languages_are_told_apart(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = d.join(langid.op4_language_id(spark, sf), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95
    assert out.score.between(0, 1).all() and out.rejected.mean() < 0.02


def test_language_cases(spark):
    d = spark.createDataFrame([(i, "the cat sat on the mat " * 5 if i % 2 else "el gato come pescado ahora " * 5, "en" if i % 2 else "es", "s", 1.5) for i in range(200)], "doc_id long, text string, lang string, source string, score double")
    model = langid.fit(d)
    assert model.predict(None) == ("und", 0.0, True) and model.predict("123 !?") == ("und", 0.0, True)
    assert model.predict("the mat")[0] == "en"
    kept = langid.identified(d)
    assert kept.columns == d.columns and kept.count() == 200
    none = d.withColumn("lang", d["lang"].substr(100, 1)).limit(0)
    assert langid.fit(none).predict("the mat") == ("und", 0.0, True) and langid.identified(none).count() == 0


# Line dedup


def brute_runs(texts):
    """Every run of 50 words, compared as text: its words go from all documents but the first that has it."""
    split = [re.findall(r"[^ \t-\r]+(?:[ \t-\r]+)?", t or "") for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, pieces in enumerate(split):
        words = [p.strip(" \t\n\v\f\r") for p in pieces]
        for i in range(len(words) - 49):
            if first.setdefault(tuple(words[i : i + 50]), d) != d:
                gone[d].update(range(i, i + 50))
    return [None if t is None else re.match(r"[ \t-\r]*", t)[0] + "".join(p for i, p in enumerate(s) if i not in g) for t, s, g in zip(texts, split, gone, strict=True)]


def some_words(rng, n):
    return " ".join(f"w{rng.integers(0, 9999)}" + "," * int(rng.integers(0, 2)) + "\n" * int(rng.integers(0, 12) == 0) for _ in range(n))


def test_repeated_runs_go_but_for_the_first(spark):
    rng = np.random.default_rng(3)
    w = lambda n: some_words(rng, n)
    passage, short, long, line = w(54), w(49), w(400), "line of a text "
    texts = [
        f"{w(30)} {passage} {w(20)}", f"{w(7)} mid{passage} tail{w(9)}", f"{w(90)} {passage} {w(3)}", passage, None, "", f"  {passage}", f"{w(20)} {short} {w(20)}", f"{w(25)} {short} {w(25)}", long, f"{w(5)} {long} {w(5)}", f"{' '.join(long.split()[:60])} {w(60)} {' '.join(long.split()[200:260])}",
        f"{line * 40}", f"{w(3)} {line * 40}", f"{passage} {passage}", f"{w(40)} {' '.join(passage.split()[:50])} {w(40)}", f"{w(40)} {' '.join(passage.split()[1:50])} {w(40)}",
    ]
    got = linedup.without_repeats(docs(spark, texts)).orderBy("doc_id").collect()
    want = brute_runs(texts)
    periodic = (12, 13)
    assert [r["text"] for i, r in enumerate(got) if i not in periodic] == [t for i, t in enumerate(want) if i not in periodic]
    assert got[12]["n_deleted"] == 0 and got[13]["n_deleted"] >= 120
    count = lambda t: len((t or "").split())
    assert all((r["n_words"], r["n_deleted"]) == (count(t), count(t) - count(r["text"])) for r, t in zip(got, texts, strict=True))


def test_pasted_passages_are_always_found(spark):
    """Each passage of 51 words or more is gone from all but the first document, wherever it is pasted."""
    rng = np.random.default_rng(8)
    passages = [some_words(rng, int(n)) for n in rng.integers(51, 90, 40)]
    texts = [f"{some_words(rng, int(rng.integers(0, 80)))} {p} {some_words(rng, int(rng.integers(0, 80)))}" for _ in range(3) for p in passages]
    got = linedup.without_repeats(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == brute_runs(texts)


def test_fingerprints_are_those_of_every_window(spark):
    rng = np.random.default_rng(5)
    for text in (some_words(rng, 300), "a " * 200, some_words(rng, 50), some_words(rng, 49), "", " \n "):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends = linedup._words(data)
        assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split()
        mark, at = linedup.least_lines(data, starts, ends, np.zeros(len(starts), int), 20, 31)
        lines, n = {}, len(starts)
        for i in range(n - 19):
            one = text[starts[i] : ends[i + 19]]
            part = np.frombuffer(one.encode(), np.uint8)
            s, e = linedup._words(part)
            lines[i] = linedup.least_lines(part, s, e, np.zeros(20, int), 20, 1)[0][0]
        for i in range(n - 49):
            assert min(lines[k] for k in range(i, i + 31)) in set(mark)
        assert all(lines[k] == m for k, m in zip(at, mark, strict=True))


def test_line_dedup_is_native_and_finds_runs_whose_lines_have_other_first_places(spark):
    """No Python in the plan. Earlier documents hold pieces of a passage, too short to count, that take the first places of its lines; the passage goes as a whole."""
    rng = np.random.default_rng(11)
    found = linedup.fingerprints(linedup.keyed(docs(spark, ["a"])))
    assert not re.search("InArrow|Python|Pandas", found._jdf.queryExecution().executedPlan().toString())
    w = lambda n: some_words(rng, n)
    passage, exact = w(240).split(), w(50)
    pieces = [f"{w(40)} {' '.join(passage[a : a + 45])} {w(40)}" for a in range(0, 200, 30)]
    texts = [*pieces, f"{w(9)} {' '.join(passage)} {w(60)}", f"{w(70)} {' '.join(passage)} {w(5)}", f"{w(33)} {exact} {w(20)}", f" {w(5)} {exact}", exact, exact, w(49), "a " * 200, f"b {'a ' * 90}", "one\ttwo\x0bthree\x0c" * 90, "one\rtwo  three " * 60]
    got = linedup.without_repeats(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == brute_runs(texts)
    assert [r["n_deleted"] for r in got][7:13] == [0, 240, 0, 50, 50, 50]


def test_line_fingerprints_are_few_and_stand_for_every_window(spark):
    rng = np.random.default_rng(12)
    passage = some_words(rng, 400)
    texts = [f"{some_words(rng, 1300)} {passage} {some_words(rng, 1300)}" for _ in range(2)]
    found = linedup.fingerprints(linedup.keyed(docs(spark, texts))).orderBy("id", "lo").collect()
    own = [[r for r in found if r["id"] == i] for i in range(2)]
    for rows in own:
        assert rows[0]["lo"] == 0 and rows[-1]["hi"] == 3000 and len(rows) < 3000 / 13
        assert all(r["lo"] <= r["at"] <= r["lo"] + 30 and r["hi"] <= r["at"] + 50 for r in rows)
        assert all(b["lo"] == a["hi"] - 49 for a, b in zip(rows, rows[1:], strict=False))
    inside = [[(r["lo"], r["at"], r["mark"]) for r in rows if 1300 < r["lo"] <= 1650] for rows in own]
    assert inside[0] == inside[1] and len(inside[0]) > 10


def test_equal_hashes_alone_delete_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [some_words(rng, 120), some_words(rng, 120)]
    true = linedup.repeated_runs

    def false_runs(rows, *args):
        key = {r["id"]: r["of"] for r in rows.select("id", "of").collect()}
        return rows.sparkSession.createDataFrame([(True, 1, key[1], 10, 90, True, 0, key[0], 10)], true(rows, *args).schema)

    monkeypatch.setattr(linedup, "repeated_runs", false_runs)
    assert [r["n_deleted"] for r in linedup.without_repeats(docs(spark, texts)).collect()] == [0, 0]


def test_line_dedup_of_nothing_of_equal_rows_and_of_long_texts(spark):
    assert linedup.without_repeats(docs(spark, ["a"]).limit(0)).count() == 0
    rng = np.random.default_rng(9)
    text = some_words(rng, 100)
    same = spark.createDataFrame([(1, text, "x", 1, 2)] * 2 + [(None, text, "x", 1, 2)], "doc_id long, text string, runs string, known long, mark long")
    assert sorted((r["doc_id"] or 0, r["n_deleted"]) for r in linedup.without_repeats(same).collect()) == [(0, 0), (1, 100), (1, 100)]
    long = some_words(rng, 300_000)
    got = linedup.without_repeats(docs(spark, [text, f"{long} {text} {long}"[: len(long) + len(text) + 2000]])).orderBy("doc_id").collect()
    assert 100 <= got[1]["n_deleted"] <= 100 and got[1]["n_words"] > 300_000


# Mixing


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", *(" ".join(["w"] * int(n)) for n in rng.integers(1, 300, 200))]
    d = docs(spark, texts).unionByName(docs(spark, ["null source"] * 3).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "CAST(NULL AS string) AS source", "n_chars"))
    m = mixing.mix(d, block=64, shard_slots=16)
    t = mixing.taken(m).toPandas()
    assert len(t) == len(texts) + 3 and (t.taken <= 2 * t["size"]).all()
    per = t.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(per.taken - per.target) <= 1).all()
    assert abs(per.target.sum() - 1.5 * per.source_size.sum()) < 1e-6
    slots = m.slots.toPandas()
    assert slots.slot.is_unique and not slots.duplicated(["sid", "turn", "index"]).any()
    again = mixing.taken(mixing.mix(d, block=64, shard_slots=16)).toPandas()
    order = list(t.columns)
    assert t.sort_values(order, ignore_index=True).equals(again.sort_values(order, ignore_index=True))


def test_targets_are_filled_up_like_water(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 3, "e": 700}
    d = spark.createDataFrame([(i, s, n, 0) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long, text_hash long")
    got = {r["source"]: r["target"] for r in mixing.targets(d).collect()}
    want, weights, left = {}, dict(zip(sizes, (5, 2, 1, 5, 2), strict=True)), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in want]
        scale = (left - sum(want.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * scale > 2 * sizes[s]]
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
    want |= {s: weights[s] * scale for s in free}
    assert got == pytest.approx(want)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        r = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(1)).alias("p"))
        r = r.withColumn("back", mixing.permuted(F.col("p"), F.lit(n), F.lit(3), F.lit(1), inverse=True)).toPandas()
        assert sorted(r.p) == list(range(n)) and (r.back == r.id).all()


def test_mixed_documents_hold_the_words_taken(spark):
    d = docs(spark, ["a b  c\nd " * 40, "x " * 2000, "", None, *(["same text"] * 2)]).withColumnRenamed("lang", "parts")
    out = mixing.mixed(d)
    assert out.columns == d.columns
    words = out.toPandas().assign(w=lambda x: x.text.map(lambda t: len(t.split()))).groupby("doc_id").w.sum()
    want = mixing.taken(mixing.mix(d)).toPandas().groupby("doc_id").taken.sum()
    assert (words.reindex(want.index).fillna(0) == want).all()
    assert mixing.mixed(d.limit(0)).count() == 0 and mixing.taken(mixing.mix(d.limit(0))).count() == 0


def test_mix_of_hot_ids_ties_and_other_columns(spark):
    """Null, repeated and sparse ids; equal rows; no n_chars; columns with the operator's own names."""
    rows = [(None, f"t{k} " * (k % 50 + 1), "a", 1, 2) for k in range(300)] + [(5, "same words here", "a", 1, 2)] * 40 + [(2**62 - k * 10**12, "x y " * 30, "b", 1, 2) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, __id long, mix_id long")
    t = mixing.taken(mixing.mix(d, block=16)).toPandas()
    assert len(t) == len(rows) and (t.taken <= 2 * t["size"]).all()
    per = t.groupby(["source_size", "target"]).taken.sum().reset_index()
    assert (abs(per.taken - per.target) <= 1).all()
    out = mixing.mixed(d)
    assert out.columns == d.columns
    assert out.toPandas().text.str.split().str.len().sum() == mixing.taken(mixing.mix(d)).toPandas().taken.sum()


# URL filters


def test_list_entries_hold_from_their_day(spark):
    day = lambda x: pd.Timestamp(f"2024-{x}").to_pydatetime()
    entries = [("bad.com", "block", day("01-10")), ("bad.com", "allow", day("03-01")), ("ok.bad.com", "allow", day("01-01")), ("tie.org", "allow", day("02-02")), ("tie.org", "block", day("02-02")), (None, "block", day("01-01")), ("bad.com", "block", day("01-10"))]
    captures = [
        (1, "http://bad.com/x", day("01-09")), (2, "http://bad.com/x", day("01-10")), (3, "https://u:p@www.BAD.com:80/", day("02-29")), (4, "http://bad.com", day("03-01")), (5, "http://ok.bad.com", day("02-01")), (6, "http://notbad.com", day("02-01")), (7, "http://tie.org", day("02-02")),
        (8, None, day("02-02")), (9, "not a url", day("02-02")), (10, "http://bad.com", None), (2, "http://bad.com/x", day("01-10")),
    ]
    got = urlfilter.judge(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp"), spark.createDataFrame(entries, "pattern string, action string, since timestamp")).collect()
    assert sorted(r["page_id"] for r in got if r["blocked"]) == [2, 2, 3, 7] and len(got) == len(captures)
    none = spark.createDataFrame([], "pattern string, action string, since timestamp")
    assert urlfilter.judge(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp"), none).where("blocked").count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, fetched timestamp"), none).count() == 0


def test_hosts_with_fewer_labels_and_long_lists(spark):
    stamp = lambda y, m: pd.Timestamp(f"{y}-{m:02d}-01").to_pydatetime()
    entries = [("a.b.com", "block" if k % 2 else "allow", stamp(2000 + k // 12, k % 12 + 1), "x") for k in range(120)]
    captures = [(k, f"http://{'a.b.com' if k % 2 else 'b.com'}/{'p' * (200_000 if k == 7 else 1)}", stamp(2000 + k // 12, k % 12 + 1), 1) for k in range(120)]
    got = urlfilter.judge(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp, pattern long"), spark.createDataFrame(entries, "pattern string, action string, since timestamp, year string")).collect()
    assert sorted(r["page_id"] for r in got if r["blocked"]) == [k for k in range(120) if k % 2]


# Media


def test_media_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "a")], "doc_id long, text string")
    media.write_media(d, path)
    got = media.features(media.read_media(spark, path)).toPandas()
    assert len(got) == len(ODD) + 1
    for r in got.itertuples():
        data = ("a" if pd.isna(r.doc_id) else ODD[int(r.doc_id)] or "").encode()
        assert (r.n_bytes, r.payload_bytes) == (len(data), max(64, -(-len(data) // 64) * 64))
        assert r.tail_crc32 == zlib.crc32(media.padded(data)[-64:])
        assert r.payload_sha256 == hashlib.sha256(media.padded(data)).hexdigest()
        image = media.encode_png(media.padded(data))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(image), hashlib.sha256(image).hexdigest(), media.feature(media.padded(data)))
    alike = got.groupby("payload_sha256")[["media_sha256", "feature", "media_bytes"]].nunique()
    assert (alike == 1).all(axis=None)
    assert media.read_media(spark, str(tmp_path / "none")).count() == 0


def test_media_of_long_texts_repeats_and_other_columns(spark, tmp_path):
    long = "ünï " * 500_000
    rows = [(1, "same", b"m", 3), (1, "same", b"m", 3), (2, long, b"m", 3)]
    media.write_media(spark.createDataFrame(rows, "doc_id long, text string, media binary, n_bytes long"), str(tmp_path / "m"))
    got = sorted((r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in media.features(media.read_media(spark, str(tmp_path / "m"))).collect())
    sha = lambda t: hashlib.sha256(media.padded(t.encode())).hexdigest()
    assert got == [(1, 4, sha("same"))] * 2 + [(2, len(long.encode()), sha(long))]


def test_ranges_are_planned_whole_and_bounded(tmp_path):
    archives = [(f"a{k}", (k + 1) * media.SPLIT_BYTES, [i * media.SPLIT_BYTES for i in range(k + 1)]) for k in range(9)]
    for most in (1, 4, 10_000):
        parts = media.planned(archives, most)
        assert len(parts) <= max(most, 1) + 1 if most < 45 else len(parts) == 45
        covered = sorted(x for p in parts for x in p.stretches)
        for name, size, _ in archives:
            own = [x for x in covered if x[0] == name]
            assert own[0][1] == 0 and own[-1][2] == size and all(a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
    (tmp_path / "media-x.zip").write_bytes(b"PK")
    with pytest.raises(FileNotFoundError):
        media.ArchiveReader(str(tmp_path)).partitions()


def test_members_are_read_again_by_offset(tmp_path):
    from pyarrow import fs

    local, path = fs.LocalFileSystem(), str(tmp_path / "a.zip")
    archive = media.Archive(local.open_output_stream(path))
    for i in range(5):
        archive.add(media.member_name(i, 3), media.encode_png(media.padded(b"abc" * i)))
    archive.close()

    class Flaky:
        fails = 3

        def open_input_file(self, p):
            self.fails -= 1
            if self.fails >= 0:
                raise OSError("lost")
            return local.open_input_file(p)

    reader, at = media.MemberReader(Flaky(), path, retries=4, wait=0.001), 0
    for i in range(5):
        name, data, at = reader.member(at)
        assert name == f"{i}.3.png".encode() and media.decode_png(data) == media.padded(b"abc" * i)
    with pytest.raises(OSError):
        media.MemberReader(local, path, retries=1, wait=0.001).member(1)


# Chat


def test_preferences_share_their_prefix(spark):
    a = [("system", "s"), ("user", "u"), ("assistant", "good"), ("user", "more"), ("assistant", "fine")]
    b = [("system", "s"), ("user", "u"), ("assistant", "bad")]
    rows = [(1, s, i, r, t) for s, side in (("chosen", a), ("rejected", b)) for i, (r, t) in enumerate(side)]
    rows += [(2, "chosen", 0, None, None), (None, "chosen", 0, "user", "x"), (None, "rejected", 0, "user", "x"), (3, "rejected", 0, "assistant", "alone")]
    got = {r["pair_id"]: r for r in chat.preferences(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    one = got[1]
    assert one["shared_turns"] == 2 and one["prompt"] == "<|system|>\ns\n<|end|>\n<|user|>\nu\n<|end|>\n"
    cut = lambda text, mask: [text[int(s) : int(e)] for s, e in (m.split("-") for m in mask.split(",") if m)]
    assert cut(one["chosen"], one["chosen_mask"]) == ["good", "fine"] and cut(one["rejected"], one["rejected_mask"]) == ["bad"]
    assert got[2]["chosen"] == "<|user|>\n\n<|end|>\n" and got[None]["prompt"] and not got[None]["chosen"] and cut(got[3]["rejected"], got[3]["rejected_mask"]) == ["alone"]


def test_long_conversations_come_in_chunks(spark):
    rows = [(7, s, i, "user" if i % 2 else "assistant", f"{i}" if i < 700 else f"{s}{i}") for s in ("chosen", "rejected") for i in range(1500)]
    got = chat.preferences(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).orderBy("chunk").collect()
    assert len(got) == 4 and {r["shared_turns"] for r in got} == {700}
    assert "".join(r["prompt"] for r in got).count("<|end|>") == 700 and "".join(r["rejected"] for r in got).count("<|end|>") == 800
    assert chat.preferences(spark.createDataFrame([], "pair_id long, side string, turn long, role string, text string")).count() == 0


def test_preferences_of_repeats_long_texts_and_other_columns(spark):
    rows = [(1, "chosen", 0, "user", "hi", 1), (1, "chosen", 0, "user", "hi", 1), (1, "rejected", 0, "user", "hi", 1), (2, "chosen", None, "user", "x" * 2_000_000, 1), (2, "rejected", None, "user", "x" * 2_000_000, 1)]
    got = {r["pair_id"]: r for r in chat.preferences(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, shared long")).collect()}
    assert got[1]["shared_turns"] == 1 and got[1]["chosen"].count("hi") == 1 and got[1]["rejected"] == ""
    assert got[2]["shared_turns"] == 1 and len(got[2]["prompt"]) > 2_000_000


# SimHash


def slow_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [*ODD, "A b C d " * 50])
def test_fingerprints(text, monkeypatch):
    want = slow_fingerprint(text)
    assert simhash.fingerprint(text) == want
    monkeypatch.setattr(simhash, "PIECE", 7)
    monkeypatch.setattr(simhash.word_pieces, "__defaults__", (7,))
    assert simhash.fingerprint(text) == want


def test_visitors_reach_every_home_within_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.integers(-(2**63), 2**63 - 1, 300)
    homes = simhash.homes_of(x)
    for k in range(3):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in x], dtype=np.uint64).view(np.int64)
        of, anchor = simhash.visits_of(x ^ flips)
        met = np.zeros(len(x), bool)
        np.logical_or.at(met, of, anchor == homes[of])
        assert met.all()


@pytest.mark.parametrize("crowded", [0, 4096])
def test_components_are_those_of_brute_force(spark, sf, crowded):
    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    texts = [*d.text, *ODD, *(f"{t} extra" for t in d.text[:60])]
    fps = np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64)
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 2):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, texts), crowded).collect()}
    assert got == {i: find(i) for i in range(len(fps))}


def test_no_growing_side_of_a_mix_is_broadcast(spark):
    """A long text is one row and many pieces, which Spark doesn't know; rows of the documents are no broadcast either."""
    d = spark.createDataFrame([(i, "word " * (20_000 if i < 3 else 30), "en", "s", 0) for i in range(40)], DOCS)
    m = mixing.mix(d)
    for out, keys in ((m.takes, r"\[sid#\w+, index#"), (mixing.mixed(d), r"\[sid#\w+, start#")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(f"SortMergeJoin.* {keys}", plan) and not re.search(f"BroadcastHashJoin.* {keys}", plan)
    words = {r["turn"]: r["n"] for r in m.takes.groupBy("turn").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    assert words == {0: 61_110, 1: 30_555}


@pytest.mark.parametrize("crowded", [0, 4096])
def test_no_growing_side_of_links_is_broadcast(spark, crowded):
    """Visits and points are 60 rows a fingerprint and more, which Spark doesn't know; crowded anchors alone are few."""
    fps = spark.range(300).select((F.xxhash64("id") if crowded else F.col("id")).alias("fp"))
    out = simhash.links(fps, crowded)
    plans = [out._jdf.queryExecution().executedPlan().toString()]
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "Join" in plan and not [line for line in plan.split("\n") if "BroadcastHashJoin" in line and "Inner" in line]


def test_one_of_each_component_stays(spark):
    rows = [(5, "the same text here", 1), (3, "the same text here", 2), (3, "the same text here", 2), (9, "another text altogether, quite", 3), (None, "x y z", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, count long")
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 9]
    assert simhash.keep_one(d.limit(0)).count() == 0


def test_one_stays_by_document_and_text(spark):
    """Repeated and null ids with different texts, and columns with the operator's own names."""
    one, two, three = "a text about one thing or another", "quite some other words that differ", "and a third that nobody else has"
    rows = [(1, one), (1, two), (2, two), (None, one), (None, three), (None, three), (7, three)]
    d = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, __rows long, kept_id long, of long")
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, one), (1, two), (7, three)]
    nulls = spark.createDataFrame([(None, one), (None, one), (None, two)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(nulls).collect()) == sorted([one, two])
