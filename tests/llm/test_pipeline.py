import zlib

import duckdb
import numpy as np
import pytest
from test_operators import DOCS, ODD, brute_matches, slow_fingerprint

import corpus_pipeline
from tallyweave.llm import decontam, langid, mixing, queries


def test_stages_keep_the_columns_and_shrink_or_mix(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
        d = corpus_pipeline.stored(out, "test")
        counts.append(d.count())
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[0] >= 190
    out = corpus_pipeline.write_token_ids(spark, d, sf)
    assert out.count() == counts[-1] and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.fixture
def small(spark, sf, tmp_path):
    """Documents with copies, near copies, benchmark passages, odd rows and ids that repeat, and the benchmark."""
    d = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in d]
    rows += [(500 + k, rows[k][1], "en", "s1", 1) for k in range(5)] + [(600 + k, f"{rows[k + 9][1]} and {t} end", "en", "s2", 1) for k, (_, t) in enumerate(items)]
    rows += [(700 + k, t, "en", None, 0) for k, t in enumerate(ODD)] + [(None, rows[30][1], "en", "s1", 1), (None, "words of an unknown document", None, "s1", 1), (3, "another text under an id that is taken", "en", "s2", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def key(row):
    return (row[0] is None, row[0] or 0, row[1] or "", row[2] or "", row[3] or "")


def test_every_stage_is_that_of_brute_force(spark, small):
    from tokenizers import Tokenizer

    import public_tokenizers

    folder, rows, items = small
    d = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        d = corpus_pipeline.stored(stage(spark, d, folder), "test")
        after[name] = [tuple(r) for r in d.collect()]

    model = langid.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    kept = [r for r in rows if not model.predict(r[1])[2]]
    assert sorted(after["language_id"], key=key) == sorted(kept, key=key)

    fps = np.array([slow_fingerprint(r[1]) for r in kept], dtype=np.uint64)
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 2).tolist():
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(kept[i])
    assert len(after["simhash_dedup"]) == len(groups)
    for own in groups.values():
        best = min((r[0] is None, r[0] or 0) for r in own)
        stay = [r for r in after["simhash_dedup"] if r in own]
        assert len(stay) == 1 and (stay[0][0] is None, stay[0][0] or 0) == best

    kept = after["simhash_dedup"]
    bad = {d for d, _ in brute_matches([r[1] or "" for r in kept], items)}
    assert bad and sorted(after["decontamination"], key=key) == sorted((r for i, r in enumerate(kept) if i not in bad), key=key)

    spark.createDataFrame(after["decontamination"], DOCS).write.parquet(f"{folder}/mixed/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/mixed/documents.parquet/*.parquet'")
    taken = sorted((-1 if r[0] is None else r[0], r[1]) for r in con.sql(f"SELECT doc_id, sum(taken)::BIGINT FROM ({mixing.ORACLE}) GROUP BY 1 HAVING sum(taken) > 0").fetchall())
    got = {}
    for r in after["mixing"]:
        got[-1 if r[0] is None else r[0]] = got.get(-1 if r[0] is None else r[0], 0) + len(r[1].split())
    assert sorted(got.items()) == taken
    whole = {" ".join((r[1] or "").split()) for r in after["decontamination"]}
    assert all(any(" ".join(r[1].split()[:8]) in w for w in whole) for r in after["mixing"])

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in after["mixing"]:
        ids = np.array([*plain.encode(r[1], add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((-1 if r[0] is None else r[0], len(ids), zlib.crc32(ids.tobytes())))
    out = sorted(after["token_ids"], key=lambda r: r[1])
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in out) == sorted(want)
    assert [r[1] for r in out] == np.cumsum([0, *(r[2] for r in out)])[:-1].tolist()
    assert [(r[0] is not None, r[0] or 0) for r in out] == sorted((r[0] is not None, r[0] or 0) for r in out)


def test_clean_documents_stay(spark, small):
    folder, rows, items = small
    d = spark.createDataFrame([r for r in rows[:60] if r[1]], DOCS)
    bench = spark.createDataFrame([(1, " ".join(f"none{k}" for k in range(30)))], "item_id long, text string")
    assert decontam.clean(d, bench).count() == d.count()


def test_odd_rows_and_no_rows_go_through(spark, sf):
    d = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(ODD * 2)], DOCS)
    for start in (d, d.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.stored(stage(spark, now, sf), "odd")
        assert now.count() >= 0


def test_pipeline_runs_whole(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_queries_agree_with_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    for name, sql in queries.ORACLE.items():
        got, want = queries.QUERIES[name](spark, sf), con.sql(sql)
        # As rows, not as pandas: that turns whole numbers beside nulls into floats.
        assert text(got.collect()) == text([[r[want.columns.index(c)] for c in got.columns] for r in want.fetchall()]), name
