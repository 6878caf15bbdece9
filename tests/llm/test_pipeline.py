"""The pipeline: each stage's effect on planted documents."""

import pytest

from tests.llm.conftest import sentence

cp = pytest.importorskip("corpus_pipeline")


def text(rng, n):
    return " ".join(rng.choice(["The", "house", "of", "many", "rivers,", "ran", "over.", "quick"]) if rng.random() < 0.4 else f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture
def corpus(spark, documents, rng, tmp_path):
    passage, item = sentence(rng, 70), sentence(rng, 30)
    rows = [(i, text(rng, rng.randrange(80, 160))) for i in range(150)]
    clean = dict(rows)
    rows += [(200 + i, "###$$$ %%%&&& @@@ " * 60) for i in range(5)]
    rows += [(300, rows[3][1]), (301, rows[3][1] + " end"), (302, rows[4][1].replace("house", "home", 1))]
    rows += [(400 + i, text(rng, 90) + "\n" + passage + "\n" + text(rng, 90)) for i in range(4)]
    rows += [(500, text(rng, 80) + " " + item + " " + text(rng, 80)), (600, None), (601, ""), (602, text(rng, 20000))]
    sf = str(tmp_path)
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, clean, passage, item


def test_stages(spark, corpus):
    sf, clean, passage, item = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    from loomgraph.llm.shared import written

    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), name)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        kept.append({r.doc_id: r.text for r in docs.collect()})
    _, quality, near, suffix, clear, final = kept
    assert not set(quality) & ({200, 201, 202, 203, 204, 600, 601}) and set(clean) <= set(quality)
    assert not set(near) & {300, 301, 302} and set(clean) <= set(near)
    assert [passage in suffix[i] for i in range(400, 404)] == [True, False, False, False]
    assert item in suffix[500] and item not in clear[500]
    assert all(clear[i] == t for i, t in clean.items())
    assert final == clear and all(r.n_tokens == len(r.tokens) > 0 for r in docs.collect())
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == set(final)


def test_empty_tables(spark, corpus):
    sf = corpus[0]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


CLASHING = "gone_id GONE TOKENS N_tokens Spans spans_doc Key_Lang key_source MU inv distance as_text node low high part bucket packed raw_bytes X0 keep group_id Doc size code item_id start_word task cut of_id".split()


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_a_hostile_table(spark, rng, tmp_path, name, stage):
    """Nulls in every column, empty and very long texts, repeated rows and ids, names that clash in any case."""
    item, base = sentence(rng, 20), text(rng, 100)
    rows = [(1, base), (1, base), (2, base), (3, text(rng, 120)), (None, base), (None, None), (4, None), (5, ""), (6, " \n "), (7, text(rng, 20000)), (8, item + " " + text(rng, 90)), (8, "other " + text(rng, 60)), (9, "ÉÀ İ 中文 🙂 " * 30)]
    full = [(d, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", *[None if i % 3 else i] * len(CLASHING)) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)).repartition(3)
    sf = str(tmp_path)
    spark.createDataFrame([(1, item), (None, "x y z u v w"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = stage(spark, docs, sf)
    out.write.parquet(f"{sf}/out.parquet")
    back = spark.read.parquet(f"{sf}/out.parquet")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in back.collect())
    if name != "bpe_encoding":
        assert back.columns == docs.columns
    else:
        assert back.columns == [*[c for c in docs.columns if c.lower() not in ("tokens", "n_tokens")], "tokens", "n_tokens"]
    want = sorted(((-1 if d is None else d), t or "") for d, t in rows)
    if name == "quality_rules":  # texts without a word go, each row by itself
        assert set(got) <= {x for x in want if x[1].strip()} and (1, base) in got
    elif name == "simhash_near_dedup":
        assert [d for d, _ in got] == sorted([-1, -1, 1, 3, 4, 7, 8, 9])
    elif name == "suffix_array_dedup":  # rows with one id are one document
        assert [x for x in got if x[1] == base] == [(-1, base), (1, base), (1, base)] and not any(d == 2 for d, _ in got)
        assert [d for d, _ in got if d != 2] == [d for d, _ in want if d != 2]
    elif name == "benchmark_decontamination":
        assert len(got) == len(want) and not any(item in t for _, t in got) and [x for x in got if x[0] != 8] == [x for x in want if x[0] != 8]
    else:
        assert got == want and all((r.n_tokens == 0) == (not r.text) for r in back.collect())


def test_stages_without_a_benchmark(spark, documents, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents([(1, "a b c d e f g h i j"), (2, None)])
    assert dict(cp.STAGES)["benchmark_decontamination"](spark, docs, str(tmp_path)).count() == 2
