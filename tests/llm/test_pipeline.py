"""Every stage of the pipeline against a plain version, on small tables with nulls and an extra column."""

import numpy as np
import pytest
from plain import corpus, groups, leaks, without_lines

import corpus_pipeline
from shotloom.llm import bpe_codec, toxicity, vocab

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = corpus(72)
    rows += [(3000 + k, f"this number {k} is such a blockhead and a nitwit at {k * k}") for k in range(40)]
    rows += [(4000, "x y " + ITEM + " z"), (4001, ITEM.replace("eta ", "other ", 1)), (None, "no id at all"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), "extra", "many", None, "was") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int, words string, n_lines string, n_removed string, _gone string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if i < 3000 else 1) for i, _ in rows if i is not None and i < 4000], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    before = [(r.doc_id, r.text) for r in docs.collect()]
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, tables)
        out.write.parquet(f"{tables}/{name}")
        docs = spark.read.parquet(f"{tables}/{name}")
        if name != "encoding":
            assert docs.columns == columns
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(r.n_chars == len(r.text or "") for r in docs.collect()) and {(r.words, r.n_lines, r.n_removed, r._gone) for r in docs.collect()} == {("extra", "many", None, "was")}
            seen[name] = (before, rows)
            before = rows
    with_id = lambda rows: {i: t for i, t in rows if i is not None}
    for _, rows in seen.values():
        assert sum(i is None for i, _ in rows) == 2
    old, new = map(with_id, seen["toxicity"])
    assert new == {i: t for i, t in old.items() if not 3000 <= i < 4000}
    old, new = map(with_id, seen["line dedup"])
    assert new == {i: t for i, (t, _, _) in without_lines(old.items()).items()}
    old, new = map(with_id, seen["near-dedup"])
    assert new == {i: old[i] for i, (_, c) in groups(old.items()).items() if i == c}
    old, new = map(with_id, seen["decontamination"])
    hit = {i for i, _ in leaks([(i, t) for i, t in old.items() if i != 1007], [(1, ITEM)])}
    assert hit == {4000, 4001} & set(old) and new == {i: t for i, t in old.items() if i not in hit}
    lib = vocab.library(vocab.default_path(bpe_codec.TOKENIZER))
    for r in docs.collect():
        if r.doc_id is not None:
            assert r.ids == lib.encode(new[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_and_empty_tables(spark, tables, tmp_path):
    got = corpus_pipeline.run(spark, tables)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_model_needs_both_classes(spark):
    m = toxicity.train(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert m.terms == [] and np.isfinite(m.weights).all()
