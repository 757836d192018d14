"""The pipeline stage by stage, each against its own input."""

import zlib

import numpy as np
import pytest
from reference import leaks, near_components, source_targets, words

import corpus_pipeline as cp
from loomlog.llm.running import identified, without

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    """Input and output of every stage as pandas frames."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before = docs.toPandas()
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).toPandas(), schema=stage(spark, docs.limit(0), SF_DIR).schema)
        out.append((before, docs.toPandas()))
    return out


def test_stages_keep_the_columns(tables):
    for before, after in tables[:-1]:
        assert list(before.columns) == list(after.columns) and 0 < len(after)


def test_quality_stage(spark, tables):
    before, after = tables[0]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    assert not set(labels[labels.quality == 0].doc_id) & set(after.doc_id)
    assert len(set(labels[labels.quality == 1].doc_id) - set(after.doc_id)) <= 3


def test_near_stage(tables):
    before, after = tables[1]
    found = near_components(zip(before.doc_id, before.text), 5)
    assert sorted(after.doc_id) == sorted(i for i, (_, root) in found.items() if root == i)


def test_leak_stage(spark, tables):
    before, after = tables[2]
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").toPandas()
    found = {d for d, _ in leaks(zip(before.doc_id, before.text), zip(items.item_id, items.text))}
    assert found and set(after.doc_id) == set(before.doc_id) - found


def test_mix_stage(tables):
    before, after = tables[3]
    size = lambda frame: frame.assign(n=frame.text.map(lambda t: len(words(t)))).groupby("source").n.sum()
    target, got = source_targets(size(before).to_dict()), size(after)
    assert all(got.get(s, 0) == int(t + 1e-9) for s, t in target.items())
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() == 2


def test_token_stage(tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, after = tables[4]
    sums = sorted((r.doc_id, zlib.crc32(np.array(made.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes()))
                  for r in before.itertuples())
    assert sorted(zip(after.doc_id, after.ids_crc32)) == sums
    ordered = after.sort_values("start")
    assert ordered.doc_id.is_monotonic_increasing and (ordered.start + ordered.n_tokens).iloc[:-1].tolist() == ordered.start.iloc[1:].tolist()


def test_odd_and_empty_rows(spark, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        rows, columns = docs.count(), docs.columns
        for name, stage in cp.STAGES[:4]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == columns
        assert cp.STAGES[4][1](spark, docs, SF_DIR).count() == docs.count() and (docs.count() > 0) == (rows > 0)


def test_equal_ids_are_told_apart(spark, odd_docs):
    rows = identified(odd_docs)
    got = rows.select("doc_id", "_same").collect()
    assert len(got) == len(set(got)) == odd_docs.count()
    assert {r.doc_id for r in got if r._same >= 0} == {None, 3}
    assert without(rows, rows.filter("doc_id is null or doc_id = 5").select("doc_id", "_same")).count() == 10
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (1, text + " end"), (1, "other"), (2, text)], "doc_id long, text string")
    left = sorted(cp.near_copies(spark, docs, SF_DIR).collect())
    assert [r.doc_id for r in left] == [1, 1] and left[0].text == "other" and left[1].text in (text, text + " end")
