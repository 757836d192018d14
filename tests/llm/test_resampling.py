"""Importance resampling: the draw itself, its temperature, keys of any type."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlog.llm import importance as im


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts between two vocabularies; the labelled good ones are of the first."""
    rng = np.random.default_rng(8)
    good, other = [f"g{i}" for i in range(40)], [f"o{i}" for i in range(40)]
    rows = []
    for n in range(1200):
        share = rng.beta(1.2, 1.2)
        words = [str(rng.choice(good if rng.random() < share else other)) for _ in range(int(rng.integers(4, 16)))]
        rows.append((f"doc {n}", " ".join(words), float(share)))
    docs = spark.createDataFrame(rows, "doc_id string, text string, share double").cache()
    labels = spark.createDataFrame([(r[0], int(r[2] > 0.8), 0) for r in rows[::2]], "doc_id string, quality int, toxic int")
    return rows, docs, labels


def grams(texts):
    _, bins = im.ngram_bins(pa.array(texts), 512)
    found = np.bincount(bins, minlength=512) + 0.5
    return found / found.sum()


def distance(a, b):
    return float((a * np.log(a / b)).sum())


def test_the_sample_moves_towards_the_target(corpus):
    rows, docs, labels = corpus
    target = grams([r[1] for n, r in enumerate(rows) if n % 2 == 0 and r[2] > 0.8])
    raw = grams([r[1] for r in rows])
    drawn = im.resample(docs, labels, k=300).filter("_kept").toPandas()
    assert len(drawn) == 300 and distance(target, grams(drawn.text.tolist())) < 0.5 * distance(target, raw)


def test_seeds_give_different_draws_of_the_same_size(corpus):
    _, docs, labels = corpus
    draws = [{r.doc_id for r in im.resample(docs, labels, k=200, seed=s).filter("_kept").collect()} for s in (1, 2, 1)]
    assert [len(d) for d in draws] == [200] * 3 and draws[0] == draws[2]
    assert 40 < len(draws[0] & draws[1]) < 180


def test_chances_follow_the_ratios(corpus):
    """Drawing one document many times: each comes up in proportion to its ratio."""
    _, docs, labels = corpus
    few = docs.limit(6)
    rows = im.resample(few, labels, k=1, temper=None).toPandas()
    weight = np.exp(rows._log_weight - rows._log_weight.max())
    rng = np.random.default_rng(3)
    wins = np.bincount((rows._log_weight.to_numpy() + rng.gumbel(size=(20_000, 6))).argmax(1), minlength=6) / 20_000
    assert np.allclose(wins, weight / weight.sum(), atol=0.02) and rows._kept.sum() == 1


def test_temperature(corpus):
    _, docs, labels = corpus
    plain = {r.doc_id: r for r in im.resample(docs, labels, k=1, temper=None).collect()}
    for r in im.resample(docs, labels, k=1, temper=8).collect():
        assert r._log_weight == pytest.approx(plain[r.doc_id]._log_weight * 8 / max(8, r._n_grams), rel=1e-6, abs=1e-9)


def test_weights_by_hand(corpus):
    rows, docs, labels = corpus
    texts = {r[0]: r[1] for r in rows}
    target = [i for n, (i, _, s) in enumerate(rows) if n % 2 == 0 and s > 0.8]
    bins = {i: im.ngram_bins(pa.array([t]))[1] for i, t in texts.items()}
    raw, mine = np.zeros(im.BINS), np.zeros(im.BINS)
    for i, b in bins.items():
        np.add.at(raw, b, 1)
        if i in set(target):
            np.add.at(mine, b, 1)
    ratio = np.log((mine + 5) / (raw * mine.sum() / raw.sum() + 5))
    for r in im.resample(docs, labels, k=5, temper=None).collect():
        assert r._log_weight == pytest.approx(ratio[bins[r.doc_id]].sum(), rel=1e-4, abs=1e-4) and r._n_grams == len(bins[r.doc_id])


def test_expected_number_and_edges(spark, corpus, odd_docs):
    rows, docs, labels = corpus
    kept = im.resample(docs, labels).filter("_kept").count()
    assert abs(kept - sum(r[2] > 0.8 for r in rows)) < 60
    assert im.resample(docs, labels, k=0).filter("_kept").count() == 0
    assert im.resample(docs, labels, k=10**6).filter("_kept").count() == len(rows)
    odd = im.resample(odd_docs, spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert odd.count() == 13 and odd.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert not odd.filter(F.col("_kept") & (F.col("_n_grams") == 0)).count()
