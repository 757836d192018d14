"""Cases at the edge: clashing names, ids of other types, one language, many languages; plain versions of the queries."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import language as la
from loomlog.llm import queries as q
from loomlog.llm.decontamination import contaminations
from loomlog.llm.mixing import mix

SF_DIR = "/root/testdata/sf0.001"


def test_mix_replaces_columns_named_like_results(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 5, 1, 2, 3) for i in range(20)], "doc_id long, source string, size long, target int, taken int, source_size int")
    plain = mix(docs.drop("target", "taken", "source_size"))
    assert sorted(map(str, mix(docs).select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    with pytest.raises(ValueError):
        mix(docs, size="taken")


def test_items_with_text_ids_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame(
        [("a", " ".join(words[:12])), ("a", " ".join(words[30:50])), ("a", " ".join(words[:12])), (None, " ".join(words[14:26])), ("z", "not there at all today")],
        "item_id string, text string")
    docs = spark.createDataFrame([("d1", "x y " + " ".join(words)), ("d2", " ".join(words[28:55])), ("d3", "nothing of it")], "doc_id string, text string")
    got = {(r.doc_id, r.item_id): (r.words, r.similarity) for r in contaminations(docs, items).collect()}
    assert got == {("d1", "a"): (12, 1.0), ("d1", None): (12, 1.0), ("d2", "a"): (20, 1.0)}


def test_one_language_is_everything_with_letters(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["some words", "more of them", "12 34", None, "ok then", "yes and no", "last one"])],
                                 "doc_id long, text string, lang string")
    rows = la.identify(docs).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3)} == {"und"}
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id not in (2, 3)} == {("en", 1.0)}


def test_many_languages_teach_a_bounded_sample(spark, monkeypatch):
    rng = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    kinds = {f"l{n}": [rng.choice(alphabet) + rng.choice(alphabet) + rng.choice(alphabet) for _ in range(9)] for n in range(30)}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(la, "TAUGHT", 240)  # eight texts a language
    sizes = []
    kept = la.fit
    monkeypatch.setattr(la, "fit", lambda langs, counts: sizes.append(len(langs)) or kept(langs, counts))
    got = {r.doc_id: (r.held_out, r.lang_pred) for r in la.identify(docs).collect()}
    held = [got[i][1] == k for i, _, k in rows if got[i][0]]
    assert sizes[0] < 700 and np.mean(held) > 0.9


def test_decisions_by_hand():
    """The family with the greatest margin, then the language that wins most of its pairs, step by step."""
    families = [("f", ["a", "b", "c"], 0), ("g", ["d"], 1)]
    pairs = [("a", "b", 2), ("a", "c", 3), ("b", "c", 4)]
    rng = np.random.default_rng(2)
    margins = rng.normal(size=(200, 5))
    lang, score = la.decide(margins, families, pairs)
    for row, m in enumerate(margins):
        if m[1] > m[0]:
            assert lang[row] == "d"
            continue
        wins = {"a": (m[2] > 0) + (m[3] > 0), "b": (m[2] <= 0) + (m[4] > 0), "c": (m[3] <= 0) + (m[4] <= 0)}
        top = [k for k, v in wins.items() if v == max(wins.values())]
        assert lang[row] in top
        assert 0 <= score[row] <= 1


def test_predictions_by_plain_sums(spark):
    """Margins of whole texts, feature by feature."""
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(la.FEATURES + 1, 2))
    model = (weights, [("f", ["a"], 0), ("g", ["b"], 1)], [])
    texts = ["Hello World", "a", "Été à la mer  là", "x " * 500]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], ["id", "text"])
    got = next(iter(la._predictor(model)(iter([batch])))).to_pydict()
    for text, lang in zip(texts, got["lang_pred"]):
        total, count = np.zeros(2), 0
        for word in text.split():
            _, grams = la.word_features([word])
            total += weights[grams].sum(axis=0)
            count += len(grams)
        assert lang == "ab"[int((total / count + weights[-1]).argmax())]


def test_shard_query_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = q.op2_hypergeometric_shards(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        body = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "rows", None)
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) - len(docs) // 16 in (0, 1)


def test_shards_replace_columns_named_like_results(spark):
    from loomlog.llm.sharding import shuffle_into_shards

    out = shuffle_into_shards(spark.range(50).select("id", F.lit("x").alias("shard"), F.lit("y").alias("slot")), 4)
    assert sorted(r.shard for r in out.collect()) == sorted(i % 4 for i in range(50)) and len(out.columns) == 3
