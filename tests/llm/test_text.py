"""Operators that read texts in Python tasks, against plain versions and held-out labels."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from reference import leaks, near_components

from loomlog.llm import masked_lm as lm
from loomlog.llm import queries as q
from loomlog.llm.decontamination import contaminations, simhash, weighted
from loomlog.llm.importance import resample
from loomlog.llm.language import family_of, identify
from loomlog.llm.near_dups import near_groups, sketches, smallest_reachable
from loomlog.llm import token_files as tf
from loomlog.llm.token_files import (
    encode_texts, id_bits, pack_ids, read_document, read_documents, read_range, unpack_ids, write_token_files)
from loomlog.llm.words import shingle_hashes, split_words

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 24, 31, 32])
def test_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        data = pack_ids(ids, bits)
        assert len(data) == (n * bits + 7) // 8 and (unpack_ids(data, n, bits) == ids).all()
        for start in rng.integers(0, n + 1, 5).tolist():
            count = int(rng.integers(0, n - start + 1))
            assert (unpack_ids(data, count, bits, start) == ids[start : start + count]).all()
    assert id_bits(50257) == 16 and id_bits(2) == 1 and id_bits(1) == 1 and id_bits(65537) == 17


def test_pieces_encode_like_whole_texts(tokenizer):
    path, made = tokenizer
    odd = ["", " ", "  ", " a", "a  b", "a   b", "a \n b", "a\n\n  b", "x\x1c y", "x  y", "x  y", "tab\t b", "a ",
           "\n", "it's  we'll 'd", "é ü 12 34!! ??", None, "<|endoftext|> x", "a\u0085 b", "a​ b", "a\x00 b", "日本 語"]
    odd += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", " <|endoftext|>  <|endoftext|>", "<|endof text|>", "a <|endoftext|>"]
    for remembered in (0, 10):
        lengths, ids = encode_texts(pa.array(odd), path, remembered)
        ends = np.cumsum(lengths)
        for text, end, n in zip(odd, ends, lengths):
            assert ids[end - n : end].tolist() == made.encode(text or "", add_special_tokens=False).ids


def test_words_are_cut_where_the_tokenizer_cuts(tokenizer):
    """Every three of these in a row, kept pieces or not, like whole texts."""
    some = [" ", "  ", "\n", "\x1c", "\x00", "\u0085", "\u00a0", "\u2003", "\u200b", "\u3000", "b", "S", "s", "re", "'", "''", ".", "(", "7",
            "\u0663", "\u00bd", "\u00e9", "\u0301", "\u00d7", "\u00f7", "\u00df", "\u0436", "\u0482", "\u201c", "\u65e5", "\U0001f600", "<|endoftext|>"]
    texts = ["".join(t) for t in itertools.product(some, repeat=3)]
    want = tokenizer[1].encode_batch(texts, add_special_tokens=False)
    for remembered in (0, 10**6):
        for begin in range(0, len(texts), 4096):
            lengths, ids = encode_texts(pa.array(texts[begin : begin + 4096]), tokenizer[0], remembered)
            coded = [w.ids for w in want[begin : begin + 4096]]
            assert lengths.tolist() == [len(c) for c in coded] and ids.tolist() == [i for c in coded for i in c]
    assert [len(x) for x in encode_texts(pa.array([], pa.string()), tokenizer[0])] == [0, 0]
    assert [x.tolist() for x in encode_texts(pa.array(["", None]), tokenizer[0])] == [[0, 0], []]


def test_a_word_is_encoded_once_whatever_follows_it(tokenizer):
    """The text that goes to the library grows with the words, not with the marks behind them."""
    coder = tf._encoder(tokenizer[0])
    made, given = coder.made, []

    class Counting:
        @staticmethod
        def encode_batch_fast(texts, **settings):
            given.extend(texts)
            return made.encode_batch_fast(texts, **settings)

    words = ["".join(w) for w in itertools.product("bdfk", "aeou", "lmnr", "aiou")]
    texts = [f"so {w}{mark} then" for w in words for mark in (",", ".", ";", ":", "?", "!", "")]
    coder.forget()
    coder.made = Counting
    try:
        lengths, ids = encode_texts(pa.array(texts), tokenizer[0])
    finally:
        coder.made = made
    coded = [c.ids for c in made.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(c) for c in coded] and ids.tolist() == [i for c in coded for i in c]
    assert sum(map(len, given)) <= sum(len(w) + 1 for w in words) + 50  # not seven times as much


def test_token_query(spark, documents, tokenizer):
    got = q.op3_packed_token_ids(spark, SF_DIR).toPandas().set_index("doc_id")
    place = 0
    for r in documents.sort_values("doc_id").itertuples():
        ids = np.array(tokenizer[1].encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        row = got.loc[r.doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (place, len(ids), zlib.crc32(ids.tobytes()))
        place += len(ids)
    assert len(got) == len(documents)


def test_token_files_of_odd_rows(spark, odd_docs, tokenizer, tmp_path):
    path = f"file://{tmp_path}/t"
    write_token_files(odd_docs, path, tokenizer[0], 50257, block_tokens=64)
    got = read_documents(spark, path).orderBy("start").collect()
    assert [r.id for r in got] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, None, None] and got[0].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    write_token_files(odd_docs.limit(0), path, tokenizer[0], 50257)
    assert read_documents(spark, path).count() == 0


@pytest.mark.parametrize("vocabulary", [None, 70_000])
def test_ranges_and_documents_by_offsets(spark, documents, tokenizer, tmp_path, vocabulary):
    """At 16 and at 17 bits; the ranges cross documents, blocks and parts."""
    path = f"file://{tmp_path}/r"
    docs = spark.createDataFrame(documents[["doc_id", "text"]]).repartition(5)
    write_token_files(docs, path, tokenizer[0], vocabulary, block_tokens=500)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert {r.bits for r in blocks.select("bits").distinct().collect()} == {16 if vocabulary is None else 17}
    made = {r.doc_id: tokenizer[1].encode(r.text, add_special_tokens=False).ids + [0] for r in documents.itertuples()}
    stream = [i for key in sorted(made) for i in made[key]]
    rng = np.random.default_rng(0)
    for start, count in [(0, 1), (0, 0), (len(stream) - 3, 10), (len(stream), 5), (-4, 9)] + [
            (int(s), int(n)) for s, n in zip(rng.integers(0, len(stream), 4), rng.integers(1, 5000, 4))]:
        pieces = sorted(tuple(r) for r in read_range(spark, path, start, count).collect())
        got = [i for _, ids in pieces for i in ids]
        assert got == stream[max(0, start) : max(0, start + count)]
        assert not pieces or pieces[0][0] == max(0, start)
    plan = read_range(spark, path, 700, 20)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(part" in plan
    key = int(documents.doc_id[17])
    assert [r.ids for r in read_document(spark, path, key).collect()] == [made[key]]
    assert read_document(spark, path, -1).count() == 0


def test_ids_that_do_not_fit_raise(tokenizer):
    run = tf._packer(tokenizer[0], 0, 8, pa.int64(), 100)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some ordinary words"])], ["id", "text"])

    class Context:
        @staticmethod
        def get():
            return Context

        partitionId = staticmethod(lambda: 0)

    import pyspark

    kept, pyspark.TaskContext = pyspark.TaskContext, Context
    try:
        with pytest.raises(ValueError, match="8 bits"):
            list(run(iter([batch])))
    finally:
        pyspark.TaskContext = kept
    assert tf.vocabulary_size(tokenizer[0]) == 50257


def test_near_query(spark, documents):
    got = {r.doc_id: r for r in q.op7_near_copies(spark, SF_DIR).collect()}
    want = near_components(zip(documents.doc_id, documents.text), 4)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def _chain(rng, count):
    """Texts that each differ a little from the one before, so ends are linked only through the middle."""
    now = [f"c{x}" for x in rng.integers(0, 10**6, 120)]
    for i in range(count):
        yield " ".join(now)
        now[int(rng.integers(0, 120))] = f"n{i}"


def test_near_chains_groups_and_strangers(spark):
    rng = np.random.default_rng(3)
    texts = [t for _ in range(4) for t in _chain(rng, 25)]
    base = [f"p{x}" for x in range(60)]
    texts += [" ".join(base + [f"u{i}_{j}" for j in range(14)]) for i in range(40)]  # about 0.63 alike: no links
    texts += ["a b c d e", "A b c d e", "a b c", "a b c", "a b", None, "", "a b c d e f"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for size in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, size=size).collect()}
        assert got == near_components(docs, size)


def test_near_odd_rows(spark, odd_docs):
    got = near_groups(odd_docs).collect()
    assert len(got) == 13 and {r.component_id for r in got if r.doc_id == 10} == {9}
    assert [r.component_id for r in got if r.doc_id == 6] == [5] and not any(r.kept for r in got if r.doc_id is None)
    assert near_groups(odd_docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 12, 400):
        agree = []
        for _ in range(60):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            b = np.concatenate([a[: size * 2 // 3], rng.integers(0, 2**63, size - size * 2 // 3, dtype=np.uint64)])
            sets = [np.unique(a), np.unique(b)]
            m = sketches(np.array([len(s) for s in sets]), np.concatenate(sets))
            agree.append((m[0] == m[1]).mean())
        assert abs(np.mean(agree) - 0.5) < 0.08


def test_leak_query(spark, documents):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").toPandas()
    got = {(r.doc_id, r.item_id): r.similarity for r in q.op9_benchmark_leaks(spark, SF_DIR).collect()}
    want = leaks(zip(documents.doc_id, documents.text), zip(items.item_id, items.text))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_with_edits_and_odd_items(spark):
    rng = np.random.default_rng(5)
    item = [f"q{x}" for x in rng.integers(0, 500, 50)]
    edited = [*item[:3], "new", *item[4:]]
    again = "x y " * 20
    docs = [(0, "start " + " ".join(item) + " end"), (1, " ".join(edited)), (2, " ".join(item[:46])), (3, " ".join(item[:25])),
            (4, again), (5, None), (6, ""), (7, "w1 W2 w3"), (8, "a w1 w2 w3 b"), (9, " ".join(item[:20] + ["z"] + item[20:]))]
    items = [(1, " ".join(item)), (2, again), (3, "w1 w2 w3"), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminations(d, b).collect()}
    want = leaks(docs, items)
    assert got.keys() == want.keys() and (1, 1) in got and (3, 1) not in got
    assert contaminations(d.limit(0), b).count() == contaminations(d, b.limit(0)).count() == 0


def test_weighted_sets_count_repeats():
    one, two = (np.array(x, np.uint64) for x in ([5, 5, 5, 9], [5, 5, 7]))
    a, b = set(weighted(one).tolist()), set(weighted(two).tolist())
    assert len(a) == 4 and len(b) == 3 and len(a & b) == 2
    assert simhash(one) == simhash(one[::-1].copy())


def test_short_texts_are_one_shingle():
    offsets, words = split_words(pa.array(["a b", None, "", "a b c d e f", " x "]))
    ends, grams = shingle_hashes(offsets, words.indices.to_numpy().astype(np.uint64) + np.uint64(1), 5)
    assert np.diff(ends).tolist() == [1, 0, 0, 2, 1] and len(set(grams.tolist())) == 4


def test_quality(spark, odd_docs):
    sf = "/root/testdata/sf0.01"
    got = q.op5_importance_resampling(spark, sf).toPandas()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(got) == 1000 and known[known.quality == 0].kept.mean() < 0.03 and known[known.quality == 1].kept.mean() > 0.99
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = resample(odd_docs, empty).collect()
    assert sum(r._kept for r in rows) == 10 and all(r._log_weight == 0 for r in rows) and "kept" in rows[0]
    assert resample(odd_docs.limit(0), empty).count() == 0


def test_language(spark, odd_docs):
    got = q.op6_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    out = got.merge(truth, on="doc_id").query("held_out")
    assert len(got) == 1000 and (out.lang == out.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert [family_of(x) for x in ("de", "fr", "xx")] == ["germanic", "romance", "xx"]
    rows = identify(odd_docs).collect()
    assert len(rows) == 13 and {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"und"}
    assert identify(odd_docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_masked_model_learns(spark, documents, odd_docs):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.train(rows)
    offsets, tokens = lm.token_stream(pa.array(documents.text.tolist()))
    places = np.arange(len(tokens))
    score = lambda m, t: lm.log_probabilities(m, lm.contexts(offsets, t, places), t).mean()
    mixed = np.random.default_rng(0).permutation(tokens)
    assert score(model, tokens) > score(lm.start_model(), tokens) + 0.2 and score(model, tokens) > score(model, mixed)
    got = {r.doc_id: r for r in lm.score_documents(odd_docs, model=model).collect()}
    assert got[1].n_tokens == 0 and got[1].log_likelihood == 0 and got[1].mean_log_likelihood is None and got[3].n_tokens == 1
    assert lm.score_documents(odd_docs.limit(0)).count() == 0


def test_masked_probabilities_sum_to_one():
    model = {n: v * 5 for n, v in lm.start_model().items()}
    around = np.tile(np.array([[3, 5, lm.TOKENS, 9]]), (lm.TOKENS, 1))
    assert abs(np.exp(lm.log_probabilities(model, around, np.arange(lm.TOKENS))).sum() - 1) < 1e-4


def test_masked_gradient():
    rng, names = np.random.default_rng(2), list(lm.SHAPES)
    model = {n: v * 3 for n, v in lm.start_model().items()}
    around, want = rng.integers(0, lm.TOKENS + 1, (64, 4)), rng.integers(0, lm.TOKENS, 64)
    before = lm.log_probabilities(model, around, want).mean()
    for _ in range(30):
        lm.train_step(model, {n: np.full(lm.SHAPES[n], 1e-6, np.float32) for n in names}, around, want, 0.01)
    assert lm.log_probabilities(model, around, want).mean() > before + 0.3


def test_every_token_trains_the_model():
    """Each token of each text is a target once, in batches of any size."""
    texts = ["a b c", None, "", "one two " * 9000, "x y z " * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    (got,) = lm._trainer(iter([batch]))
    assert set(got.column("seen").to_pylist()) == {18303}
