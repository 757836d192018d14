"""Prefix counts, trie codes and fill-in-the-middle, against the library and plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomlog.llm import middles as m
from loomlog.llm import part_codes as pc
from loomlog.llm import prefix_counts as p
from loomlog.llm import queries as q

SF_DIR = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", " a", "a ", "a  b ", "   three  spaces", "a\n\n b", "\n", " \n ", "\t x\r\n", "<s> x </s><unk> <0x41>", "▁a ▁▁b▁",
       "日本語 Ａﬁ①", "é é", "\x00 a\x00", "  x　y", "👍🏽 ok", "Supercalifragilistic" * 30, "a" * 500, None]


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def random_texts(count, seed):
    rng = random.Random(seed)
    stock = ["the", "th", "ing", " ", "  ", "\n", "é", "ß", "Ａ", "x", "1", "00", "ation", "▁", ".", "日", "q", "zz", "\r", "'s", "<s>"]
    return ["".join(rng.choice(stock) for _ in range(rng.randrange(25))) for _ in range(count)]


def test_every_prefix_counts_as_the_library_does(pieces):
    path, model = pieces
    texts = ODD + random_texts(300, 1)
    edges, steps = p.prefix_steps(pa.array(texts, pa.string()), path)
    for text, a, b in zip(texts, edges[:-1], edges[1:]):
        body = text or ""
        want = [len(model.encode(body[:n])) for n in range(1, len(body) + 1)]
        assert np.cumsum(steps[a:b]).tolist() == want, repr(text)


def test_forgetting_changes_nothing(pieces, monkeypatch):
    path, _ = pieces
    texts = pa.array(random_texts(200, 2))
    whole = p.prefix_steps(texts, path)
    for name in ("PAIRS", "UNITS"):
        monkeypatch.setattr(p, name, 3)
    p._prefixes(path).known.clear()
    again = p.prefix_steps(texts, path)
    assert all((a == b).all() for a, b in zip(whole, again))


def test_stored_counts_answer_budgets_and_places(spark, odd_docs, pieces, tmp_path):
    path, model = pieces
    store = str(tmp_path / "counts")
    p.write_prefix_counts(odd_docs, store, path)
    stored = p.read_prefix_counts(spark, store)
    docs = odd_docs.toPandas()
    assert stored.count() == len(docs)
    texts = {i: t for i, t in zip(docs.doc_id, docs.text) if i == i}
    for budget in (-1, 0, 1, 3, 7, 20000):
        for r in p.longest_prefixes(stored, budget).filter("id is not null and id < 9").collect():
            body = texts[r.id] or ""
            fits = [n for n in range(len(body) + 1) if len(model.encode(body[:n])) <= budget]
            assert r.n_chars == (max(fits) if fits else 0)
    places = spark.createDataFrame([(5, 9), (5, -3), (5, 10**6), (5, None), (9, 1000), (77, 1), (None, 1)], "id long, asked long")
    got = {(r.id, r.asked): r.n_tokens for r in p.tokens_at(stored, places).collect()}
    size = lambda i, n: len(model.encode(texts[i][:n]))
    assert got == {(5, 9): size(5, 9), (5, -3): 0, (5, 10**6): size(5, None), (5, None): None, (9, 1000): size(9, 1000)}
    p.write_prefix_counts(odd_docs.limit(0), store, path)
    assert p.longest_prefixes(p.read_prefix_counts(spark, store), 5).count() == 0


def test_prefix_query(spark, pieces):
    got = {r.doc_id: r for r in q.op11_prefix_counts(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(pieces[1].encode(d.text or ""))
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 4096)


def nearest(parts, entries):
    gaps = ((parts[:, None] - entries[None]) ** 2).sum(2)
    return gaps.argmin(1), gaps.min(1)


@pytest.mark.parametrize("block", [1, 1 << 20])
@pytest.mark.parametrize("places,spread,rows,entries", [(4, 3, 500, 64), (4, 90, 900, 64), (1, 5, 50, 3), (7, 2, 300, 1), (3, 1, 10, 8)])
def test_trie_finds_the_nearest(monkeypatch, block, places, spread, rows, entries):
    monkeypatch.setattr(pc, "HELD", block)
    rng = np.random.default_rng(rows)
    parts, books = rng.integers(-spread, spread + 1, (rows, places)), rng.integers(-spread, spread + 1, (entries, places))
    sums = np.zeros((entries, places + 1), np.int64)
    chosen, error = pc.assign(parts, books, sums)
    want, gap = nearest(parts, books)
    assert (chosen == want).all() and (error == gap).all()
    for e in range(entries):
        assert sums[e].tolist() == [*parts[want == e].sum(0).tolist(), int((want == e).sum())]
    assert pc.assign(parts[:0], books)[0].shape == (0,)


def plain_codes(rows, parts, entries, rounds):
    """{id: (code, error)} and the digest, row by row and without a trie; ids are distinct."""
    kept = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    ids = sorted(kept)
    cut = {i: np.split(kept[i], parts) for i in ids}
    books = [np.array([cut[i][k] for i in ids[:entries]]) for k in range(parts)]
    for turn in range(rounds + 1):
        codes = {i: [nearest(cut[i][k][None], books[k]) for k in range(parts)] for i in ids}
        if turn < rounds:
            for k in range(parts):
                for e in range(len(books[k])):
                    mine = [cut[i][k] for i in ids if codes[i][k][0][0] == e]
                    if mine:
                        books[k][e] = sum(mine) // len(mine)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return {i: ("".join(f"{c[0][0]:02x}" for c in codes[i]), sum(int(c[1][0]) for c in codes[i])) for i in ids}, digest


def test_codes_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(pc, "VALUES", 40)  # several tries in a task
    rng = random.Random(5)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.5]) for _ in range(8)]) for i in range(3, 90)]
    rows += [(90, None), (91, [1.0] * 7 + [None]), (0, [float("nan")] * 8), (1, [float("inf")] + [0.0] * 7), (2, [])]
    docs = spark.createDataFrame([(i, v, "a" if i % 3 else None, i) for i, v in rows], "vec_id long, embedding array<double>, label string, error long")
    for n in (1, 5):
        coded, books = pc.compress(docs.repartition(n), carried=["label"], parts=4, entries=16, rounds=3)
        want, digest = plain_codes(rows, 4, 16, 3)
        assert {r.id: (bytes(r.code).hex(), r.error) for r in coded.collect()} == want and books.digest() == digest
        back = pc.rebuild(coded, books).collect()
        for r in back:
            exact = np.floor(256 * np.array(dict(rows)[r.id]))
            assert ((np.array(r.rebuilt) * 256 - exact) ** 2).sum() == r.error


def test_codes_of_ties_widths_and_nothing(spark):
    same = [(7, [0.25] * 5), (7, [0.25] * 5), (None, [0.25] * 5), (9, [1.0, 2.0]), (8, [0.0] * 5)]
    docs = spark.createDataFrame(same, "vec_id long, embedding array<float>")
    coded, books = pc.compress(docs, parts=2, entries=4)
    assert books.entries.shape == (2, 4, 3) and books.width == 5  # 5 components in two parts of 3
    got = sorted((r.id is None, r.id, bytes(r.code).hex(), r.error) for r in coded.collect())
    assert got == [(False, 7, "0000", 0), (False, 7, "0000", 0), (False, 8, "0202", 0), (True, None, "0000", 0)]
    none, books = pc.compress(docs.filter("vec_id = 1"))
    assert books is None and none.count() == 0 and none.columns == ["id", "code", "error"]


def middle_by_hand(text, key):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    x, y, z = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if d % 100 < 50:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_middles_by_hand_and_back():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "日", "\n", "\r\n", "<", "P", "S>", "M", ">", "\x00"]) for _ in range(rng.randrange(40))) for _ in range(500)]
    forms = set()
    for key, text in enumerate([*texts, "", "\n", "\n\n", "no end", "x" * 100_000 + "\n" + "é" * 50_000, "has <S> inside"]):
        n, form, x, y, output = m.to_middle(text.encode(), str(key), m.Plan())
        assert (n, form, x, y, output.decode()) == middle_by_hand(text, key)
        assert m.from_middle(output, form) == text.encode()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("sizes", [(0, 0), (0, 3), (4, 0), (1, 1), (3, 7), (8, 2)])
def test_rotation(sizes):
    a, b = bytes(range(sizes[0])), bytes(range(100, 100 + sizes[1]))
    buffer = bytearray(b"<" + a + b + b">")
    m.rotate(buffer, 1, 1 + len(a), 1 + len(a) + len(b))
    assert bytes(buffer) == b"<" + b + a + b">"


def test_middles_of_odd_tables(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("kept", "output").withColumnRenamed("source", "form")
    got = m.restore(m.fill_in_middle(docs)).collect()
    want = [(r.doc_id, *middle_by_hand(r.text or "", "" if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect()]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    rarely = m.fill_in_middle(docs, plan=m.Plan(cut=0))
    assert {r.form for r in rarely.collect()} == {"plain"}
    assert m.restore(m.fill_in_middle(docs.limit(0))).count() == 0
    extra = m.restore(m.fill_in_middle(docs).selectExpr("output", "1 AS restored", "form", "doc_id"))
    assert extra.columns == ["output", "form", "doc_id", "restored"] and extra.filter("output is null").count() == 0
