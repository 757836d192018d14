"""Near copies in large buckets: every link of a template family is found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference import near_components

from loomlog.llm import near_dups as nd


def family(rng, common, pairs, shared, own, tag):
    """Texts of distinct words around common ones; two and two share ``shared`` more and have ``own`` for themselves."""
    words = [f"{tag}t{i}" for i in range(common)]
    out = []
    for p in range(pairs):
        both = [f"{tag}p{p}w{i}" for i in range(shared)]
        for side in "ab":
            text = words + both + [f"{tag}p{p}{side}{i}" for i in range(own)]
            rng.shuffle(text)
            out.append(" ".join(text))
    return out


def check(spark, texts, size=1):
    docs = list(enumerate(texts))
    want = near_components(docs, size)
    got = nd.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    return len({c for _, c in want.values()})


@pytest.mark.parametrize("shared", [5, 7])
def test_close_pairs_of_a_template_family(spark, shared):
    """300 texts at 0.790 across and 0.809 or 0.815 inside pairs, all in the same buckets."""
    texts = family(random.Random(1), 376, 150, shared, 50 - shared, "x")
    assert check(spark, texts) == 150


def test_family_around_a_centre_with_other_families_beside(spark, monkeypatch):
    """Copies that lose and gain words, some linked with the centre, some only with each other."""
    monkeypatch.setattr(nd, "DIRECT", 4)
    rng = random.Random(2)
    texts = []
    for tag in ("u", "v"):
        base = [f"{tag}{i}" for i in range(180)]
        for n in range(90):
            kept = [w for w in base if rng.random() > rng.choice([0.0, 0.03, 0.06, 0.1])]
            texts.append(" ".join(kept + [f"{tag}n{n}w{i}" for i in range(rng.choice([0, 4, 10, 16]))]))
        texts.append(" ".join(base))
        parts = [" ".join(base[:150] + [f"{tag}second{i}" for i in range(30)] + [f"{tag}s{n}w{i}" for i in range(rng.randrange(14))]) for n in range(60)]
        texts += parts
    rng.shuffle(texts)
    check(spark, texts)


@pytest.mark.parametrize("seed", [3, 4])
def test_chains_and_gaps_of_shingles(spark, monkeypatch, seed):
    """Texts that drift away from their start a word at a time, in shingles of three words."""
    monkeypatch.setattr(nd, "DIRECT", 3)
    rng = random.Random(seed)
    texts, words = [], [f"w{i}" for i in range(120)]
    for n in range(150):
        for _ in range(rng.choice([1, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"c{seed}n{n}x{rng.randrange(99)}"
        texts.append(" ".join(words if rng.random() < 0.8 else words[: rng.randrange(90, 120)]))
    check(spark, texts, 3)


def test_differences_keep_every_linked_pair(spark):
    """The prefix bound itself: each linked pair without the centre's help meets in a bucket."""
    rng = random.Random(5)
    base = list(range(100))
    sets = {0: base}
    for n in range(1, 120):
        gone = set(rng.sample(base, rng.randrange(0, 25)))
        sets[n] = [w for w in base if w not in gone] + rng.sample(range(1000, 1040), rng.randrange(0, 25))
    table = spark.createDataFrame([(n, s) for n, s in sets.items()], "node long, shingles array<long>")
    links = nd._Links(table, 80)
    links.compare(spark.createDataFrame([(0, n) for n in sets if n], "a long, b long"))
    groups = spark.createDataFrame([(0, n, 1, len(s)) for n, s in sets.items() if n], "c long, node long, degree long, n long")
    held = nd._difference_buckets(groups, links).select("key", "node")
    other = held.select("key", F.col("node").alias("b"))
    met = {tuple(r) for r in held.join(other, "key").filter("node < b").select("node", "b").distinct().collect()}
    near = {r.node for r in links.roots.collect()}
    alike = lambda x, y: 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    wanted = {(a, b) for a in sets for b in sets if 0 < a < b and alike(sets[a], sets[b]) and not {a, b} <= near}
    assert wanted and wanted <= met


def test_filter_grows_with_its_content(spark):
    wanted = spark.range(50_000).select((F.col("id") * 3).alias("c1"))
    passed = nd.sieve(spark.range(300_000).select(F.col("id").alias("c1")), wanted, "c1")
    assert passed.filter("c1 % 3 = 0 and c1 < 150000").count() == 50_000
    assert passed.count() < 75_000


def test_signs_never_rule_out_a_link():
    """The bits in which two signs differ are no more than the shingles, folded or not, and tell far sets apart."""
    rng = np.random.default_rng(6)
    for size, lost in [(40, 3), (250, 20), (300, 0), (500, 30), (530, 40), (9000, 800)]:
        one = np.unique(rng.integers(0, 2**63, size, np.uint64))
        two = np.union1d(one[lost:], rng.integers(0, 2**63, lost // 2, np.uint64))
        words, flat = nd.parity_signs(np.array([len(one), len(two)]), np.concatenate([one, two]))
        signs = np.split(flat, words[:1])
        assert [len(x) for x in signs] == words.tolist()
        n = np.array([len(one), len(two)])
        apart = len(np.setxor1d(one, two))
        found = nd._possible_pairs(np.arange(2), np.arange(2), n, signs, 80).shape[1]
        assert found == 1 or 9 * apart > n.sum()
    far = rng.integers(0, 2**63, (2, 300), np.uint64)
    words, flat = nd.parity_signs(np.array([300, 300]), np.sort(far).ravel())
    assert nd._possible_pairs(np.arange(2), np.arange(2), np.array([300, 300]), np.split(flat, words[:1]), 80).shape[1] == 0


def test_pairs_far_apart_in_one_bucket_are_not_joined_with_their_sets(spark, monkeypatch):
    """60 texts that share half of their words meet in many buckets; no pair of them is compared on its sets."""
    rng, compared = random.Random(7), []
    old = nd._similar
    monkeypatch.setattr(nd, "_similar", lambda sets, pairs, percent: (compared.append(pairs.count()), old(sets, pairs, percent))[1])
    words = [f"common{i}" for i in range(200)]
    assert check(spark, [" ".join(words + [f"own{n}w{i}" for i in range(100)]) for n in range(60)]) == 60
    assert sum(compared) == 0


def test_crowded_buckets_go_by_differences(spark, monkeypatch):
    """With more possible pairs than are listed, every link is still found."""
    monkeypatch.setattr(nd, "CROWDED", 2)
    assert check(spark, family(random.Random(1), 376, 40, 7, 43, "x")) == 40
