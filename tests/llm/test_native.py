"""Operators made of DataFrame functions alone: dialogues, shards, mix, exact copies."""

import hashlib
import re
from collections import Counter
from math import comb

import pytest
from checker import compare, make_duckdb
from pyspark.sql import functions as F
from reference import source_targets

from loomlog.llm import queries as q
from loomlog.llm.exact_dups import exact_groups
from loomlog.llm.mixing import mix, word_count
from loomlog.llm.perspectives import perspective_dialogues
from loomlog.llm.running import numbered, running_totals
from loomlog.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, make_duckdb(SF_DIR), name, q.QUERIES[name], q.ORACLES[name], SF_DIR) == []


@pytest.mark.parametrize("name", ["op1_perspective_rotation", "op2_hypergeometric_shards", "op4_source_mix", "op10_exact_copies"])
def test_no_python_in_plan(spark, name):
    plan = q.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


def test_running_totals(spark):
    rows = [(g, i % 3, i) for g in ("a", "b", None) for i in range(50)]
    df = numbered(spark.createDataFrame(rows, "g string, o int, v long"))
    got = running_totals(df, ["g"], [F.col("o")], "v", "before").collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.before)
        total = 0
        assert [r.o for r in mine if r.v] == sorted(r.o for r in mine if r.v)
        for r in mine:
            assert r.before == total
            total += r.v


def test_hypergeometric_is_exact(spark):
    draws = spark.range(40_000).select(hypergeometric(
        *(F.lit(x).cast("long") for x in (50, 20, 12)), (F.col("id") + 0.5) / 40_000).alias("k")).groupBy("k").count().collect()
    for r in draws:
        assert abs(r["count"] / 40_000 - comb(20, r.k) * comb(30, 12 - r.k) / comb(50, 12)) < 1e-4


def test_hypergeometric_edges(spark):
    cases = [(5, 5, 3, 3), (5, 0, 3, 0), (5, 3, 5, 3), (5, 3, 0, 0), (0, 0, 0, 0)]
    for population, marked, draws, want in cases:
        args = (F.lit(x).cast("long") for x in (population, marked, draws))
        assert spark.range(1).select(hypergeometric(*args, F.lit(0.7)).alias("k")).first().k == want


def test_matrix_has_both_sums(spark):
    counts, room = [7, 0, 30, 3], [14, 13, 13]
    arrays = [F.array(*[F.lit(x).cast("long") for x in a]) for a in (counts, room)]
    for seed in range(5):
        rows = spark.range(1).select(communication_matrix(*arrays, F.lit(seed)).alias("m")).first().m
        assert [sum(r) for r in rows] == counts and [sum(c) for c in zip(*rows)] == room


@pytest.mark.parametrize("rows", [0, 1, 5, 16, 103])
def test_shards(spark, rows):
    df = spark.range(0, rows, 1, 7).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = shuffle_into_shards(df, 16).toPandas()
    sizes = got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))
    counts = got["shard"].value_counts().reindex(range(16), fill_value=0)
    assert len(got) == rows and sizes.all() and counts.max() - counts.min() <= 1


def test_shards_are_uniform(spark):
    df = spark.range(0, 320, 1, 4)
    where = Counter()
    for seed in range(6):
        where.update((r.id // 80, r.shard) for r in shuffle_into_shards(df, 4, seed).collect())
    assert sum(where.values()) == 1920 and all(abs(n - 120) < 45 for n in where.values())


def test_mix(spark, odd_docs):
    sized = odd_docs.withColumn("size", word_count("text"))
    got = mix(sized).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    want = source_targets({s: sizes[s] for s in {r.source for r in got}})
    assert len(got) == 13 and sorted(map(tuple, mix(sized).collect()), key=str) == sorted(map(tuple, got), key=str)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[s] and r.taken <= 2 * r["size"] for r in mine)
        assert sum(r.taken for r in mine) == int(target + 1e-9)


def test_mix_of_many_sizes(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 3, None: 400, "e": 0, "é": 77}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got, want = {r.source: r for r in mix(df).collect()}, source_targets(sizes)
    assert all(abs(got[s].target - want[s]) < 1e-6 for s in sizes)


def test_exact_copies(spark, odd_docs):
    got = exact_groups(odd_docs).collect()
    by = {}
    for r in odd_docs.collect():
        clean = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        by.setdefault(hashlib.sha256(clean.encode()).hexdigest(), []).append(r.doc_id)
    assert len(got) == 13
    for sha, ids in by.items():
        mine = [r for r in got if r.text_sha256 == sha]
        least = min((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and sum(r.kept for r in mine) == 1
        assert all(r.keep_id == least and r.group_size == len(ids) and (not r.kept or r.doc_id == least) for r in mine)


def test_exact_copies_with_equal_hashes(spark, monkeypatch):
    real = F.md5
    monkeypatch.setattr(F, "md5", lambda c: F.substring(real(c), 1, 1))  # sixteen hashes for all texts
    df = spark.createDataFrame([(i, f"text {i % 40}") for i in range(120)], "doc_id long, text string")
    got = exact_groups(df).collect()
    assert all(r.keep_id == r.doc_id % 40 and r.group_size == 3 and r.kept == (r.doc_id < 40) for r in got) and len(got) == 120


def test_perspectives(spark):
    turns = [(1, 0, "system", "be brief", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", "yo", 9), (1, 3, "ann", "", 9),
             (None, 1, None, None, 9), (2, 0, "system", "alone", 9), (1, None, "bob", "first", 9)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, part int")
    got = {(r.conv_id, r.participant): r for r in perspective_dialogues(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = got[1, "ann"]
    assert ann.text == ("<|user:bob|>\nfirst\n<|system|>\nbe brief\n<|assistant|>\nhi\n<|user:bob|>\nyo\n<|assistant|>\n\n")
    assert [ann.text[s.start : s.start + s.length] for s in ann.spans] == ["hi"]
    assert [got[1, "bob"].text[s.start : s.start + s.length] for s in got[1, "bob"].spans] == ["first", "yo"]
    small = perspective_dialogues(df, limit=20).filter("participant = 'ann'").orderBy("part").collect()
    assert "".join(r.text for r in small) == ann.text and len(small) > 1


def test_empty_tables(spark, odd_docs):
    none = odd_docs.limit(0)
    assert exact_groups(none).count() == mix(none.withColumn("size", word_count("text"))).count() == 0
    assert perspective_dialogues(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
