"""Ranks from the value index, in one and in many pieces, against plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomlog.operators import ranks as rk
from loomlog.operators import retention as rt
from loomlog.operators import segments as sg
from loomlog.operators import stats as st
from loomlog.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def places(values):
    """Average rank of every value, counted from the smallest."""
    return {v: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in set(values)}


@pytest.fixture(params=[7, 1_000_000], ids=["many pieces", "one piece"])
def pieces(request, monkeypatch):
    monkeypatch.setattr(rk, "PIECE_ROWS", request.param)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [(rng.choice("abc"), rng.choice([0.0, rng.randrange(-30, 30) / 4]), float(rng.randrange(12)), rng.choice("xy")) for _ in range(400)]
    return made + [("a", None, 1.0, "x"), (None, 3.0, None, "y")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "user_segment string, v double, w double, part string").repartition(5)


def test_ranks_of_rows(frame, rows, pieces):
    want = places([v for _, v, _, _ in rows if v is not None])
    n = sum(v is not None for _, v, _, _ in rows)
    for desc in (True, False):
        got = rk.avg_ranks(frame, "v", desc).collect()
        assert len(got) == len(rows)
        assert all(r.avg_rank == (None if r.v is None else n + 1 - want[r.v] if desc else want[r.v]) for r in got)


def test_ranks_within_keys(frame, rows, pieces):
    want = {p: places([v for _, v, _, q in rows if v is not None and q == p]) for p in "xy"}
    got = rk.avg_ranks(frame, "v", False, by=["part"]).where("v is not null").collect()
    assert all(r.avg_rank == want[r.part][r.v] for r in got)


def test_sums_of_groups_and_pairs(frame, rows, pieces):
    def plain(groups):
        sample = [(g, v) for g, v, _, _ in rows if g in groups and v is not None]
        rank = places([v for _, v in sample])
        size = lambda v: sum(x == v for _, x in sample)
        return {g: (sum(h == g for h, _ in sample), len(sample), sum(rank[v] for h, v in sample if h == g),
                    float(sum(size(v) ** 2 - 1 for h, v in sample if h == g))) for g in groups}

    groups = ["a", "b", "c"]
    got = {r.user_segment: (r.n, r.total, r.rank_sum, r.tie_sum) for r in rk.named_rank_sums(frame, "user_segment", "v", groups).collect()}
    assert got == plain(groups)
    pairs = rk.pair_rank_sums(frame, "user_segment", "v", groups).collect()
    assert len(pairs) == 6
    for a, b in combinations(groups, 2):
        mine = {r.user_segment: (r.n, r.total, r.rank_sum, r.tie_sum) for r in pairs if (r.group_a, r.group_b) == (a, b)}
        assert mine == plain([a, b])
    absent = rk.named_rank_sums(frame, "user_segment", "v", ["a", "nobody"]).collect()
    assert [r.user_segment for r in absent] == ["a"]


def test_spearman_by_hand(frame, rows, pieces):
    for r in st.spearman(frame, "v", "w", ["part"]).collect():
        both = [(v, w) for _, v, w, p in rows if p == r.part and v is not None and w is not None]
        rx, ry = places([v for v, _ in both]), places([w for _, w in both])
        m = (len(both) + 1) / 2
        dx, dy = [rx[v] - m for v, _ in both], [ry[w] - m for _, w in both]
        cov = sum(a * b for a, b in zip(dx, dy))
        assert r.n == len(both)
        assert r.spearman_r == pytest.approx(cov / (sum(a * a for a in dx) * sum(b * b for b in dy)) ** 0.5)


def test_spearman_undefined(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert [tuple(r) for r in st.spearman(flat, "x", "y").collect()] == [(3, None, None)]


def test_empty_samples(frame, pieces):
    none = frame.where("1 = 0")
    assert rk.avg_ranks(none, "v").count() == 0
    assert rk.pair_rank_sums(none, "user_segment", "v", ["a", "b"]).count() == 0
    r = st.mann_whitney(none, "a", "b", "v").first()
    assert (r.n1, r.n2, r.u, r.p_value) == (0, 0, None, None)


def jobs(spark, work):
    """How many jobs the work starts."""
    context = spark.sparkContext
    context.setJobGroup("counted", "")
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup("counted"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_the_sample_is_read_once(spark, tmp_path):
    path = str(tmp_path / "sample")
    spark.range(300).select((F.col("id") % 3).cast("string").alias("user_segment"), (F.col("id") % 70).alias("v")).write.parquet(path)
    read = spark.read.parquet(path)
    for out in (st.kruskal_pairs(read, "v", ["0", "1", "2"]), st.dunn(read, "v", ["0", "1", "2"]), st.mann_whitney(read, "0", "1", "v")):
        assert str(tmp_path) not in out._jdf.queryExecution().executedPlan().toString()  # it starts from the stored index


def test_matrix_plans_without_a_job(spark):
    cohorts = catalog.QUERIES["cohort_retention"](spark, SF_DIR)  # builds what is stored
    assert jobs(spark, lambda: rt.cohort_cells(cohorts, "retain_users")) == 0
    assert jobs(spark, lambda: catalog.QUERIES["cohort_matrix_rate"](spark, SF_DIR)) == 0
    assert jobs(spark, lambda: rt.cohort_matrix(cohorts, "retain_users", weeks=[0, 1])) == 0
    wide, long = rt.cohort_matrix(cohorts, "retain_users"), rt.cell_rows(rt.cohort_cells(cohorts, "retain_users"))
    assert sorted(map(str, rt.matrix_cells(wide).collect())) == sorted(map(str, long.collect()))


def test_share_tree_of_any_depth(spark):
    labels = ["x1"] * 3 + ["x2"] + ["y"] * 2 + ["alone"] * 4 + ["top"]
    seg = spark.createDataFrame([(str(i), s) for i, s in enumerate(labels)], "user_pseudo_id string, user_segment string")
    tree = {"x1": "x", "x2": "x", "x": "top", "y": "top", "never": "top"}
    got = {r.label: (r.parent, r.users, r.percent_of_parent) for r in sg.segment_shares(seg, tree).collect()}
    assert got == {"x1": ("x", 3, 75.0), "x2": ("x", 1, 25.0), "x": ("top", 4, 66.667), "y": ("top", 2, 33.333),
                   "top": ("", 7, 63.636), "alone": ("", 4, 36.364)}  # one user sits on top itself
    with pytest.raises(ValueError):
        sg.segment_shares(seg, {"x1": "x", "x": "x1"})
    assert sg.segment_shares(seg.limit(0), tree).count() == 0
