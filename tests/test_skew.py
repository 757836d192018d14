"""Hot keys: the few joins that move raw rows are split by adaptive execution."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from loomlog.operators import funnel as fn
from loomlog.operators import preparation as prep
from loomlog.operators import ranks as rk
from loomlog.operators import segments as sg

# Thresholds scaled down with the data; the defaults start at 256 MB.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_log(spark, rows=60_000):
    """A third of all rows belong to one device, half of the others have no login."""
    device = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (F.col("id") % 997).cast("string")))
    member = (F.col("id") % 3 == 0) | ((F.col("id") % 997) % 2 == 0)
    return spark.range(0, rows, 1, 8).select(
        device.alias("user_pseudo_id"),
        F.when(member, F.col("id")).alias("user_id"),
        F.date_add(F.lit("2022-08-01").cast("date"), (F.col("id") % 60).cast("int")).alias("event_date"),
        F.lit("click_payment").alias("event_name"),
        F.lit("cart").alias("firebase_screen"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"),
    )


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_member_filter_splits_a_hot_device(spark):
    log = hot_log(spark)
    expected = log.where("user_pseudo_id = 'hot'").count()
    with settings(spark, SMALL):
        target = prep.analysis_target(log)
        kept = target.collect()
        assert "skew=true" in final_plan(target)
    assert sum(r.user_pseudo_id == "hot" for r in kept) == expected == 20_000
    assert {int(r.user_pseudo_id[1:]) % 2 for r in kept if r.user_pseudo_id != "hot"} == {0}


def test_rank_join_splits_a_hot_value(spark):
    rows = hot_log(spark).select("filler", F.when(F.col("user_pseudo_id") == "hot", 0).otherwise(
        F.abs(F.hash("filler")) % 5000 + 1).alias("v"))
    with settings(spark, SMALL):
        ranked = rk.avg_ranks(rows, "v", desc=False)
        got = ranked.collect()
        assert "skew=true" in final_plan(ranked)
    assert len(got) == 60_000 and sum(r.avg_rank for r in got) == 60_000 * 60_001 / 2
    assert {r.avg_rank for r in got if r.v == 0} == {10_000.5}


def test_a_hot_user_is_one_row_before_the_segment_join(spark):
    log = hot_log(spark)
    with settings(spark, SMALL):
        out = fn.open_funnel(log, sg.revisit_split(log))
        rows = out.collect()
        plan = final_plan(out)
    # neither side of the join is skewed, because both have one row per user
    assert "skew=true" not in plan
    users = log.select("user_pseudo_id").distinct().count()
    assert sum(r.tot_users for r in rows) == users and all(r.funnel_step == 4 for r in rows)
