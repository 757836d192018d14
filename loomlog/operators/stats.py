"""Group comparisons and correlations.

Every test reduces its sample in Spark to a few sums per group; the p-value is
then one number per result row. Statistics are NULL where a test is undefined
(for example when all values are equal).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.columns import fraction
from loomlog.functions.pvalues import chi2_p, correlation_p, rank_sum_p, normal_p
from loomlog.operators.ranks import named_rank_sums, pair_rank_sums, rank_histogram, rank_sums, value_histogram
from loomlog.sources.tables import cut_lineage

ALPHA = 0.05
SEGMENT = "user_segment"
_PAIR = ["group_a", "group_b"]


def _to_pairs(df: DataFrame, group: str, groups: Sequence[str]) -> DataFrame:
    """Repeat each row for every pair its group takes part in (k - 1 times).

    The pairs are literals, so this is a row-local expansion, not a join.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"))
            for a, b in combinations(groups, 2)
        ]
    )
    mine = F.filter(pairs, lambda p: (p["group_a"] == F.col(group)) | (p["group_b"] == F.col(group)))
    return df.select("*", F.inline(mine))


def _correct(df: DataFrame, pairs: int) -> DataFrame:
    """The level each p of a family of pairs is compared with."""
    return df.withColumn("alpha", F.lit(ALPHA / pairs))


# ------------------------------------------------------------ rank tests

def mann_whitney(
    df: DataFrame, first: str, second: str, value: str, group: str = SEGMENT, method: str = "asymptotic"
) -> DataFrame:
    """Two-sided Mann-Whitney U of two groups, with the rank-biserial correlation.

    ``u`` belongs to ``first``. ``method`` is "asymptotic", the normal approximation
    with tie and continuity correction, or "exact", the distribution of U itself,
    which has no p-value where values tie.
    """
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"method must be 'asymptotic' or 'exact', got {method!r}")
    sums = named_rank_sums(df, group, value, [first, second])

    def of(label, column):
        return F.max(F.when(F.col(group) == label, F.col(column)))

    row = sums.agg(
        F.coalesce(of(first, "n"), F.lit(0)).alias("n1"), F.coalesce(of(second, "n"), F.lit(0)).alias("n2"),
        of(first, "rank_sum").alias("r1"), F.sum("tie_sum").alias("tie_sum"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    variance = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_sum"), n * (n - 1)))
    with_u = row.withColumn("u", F.when(n2 > 0, F.col("r1") - n1 * (n1 + 1) / 2)).withColumn(
        "z",
        F.try_divide(
            F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5,
            F.sqrt(F.when(variance > 0, variance)),
        ),
    )
    if method == "exact":
        p_value = rank_sum_p("u", "n1", "n2", "tie_sum")
    else:  # a corrected score below zero means the two-sided p reaches 1
        p_value = F.when(F.col("z") <= 0, 1.0).otherwise(normal_p("z"))
    return with_u.select(
        "n1", "n2", "u", "z",
        p_value.alias("p_value"),
        (F.try_divide(2 * F.col("u"), n1 * n2) - 1).alias("rank_biserial"),
    )


def _kruskal(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n_total").cast("double")
    # squared distances from the mean rank: no difference of two huge numbers
    off = F.col("rank_sum") / F.col("n") - (F.col("total") + 1) / 2
    h = 12 / (n * (n + 1)) * F.col("squares")
    scale = 1 - F.try_divide(F.col("tie_sum"), n * n * n - n)
    return (
        sums.groupBy(*by)
        .agg(
            F.sum("n").alias("n_total"),
            F.count("*").alias("k"),
            F.sum(F.col("n") * off * off).alias("squares"),
            F.sum("tie_sum").alias("tie_sum"),
        )
        .withColumn("h", h / F.when((scale > 0) & (F.col("k") > 1), scale))
        .withColumn("dof", (F.col("k") - 1).cast("int"))
        .select(*by, "n_total", "h", "dof", chi2_p("h", "dof").alias("p_value"))
    )


def kruskal(
    df: DataFrame, value: str, groups: Sequence[str] | None = None, group: str = SEGMENT
) -> DataFrame:
    """Kruskal-Wallis H with tie correction."""
    if groups is None:
        return _kruskal(rank_sums(value_histogram(df, value, [group]), group, value), ())
    return _kruskal(named_rank_sums(df, group, value, groups), ())


def kruskal_pairs(
    df: DataFrame, value: str, groups: Sequence[str], group: str = SEGMENT
) -> DataFrame:
    """Kruskal-Wallis for each pair of groups, ranked within the pair."""
    result = _kruskal(pair_rank_sums(df, group, value, groups), _PAIR)
    return _correct(result, len(groups) * (len(groups) - 1) // 2)


def dunn(
    df: DataFrame, value: str, groups: Sequence[str], group: str = SEGMENT
) -> DataFrame:
    """Dunn's test with Bonferroni adjustment as a full matrix in long form."""
    sums = named_rank_sums(df, group, value, groups)
    every = Window.partitionBy()  # k rows, one per group
    k_pairs = len(groups) * (len(groups) - 1) // 2
    stats = sums.select(
        group, "n", (F.col("rank_sum") / F.col("n")).alias("mean_rank"),
        F.sum("n").over(every).cast("double").alias("total"), F.sum("tie_sum").over(every).alias("ties"),
    ).withColumn("peers", F.collect_list(F.struct(group, "n", "mean_rank")).over(every))
    # Every group meets every other: the peers travel as one array of k structs.
    peers = stats.withColumn("peer", F.explode("peers")).drop("peers")
    total = F.col("total")
    spread = total * (total + 1) / 12 - F.try_divide(F.col("ties"), 12 * (total - 1))
    error = F.sqrt(F.when(spread > 0, spread) * (1 / F.col("n") + 1 / F.col("peer.n")))
    same = F.col(group) == F.col(f"peer.{group}")
    return (
        peers.select(
            F.col(group).alias("group_a"),
            F.col(f"peer.{group}").alias("group_b"),
            same.alias("same"),
            (F.abs(F.col("mean_rank") - F.col("peer.mean_rank")) / error).alias("z"),
        )
        .withColumn("p_value", F.when(F.col("same"), 1.0).otherwise(F.least(normal_p("z") * k_pairs, F.lit(1.0))))
        .drop("same")
    )


# ------------------------------------------------------- counts and rates

def conversion_counts(funnel: DataFrame, step: int = 4) -> DataFrame:
    """Per segment: users who reached the step and users who did not."""
    reached = F.coalesce(F.max(F.when(F.col("funnel_step") == step, F.col("funnel_users"))), F.lit(0))
    return (
        funnel.groupBy(SEGMENT)
        .agg(reached.alias("yes"), F.max("tot_users").alias("tot_users"))
        .select(SEGMENT, "yes", (F.col("tot_users") - F.col("yes")).alias("no"))
    )


def _chi_square(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    every = Window.partitionBy(*by)  # k rows of counts
    yes, no = F.col("yes").cast("double"), F.col("no").cast("double")
    rows = counts.select(
        *by, yes.alias("yes"), no.alias("no"),
        F.sum(yes).over(every).alias("all_yes"), F.sum(no).over(every).alias("all_no"),
        F.count("*").over(every).alias("k"),
    )

    def cell(observed, column_total):
        expected = F.try_divide((F.col("yes") + F.col("no")) * column_total, F.col("all_yes") + F.col("all_no"))
        off = F.abs(observed - expected)
        off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return off * off / F.when(expected > 0, expected)

    parts = rows.withColumn("part", cell(F.col("yes"), F.col("all_yes")) + cell(F.col("no"), F.col("all_no")))
    return (
        parts.groupBy(*by)
        .agg(F.sum("part").alias("s"), F.count("part").alias("defined"), F.max("k").alias("k"))
        .select(
            *by,
            F.when(F.col("defined") == F.col("k"), F.col("s")).alias("chi2"),
            (F.col("k") - 1).cast("int").alias("dof"),
        )
        .withColumn("p_value", chi2_p("chi2", "dof"))
    )


def chi_square(counts: DataFrame) -> DataFrame:
    """Independence of group and outcome (k x 2); Yates correction for k = 2."""
    return _chi_square(counts, ())


def chi_square_pairs(counts: DataFrame, groups: Sequence[str], group: str = SEGMENT) -> DataFrame:
    result = _chi_square(_to_pairs(counts, group, groups), _PAIR)
    return _correct(result, len(groups) * (len(groups) - 1) // 2)


def _two_groups(counts: DataFrame, first: str, second: str, group: str) -> DataFrame:
    def of(label, column):
        return F.max(F.when(F.col(group) == label, F.col(column))).cast("double")

    total = F.col("yes") + F.col("no")
    return counts.withColumn("total", total).agg(
        of(first, "yes").alias("x1"), of(first, "total").alias("n1"),
        of(second, "yes").alias("x2"), of(second, "total").alias("n2"),
    )


def proportion_ztest(counts: DataFrame, first: str, second: str, group: str = SEGMENT) -> DataFrame:
    """Two-sided z test of two proportions with a pooled estimate."""
    x1, n1, x2, n2 = (F.col(c) for c in ("x1", "n1", "x2", "n2"))
    pooled = F.try_divide(x1 + x2, n1 + n2)
    variance = pooled * (1 - pooled) * F.try_divide(n1 + n2, n1 * n2)
    z = (F.try_divide(x1, n1) - F.try_divide(x2, n2)) / F.sqrt(F.when(variance > 0, variance))
    return _two_groups(counts, first, second, group).select(z.alias("z")).withColumn("p_value", normal_p("z"))


def risk_ratio(funnel: DataFrame, first: str, second: str, step: int = 4) -> DataFrame:
    """Step conversion of ``first`` over that of ``second``, as the funnel states them."""

    def rate(label):
        hit = (F.col(SEGMENT) == label) & (F.col("funnel_step") == step)
        return F.max(F.when(hit, F.col("conversion_rate")))

    return funnel.agg(rate(first).alias("a"), rate(second).alias("b")).select(
        fraction(F.col("a"), F.col("b")).alias("risk_ratio")
    )


# ------------------------------------------------------------ correlation

def _correlate(df: DataFrame, x: str, y: str, by: Sequence[str], name: str) -> DataFrame:
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sides = F.col("sx") * F.col("sy")
    # a constant side has no correlation (corr() itself would divide by 0), and
    # neither have fewer than 3 pairs
    r = F.when((F.col("n") > 2) & (sides > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / sides)))
    return (
        pairs.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.covar_pop(x, y).alias("cov"),
            F.stddev_pop(x).alias("sx"),
            F.stddev_pop(y).alias("sy"),
        )
        .select(*by, "n", r.alias(name))
        .withColumn("p_value", correlation_p(name, "n"))
    )


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return _correlate(df, x, y, by, "pearson_r")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of the average ranks, ranked within ``by``.

    Equal pairs are counted and written first: both rankings and the sums start
    from these counts, so ``df`` is read once. The mean rank is known, so the sums are
    those of squared distances, whatever the number of rows.
    """
    by = list(by)
    pairs = cut_lineage(
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("n"))
    )
    ranked = pairs
    for side in ("_x", "_y"):
        ranks = rank_histogram(pairs.groupBy(*by, side).agg(F.sum("n").alias("n")), side, by)
        ranked = ranked.join(ranks.select(*by, side, "total", F.col("rank_asc").alias(f"rank{side}")).withColumnRenamed(
            "total", f"total{side}"), [*by, side])
    dx, dy = (F.col(f"rank{side}") - (F.col(f"total{side}") + 1) / 2 for side in ("_x", "_y"))
    sides = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    r = F.when((F.col("n") > 2) & (sides > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("xy") / sides)))
    return (
        ranked.groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * dx * dy).alias("xy"),
            F.sum(F.col("n") * dx * dx).alias("xx"),
            F.sum(F.col("n") * dy * dy).alias("yy"),
        )
        .select(*by, "n", r.alias("spearman_r"))
        .withColumn("p_value", correlation_p("spearman_r", "n"))
    )
