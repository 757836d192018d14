"""Test and correlation queries on the orders log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlog.operators import ranks as rk
from loomlog.operators import retention as rt
from loomlog.operators import stats as st
from loomlog.plans import retention as ret
from loomlog.plans.funnel import COUNTS, FUNNELS
from loomlog.plans.oracle import chi2_p, normal_p, t_p, with_ctes
from loomlog.plans.retention import GROUPS, RATE, USERS, _round, aligned_sql, centers_sql
from loomlog.sources.adapters import orders_table
from loomlog.sources.adapters import orders_visit_segments as visit_seg

_INFLOW = ("holiday", "normal_day")


def _centers(make, value, how="median"):
    return lambda s, d: rt.cohort_center(make(s, d), value, how)


def _stacked(value, how):
    return lambda s, d: rt.stack_groups(ret.aligned(value, how)(s, d), GROUPS, "v")


def _order_values(s, d):
    """Price of every order with its customer's visit segment."""
    orders = orders_table(s, d).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_pseudo_id"), "o_orderkey", "o_totalprice"
    )
    return orders.join(visit_seg(s, d), "user_pseudo_id")


def nation_totals(s, d):
    """Order value per customer nation, with its region; distinct values, few rows, made from all orders."""
    tables = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    totals = (
        tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    )
    named = totals.join(F.broadcast(tables["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(tables["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # the world's nations
    return named.select(F.col("r_name").alias("user_segment"), F.col("v").cast("double").alias("v"))


_MW = ("z", "p_value", "rank_biserial")


def _mw(make, first, second, value, method="asymptotic"):
    return lambda s, d: _round(st.mann_whitney(make(s, d), first, second, value, method=method), *_MW)


def exact_prices(s, d):
    """Exact test of order values, urgent against high priority, thousands in each group.

    Values held by several orders are left out, because ties have no exact p.
    """
    orders = orders_table(s, d).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    single = orders.groupBy(F.col("o_totalprice").alias("v")).agg(
        F.count("*").alias("n"), F.min("o_orderpriority").alias("user_segment"))
    return _round(st.mann_whitney(single.where("n = 1"), "1-URGENT", "2-HIGH", "v", method="exact"), *_MW)


def _chi(name):
    return lambda s, d: _round(st.chi_square(st.conversion_counts(FUNNELS[name](s, d))), "chi2", "p_value")


def _zt(name, first, second):
    return lambda s, d: _round(
        st.proportion_ztest(st.conversion_counts(FUNNELS[name](s, d)), first, second), "z", "p_value"
    )


def _rr(name, first, second):
    return lambda s, d: _round(st.risk_ratio(FUNNELS[name](s, d), first, second), "risk_ratio")


def _kw(make, value):
    return lambda s, d: _round(st.kruskal(make(s, d), value), "h", "p_value")


def _kwp(make, value):
    return lambda s, d: _round(
        st.kruskal_pairs(make(s, d), value, GROUPS), "h", "p_value", "alpha"
    )


def _dunn(make, value):
    return lambda s, d: _round(st.dunn(make(s, d), value, GROUPS), "z", "p_value")


def _retention_rates(s, d):
    return ret.QUERIES["weekly_retention_visit"](s, d)


def _mean_ranks(make, value):
    return lambda s, d: _round(rk.mean_ranks(make(s, d), "user_segment", value), "mean_rank")


_COHORT_SAMPLES = {
    "rate_median": (RATE, "median"),
    "rate_mean": (RATE, "mean"),
    "users_median": (USERS, "median"),
    "users_mean": (USERS, "mean"),
}

QUERIES = {
    "avg_ranks_order_counts": lambda s, d: rk.avg_ranks(
        COUNTS["order_counts_interval"](s, d), "order_cnt"
    ),
    "order_value_avg_ranks": lambda s, d: rk.avg_ranks(
        _order_values(s, d).select("o_orderkey", "o_totalprice"), "o_totalprice"
    ),
    "mean_ranks_order_counts": _mean_ranks(COUNTS["order_counts_interval"], "order_cnt"),
    "mean_ranks_cohort_rate": _mean_ranks(_stacked(RATE, "median"), "v"),
    "mean_ranks_cohort_users": _mean_ranks(_stacked(USERS, "median"), "v"),
    "order_value_mean_ranks": _mean_ranks(_order_values, "o_totalprice"),
    "order_value_kruskal": lambda s, d: _round(st.kruskal(_order_values(s, d), "o_totalprice", GROUPS), "h", "p_value"),
    "mann_whitney_order_counts": _mw(COUNTS["order_counts_split"], "one_day", "revisit", "order_cnt"),
    "mann_whitney_revisit_inflow": _mw(COUNTS["order_counts_revisit_inflow"], *_INFLOW, "order_cnt"),
    "mann_whitney_inflow": _mw(COUNTS["order_counts_inflow"], *_INFLOW, "order_cnt"),
    "mann_whitney_cohort_rate": _mw(_centers(ret.cohorts_inflow, RATE), *_INFLOW, RATE),
    "mann_whitney_cohort_users": _mw(_centers(ret.cohorts_inflow, USERS), *_INFLOW, USERS),
    "mann_whitney_retention_revisit_inflow": _mw(
        ret.QUERIES["weekly_retention_revisit_inflow"], *_INFLOW, "retention_rate"
    ),
    "mann_whitney_retention_inflow": _mw(ret.QUERIES["weekly_retention_inflow"], *_INFLOW, "retention_rate"),
    "mann_whitney_exact_nations": _mw(nation_totals, "ASIA", "EUROPE", "v", "exact"),
    "mann_whitney_exact_prices": exact_prices,
    "chi_square_revisit_split": _chi("open_funnel_revisit_split"),
    "chi_square_interval": _chi("open_funnel_interval"),
    "chi_square_revisit_inflow": _chi("open_funnel_revisit_inflow"),
    "chi_square_inflow": _chi("open_funnel_inflow"),
    "chi_square_interval_pairs": lambda s, d: _round(
        st.chi_square_pairs(st.conversion_counts(FUNNELS["open_funnel_interval"](s, d)), GROUPS),
        "chi2", "p_value", "alpha",
    ),
    "ztest_revisit_split": _zt("open_funnel_revisit_split", "one_day", "revisit"),
    "ztest_revisit_inflow": _zt("open_funnel_revisit_inflow", *_INFLOW),
    "ztest_inflow": _zt("open_funnel_inflow", *_INFLOW),
    "risk_ratio_revisit_split": _rr("open_funnel_revisit_split", "revisit", "one_day"),
    "risk_ratio_revisit_inflow": _rr("open_funnel_revisit_inflow", *_INFLOW),
    "risk_ratio_inflow": _rr("open_funnel_inflow", *_INFLOW),
    "kruskal_order_counts": _kw(COUNTS["order_counts_interval"], "order_cnt"),
    "kruskal_retention_rate": _kw(_retention_rates, "retention_rate"),
    "kruskal_pairs_order_counts": _kwp(COUNTS["order_counts_interval"], "order_cnt"),
    **{f"kruskal_cohort_{n}": _kw(_stacked(*a), "v") for n, a in _COHORT_SAMPLES.items()},
    **{f"kruskal_pairs_cohort_{n}": _kwp(_stacked(*a), "v") for n, a in _COHORT_SAMPLES.items()},
    **{f"dunn_cohort_{n}": _dunn(_stacked(*a), "v") for n, a in _COHORT_SAMPLES.items()},
    "dunn_order_counts": _dunn(COUNTS["order_counts_interval"], "order_cnt"),
}

_RATES = {"all": (ret.rates_all, ()), "visit": (ret.rates_visit, ("user_segment",)),
          "inflow": (ret.rates_inflow, ("user_segment",))}


def _corr(fn, make, by, name, **kw):
    return lambda s, d: _round(fn(make(s, d), "retention_rate", "order_ratio", by, **kw), name, "p_value")


for _n, (_make, _by) in _RATES.items():
    QUERIES[f"pearson_{_n}"] = _corr(st.pearson, _make, _by, "pearson_r")
    QUERIES[f"spearman_{_n}"] = _corr(st.spearman, _make, _by, "spearman_r")


# --------------------------------------------------------------------- SQL

_AVG_RANK = "rank() OVER ({w} ORDER BY {v}{d}) + (count(*) OVER (PARTITION BY {p}{v}) - 1) / 2.0::DOUBLE"


def _rank(v, desc=False, by=""):
    return _AVG_RANK.format(
        v=v, d=" DESC" if desc else "", w=f"PARTITION BY {by}" if by else "", p=f"{by}, " if by else ""
    )


def _sample(source, value, extra=None):
    """needs, extra blocks and the sample CTE (g, v)."""
    return dict(extra or {}) | {"smp": f"SELECT user_segment AS g, CAST({value} AS DOUBLE) AS v FROM {source}"}


def _mw_sql(needs, blocks, first, second):
    """U by counting pairs."""
    return with_ctes(
        f"""SELECT n1, n2, u, round(z, 6) AS z,
                   round(CASE WHEN z <= 0 THEN 1.0::DOUBLE WHEN z > 0 THEN {normal_p('z')} END, 6) AS p_value,
                   round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial
            FROM (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5::DOUBLE)
                            / nullif(sqrt(n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))), 0) AS z
                  FROM base)""",
        *needs, **blocks,
        a=f"SELECT v FROM smp WHERE g = '{first}'",
        b=f"SELECT v FROM smp WHERE g = '{second}'",
        base="""SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2,
                       (SELECT sum(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v = b.v THEN 0.5::DOUBLE
                                        ELSE 0.0::DOUBLE END) FROM a CROSS JOIN b) AS u,
                       (SELECT sum(power(c, 3) - c) FROM (SELECT CAST(count(*) AS DOUBLE) AS c
                                                          FROM smp GROUP BY v)) AS t""",
    )


def _h_sql(by=""):
    """Select list of H from rows (by, g, v, r) named rk."""
    keys = f"{by}, " if by else ""
    join = f"JOIN t USING ({by})" if by else "CROSS JOIN t"
    group = f"GROUP BY {by}" if by else ""
    return {
        "t": f"""SELECT {keys} sum(power(c, 3) - c) AS t FROM
                 (SELECT {keys} v, CAST(count(*) AS DOUBLE) AS c FROM rk GROUP BY ALL) {group}""",
        "gs": f"SELECT {keys} g, sum(r) AS s, CAST(count(*) AS DOUBLE) AS n FROM rk GROUP BY ALL",
        "hh": f"""SELECT {keys} CAST(nn AS BIGINT) AS n_total, CAST(k - 1 AS INTEGER) AS dof,
                         (12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - t / (nn * nn * nn - nn)) AS h
                  FROM (SELECT {keys} sum(n) AS nn, count(*) AS k, sum(s * s / n) AS q FROM gs {group}) {join}""",
    }


def _kw_sql(needs, blocks):
    return with_ctes(
        f"SELECT n_total, round(h, 6) AS h, dof, round({chi2_p('h', 'dof')}, 6) AS p_value FROM hh",
        *needs, **blocks, rk=f"SELECT g, v, {_rank('v')} AS r FROM smp", **_h_sql(),
    )


_PAIRS = "SELECT * FROM (VALUES ('short', 'mid'), ('short', 'long'), ('mid', 'long')) AS t(group_a, group_b)"
_ALPHA = "round(0.05::DOUBLE / 3, 6) AS alpha"


def _kwp_sql(needs, blocks):
    return with_ctes(
        f"""SELECT group_a, group_b, n_total, round(h, 6) AS h, dof,
                   round({chi2_p('h', 'dof')}, 6) AS p_value, {_ALPHA} FROM hh""",
        *needs, **blocks, pr=_PAIRS,
        rk=f"""SELECT group_a, group_b, g, v, {_rank('v', by='group_a, group_b')} AS r
               FROM smp JOIN pr ON g = group_a OR g = group_b""",
        **_h_sql("group_a, group_b"),
    )


def _dunn_sql(needs, blocks):
    return with_ctes(
        f"""SELECT group_a, group_b, round(z, 6) AS z,
                   round(CASE WHEN group_a = group_b THEN 1.0::DOUBLE
                              ELSE least(1.0::DOUBLE, 3 * {normal_p('z')}) END, 6) AS p_value
            FROM (SELECT x.g AS group_a, y.g AS group_b,
                         abs(x.m - y.m) / sqrt((nn * (nn + 1) / 12 - t / (12 * (nn - 1))) * (1 / x.n + 1 / y.n)) AS z
                  FROM gm x CROSS JOIN gm y CROSS JOIN tot)""",
        *needs, **blocks,
        rk=f"SELECT g, v, {_rank('v')} AS r FROM smp",
        gm="SELECT g, avg(r) AS m, CAST(count(*) AS DOUBLE) AS n FROM rk GROUP BY 1",
        tot="""SELECT (SELECT CAST(count(*) AS DOUBLE) FROM rk) AS nn,
                      (SELECT sum(power(c, 3) - c) FROM (SELECT CAST(count(*) AS DOUBLE) AS c
                                                         FROM rk GROUP BY v)) AS t""",
    )


def _yes_no(funnel):
    return f"""SELECT user_segment AS g, CAST(max(CASE WHEN funnel_step = 4 THEN funnel_users ELSE 0 END) AS DOUBLE) AS yes,
                      CAST(max(tot_users) AS DOUBLE) AS tot FROM {funnel} GROUP BY 1"""


_CELL = """(abs(o - e) - CASE WHEN k = 2 THEN least(0.5::DOUBLE, abs(o - e)) ELSE 0 END)"""


def _chi_sql(funnel, pairs=False):
    keys = "group_a, group_b, " if pairs else ""
    over = "(PARTITION BY group_a, group_b)" if pairs else "()"
    source = "obs JOIN pr ON g = group_a OR g = group_b" if pairs else "obs"
    blocks = {"obs": _yes_no(funnel)} | ({"pr": _PAIRS} if pairs else {})
    blocks["cells"] = f"""
        SELECT {keys} yes AS o, tot * sum(yes) OVER {over} / sum(tot) OVER {over} AS e, count(*) OVER {over} AS k
        FROM {source}
        UNION ALL
        SELECT {keys} tot - yes, tot * sum(tot - yes) OVER {over} / sum(tot) OVER {over}, count(*) OVER {over}
        FROM {source}"""
    blocks["x"] = f"""SELECT {keys} sum({_CELL} * {_CELL} / e) AS c, CAST(max(k) - 1 AS INTEGER) AS dof
                      FROM cells {'GROUP BY group_a, group_b' if pairs else ''}"""
    return with_ctes(
        f"""SELECT {keys} round(c, 6) AS chi2, dof, round({chi2_p('c', 'dof')}, 6) AS p_value
                   {', ' + _ALPHA if pairs else ''} FROM x""",
        funnel, **blocks,
    )


def _z_sql(funnel, first, second):
    return with_ctes(
        f"""SELECT round(z, 6) AS z, round({normal_p('z')}, 6) AS p_value
            FROM (SELECT (ay / atot - byes / btot) / sqrt((ay + byes) / (atot + btot) * (1 - (ay + byes) / (atot + btot))
                                                    * (1 / atot + 1 / btot)) AS z FROM two)""",
        funnel, obs=_yes_no(funnel),
        two=f"""SELECT max(yes) FILTER (WHERE g = '{first}') AS ay, max(tot) FILTER (WHERE g = '{first}') AS atot,
                       max(yes) FILTER (WHERE g = '{second}') AS byes, max(tot) FILTER (WHERE g = '{second}') AS btot
                FROM obs""",
    )


def _rr_sql(funnel, first, second):
    rate = "(SELECT conversion_rate FROM {} WHERE funnel_step = 4 AND user_segment = '{}')"
    return with_ctes(
        f"SELECT round({rate.format(funnel, first)} / {rate.format(funnel, second)}, 6) AS risk_ratio", funnel
    )


def _corr_sql(name, spearman):
    spec = ret.RATES_SQL[name]
    by = "" if name == "all" else "user_segment"
    keys = f"{by}, " if by else ""
    out = "spearman_r" if spearman else "pearson_r"
    x, y = "retention_rate", "order_ratio"
    source = f"""SELECT {keys} {_rank(x, by=by)} AS x, {_rank(y, by=by)} AS y FROM j""" if spearman else (
        f"SELECT {keys} {x} AS x, {y} AS y FROM j"
    )
    return with_ctes(
        f"""SELECT {keys} n, round(r, 6) AS {out}, round({t_p('r', 'n')}, 6) AS p_value
            FROM (SELECT {keys} count(*) AS n, corr(x, y) AS r FROM xy {'GROUP BY ' + by if by else ''})""",
        *spec["needs"], j=spec["text"], xy=source,
    )


def _aligned_sample(value, how):
    fn = {"median": "median", "mean": "avg"}[how]
    return aligned_sql(value, fn) | {
        "smp": "SELECT 'short' AS g, short AS v FROM al UNION ALL SELECT 'mid', mid FROM al "
               "UNION ALL SELECT 'long', long FROM al"
    }


def _mean_ranks_sql(needs, blocks):
    return with_ctes(
        f"""SELECT g AS user_segment, count(*) AS n, round(avg(r), 6) AS mean_rank
            FROM (SELECT g, {_rank('v', desc=True)} AS r FROM smp) GROUP BY 1""",
        *needs, **blocks,
    )


_VALUES = "SELECT o_orderkey, o_totalprice, user_segment FROM orders JOIN seg ON user_pseudo_id = 'c' || o_custkey"
_ORDER_VALUE = {"ov": _VALUES, "smp": "SELECT user_segment AS g, o_totalprice AS v FROM ov"}

ORACLES = {
    "avg_ranks_order_counts": with_ctes(
        f"SELECT user_segment, user_pseudo_id, order_cnt, {_rank('order_cnt', True)} AS avg_rank FROM cnt_interval",
        "cnt_interval",
    ),
    "order_value_avg_ranks": with_ctes(
        f"SELECT o_orderkey, o_totalprice, {_rank('o_totalprice', True)} AS avg_rank FROM ov", "seg", ov=_VALUES
    ),
    "mean_ranks_order_counts": _mean_ranks_sql(["cnt_interval"], _sample("cnt_interval", "order_cnt")),
    "mean_ranks_cohort_rate": _mean_ranks_sql(["coh_visit"], _aligned_sample(RATE, "median")),
    "mean_ranks_cohort_users": _mean_ranks_sql(["coh_visit"], _aligned_sample(USERS, "median")),
    "order_value_mean_ranks": _mean_ranks_sql(["seg"], _ORDER_VALUE),
    "order_value_kruskal": _kw_sql(["seg"], _ORDER_VALUE | {
        "smp": "SELECT user_segment AS g, o_totalprice AS v FROM ov WHERE user_segment <> 'one_day'"}),
    "mann_whitney_order_counts": _mw_sql(["cnt_split"], _sample("cnt_split", "order_cnt"), "one_day", "revisit"),
    "mann_whitney_revisit_inflow": _mw_sql(
        ["cnt_inflow_revisit"], _sample("cnt_inflow_revisit", "order_cnt"), *_INFLOW
    ),
    "mann_whitney_inflow": _mw_sql(["cnt_inflow"], _sample("cnt_inflow", "order_cnt"), *_INFLOW),
    "mann_whitney_cohort_rate": _mw_sql(
        ["coh_inflow"], _sample("c", "v", {"c": centers_sql("coh_inflow", RATE, "median")}), *_INFLOW
    ),
    "mann_whitney_cohort_users": _mw_sql(
        ["coh_inflow"], _sample("c", "v", {"c": centers_sql("coh_inflow", USERS, "median")}), *_INFLOW
    ),
    "mann_whitney_retention_revisit_inflow": _mw_sql(
        ["ret_inflow_revisit"], _sample("ret_inflow_revisit", "retention_rate"), *_INFLOW
    ),
    "mann_whitney_retention_inflow": _mw_sql(["ret_inflow"], _sample("ret_inflow", "retention_rate"), *_INFLOW),
    # the real transform of U about its mean, summed over the frequencies at which it has not died away
    "mann_whitney_exact_prices": with_ctes(
        """SELECT n1, n2, u, round((greatest(u, size - u) - size / 2 - 0.5::DOUBLE) / sd, 6) AS z,
                  round(least(1.0::DOUBLE, 2.0::DOUBLE / (size + 1) * (least + 1 + 2 * (SELECT sum(term) FROM terms))), 6) AS p_value,
                  round(2 * u / size - 1, 6) AS rank_biserial
           FROM base""",
        smp="""SELECT o_totalprice AS v, any_value(o_orderpriority) AS g FROM orders
               WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY v HAVING count(*) = 1""",
        base="""SELECT *, CAST(n1 * n2 AS DOUBLE) AS size, sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1)) AS sd,
                       floor(least(u, n1 * n2 - u)) AS least
                FROM (SELECT count(*) FILTER (g = '1-URGENT') AS n1, count(*) FILTER (g = '2-HIGH') AS n2,
                             CAST(sum(CASE WHEN g = '1-URGENT' THEN r END) AS DOUBLE)
                             - count(*) FILTER (g = '1-URGENT') * (count(*) FILTER (g = '1-URGENT') + 1) / 2 AS u
                      FROM (SELECT g, row_number() OVER (ORDER BY v) AS r FROM smp))""",
        waves="""SELECT n1, n2, size, least, unnest(range(1, 1 + CAST(least(size / 2, 40 + 2 * size / sd) AS BIGINT))) * 2 * pi() / (size + 1) AS t
                 FROM base""",
        factors="""SELECT t, size, least, sum(ln(abs(sin((n2 + i) * t / 2) * i / ((n2 + i) * sin(i * t / 2))))) AS lg,
                          sum(CASE WHEN sin((n2 + i) * t / 2) * sin(i * t / 2) < 0 THEN 1 ELSE 0 END) % 2 AS odd
                   FROM (SELECT *, unnest(range(1, n1 + 1)) AS i FROM waves) GROUP BY t, size, least""",
        terms="""SELECT CASE WHEN odd = 1 THEN -1 ELSE 1 END * exp(lg) * sin((least + 1) * t / 2) / sin(t / 2)
                        * cos(t * (least - size) / 2) AS term
                 FROM factors""",
    ),
    "mann_whitney_exact_nations": with_ctes(
        """SELECT n1, n2, u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5::DOUBLE)
                                   / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1)), 6) AS z,
                  round(least(1.0::DOUBLE, 2.0::DOUBLE * (SELECT count(*) FROM draws WHERE du <= least(u, n1 * n2 - u))
                                           / (SELECT count(*) FROM draws)), 6) AS p_value,
                  round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial
           FROM base""",
        tot="""SELECT r_name AS g, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_nationkey""",
        base="""SELECT (SELECT count(*) FROM tot WHERE g = 'ASIA') AS n1, (SELECT count(*) FROM tot WHERE g = 'EUROPE') AS n2,
                       (SELECT CAST(count(*) AS DOUBLE) FROM tot a JOIN tot b ON a.v > b.v
                        WHERE a.g = 'ASIA' AND b.g = 'EUROPE') AS u""",
        # every choice of n1 of the n1 + n2 places as a bit mask, and its U
        draws="""SELECT list_sum(list_transform(range(1, n1 + n2 + 1), lambda i: CASE WHEN (m >> CAST(i - 1 AS INTEGER)) & 1 = 1 THEN i ELSE 0 END))
                        - n1 * (n1 + 1) // 2 AS du
                 FROM (SELECT n1, n2, unnest(range(CAST(power(2, n1 + n2) AS BIGINT))) AS m FROM base)
                 WHERE bit_count(m) = n1""",
    ),
    "chi_square_revisit_split": _chi_sql("fun_split"),
    "chi_square_interval": _chi_sql("fun_interval"),
    "chi_square_revisit_inflow": _chi_sql("fun_inflow_revisit"),
    "chi_square_inflow": _chi_sql("fun_inflow"),
    "chi_square_interval_pairs": _chi_sql("fun_interval", pairs=True),
    "ztest_revisit_split": _z_sql("fun_split", "one_day", "revisit"),
    "ztest_revisit_inflow": _z_sql("fun_inflow_revisit", *_INFLOW),
    "ztest_inflow": _z_sql("fun_inflow", *_INFLOW),
    "risk_ratio_revisit_split": _rr_sql("fun_split", "revisit", "one_day"),
    "risk_ratio_revisit_inflow": _rr_sql("fun_inflow_revisit", *_INFLOW),
    "risk_ratio_inflow": _rr_sql("fun_inflow", *_INFLOW),
    "kruskal_order_counts": _kw_sql(["cnt_interval"], _sample("cnt_interval", "order_cnt")),
    "kruskal_retention_rate": _kw_sql(["ret_visit"], _sample("ret_visit", "retention_rate")),
    "kruskal_pairs_order_counts": _kwp_sql(["cnt_interval"], _sample("cnt_interval", "order_cnt")),
    **{f"kruskal_cohort_{n}": _kw_sql(["coh_visit"], _aligned_sample(*a)) for n, a in _COHORT_SAMPLES.items()},
    **{f"kruskal_pairs_cohort_{n}": _kwp_sql(["coh_visit"], _aligned_sample(*a)) for n, a in _COHORT_SAMPLES.items()},
    **{f"dunn_cohort_{n}": _dunn_sql(["coh_visit"], _aligned_sample(*a)) for n, a in _COHORT_SAMPLES.items()},
    "dunn_order_counts": _dunn_sql(["cnt_interval"], _sample("cnt_interval", "order_cnt")),
    **{f"pearson_{n}": _corr_sql(n, False) for n in _RATES},
    **{f"spearman_{n}": _corr_sql(n, True) for n in _RATES},
}
