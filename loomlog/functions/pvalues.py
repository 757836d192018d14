"""Arrow-batched wrappers that put a p-value on the result rows of a test."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions import tails
from loomlog.functions.tails import chi2_sf, normal_two_sided, rank_sum_exact, t_two_sided

# a worker gets the functions with the job and needs no copy of the package
cloudpickle.register_pickle_by_value(tails)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _present(*values) -> bool:
    return all(pd.notna(v) for v in values)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p."""
    return z.map(lambda v: normal_two_sided(v) if _present(v) else None)


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [chi2_sf(x, int(k)) if _present(x, k) else None for x, k in zip(stat, dof)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation over n pairs (t with n-2 dof)."""

    def one(rho, pairs):
        if not _present(rho, pairs) or pairs < 3:
            return None
        if abs(rho) >= 1.0:
            return 0.0
        t = rho * ((pairs - 2) / (1.0 - rho * rho)) ** 0.5
        return t_two_sided(t, pairs - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Exact two-sided p of a rank sum; NULL where values tie."""

    def one(stat, a, b, tied):
        if not _present(stat, tied) or tied > 0 or min(a, b) < 1:
            return None
        return rank_sum_exact(stat, int(a), int(b))

    return pd.Series([one(*row) for row in zip(u, n1, n2, ties)], dtype="float64")
