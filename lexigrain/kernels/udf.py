"""Python kernels as Columns. A kernel is a plain function of values, run once per distinct value of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kernel(function: Callable, returns: str, *columns: ColumnLike) -> Column:
    """``function`` of one or more columns; a null argument gives null."""

    def single(values: pd.Series) -> pd.Series:
        memo = {v: function(v) for v in values.dropna().unique()}
        return values.map(lambda v: memo.get(v) if v is not None and v == v else None).astype(object)

    def several(*values: pd.Series) -> pd.Series:
        memo: dict[tuple, object] = {}
        out = []
        for key in zip(*values):
            if any(v is None or v is pd.NA or (isinstance(v, float) and v != v) for v in key):
                out.append(None)
                continue
            try:
                if key not in memo:
                    memo[key] = function(*key)
                out.append(memo[key])
            except TypeError:
                out.append(function(*key))
        return pd.Series(out, dtype=object)

    if len(columns) == 1:

        @F.pandas_udf(returns)
        def run(a: pd.Series) -> pd.Series:
            return single(a)
    elif len(columns) == 2:

        @F.pandas_udf(returns)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return several(a, b)
    else:

        @F.pandas_udf(returns)
        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return several(a, b, c)

    return run(*map(col, columns))
