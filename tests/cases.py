"""Pinned cases: values in, results of an operator out, next to the expected values as SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.plans.cases import literal

_DUCK = {"string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "array<string>": "VARCHAR[]"}


class Case:
    """``operator`` gets one Column per input; ``rows`` hold the inputs and then the expected result."""

    def __init__(self, operator: Callable[..., Column], rows: Sequence[tuple], returns: str = "string", inputs: str = "string") -> None:
        self.operator, self.rows, self.returns = operator, [r if isinstance(r, tuple) else (r,) for r in rows], returns
        n = len(self.rows[0]) - 1
        self.names = [f"arg{k}" for k in range(n)]
        self.inputs = [inputs] * n if isinstance(inputs, str) and "," not in inputs else inputs.split(",")

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = "case_id int, " + ", ".join(f"{n} {t}" for n, t in zip(self.names, self.inputs))
        return spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(self.rows)], schema)

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = self.operator(*[F.col(n) for n in self.names]).cast(self.returns)
        done = self.frame(spark).withColumn("result", result)
        return done.select("case_id", *[F.col(n).cast("string").alias(n) if not t.startswith("array") else F.array_join(n, "|", "").alias(n) for n, t in zip(self.names, self.inputs)], F.col("result"))

    def sql(self) -> str:
        show = lambda v: "|".join("" if x is None else x for x in v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else v if v is None else str(v)
        rows = ", ".join(f"({i}, {', '.join(literal(show(v)) for v in r[:-1])}, {literal(r[-1])})" for i, r in enumerate(self.rows))
        columns = ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in self.names)
        return f"SELECT CAST(case_id AS INTEGER) AS case_id, {columns}, CAST(result AS {_DUCK[self.returns]}) AS result FROM (VALUES {rows}) t(case_id, {', '.join(self.names)}, result)"
