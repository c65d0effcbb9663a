"""Table contracts: declared columns, keys and checks, applied to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Contract:
    """A table's columns in order (DDL types), its keys, the columns it is laid out by, and its checks."""

    name: str
    columns: dict[str, str]
    keys: tuple[str, ...] = ()
    cluster: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if missing := [c for c in (*self.keys, *self.cluster) if c not in self.columns]:
            raise ValueError(f"{self.name}: {missing} are not among its columns")

    @property
    def schema(self) -> StructType:
        schema = StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in self.columns.items()))
        for f in schema.fields:
            f.nullable = f.name not in self.keys
        return schema


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """Exactly the contract's columns, in order and type."""
    if missing := [c for c in contract.columns if c not in df.columns]:
        raise ValueError(f"{contract.name}: columns are missing: {', '.join(missing)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in contract.columns.items()))


def key_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(keys..., rows, problem): keys with a NULL part, and keys that stand more than once."""
    has_null = F.greatest(*(F.col(k).isNull().cast("int") for k in contract.keys), F.lit(0)) == 1
    counted = df.groupBy(*contract.keys).agg(F.count("*").alias("rows"))
    problem = F.when(has_null, "null key").when(F.col("rows") > 1, "duplicate key")
    return counted.withColumn("problem", problem).where("problem is not null")


def check_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """(check, rows): rows that break each check. A condition that is NULL passes."""
    failed = [F.sum((~F.coalesce(F.expr(c), F.lit(True))).cast("long")).alias(n) for n, c in contract.checks.items()]
    if not failed:
        return df.sparkSession.createDataFrame([], "check string, rows long")
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("rows")) for n in contract.checks))
    return df.agg(*failed).select(F.explode(pairs).alias("p")).select("p.*").where("rows > 0")


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` conformed; raises at once if rows break a check or a key part is NULL, after one pass that counts both."""
    out = conform(df, contract)
    problems = {n: ~F.coalesce(F.expr(c), F.lit(True)) for n, c in contract.checks.items()} | {f"{k} is null": F.col(k).isNull() for k in contract.keys}
    if not problems:
        return out
    counts = out.agg(*(F.count(F.when(p, 1)).alias(n) for n, p in problems.items())).first().asDict()
    if broken := {n: c for n, c in counts.items() if c}:
        raise ValueError(f"{contract.name}: {broken}")
    return out


def guarded(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` conformed; whatever reads or writes its first column fails at the first row that breaks a check or lacks a key part.

    The check is part of the plan, so it costs no pass of its own, and nothing that breaks it is ever handed on.
    """
    out = conform(df, contract)
    named = [F.when(F.col(k).isNull(), f"{k} is null") for k in contract.keys] + [F.when(~F.coalesce(F.expr(c), F.lit(True)), n) for n, c in contract.checks.items()]
    if not named:
        return out
    first, kind = next(iter(contract.columns.items()))
    problem = F.coalesce(*named)
    return out.withColumn(first, F.when(problem.isNull(), F.col(first)).otherwise(F.raise_error(F.concat(F.lit(f"{contract.name}: "), problem)).cast(kind)))
