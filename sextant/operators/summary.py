"""Statistics across runs and of answer quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def rounded(value: Column, digits: int) -> Column:
    """Half up on eleven decimals, so that the order of additions doesn't decide ties; plain rounding where those don't fit."""
    return F.coalesce(F.round(value.try_cast("decimal(38,11)"), digits).cast("double"), F.round(value, digits))


def metric_summary(df: DataFrame, keys: list[str], value: str = "value", digits: int | None = 2, raw: bool = False) -> DataFrame:
    """keys, n, mean, stdev, cv_pct, min, max, p10, p25, p50, p75, p90 of non-null, non-NaN values.

    Sample deviation and exact, linearly interpolated percentiles. One value: no deviation (raw: 0). cv_pct is null
    where the mean or itself is 0 (raw: only for mean 0). Keys without any value keep a row with n 0. raw doesn't round.
    """
    v = F.when(~F.isnan(value), F.col(value))
    stats = [F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("stdev"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.percentile("_v", F.array(*[F.lit(q) for q in QUANTILES])).alias("_q")]
    g = df.withColumn("_v", v.cast("double"))
    out = g.groupBy(*keys).agg(*stats) if keys else g.agg(*stats)
    sd = F.when((F.col("n") == 1), F.lit(0.0)).otherwise(F.col("stdev")) if raw else F.col("stdev")
    cv = F.when(F.col("mean") != 0, 100 * sd / F.abs("mean"))
    cv = cv if raw else F.when(cv != 0, cv)
    r = (lambda c: rounded(c, digits) + 0.0) if digits is not None and not raw else (lambda c: c)
    return out.select(*keys, "n", r(F.col("mean")).alias("mean"), r(sd).alias("stdev"), r(cv).alias("cv_pct"), r(F.col("min")).alias("min"), r(F.col("max")).alias("max"), *[r(F.element_at("_q", i + 1)).alias(f"p{int(q * 100)}") for i, q in enumerate(QUANTILES)])


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, sum_value, max_value, mean_value weighted by `weight`, which counts as 1 where it is null or not positive."""
    w = F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(1.0)
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull()).groupBy(*keys).agg(F.sum(v).alias("sum_value"), F.max(v).alias("max_value"), (F.sum(v * w) / F.sum(w)).alias("mean_value"))


def with_total(df: DataFrame, keys: list[str], entity: str, value: str) -> DataFrame:
    """keys, entity, value summed; plus the entity TOTAL of each key."""
    part = df.groupBy(*keys, entity).agg(F.sum(value).alias("sum_value"))
    return part.unionByName(part.groupBy(*keys).agg(F.sum("sum_value").alias("sum_value")).withColumn(entity, F.lit("TOTAL")))


def run_series(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, series: values in run order, with nulls where a run has none."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("series"))


def py_round(values, digits: int = 2):
    """Column of values rounded as Python does (half to even on the binary value); the other functions round half up."""

    @F.pandas_udf("double")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else round(x, digits))

    return rounded(values)


def judge_gate(records: DataFrame, contexts: str = "contexts") -> DataFrame:
    """records with flags which of the three scores a judge can give: two of them need contexts."""
    some = F.size(F.coalesce(contexts, F.array().cast("array<string>"))) > 0
    return records.withColumns({"score_faithfulness": some.cast("int"), "score_relevancy": F.lit(1), "score_utilization": some.cast("int")})
