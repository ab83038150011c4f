"""Regression metrics, leaderboards and argmin with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    """MAE, RMSE and R2 (1 - SSE / SST; null below two rows, and for a constant target 1 if exact, else 0)."""
    e = F.col(y) - F.col(p)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    r2 = F.when(F.count(y) < 2, None).when(sst > 0, 1 - F.try_divide(sse, sst)).when(sse == 0, 1.0).otherwise(0.0)
    return [F.count("*").alias("n_rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2")]


def require_finite(df: DataFrame, y: str = "y", p: str = "p") -> None:
    bad = df.where(F.col(y).isNull() | F.col(p).isNull() | F.isnan(y) | F.isnan(p) | (F.abs(F.col(y)) == float("inf")) | (F.abs(F.col(p)) == float("inf")))
    if not bad.isEmpty():
        raise ValueError("targets and predictions must be finite")


def metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(*metric_columns(y, p))


def grouped_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Metrics of each group and, with the group columns null, of all rows: one shuffle."""
    total = F.grouping_id().alias("_g")
    out = df.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(total, *metric_columns(y, p))
    return out.withColumn("is_total", (F.col("_g") > 0).cast("int")).drop("_g")


def require_entities(by_entity: DataFrame, entity: str, expected: list[str]) -> None:
    got = {r[0] for r in by_entity.where("is_total = 0").select(entity).collect()}
    if got != set(expected):
        raise ValueError(f"metrics must cover {sorted(expected)}")


def leaderboard(scores: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """candidate, mae and rank by (mae, candidate). Scores are one row a candidate."""
    if candidates is not None:
        got = sorted(r[0] for r in scores.select("candidate").collect())
        if got != sorted(candidates):
            raise ValueError(f"the leaderboard needs exactly {sorted(candidates)}")
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mae", "candidate"))
    return scores.withColumn("rank", rank.cast("long"))


def champion(scores: DataFrame) -> str:
    return scores.agg(F.min(F.struct("mae", "candidate")).alias("m")).first()["m"]["candidate"]


def timings(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Batches, summed and longest time of each stage; ``df`` has one row a batch."""
    return df.groupBy(stage).agg(F.count("*").alias("n_batches"), F.sum(seconds).alias("seconds"), F.max(seconds).alias("longest"))
