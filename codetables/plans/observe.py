"""Job and usage statistics side by side, each with an optional grouping column."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codetables.operators import observe as ops


def observe(jobs: DataFrame, usage: DataFrame, prices: DataFrame, by: list[str] | None = None) -> dict[str, DataFrame]:
    priced = ops.cost(usage, prices)
    return {"jobs": ops.job_stats(jobs, by), "usage": ops.usage_summary(priced, by), "models": ops.usage_summary(priced, [*(by or []), "model"]), "unpriced": ops.unpriced(usage, prices)}
