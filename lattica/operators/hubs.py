"""Hub detection, reasons and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.options import SplitOptions


def detect(degrees: DataFrame, options: SplitOptions, excluded: DataFrame | None = None) -> DataFrame:
    """(graph_id, alias, in_degree, out_degree, reason, forced, policy) of hubs.

    A hub has enough relations in or out, or is forced; excluded aliases
    (graph_id, alias) are never hubs.  The policy is an override, else
    `separate` for unforced hubs by out-degree alone, else the global one.
    """
    rows = degrees if excluded is None else degrees.join(excluded.select("graph_id", "alias").distinct(), ["graph_id", "alias"], "left_anti")
    forced = F.col("alias").isin(*options.forced_hubs) if options.forced_hubs else F.lit(False)
    many_in, many_out = F.col("in_degree") >= options.hub_threshold, F.col("out_degree") >= options.hub_out_threshold
    reason = F.when(forced, "forced").when(many_in & many_out, "in+out").when(many_in, "in").when(many_out, "out")
    override = F.lit(None).cast("string")
    for alias, policy in options.policy_overrides.items():
        override = F.when(F.col("alias") == alias, F.lit(policy)).otherwise(override)
    hubs = rows.where(many_in | many_out | forced).select("graph_id", "alias", "in_degree", "out_degree", reason.alias("reason"), forced.alias("forced"))
    return hubs.withColumn("policy", F.coalesce(override, F.when(F.col("reason") == "out", "separate"), F.lit(options.hub_policy)))


def pure_out(hubs: DataFrame) -> DataFrame:
    return hubs.where((F.col("reason") == "out") & ~F.col("forced"))
