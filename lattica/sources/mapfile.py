"""Map files: clusters by hand, as JSON."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.options import PartitionError

FALLBACKS = ("auto", "misc", "error")


@dataclass(frozen=True)
class MapFile:
    clusters: dict[str, list[str]]
    fallback: str = "auto"

    def owners(self) -> dict[str, str]:
        return {a: name for name, members in self.clusters.items() for a in members}


def load(path: str) -> MapFile:
    try:
        content = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise PartitionError(f"Cannot read map file: {path}") from e
    return parse(content, path)


def parse(content: str, path: str = "map") -> MapFile:
    """Checks in a fixed order; the first failure is raised, repeats and conflicts with all offenders."""
    try:
        data = json.loads(content)
    except ValueError as e:
        raise PartitionError(f"Invalid JSON in map file {path}: {e}") from e
    clusters = data.get("clusters") if isinstance(data, dict) else None
    if not isinstance(data, dict):
        raise PartitionError(f'Map file {path} must be a JSON object with a "clusters" key.')
    if not isinstance(clusters, dict):
        raise PartitionError(f'Map file {path} must have a "clusters" object mapping cluster names to alias lists.')
    fallback = data.get("fallback", "auto")
    if fallback not in FALLBACKS:
        raise PartitionError(f'Map file {path} has an invalid "fallback" value: {fallback!r} (expected {", ".join(FALLBACKS)}).')
    for name, members in clusters.items():
        if not name:
            raise PartitionError(f"Map file {path} has an empty cluster name.")
        if not re.search("[a-z0-9]", name.lower()):
            raise PartitionError(f'Map file {path}: cluster name "{name}" normalizes to an empty slug.')
        if not isinstance(members, list):
            raise PartitionError(f'Map file {path}: cluster "{name}" must be a list of alias strings.')
        if any(not isinstance(a, str) or not a for a in members):
            raise PartitionError(f'Map file {path}: cluster "{name}" contains a non-string or empty alias.')
    repeated = sorted({a for members in clusters.values() for a, n in Counter(members).items() if n > 1}, key=str.encode)
    if repeated:
        raise PartitionError(f"Map file {path} repeats the same alias within one cluster: {', '.join(repeated)}.")
    shared = sorted((a for a, n in Counter(a for members in clusters.values() for a in set(members)).items() if n > 1), key=str.encode)
    if shared:
        raise PartitionError(f"Map file {path} assigns the same alias to more than one cluster: {', '.join(shared)}.")
    return MapFile({k: list(v) for k, v in clusters.items()}, fallback)


def repeats(assigned: DataFrame) -> DataFrame:
    """(alias, n) of a table (cluster_name, alias) that one cluster lists more than once."""
    return assigned.groupBy("cluster_name", "alias").agg(F.count("*").alias("n")).where("n > 1")


def conflicts(assigned: DataFrame) -> DataFrame:
    """(alias, n_clusters) of aliases that several clusters list."""
    return assigned.groupBy("alias").agg(F.count_distinct("cluster_name").alias("n_clusters")).where("n_clusters > 1")


def assigned(spark: SparkSession, mapping: MapFile) -> DataFrame:
    return spark.createDataFrame([(c, a) for c, members in mapping.clusters.items() for a in members], "cluster_name string, alias string")


def emit(membership: DataFrame, graph_id: str | None = None) -> str:
    """The map that reproduces a partition: clusters in order, members sorted, names made unique by _2, _3…; no hubs."""
    rows = membership if graph_id is None else membership.where(F.col("graph_id") == graph_id)
    table = rows.groupBy("cluster_id", "cluster_name").agg(F.array_sort(F.collect_list("alias")).alias("members")).orderBy("cluster_name", F.element_at("members", 1)).collect()
    names = unique_names([r["cluster_name"] for r in table])
    clusters = dict(sorted(zip(names, [list(r["members"]) for r in table], strict=True), key=lambda c: c[0].encode()))
    return json.dumps({"clusters": clusters, "fallback": "auto"}, indent=4, ensure_ascii=False) + "\n"


def unique_names(names: list[str], used: set[str] | None = None) -> list[str]:
    """Each name, or with the first of _2, _3… that is free."""
    used = set() if used is None else used
    out = []
    for name in names:
        got, k = name, 2
        while got in used:
            got, k = f"{name}_{k}", k + 1
        used.add(got)
        out.append(got)
    return out
