"""Options of a split, their defaults and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

STRATEGIES = ("auto", "louvain", "leiden", "prefix", "map", "seeds")
POLICIES = ("duplicate", "separate", "exclude")
LAYOUTS = ("elk", "graphviz", "none")
EDGE_COLORS = ("target", "source", "pair", "none")
#: Name of the catch-all cluster; no seed may have it.
MISC = "misc"


class PartitionError(ValueError):
    """A split that can't be carried out; the message names every offender."""


@dataclass(frozen=True)
class SplitOptions:
    max_size: int = 25
    min_size: int = 3
    strategy: str = "auto"
    hub_threshold: int = 8
    hub_out_threshold: int = 20
    forced_hubs: tuple[str, ...] = ()
    hub_policy: str = "duplicate"
    policy_overrides: dict[str, str] = field(default_factory=dict)
    seeds: tuple[str, ...] = ()
    seed_threshold: int = 7
    layout: str = "elk"
    edge_color: str = "target"
    legend: bool = True
    headers: tuple[str, ...] = ()
    #: Nodes of a graph up to which one task refines all of its clusters; larger graphs are refined by rounds over all tasks.
    one_task_nodes: int = 100_000

    def validate(self) -> SplitOptions:
        """Checks in a fixed order; the first failure is raised."""
        if self.hub_policy not in POLICIES:
            raise PartitionError(f"Invalid hub policy: {self.hub_policy} (expected {', '.join(POLICIES)}).")
        for alias, policy in self.policy_overrides.items():
            if policy not in POLICIES:
                raise PartitionError(f"Invalid hub policy for {alias}: {policy} (expected {', '.join(POLICIES)}).")
        for what, value, known in (("strategy", self.strategy, STRATEGIES), ("layout", self.layout, LAYOUTS), ("edge color", self.edge_color, EDGE_COLORS)):
            if value not in known:
                raise PartitionError(f"Invalid {what}: {value} (expected {', '.join(known)}).")
        for what, size in (("max-size", self.max_size), ("min-size", self.min_size)):
            if not isinstance(size, int) or size < 1:
                raise PartitionError(f"{what} must be a whole number of 1 or more.")
        if self.min_size > self.max_size:
            raise PartitionError("min-size must not exceed max-size.")
        return self
