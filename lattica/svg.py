"""SVG rendering by an external program, in batches."""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from dataclasses import dataclass

from lattica.options import PartitionError

#: Fixed value: files of one call.
BATCH = 50


@dataclass(frozen=True)
class Ran:
    code: int
    out: str
    err: str


def run(command: list[str]) -> Ran:
    """Runs a program to its end; 127 if there is none."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, errors="replace", check=False)
    except FileNotFoundError:
        return Ran(127, "", f"{command[0]}: not found")
    return Ran(done.returncode, done.stdout, done.stderr)


def render(paths: list[str], binary: str = "plantuml", batch: int = BATCH, runner: Callable[[list[str]], Ran] = run) -> list[str]:
    """The paths of the SVG files; the first failure ends it."""
    if batch < 1:
        raise PartitionError("The batch size must be 1 or more.")
    if not paths:
        return []
    probe = runner([binary, "-version"])
    if probe.code:
        raise PartitionError(f"{binary} is not available: {probe.err.strip() or probe.out.strip()}")
    for i in range(0, len(paths), batch):
        done = runner([binary, "-tsvg", *paths[i : i + batch]])
        if done.code:
            raise PartitionError(f"Rendering failed with {i} of {len(paths)} files done: {done.err.strip()}")
    return [p.rsplit(".", 1)[0] + ".svg" for p in paths]
