"""The command line: split a diagram, or anonymise one."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica import svg
from lattica.operators import render
from lattica.operators.anonymize import anonymize
from lattica.options import EDGE_COLORS, LAYOUTS, STRATEGIES, PartitionError, SplitOptions
from lattica.plans.partition import Partition, partition, partition_by_map, partition_by_seeds
from lattica.plans.report import plan_report
from lattica.sources import diagrams, mapfile


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica")
    sub = top.add_subparsers(dest="command", required=True)
    s = sub.add_parser("split", help="split one class diagram into clusters")
    s.add_argument("input", nargs="?")
    s.add_argument("--stdin", action="store_true")
    s.add_argument("--output", default="./diagram-split")
    s.add_argument("--max-size", type=int, default=25)
    s.add_argument("--min-size", type=int, default=3)
    s.add_argument("--strategy", default="auto", help=", ".join(STRATEGIES))
    s.add_argument("--map")
    s.add_argument("--emit-map")
    s.add_argument("--seed", action="append", default=[])
    s.add_argument("--seed-threshold", type=int, default=7)
    s.add_argument("--hub-threshold", type=int, default=8)
    s.add_argument("--hub-out-threshold", type=int, default=20)
    s.add_argument("--hub", action="append", default=[])
    s.add_argument("--hub-policy", default="duplicate")
    s.add_argument("--hub-policy-override", action="append", default=[], metavar="ALIAS=POLICY")
    s.add_argument("--render", action="store_true")
    s.add_argument("--plantuml-bin", default="plantuml")
    s.add_argument("--header", action="append", default=[])
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--layout", default="elk", help=", ".join(LAYOUTS))
    s.add_argument("--edge-color", default="target", help=", ".join(EDGE_COLORS))
    s.add_argument("--no-legend", action="store_true")
    a = sub.add_parser("anonymize", help="replace names by pseudonyms of the same structure")
    a.add_argument("input")
    a.add_argument("output", nargs="?")
    a.add_argument("--scrub-members", action="store_true")
    return top


def _options(args: argparse.Namespace) -> SplitOptions:
    overrides = {}
    for entry in args.hub_policy_override:
        alias, eq, policy = entry.partition("=")
        if not eq or not alias:
            raise PartitionError(f"Invalid hub policy override: {entry} (expected ALIAS=POLICY).")
        overrides[alias] = policy
    return SplitOptions(
        max_size=args.max_size, min_size=args.min_size, strategy=args.strategy, hub_threshold=args.hub_threshold, hub_out_threshold=args.hub_out_threshold, forced_hubs=tuple(args.hub), hub_policy=args.hub_policy, policy_overrides=overrides,
        seeds=tuple(args.seed), seed_threshold=args.seed_threshold, layout=args.layout, edge_color=args.edge_color, legend=not args.no_legend, headers=tuple(args.header),
    ).validate()


def _content(path: str | None, stdin: bool) -> str:
    if stdin:
        return sys.stdin.read()
    if not path:
        raise PartitionError("No input: name a file or use --stdin.")
    try:
        return Path(path).read_text(encoding="utf-8", errors="replace")
    except OSError as e:
        raise PartitionError(f"Cannot read input file: {path}") from e


def _split(spark: SparkSession, args: argparse.Namespace) -> None:
    content = _content(args.input, args.stdin)
    parsed = diagrams.parse(diagrams.from_text(spark, content)).cache()
    classes, relations = diagrams.classes(parsed), diagrams.relations(parsed)
    for r in diagrams.warnings(parsed).orderBy("seq").collect():
        print(f"warning: {r['text']}", file=sys.stderr)
    options = _options(args)
    p: Partition
    if options.strategy == "map":
        if not args.map:
            raise PartitionError("--strategy=map needs --map.")
        p = partition_by_map(classes, relations, mapfile.load(args.map), options)
    elif options.strategy == "seeds":
        p = partition_by_seeds(classes, relations, options)
    else:
        p = partition(classes, relations, options)
    for w in p.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if args.emit_map:
        Path(args.emit_map).parent.mkdir(parents=True, exist_ok=True)
        Path(args.emit_map).write_text(mapfile.emit(p.membership), encoding="utf-8")
    print(plan_report(p, options), end="")
    if args.dry_run:
        return
    target = Path(args.output)
    target.mkdir(parents=True, exist_ok=True)
    written = []
    for r in render.output_files(p, options, parsed.select("graph_id", "headers")).orderBy("file_name").toLocalIterator():
        (target / r["file_name"]).write_text(r["content"], encoding="utf-8")
        written.append(str(target / r["file_name"]))
    if args.render:
        svg.render(written, args.plantuml_bin)
    page = render.index_page(p.classes, p.membership, p.hubs, args.render).select(F.col("content")).first()
    (target / "index.html").write_text(page["content"], encoding="utf-8")
    print(f"{len(written) + 1} files written to {target}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.master("local[*]").appName("lattica").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if args.command == "split":
            _split(spark, args)
        else:
            made = anonymize(diagrams.from_text(spark, _content(args.input, False)), args.scrub_members).first()["content"]
            if args.output:
                Path(args.output).write_text(made, encoding="utf-8")
            else:
                print(made, end="")
    except PartitionError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
