"""Command line: check, diff, lineage, and add-ons on the PATH."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__, text
from .operators import graph
from .operators import report as rep
from .operators.diffing import diff
from .operators.project import build
from .operators.rules import evaluate
from .sources import baseline as base
from .sources import config as conf
from .sources import manifest as man
from .sources import sinks, warehouse
from .storage import hold, release

COMMANDS = ("check", "diff", "lineage")
FAILURES = (man.ManifestError, conf.ConfigError, base.ToolError, base.GitError, base.StaleManifest, graph.LineageError, OSError)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veinmap")
    p.add_argument("--version", action="version", version=f"veinmap {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("check", "diff"):
        c = sub.add_parser(name)
        c.add_argument("--state", type=Path)
        c.add_argument("--project-dir", type=Path, default=Path("."))
        c.add_argument("--against")
        c.add_argument("--format", choices=("text", "json"), default="text")
        c.add_argument("--no-color", action="store_true")
        either = c.add_mutually_exclusive_group()
        either.add_argument("--dbt-arg", action="append", default=[])
        either.add_argument("--dbt-args")
        c.add_argument("--dbt-command")
        c.add_argument("--check-relations", action="store_true")
        c.add_argument("--defer-target")
        c.add_argument("--defer-state")
        c.add_argument("--log-level", choices=conf.LOG_LEVELS)
        c.add_argument("--purge-logs", type=int)
        c.add_argument("--allow-stale-manifest", action="store_true")
    c = sub.add_parser("lineage")
    c.add_argument("target", nargs="?")
    c.add_argument("--project-dir", type=Path, default=Path("."))
    either = c.add_mutually_exclusive_group()
    either.add_argument("--html", type=Path)
    either.add_argument("--text", action="store_true")
    c.add_argument("--compile", action="store_true")
    c.add_argument("--package")
    c.add_argument("--log-level", choices=conf.LOG_LEVELS)
    c.add_argument("--purge-logs", type=int)
    return p


def _say(out: str, project_dir: Path) -> None:
    print(out, end="" if out.endswith("\n") else "\n")
    sinks.best_effort("the log", lambda: sinks.append_log(project_dir, out))


def _logger(project_dir: Path):
    return lambda said: sinks.best_effort("the log", lambda: sinks.append_log(project_dir, said))


def _current(project_dir: Path) -> Path:
    return project_dir / "target" / "manifest.json"


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    """check and diff: 1 if check finds something breaking, else 0."""
    d = args.project_dir
    if not args.allow_stale_manifest:
        base.check_fresh(d, _current(d))
    config = conf.load(d)
    base.resolve_tool(d, config.tool)
    extra = args.dbt_arg or (conf.split_words(args.dbt_args, "--dbt-args") if args.dbt_args else conf.split_words(config.dbt_args, "dbt-args") if config.dbt_args else [])
    against, command = args.against or config.against or "master", args.dbt_command or config.dbt_command or "dbt"
    state = args.state
    if state is None:
        state = base.baseline_manifest(d, against, command, extra, _logger(d))
    older = build(spark, man.read_manifest(spark, str(state))).cached()
    manifest = man.read_manifest(spark, str(_current(d)))
    current = build(spark, manifest).cached()
    changes = hold(diff(older, current))
    findings = hold(evaluate(older.edges, changes, config.severities()))
    for r in rep.lost_schemas(older.nodes, current.nodes).orderBy("node_id").toLocalIterator():
        print(f"warning: the columns of {r.node_id} are not known any more; they count as removed, though its SQL may still have them", file=sys.stderr)
    checks = None
    if args.check_relations:
        nodes = [r.node for r in rep.schema_evolution(changes, current.nodes).select("node").distinct().collect()]
        if missing := warehouse.unsupported(man.adapter_type(manifest)):
            failed = [f"--check-relations: {missing}; relations were not looked up"]
        else:
            checks, failed = warehouse.check_relations(man.relation_identities(manifest), nodes, warehouse.dbt_macro(d, command, extra))
        for x in failed:
            print(f"warning: {x}", file=sys.stderr)
    report = rep.build_report(changes, findings, current, args.defer_target or config.defer_target, args.defer_state or config.defer_state, base.is_stale(d, against), checks)
    wire = rep.to_json(report)
    _say(json.dumps(wire, indent=2) if args.format == "json" else text.report_text(report, changes, findings, text.wants_color(args.no_color)), d)
    sinks.best_effort("run metadata", lambda: sinks.write_whole(sinks.target(d) / "run-metadata.json", json.dumps(sinks.run_metadata(wire, current), indent=2)))
    _purge(args, config)
    return int(args.command == "check" and report.breaking)


def _purge(args: argparse.Namespace, config: conf.Config) -> None:
    days = args.purge_logs if args.purge_logs is not None else config.log_retention_days
    if days is not None:
        sinks.best_effort("the log folder", lambda: sinks.purge_logs(args.project_dir, days))


def lineage(spark: SparkSession, args: argparse.Namespace) -> int:
    d = args.project_dir
    config = conf.load(d)
    base.resolve_tool(d, config.tool)
    if args.compile:
        base.dbt("compile", d, config.dbt_command or "dbt", log=_logger(d))
    project = build(spark, man.read_manifest(spark, str(_current(d)))).cached()
    full = sinks.full_lineage(project)
    sinks.write_whole(sinks.target(d) / "full_lineage.json", json.dumps(full))
    parsed = graph.parse_target(args.target) if args.target else None
    if args.text and parsed is None:
        raise graph.LineageError("--text needs a target")
    rows = node = None
    if parsed:
        model, column, direction = parsed
        node = graph.find_node(project, model, args.package)
        rows = graph.trace_column(project, model, column, direction, args.package) if column else graph.trace(project, model, direction, args.package)
    if args.text:
        _say(text.trace_text(rows, parsed[2]), d)
    else:
        path = args.html or sinks.html_path(d, parsed, args.package)
        sinks.write_whole(path, sinks.lineage_page(full, node, parsed and parsed[1], parsed[2] if parsed else "both"))
        _say(f"wrote {path}", d)
    _purge(args, config)
    return 0


def addon(argv: list[str]) -> int | None:
    """Run veinmap-NAME from the PATH for a command that is none of ours; its exit code, or None without one."""
    if not argv or argv[0].startswith("-") or argv[0] in COMMANDS:
        return None
    program = shutil.which(f"veinmap-{argv[0]}")
    return subprocess.run([program, *argv[1:]], env=os.environ).returncode if program else None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if (code := addon(argv)) is not None:
        return code
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("veinmap").config("spark.ui.enabled", "false").getOrCreate()
    try:
        return lineage(spark, args) if args.command == "lineage" else compare(spark, args)
    except FAILURES as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        release()
