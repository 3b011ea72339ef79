"""Reports and traces as text."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import report as r

RED, YELLOW, RESET = "\x1b[31m", "\x1b[33m", "\x1b[0m"


def wants_color(no_color: bool) -> bool:
    """Off by flag or NO_COLOR; on for a terminal and under GITHUB_ACTIONS."""
    if no_color or os.environ.get("NO_COLOR"):
        return False
    return bool(os.environ.get("GITHUB_ACTIONS")) or sys.stdout.isatty()


def report_text(report: r.Report, changes: DataFrame, findings: DataFrame, color: bool = False) -> str:
    """The sections of a report in fixed order."""
    out = [f"warning: {report.staleness_warning}\n"] if report.staleness_warning else []
    if not report.changes and not report.findings:
        return "\n".join([*out, "No changes detected."]) + "\n"

    def section(title: str, rows: DataFrame) -> list[str]:
        found = rows.orderBy("first_idx").collect()
        return [title, *(line for x in found for line in (f"  model {x.node}:", *(f"    {y}" for y in x.lines)))]

    out += section("Changed:", r.changed_lines(changes))
    impact = section("\nDownstream impact:", r.impact_lines(findings))
    if len(impact) > 1:
        if color:
            impact = [x.replace("[BREAKING]", f"[{RED}BREAKING{RESET}]", 1).replace("[WARN]", f"[{YELLOW}WARN{RESET}]", 1) for x in impact]
        out += impact
    s = r.summary(changes, findings).first()
    out.append(f"\nSummary: {s.models_changed} model(s) changed, {s.columns_changed} column(s) changed, {s.breaking} breaking, {s.warning} warning")
    if report.impacted_models:
        out.append(f"\nImpacted models: {', '.join(report.impacted_models)}")
    if plan := report.defer_plan:
        out += ["\nDefer plan:", f"  Build: {', '.join(plan['build'])}", f"  Defer (assumed available): {', '.join(plan['defer']) or 'none'}"]
        out += [f"  {label}: {plan[key]}" for label, key in (("Target", "target"), ("State", "state")) if key in plan]
    if report.schema_evolution_warnings:
        out += ["\nSchema evolution:", *(f"  model {w['node']}: {w['message']}" for w in report.schema_evolution_warnings)]
    return "\n".join(out) + "\n"


def trace_text(rows: DataFrame, direction: str) -> str:
    """A trace by side: sources, then models, then models where a column could not be followed."""
    kinds = {"origin": 0, "node": 1, "unresolved": 2}
    found = sorted(rows.collect(), key=lambda x: (kinds[x.kind], x.depth, x.rank))
    columned = "column" in rows.columns
    out = []
    for side in ("upstream", "downstream"):
        if direction not in (side, "both"):
            continue
        lines = [f"  {'source' if x.kind == 'origin' else 'model'} {x.id}" + (" (unresolved)" if x.kind == "unresolved" else f".{x.column}" if columned else "") for x in found if x.side == side]
        out += [f"{side.capitalize()}:", *(lines or ["  (none)"])]
    return "\n".join(out) + "\n"


def lines_of(rows: DataFrame) -> list[str]:
    return [x[0] for x in rows.select(F.concat_ws(" ", "*")).collect()]
