"""Report relations over changes and findings, and the report built of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import local
from .graph import defer_set
from .project import Project

STALENESS_WARNING = "analysis may be stale, consider rebasing"


def display_name(node_id: Column) -> Column:
    """The last dotted part of an id: works for nodes that are gone as well."""
    return F.element_at(F.split(node_id, r"\."), -1)


def impacted_nodes(findings: DataFrame) -> DataFrame:
    """(node_id, first_idx): nodes that findings other than 'pass' hit, once each; sort by first_idx for first-seen order."""
    hit = F.coalesce(F.when(F.col("rule") == "column-removed-with-active-references", F.col("reached")), F.col("node"))
    return findings.filter("severity != 'pass'").groupBy(hit.alias("node_id")).agg(F.min("finding_idx").alias("first_idx"))


def impacted_models(findings: DataFrame) -> DataFrame:
    return impacted_nodes(findings).select(display_name(F.col("node_id")).alias("name"), "node_id", "first_idx")


def lost_schemas(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """(node_id): nodes whose schema was known and is not any more; all their columns count as removed, which may be wrong."""
    lost = new_nodes.filter("unresolved").select("node_id")
    return lost.join(old_nodes.filter("NOT unresolved").select("node_id"), "node_id", "left_semi")


def describe(change: str | None = None) -> Column:
    """One line about a change."""
    c = F.col
    # The phrases, which readers of reports know.
    return (
        F.when(c("type") == "column_added", F.format_string("+ column added: %s", "column"))
        .when(c("type") == "column_removed", F.format_string("- column removed: %s", "column"))
        .when(c("type") == "column_type_changed", F.format_string("~ column type changed: %s (%s -> %s)", "column", "from_type", "to_type"))
        .when(c("type") == "join_changed", F.format_string("~ join changed at position %d: %s -> %s", "position", F.coalesce("from_kind", F.lit("none")), F.coalesce("to_kind", F.lit("none"))))
        .when(c("type") == "struct_field_added", F.format_string("+ struct field added: %s.%s", "column", "field"))
        .when(c("type") == "struct_field_removed", F.format_string("- struct field removed: %s.%s", "column", "field"))
        .otherwise(F.format_string("~ struct field type changed: %s.%s (%s -> %s)", "column", "field", "from_type", "to_type"))
    )


def describe_impact() -> Column:
    """One line about a finding's impact."""
    c = F.col
    # The phrases, as above.
    return (
        F.when(c("rule") == "column-removed-with-active-references", F.format_string("%s removed from model %s breaks reference via %s", "column", "node", "reached_column"))
        .when(c("rule") == "column-type-narrowed", F.format_string("%s type narrowed from %s to %s", "column", "from_type", "to_type"))
        .when(c("rule") == "join-cardinality-loosened", F.format_string("join at position %d loosened from %s to %s", "position", "from_kind", "to_kind"))
        .when(c("rule") == "column-added", F.format_string("%s added", "column"))
        .when(c("rule") == "struct-field-removed", F.format_string("%s removed from struct column %s", "field", "column"))
        .when(c("rule") == "struct-field-added", F.format_string("%s added to struct column %s", "field", "column"))
        .otherwise(F.format_string("%s.%s type narrowed from %s to %s", "column", "field", "from_type", "to_type"))
    )


def schema_evolution(changes: DataFrame, current_nodes: DataFrame) -> DataFrame:
    """(change_idx, node, description): changes of columns or fields on nodes that are incremental now."""
    incremental = current_nodes.filter("materialization = 'incremental'").select(F.col("node_id").alias("node"))
    return changes.filter("type != 'join_changed'").join(incremental, "node", "left_semi").select("change_idx", "node", describe().alias("description"))


def evolution_messages(warnings: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(change_idx, node, message). checks (node, present): what a live look said; absent relations give no warning, unknown ones a conditional one."""
    if checks is None:
        checks = local(warnings.sparkSession, [], "node string, present boolean")
    joined = warnings.join(checks, "node", "left").filter("present IS NULL OR present")
    sure = F.format_string("this incrementally-materialized model exists in your target environment; this change requires manual schema evolution: %s", "description")
    maybe = F.format_string("if this incrementally-materialized model already exists in your target environment, this change requires manual schema evolution: %s", "description")
    return joined.select("change_idx", "node", F.when(F.col("present"), sure).otherwise(maybe).alias("message"))


def summary(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: models_changed, columns_changed (changes other than joins), breaking, warning."""
    of_changes = changes.agg(F.countDistinct("node").alias("models_changed"), F.count_if(F.col("type") != "join_changed").alias("columns_changed"))
    of_findings = findings.agg(F.count_if(F.col("severity") == "error").alias("breaking"), F.count_if(F.col("severity") == "warn").alias("warning"))
    return of_changes.join(of_findings)  # one row beside one row


def is_breaking(findings: DataFrame) -> bool:
    return not findings.filter("severity = 'error'").isEmpty()


def changed_lines(changes: DataFrame) -> DataFrame:
    """(node, first_idx, lines): descriptions of each node's changes in order; sort by first_idx for first-seen order."""
    return _grouped(changes.select(F.col("node"), F.col("change_idx").alias("idx"), describe().alias("line")))


def impact_lines(findings: DataFrame) -> DataFrame:
    hit = F.coalesce(F.when(F.col("rule") == "column-removed-with-active-references", F.col("reached")), F.col("node"))
    label = F.when(F.col("severity") == "error", "BREAKING").otherwise("WARN")
    return _grouped(findings.filter("severity != 'pass'").select(hit.alias("node"), F.col("finding_idx").alias("idx"), F.format_string("[%s] %s (%s)", label, describe_impact(), F.col("rule")).alias("line")))


def _grouped(rows: DataFrame) -> DataFrame:
    """A node's lines gather in one row: the report of one node."""
    return rows.groupBy("node").agg(F.min("idx").alias("first_idx"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]).alias("lines"))


@dataclass
class Report:
    """What a run found, collected for output."""

    changes: list[dict]
    findings: list[dict]
    staleness_warning: str | None = None
    impacted_models: list[str] = field(default_factory=list)
    defer_plan: dict | None = None
    schema_evolution_warnings: list[dict] = field(default_factory=list)

    @property
    def breaking(self) -> bool:
        return any(f["severity"] == "error" for f in self.findings)


CHANGE_FIELDS = {
    "column_added": ("node", "column"),
    "column_removed": ("node", "column"),
    "column_type_changed": ("node", "column", "from_type", "to_type"),
    "join_changed": ("node", "position", "from_kind", "to_kind"),
    "struct_field_added": ("node", "column", "field"),
    "struct_field_removed": ("node", "column", "field"),
    "struct_field_type_changed": ("node", "column", "field", "from_type", "to_type"),
}
FINDING_FIELDS = {
    "column-removed-with-active-references": ("node", "column", "reached", "reached_column"),
    "column-type-narrowed": ("node", "column", "from_type", "to_type"),
    "join-cardinality-loosened": ("node", "position", "from_kind", "to_kind"),
    "column-added": ("node", "column"),
    "struct-field-removed": ("node", "column", "field"),
    "struct-field-added": ("node", "column", "field"),
    "struct-field-type-narrowed": ("node", "column", "field", "from_type", "to_type"),
}


def build_report(changes: DataFrame, findings: DataFrame, current: Project, target: str | None = None, state: str | None = None, stale: bool = False, checks: DataFrame | None = None) -> Report:
    """Collect a report. Changes and findings are a few rows per edited model."""
    rows = changes.orderBy("change_idx").collect()
    found = findings.orderBy("finding_idx").collect()
    report = Report([{"type": r.type, **{k: r[k] for k in CHANGE_FIELDS[r.type]}} for r in rows], [{"rule": r.rule, "severity": r.severity, **{k: r[k] for k in FINDING_FIELDS[r.rule]}} for r in found])
    report.staleness_warning = STALENESS_WARNING if stale else None
    hit = impacted_models(findings).orderBy("first_idx").collect()
    report.impacted_models = [r.name for r in hit]
    if hit:
        build = local(current.nodes.sparkSession, [(r.node_id,) for r in hit], "id string")
        deferred = [r.name for r in defer_set(current.edges, build).select("id", display_name(F.col("id")).alias("name")).orderBy("id").collect()]
        report.defer_plan = {"build": report.impacted_models, "defer": deferred} | ({"target": target} if target else {}) | ({"state": state} if state else {})
    warnings = evolution_messages(schema_evolution(changes, current.nodes), checks)
    report.schema_evolution_warnings = [{"node": r.node, "message": r.message} for r in warnings.orderBy("change_idx").collect()]
    return report


def to_json(report: Report) -> dict:
    """The report's wire form; what is absent is left out."""
    out: dict = {"changes": report.changes, "findings": report.findings}
    if report.staleness_warning:
        out["staleness_warning"] = report.staleness_warning
    out["impacted_models"] = report.impacted_models
    if report.defer_plan:
        out["defer_plan"] = report.defer_plan
    return out | {"schema_evolution_warnings": report.schema_evolution_warnings}
