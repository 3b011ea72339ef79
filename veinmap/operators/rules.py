"""Rules: which changes are findings, and how grave each is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diffing import indexed

SEVERITIES = ("error", "warn", "pass")
#: The rules by name, and the severity of each under the default preset.
RULES = {
    "column-removed-with-active-references": "error",
    "column-type-narrowed": "warn",
    "join-cardinality-loosened": "warn",
    "column-added": "pass",
    "struct-field-removed": "error",
    "struct-field-added": "error",
    "struct-field-type-narrowed": "error",
}
#: What each preset makes of a severity.
PRESETS = {
    "default": {"error": "error", "warn": "warn", "pass": "pass"},
    "strict": {"error": "error", "warn": "error", "pass": "warn"},
    "lenient": {"error": "warn", "warn": "pass", "pass": "pass"},
}
#: Types that can be ranked by what they hold; a change to a lower rank narrows. Others are never said to be narrowed.
TYPE_RANKS = {"tinyint": 0, "smallint": 1, "int": 2, "integer": 2, "bigint": 3}
#: Joins by how many rows they may let through; cross joins are not ranked.
JOIN_RANKS = {"inner": 0, "left": 1, "right": 1, "full": 2}


def severities(preset: str = "default", overrides: dict[str, str] | None = None) -> dict[str, str]:
    """The severity of every rule: its override, else what the preset makes of its default."""
    return {rule: (overrides or {}).get(rule, PRESETS[preset][base]) for rule, base in RULES.items()}


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[value]


def _type_rank(value: Column) -> Column:
    return _rank(F.lower(F.trim(value)), TYPE_RANKS)


def evaluate(baseline_edges: DataFrame, changes: DataFrame, graveness: dict[str, str] | None = None) -> DataFrame:
    """findings of schemas.py, in order of changes and, for a removed column, of the baseline's edges.

    A removed column is a finding for each baseline edge that read it, whether
    or not the reader still does.
    """
    narrowed = _type_rank(F.col("to_type")) < _type_rank(F.col("from_type"))
    loosened = _rank(F.col("to_kind"), JOIN_RANKS) > _rank(F.col("from_kind"), JOIN_RANKS)
    kind = F.col("type")
    rule = (
        F.when((kind == "column_type_changed") & narrowed, "column-type-narrowed")
        .when((kind == "join_changed") & loosened, "join-cardinality-loosened")
        .when(kind == "column_added", "column-added")
        .when(kind == "struct_field_removed", "struct-field-removed")
        .when(kind == "struct_field_added", "struct-field-added")
        .when((kind == "struct_field_type_changed") & narrowed, "struct-field-type-narrowed")
    )
    edges = baseline_edges.filter("upstream_kind = 'node' AND upstream_column IS NOT NULL").select(F.coalesce("edge_idx", F.lit(0)).alias("edge_idx"), "upstream_id", "upstream_column", F.col("downstream_id").alias("reached"), F.col("downstream_column").alias("reached_column"))
    # Only removed columns have a key that edges can meet; all other changes pass the join alone.
    keyed = changes.withColumn("gone", F.when(kind == "column_removed", F.col("column")))
    met = keyed.join(edges, (F.col("node") == F.col("upstream_id")) & (F.col("gone") == F.col("upstream_column")), "left")
    broken = (kind == "column_removed") & F.col("upstream_id").isNotNull()
    named = met.withColumn("rule", F.when(broken, "column-removed-with-active-references").otherwise(rule)).withColumn("edge_idx", F.coalesce("edge_idx", F.lit(-1)))
    found = indexed(named.filter("rule IS NOT NULL"), ("change_idx", "edge_idx"), "finding_idx")
    table = graveness or severities()
    grave = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return found.select("finding_idx", grave[F.col("rule")].alias("severity"), "rule", "node", "column", "field", "reached", "reached_column", "from_type", "to_type", "position", "from_kind", "to_kind")
