"""The queries that the driver contract registers for the engine itself, and DuckDB SQL for them.

Four families: a bundled project, whose expected rows are written by hand from
the rules; a graph over the test tables' keys; a diff of columns derived from
parts; and the bundled models' own SQL, run to check what was predicted of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sample, snippets
from .operators import diffing, graph, report, rules
from .sources import manifest as man
from .storage import hold, release


def _short(c: str):
    """Ids of the bundled project without their common beginning."""
    return F.regexp_replace(c, r"^(model|source)\.shop\.(raw\.)?", "").alias(c)


# The bundled project


def relation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return man.relation_catalog(sample.manifest(spark)).select("schema", "identifier", "upstream_kind", _short("upstream_id"))


def model_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return man.dependencies(sample.manifest(spark)).select(_short("downstream_id"), "position", "upstream_kind", _short("upstream_id"))


def project_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.project(spark).nodes.select("name", "package", "materialization", F.array_join("joins", ",").alias("joins"), "unresolved")


def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array_join(F.transform("struct_fields", lambda f: f["name"]), ",")
    return sample.project(spark).columns.select(_short("node_id"), "ordinal", "column_name", "data_type", F.col("expression").isNotNull().alias("calculated"), fields.alias("fields"))


def project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.project(spark).edges.select("upstream_kind", _short("upstream_id"), _short("downstream_id"), "upstream_column", "downstream_column")


def trace_column_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace_column(sample.project(spark), "segment_orders", "some_name", "upstream").select("side", "kind", _short("id"), "column", "depth")


def trace_column_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace_column(sample.project(spark), "stg_orders", "status", "downstream").select("side", "kind", _short("id"), "column", "depth")


def trace_column_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace_column(sample.project(spark), "stg_orders", "status", "both", small=0).select("side", "kind", _short("id"), "column", "depth")


def trace_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trace(sample.project(spark), "stg_orders").select("side", "kind", _short("id"), "depth")


def project_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.exported_nodes(sample.project(spark)).select("kind", "name", "layer", "place")


def project_out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degrees(sample.project(spark)).select("kind", _short("id"), "consumers")


def _compared(spark: SparkSession, preset: str = "default"):
    release()  # what earlier queries held
    old, new = sample.project(spark), sample.project(spark, sample.NEW)
    changes = hold(diffing.diff(old, new))
    return new, changes, hold(rules.evaluate(old.edges, changes, rules.severities(preset)))


def project_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark)[1].drop("change_idx").withColumn("node", _short("node"))


def _findings(spark: SparkSession, preset: str) -> DataFrame:
    return _compared(spark, preset)[2].select("severity", "rule", _short("node"), "column", "field", _short("reached"), "reached_column")


def project_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, "default")


def project_findings_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, "strict")


def project_findings_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, "lenient")


def impacted_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.impacted_models(_compared(spark)[2]).select("name")


def defer_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, _, findings = _compared(spark)
    return graph.defer_set(new.edges, report.impacted_nodes(findings).select(F.col("node_id").alias("id"))).select(_short("id"))


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, changes, _ = _compared(spark)
    return report.schema_evolution(changes, new.nodes).select(_short("node"), "description")


def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, changes, findings = _compared(spark)
    return report.summary(changes, findings)


# The graph over keys


def _nations(p) -> DataFrame:
    return p.edges.filter("upstream_kind = 'origin'").orderBy("edge_idx").select(F.col("downstream_id").alias("id"))


def _orders(p) -> DataFrame:
    return p.nodes.filter("node_id LIKE 'o:%'").orderBy("node_idx").select(F.col("node_id").alias("id"))


def graph_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sample.key_graph(spark, sf_dir)
    return graph.closure(p.edges, _nations(p), "downstream").select("kind", "id", "depth", "rank")


def graph_downstream_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sample.key_graph(spark, sf_dir)
    return graph.closure(p.edges, _nations(p), "downstream", small=0).select("kind", "id", "depth", "rank")


def graph_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sample.key_graph(spark, sf_dir)
    return graph.closure(p.edges, _orders(p), "upstream").select("kind", "id", "depth", "rank")


def graph_columns_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sample.key_graph(spark, sf_dir)
    return graph.column_closure(p.edges, _nations(p).withColumn("column", F.lit("region")), "downstream").select("kind", "id", "column", "depth", "rank")


def graph_columns_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sample.key_graph(spark, sf_dir)
    return graph.column_closure(p.edges, _orders(p).withColumn("column", F.lit("region")), "upstream", small=0).select("kind", "id", "column", "depth", "rank")


def graph_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sample.key_graph(spark, sf_dir)
    return graph.layers(p.nodes, p.edges)


def graph_defer_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sample.key_graph(spark, sf_dir)
    return graph.defer_set(p.edges, p.nodes.filter("node_id LIKE 'o:%'").select(F.col("node_id").alias("id")))


def graph_out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degrees(sample.key_graph(spark, sf_dir))


# Columns derived from parts


def _parts(spark: SparkSession, sf_dir: str):
    old, new = (sample.part_columns(spark, sf_dir, s) for s in ("old", "new"))
    return old, new, diffing.diff(old, new)


def diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir)[2].select("type", "node", "column", "from_type", "to_type")


def diff_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, changes = _parts(spark, sf_dir)
    return rules.evaluate(old.edges, changes).select("severity", "rule", "node", "column", "reached", "reached_column", "from_type", "to_type")


def diff_impacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, changes = _parts(spark, sf_dir)
    return report.impacted_nodes(rules.evaluate(old.edges, changes)).select("node_id")


def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _, changes = _parts(spark, sf_dir)
    return report.summary(changes, rules.evaluate(old.edges, changes))


def diff_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new, changes = _parts(spark, sf_dir)
    return report.schema_evolution(changes, new.nodes).select("node", "description")


def join_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (sample.event_joins(spark, sf_dir, s) for s in ("old", "new"))
    return diffing.join_changes(old, new).select("node", "c.position", "c.from_kind", "c.to_kind")


# The bundled models, run


def model_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted columns beside those of the executed model; models whose schema is admitted unknown give none."""
    predicted = sample.project(spark).columns.select(_short("node_id"), "ordinal", "column_name")
    ran = [(n, k, c) for n, df in sample.execute(spark, sf_dir).items() for k, c in enumerate(df.columns)]
    actual = spark.createDataFrame(ran, "a_node string, a_ordinal int, a_column string")
    on = (F.col("node_id") == F.col("a_node")) & (F.col("ordinal") == F.col("a_ordinal"))
    return predicted.join(actual, on, "left").select("node_id", "ordinal", "column_name", (F.col("column_name") == F.col("a_column")).alias("as_executed"))


def run_dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.execute(spark, sf_dir)["dim_customers"]


def run_all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.execute(spark, sf_dir)["all_ids"]


# Small models, a family of constructs each


def expression_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.sources(spark, snippets.EXPRESSIONS)


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.sources(spark, snippets.NAMES)


def dialect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.sources(spark, snippets.DIALECTS)


def struct_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.structs(spark)


def join_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.joins(spark)


def lineage_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets.targets(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        relation_catalog, model_dependencies, project_nodes, project_columns, project_edges, trace_column_upstream, trace_column_downstream, trace_column_distributed, trace_model, project_layers, project_out_degrees,
        project_changes, project_findings, project_findings_strict, project_findings_lenient, impacted_models, defer_plan, schema_evolution, project_summary,
        graph_downstream, graph_downstream_distributed, graph_upstream, graph_columns_downstream, graph_columns_upstream, graph_layers, graph_defer_set, graph_out_degrees,
        diff_columns, diff_findings, diff_impacted, diff_summary, diff_schema_evolution, join_alignment, model_schemas, run_dim_customers, run_all_ids,
        expression_sources, name_resolution, dialect_sources, struct_shapes, join_edits, lineage_targets,
    )
    return {f.__name__: f for f in found}


def _values(names: str, *rows: tuple) -> str:
    """SELECT * FROM (VALUES ...) with NULL, numbers, booleans and text."""

    def cell(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    quoted = ", ".join(f'"{n}"' for n in names.split())
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({quoted})"


MODELS = ("stg_customers", "stg_orders", "stg_lines", "dim_customers", "fct_orders", "segment_orders", "all_ids")
#: Column edges by downstream model: (kind, upstream, upstream column, downstream column), read off the SQL.
COLUMN_EDGES = {
    "stg_customers": [("origin", "customer", "c_custkey", "customer_id"), ("origin", "customer", "c_name", "name"), ("origin", "customer", "c_nationkey", "nation_id"), ("origin", "customer", "c_mktsegment", "segment")],
    "stg_orders": [("origin", "orders", "o_orderkey", "order_id"), ("origin", "orders", "o_custkey", "customer_id"), ("origin", "orders", "o_orderstatus", "status"), ("origin", "orders", "o_orderdate", "ordered_at")],
    "stg_lines": [("origin", "lineitem", "l_orderkey", "order_id"), ("origin", "lineitem", "l_linenumber", "line_number"), ("origin", "lineitem", "l_quantity", "quantity"), ("origin", "lineitem", "l_extendedprice", "net_price"), ("origin", "lineitem", "l_discount", "net_price")],
    "dim_customers": [("node", "stg_customers", "customer_id", "customer_id"), ("node", "stg_customers", "name", "name"), ("node", "stg_customers", "segment", "segment"), ("node", "stg_orders", "ordered_at", "first_order"), ("node", "stg_orders", "ordered_at", "last_order"), ("node", "stg_orders", "order_id", "order_count")],
    "fct_orders": [("node", "stg_orders", "order_id", "order_id"), ("node", "stg_orders", "customer_id", "customer_id"), ("node", "stg_orders", "status", "status"), ("node", "stg_lines", "quantity", "quantity"), ("node", "stg_lines", "line_number", "detail"), ("node", "stg_orders", "status", "detail")],
    "segment_orders": [("node", "dim_customers", "segment", "segment"), ("node", "fct_orders", "order_id", "orders"), ("node", "fct_orders", "status", "least_status"), ("node", "fct_orders", "quantity", "some_name"), ("node", "dim_customers", "name", "some_name")],
}
NODE_EDGES = [("origin", "customer", "stg_customers"), ("origin", "orders", "stg_orders"), ("origin", "lineitem", "stg_lines"), ("node", "stg_customers", "dim_customers"), ("node", "stg_orders", "dim_customers"), ("node", "stg_orders", "fct_orders"), ("node", "stg_lines", "fct_orders"), ("node", "dim_customers", "segment_orders"), ("node", "fct_orders", "segment_orders"), ("node", "stg_customers", "all_ids"), ("node", "stg_orders", "all_ids")]
COLUMNS = {
    "stg_customers": ["customer_id", "name", "nation_id", "segment"],
    "stg_orders": ["order_id", "customer_id", "status", "ordered_at"],
    "stg_lines": ["order_id", "line_number", "quantity", "net_price"],
    "dim_customers": ["customer_id", "name", "segment", "first_order", "last_order", "order_count"],
    "fct_orders": ["order_id", "customer_id", "status", "quantity", "detail"],
    "segment_orders": ["segment", "orders", "least_status", "some_name", "place"],
}
DOCUMENTED = {("stg_customers", "customer_id"): "bigint", ("stg_customers", "segment"): "varchar", ("stg_orders", "order_id"): "bigint", ("stg_lines", "quantity"): "int", ("dim_customers", "customer_id"): "bigint", ("fct_orders", "quantity"): "bigint"}
CALCULATED = {("stg_lines", "net_price"), ("dim_customers", "order_count"), ("fct_orders", "detail"), *(("segment_orders", c) for c in ("orders", "least_status", "some_name", "place"))}
CHANGES = [
    ("column_type_changed", "stg_customers", "customer_id", None, "bigint", "int", None, None, None),
    ("column_added", "stg_customers", "loyalty", None, None, None, None, None, None),
    ("column_removed", "stg_customers", "segment", None, None, None, None, None, None),
    ("column_removed", "dim_customers", "segment", None, None, None, None, None, None),
    ("join_changed", "dim_customers", None, None, None, None, 0, "left", "full"),
    ("column_type_changed", "fct_orders", "quantity", None, "bigint", "int", None, None, None),
    ("column_added", "fct_orders", "ordered_at", None, None, None, None, None, None),
    ("struct_field_added", "fct_orders", "detail", "placed", None, None, None, None, None),
    ("struct_field_removed", "fct_orders", "detail", "status", None, None, None, None, None),
    ("column_removed", "fct_orders", "status", None, None, None, None, None, None),
]
#: (default severity, rule, node, column, field, reached, reached column)
FINDINGS = [
    ("warn", "column-type-narrowed", "stg_customers", "customer_id", None, None, None),
    ("pass", "column-added", "stg_customers", "loyalty", None, None, None),
    ("error", "column-removed-with-active-references", "stg_customers", "segment", None, "dim_customers", "segment"),
    ("error", "column-removed-with-active-references", "dim_customers", "segment", None, "segment_orders", "segment"),
    ("warn", "join-cardinality-loosened", "dim_customers", None, None, None, None),
    ("warn", "column-type-narrowed", "fct_orders", "quantity", None, None, None),
    ("pass", "column-added", "fct_orders", "ordered_at", None, None, None),
    ("error", "struct-field-added", "fct_orders", "detail", "placed", None, None),
    ("error", "struct-field-removed", "fct_orders", "detail", "status", None, None),
    ("error", "column-removed-with-active-references", "fct_orders", "status", None, "segment_orders", "least_status"),

]


def _found(preset: dict[str, str]) -> str:
    return _values("severity rule node column field reached reached_column", *[(preset[f[0]], *f[1:]) for f in FINDINGS])


KEY_EDGES = """
WITH RECURSIVE e AS (
  SELECT n_nationkey AS idx, 'origin' AS uk, 'r:' || n_regionkey AS u, 'n:' || n_nationkey AS d, 'r_name' AS uc, 'region' AS dc FROM nation
  UNION ALL SELECT 1099511627776 + c_custkey, 'node', 'n:' || c_nationkey, 'c:' || c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN 'region' END, CASE WHEN c_nationkey % 5 <> 0 THEN 'region' END FROM customer
  UNION ALL SELECT 2199023255552 + o_orderkey, 'node', 'c:' || o_custkey, 'o:' || o_orderkey, 'region', 'region' FROM orders),
"""
#: Places of reached rows, by depth and then by the edges that lead there.
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY depth = 0 ORDER BY depth, path) - 1 AS rank FROM m) "
STUCK = " UNION ALL SELECT 'unresolved', id, NULL, min(depth), min(rank) FROM r WHERE "
PART_DIFF = """
WITH o AS (SELECT p_brand AS node, 'p' || p_partkey AS c, ['tinyint','smallint','int','bigint','varchar'][p_size % 5 + 1] AS t FROM part WHERE p_partkey % 11 <> 0),
n AS (SELECT p_brand AS node, 'p' || p_partkey AS c, ['tinyint','smallint','int','bigint','varchar'][(p_size + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END) % 5 + 1] AS t FROM part WHERE p_partkey % 7 <> 0),
d AS (SELECT CASE WHEN o.c IS NULL THEN 'column_added' WHEN n.c IS NULL THEN 'column_removed' ELSE 'column_type_changed' END AS type, coalesce(o.node, n.node) AS node, coalesce(o.c, n.c) AS "column",
    CASE WHEN n.c IS NOT NULL THEN o.t END AS from_type, CASE WHEN o.c IS NOT NULL THEN n.t END AS to_type
  FROM o FULL JOIN n ON o.node = n.node AND o.c = n.c WHERE o.c IS NULL OR n.c IS NULL OR o.t <> n.t),
r AS (SELECT *, list_position(['tinyint','smallint','int','bigint'], from_type) AS fr, list_position(['tinyint','smallint','int','bigint'], to_type) AS tr FROM d),
f AS (SELECT 'pass' AS severity, 'column-added' AS rule, node, "column", NULL AS reached, NULL AS reached_column, from_type, to_type FROM d WHERE type = 'column_added'
  UNION ALL SELECT 'warn', 'column-type-narrowed', node, "column", NULL, NULL, from_type, to_type FROM r WHERE type = 'column_type_changed' AND tr < fr AND tr > 0
  UNION ALL SELECT 'error', 'column-removed-with-active-references', d.node, d."column", 's:' || l_suppkey, 'q' || l_partkey || '_' || l_orderkey || '_' || l_linenumber, NULL, NULL
    FROM d JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey) x ON x.p_brand = d.node AND 'p' || x.l_partkey = d."column" WHERE d.type = 'column_removed')
"""


def oracle_sql() -> dict[str, str]:
    layer = {"stg_customers": 1, "stg_orders": 1, "stg_lines": 1, "all_ids": 2, "dim_customers": 2, "fct_orders": 2, "segment_orders": 3}
    consumers = {m: 0 for m in (*MODELS, "customer", "orders", "lineitem")}
    for kind_up in [(k, u) for rows in COLUMN_EDGES.values() for k, u, _, _ in rows] + [(k, u) for k, u, _ in NODE_EDGES]:
        consumers[kind_up[1]] += 1
    keep = lambda x: x
    order = [("origin", "customer", 0, 1), ("origin", "lineitem", 0, 2), ("origin", "orders", 0, 3), ("node", "stg_customers", 1, 1), ("node", "stg_lines", 1, 2), ("node", "stg_orders", 1, 3), ("node", "all_ids", 2, 1), ("node", "dim_customers", 2, 2), ("node", "fct_orders", 2, 3), ("node", "segment_orders", 3, 1)]
    assert all(layer.get(n, 0) == at for _, n, at, _ in order)
    down = [("downstream", "node", "fct_orders", "status", 1), ("downstream", "node", "fct_orders", "detail", 1), ("downstream", "node", "segment_orders", "least_status", 2), ("downstream", "unresolved", "fct_orders", None, 1)]
    return {
        "relation_catalog": _values("schema identifier upstream_kind upstream_id", *[("raw", s, "origin", s) for s in ("customer", "orders", "lineitem")], *[("mart", m, "node", m) for m in MODELS]),
        "model_dependencies": _values("downstream_id position upstream_kind upstream_id", *[(d, sum(1 for _, _, d2 in NODE_EDGES[:k] if d2 == d), kind, u) for k, (kind, u, d) in enumerate(NODE_EDGES)]),
        "project_nodes": _values("name package materialization joins unresolved", *[(m, "shop", {"dim_customers": "table", "segment_orders": "table", "fct_orders": "incremental", "all_ids": "ephemeral"}.get(m, "view"), {"dim_customers": "left", "fct_orders": "left", "segment_orders": "inner"}.get(m, ""), m == "all_ids") for m in MODELS]),
        "project_columns": _values("node_id ordinal column_name data_type calculated fields", *[(m, k, c, DOCUMENTED.get((m, c)), (m, c) in CALCULATED, "lines,status" if c == "detail" else None) for m, cs in COLUMNS.items() for k, c in enumerate(cs)]),
        "project_edges": _values("upstream_kind upstream_id downstream_id upstream_column downstream_column", *[(k, u, d, a, b) for d, rows in COLUMN_EDGES.items() for k, u, a, b in rows], *[(k, u, d, None, None) for k, u, d in NODE_EDGES]),
        "trace_column_upstream": _values("side kind id column depth", ("upstream", "node", "fct_orders", "quantity", 1), ("upstream", "node", "dim_customers", "name", 1), ("upstream", "node", "stg_lines", "quantity", 2), ("upstream", "node", "stg_customers", "name", 2), ("upstream", "origin", "lineitem", "l_quantity", 3), ("upstream", "origin", "customer", "c_name", 3)),
        "trace_column_downstream": _values("side kind id column depth", *down),
        "trace_column_distributed": _values("side kind id column depth", ("upstream", "origin", "orders", "o_orderstatus", 1), *down),
        "trace_model": _values("side kind id depth", ("upstream", "origin", "orders", 1), ("downstream", "node", "all_ids", 1), ("downstream", "node", "dim_customers", 1), ("downstream", "node", "fct_orders", 1), ("downstream", "node", "segment_orders", 2)),
        "project_layers": _values("kind name layer place", *order),
        "project_out_degrees": _values("kind id consumers", *[("node" if m in MODELS else "origin", m, n) for m, n in consumers.items()]),
        "project_changes": _values("type node column field from_type to_type position from_kind to_kind", *CHANGES),
        "project_findings": _found({"error": "error", "warn": "warn", "pass": "pass"}),
        "project_findings_strict": _found({"error": "error", "warn": "error", "pass": "warn"}),
        "project_findings_lenient": _found({"error": "warn", "warn": "pass", "pass": "pass"}),
        "impacted_models": _values("name", *[(m,) for m in ("stg_customers", "dim_customers", "segment_orders", "fct_orders")]),
        "defer_plan": _values("id", ("stg_lines",), ("stg_orders",)),
        "schema_evolution": _values("node description", *[("fct_orders", d) for d in ("~ column type changed: quantity (bigint -> int)", "+ column added: ordered_at", "+ struct field added: detail.placed", "- struct field removed: detail.status", "- column removed: status")]),
        "project_summary": _values("models_changed columns_changed breaking warning", (3, 9, 5, 3)),
        **{k: keep(KEY_EDGES + "w AS (SELECT d AS id, 0 AS depth, [idx] AS path FROM e WHERE uk = 'origin' UNION ALL SELECT e.d, w.depth + 1, list_append(w.path, e.idx) FROM w JOIN e ON e.uk = 'node' AND e.u = w.id), m AS (SELECT id, min(depth) AS depth, min(path) AS path FROM w GROUP BY id), " + RANKED + "SELECT 'node' AS kind, id, depth, rank FROM r WHERE depth > 0") for k in ("graph_downstream", "graph_downstream_distributed")},
        "graph_upstream": KEY_EDGES + "w AS (SELECT 'node' AS kind, 'o:' || o_orderkey AS id, 0 AS depth, [o_orderkey] AS path FROM orders UNION ALL SELECT e.uk, e.u, w.depth + 1, list_append(w.path, e.idx) FROM w JOIN e ON w.kind = 'node' AND e.d = w.id), m AS (SELECT kind, id, min(depth) AS depth, min(path) AS path FROM w GROUP BY kind, id), " + RANKED + "SELECT kind, id, depth, rank FROM r WHERE depth > 0",
        "graph_columns_downstream": KEY_EDGES
        + "w AS (SELECT d AS id, 'region' AS c, 0 AS depth, [idx] AS path FROM e WHERE uk = 'origin' UNION ALL SELECT e.d, e.dc, w.depth + 1, list_append(w.path, e.idx) FROM w JOIN e ON e.uk = 'node' AND e.u = w.id AND e.uc = w.c), m AS (SELECT id, c, min(depth) AS depth, min(path) AS path FROM w GROUP BY id, c), "
        + RANKED + "SELECT 'node' AS kind, id, c AS \"column\", depth, rank FROM r WHERE depth > 0" + STUCK + "EXISTS (SELECT 1 FROM e WHERE e.uk = 'node' AND e.u = r.id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.uk = 'node' AND e.u = r.id AND e.uc = r.c) GROUP BY id",
        "graph_columns_upstream": KEY_EDGES
        + "w AS (SELECT 'node' AS kind, 'o:' || o_orderkey AS id, 'region' AS c, 0 AS depth, [o_orderkey] AS path FROM orders UNION ALL SELECT e.uk, e.u, e.uc, w.depth + 1, list_append(w.path, e.idx) FROM w JOIN e ON w.kind = 'node' AND e.d = w.id AND e.dc = w.c), m AS (SELECT kind, id, c, min(depth) AS depth, min(path) AS path FROM w GROUP BY kind, id, c), "
        + RANKED + "SELECT kind, id, c AS \"column\", depth, rank FROM r WHERE depth > 0" + STUCK + "kind = 'node' AND EXISTS (SELECT 1 FROM e WHERE e.d = r.id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.d = r.id AND e.dc = r.c) GROUP BY id",
        "graph_layers": "SELECT 'n:' || n_nationkey AS node_id, 1 AS layer FROM nation UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer UNION ALL SELECT 'o:' || o_orderkey, 3 FROM orders",
        "graph_defer_set": "SELECT DISTINCT 'c:' || o_custkey AS id FROM orders UNION SELECT 'n:' || c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        "graph_out_degrees": KEY_EDGES + "x AS (SELECT 'origin' AS kind, 'r:' || r_regionkey AS id FROM region UNION ALL SELECT 'node', 'n:' || n_nationkey FROM nation UNION ALL SELECT 'node', 'c:' || c_custkey FROM customer UNION ALL SELECT 'node', 'o:' || o_orderkey FROM orders) SELECT x.kind, x.id, count(e.u) AS consumers FROM x LEFT JOIN e ON e.uk = x.kind AND e.u = x.id GROUP BY x.kind, x.id",
        "diff_columns": PART_DIFF + "SELECT * FROM d",
        "diff_findings": PART_DIFF + "SELECT * FROM f",
        "diff_impacted": PART_DIFF + "SELECT DISTINCT coalesce(reached, node) AS node_id FROM f WHERE severity <> 'pass'",
        "diff_summary": PART_DIFF + "SELECT (SELECT count(DISTINCT node) FROM d) AS models_changed, (SELECT count(*) FROM d) AS columns_changed, (SELECT count(*) FROM f WHERE severity = 'error') AS breaking, (SELECT count(*) FROM f WHERE severity = 'warn') AS warning",
        "diff_schema_evolution": PART_DIFF
        + "SELECT node, CASE type WHEN 'column_added' THEN '+ column added: ' || \"column\" WHEN 'column_removed' THEN '- column removed: ' || \"column\" ELSE '~ column type changed: ' || \"column\" || ' (' || from_type || ' -> ' || to_type || ')' END AS description FROM d WHERE coalesce(TRY_CAST(regexp_extract(node, '(\\d+)', 1) AS BIGINT), 0) % 2 = 0",
        "model_schemas": _values("node_id ordinal column_name as_executed", *[(m, k, c, True) for m, cs in COLUMNS.items() for k, c in enumerate(cs)]),
        "expression_sources": _values("case column sources", *snippets.source_rows(snippets.EXPRESSIONS)),
        "name_resolution": _values("case column sources", *snippets.source_rows(snippets.NAMES)),
        "dialect_sources": _values("case column sources", *snippets.source_rows(snippets.DIALECTS)),
        "struct_shapes": _values("expression fields", *snippets.STRUCTS.items()),
        "join_edits": _values("node position from_kind to_kind", *[(n, *c) for n, (_, _, changes) in snippets.JOINS.items() for c in changes]),
        "lineage_targets": _values("target model column direction", *[(t, *x) for t, x in snippets.TARGETS.items()]),
        "run_dim_customers": sample.execution_sql("dim_customers"),
        "run_all_ids": "SELECT c_custkey AS id FROM customer UNION ALL SELECT o_orderkey FROM orders",
    }
