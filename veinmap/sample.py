"""A small project over the test tables, in two states, and graphs and columns derived from these tables at scale."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.project import Project, build
from .sources.manifest import read_manifest
from .storage import local, scratch

DB, RAW, MART = "lake", "raw", "mart"


def _rel(schema: str, name: str) -> str:
    return f'"{DB}"."{schema}"."{name}"'


STAGING = "with source as (\n  select * from {source}\n), renamed as (\n  select {columns} from source\n)\nselect * from renamed"

#: name: (materialization, sources, models, SQL, documented types)
OLD = {
    "stg_customers": ("view", ["customer"], [], STAGING.format(source=_rel(RAW, "customer"), columns="c_custkey as customer_id, c_name as name, c_nationkey as nation_id, c_mktsegment as segment"), {"customer_id": "bigint", "segment": "varchar"}),
    "stg_orders": ("view", ["orders"], [], STAGING.format(source=_rel(RAW, "orders"), columns="o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, o_orderdate as ordered_at"), {"order_id": "bigint"}),
    "stg_lines": ("view", ["lineitem"], [], STAGING.format(source=_rel(RAW, "lineitem"), columns="l_orderkey as order_id, l_linenumber as line_number, l_quantity as quantity, l_extendedprice * (1 - l_discount) as net_price"), {"quantity": "int"}),
    "dim_customers": (
        "table",
        [],
        ["stg_customers", "stg_orders"],
        f"""with customers as (select * from {_rel(MART, "stg_customers")}),
orders as (select * from {_rel(MART, "stg_orders")}),
customer_orders as (
  select customer_id, min(ordered_at) as first_order, max(ordered_at) as last_order, count(order_id) as order_count
  from orders group by customer_id
)
select customers.customer_id, customers.name, customers.segment, customer_orders.first_order, customer_orders.last_order,
  coalesce(customer_orders.order_count, 0) as order_count
from customers left join customer_orders on customers.customer_id = customer_orders.customer_id""",
        {"customer_id": "bigint"},
    ),
    "fct_orders": (
        "incremental",
        [],
        ["stg_orders", "stg_lines"],
        f"""with orders as (select * from {_rel(MART, "stg_orders")}),
totals as (select order_id, sum(quantity) as quantity, max(line_number) as line_count from {_rel(MART, "stg_lines")} group by order_id)
select orders.order_id, orders.customer_id, orders.status, totals.quantity,
  named_struct('lines', totals.line_count, 'status', orders.status) as detail
from orders left join totals on orders.order_id = totals.order_id""",
        {"quantity": "bigint"},
    ),
    "segment_orders": (
        "table",
        [],
        ["dim_customers", "fct_orders"],
        f"""select c.segment, count(o.order_id) as orders, min(o.status) as least_status,
  case when max(o.quantity) > 40 then max(c.name) else min(c.name) end as some_name,
  rank() over (order by c.segment) as place
from {_rel(MART, "dim_customers")} c inner join {_rel(MART, "fct_orders")} o on c.customer_id = o.customer_id
group by c.segment""",
        {},
    ),
    "all_ids": ("ephemeral", [], ["stg_customers", "stg_orders"], f"select customer_id as id from {_rel(MART, 'stg_customers')} union all select order_id from {_rel(MART, 'stg_orders')}", {}),
}

NEW = OLD | {
    "stg_customers": ("view", ["customer"], [], STAGING.format(source=_rel(RAW, "customer"), columns="c_custkey as customer_id, c_name as name, c_nationkey as nation_id, 'none' as loyalty"), {"customer_id": "int", "segment": "varchar"}),
    "dim_customers": ("table", [], ["stg_customers", "stg_orders"], OLD["dim_customers"][3].replace("customers.segment, ", "").replace("customers left join", "customers full join"), {"customer_id": "bigint"}),
    "fct_orders": (
        "incremental",
        [],
        ["stg_orders", "stg_lines"],
        OLD["fct_orders"][3].replace("'status', orders.status)", "'placed', orders.ordered_at)").replace("orders.status, totals.quantity", "totals.quantity, orders.ordered_at"),
        {"quantity": "int"},
    ),
}


def manifest_json(models: dict = OLD) -> str:
    """The compiled manifest of a state of the project."""
    source = lambda s: f"source.shop.raw.{s}"
    model = lambda m: f"model.shop.{m}"
    nodes = {
        model(n): {
            "unique_id": model(n), "resource_type": "model", "name": n, "database": DB, "schema": MART, "alias": n, "compiled_code": sql, "config": {"materialized": kind},
            "depends_on": {"nodes": [source(s) for s in sources] + [model(m) for m in deps] + ["seed.shop.codes"]}, "columns": {c: {"name": c, "data_type": t} for c, t in types.items()},
        }
        for n, (kind, sources, deps, sql, types) in models.items()
    }
    nodes["seed.shop.codes"] = {"unique_id": "seed.shop.codes", "resource_type": "seed", "name": "codes", "database": DB, "schema": MART, "alias": "codes", "depends_on": {"nodes": []}}
    tables = sorted({s for m in models.values() for s in m[1]})
    return json.dumps({"metadata": {"adapter_type": "spark"}, "nodes": nodes, "sources": {source(t): {"unique_id": source(t), "name": t, "database": DB, "schema": RAW, "identifier": t} for t in tables}})


def manifest(spark: SparkSession, models: dict = OLD) -> DataFrame:
    path = scratch(spark, "manifest")
    spark.createDataFrame([(manifest_json(models),)], "value string").coalesce(1).write.text(path)
    return read_manifest(spark, path)


def project(spark: SparkSession, models: dict = OLD) -> Project:
    return build(spark, manifest(spark, models)).cached()


def execute(spark: SparkSession, sf_dir: str, models: dict = OLD) -> dict[str, DataFrame]:
    """Run the models' SQL on the test tables, in order; not something the analysis needs, but a check of its predictions."""
    out: dict[str, DataFrame] = {}
    for table in sorted({s for m in models.values() for s in m[1]}):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"vm_{RAW}_{table}")
    for name, (_, sources, deps, sql, _) in models.items():
        for schema, names in ((RAW, sources), (MART, deps)):
            for x in names:
                sql = sql.replace(_rel(schema, x), f"vm_{schema}_{x}")
        out[name] = spark.sql(sql)
        out[name].createOrReplaceTempView(f"vm_{MART}_{name}")
    return out


def execution_sql(name: str, models: dict = OLD) -> str:
    """One statement with every model as a CTE, ending in the one asked for."""
    ctes = []
    for n, (_, sources, deps, sql, _) in models.items():
        for x in sources:
            sql = sql.replace(_rel(RAW, x), x)
        for x in deps:
            sql = sql.replace(_rel(MART, x), f"m_{x}")
        ctes.append(f"m_{n} AS ({sql})")
        if n == name:
            break
    return f"WITH {', '.join(ctes)} SELECT * FROM m_{name}"


def key_graph(spark: SparkSession, sf_dir: str) -> Project:
    """Regions, nations, customers and orders as a graph: regions are origins; a name column runs down, but not past nations whose key is divisible by 5."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "orders")}
    nation = t["nation"].select(F.lit("origin").alias("upstream_kind"), F.concat(F.lit("r:"), "n_regionkey").alias("upstream_id"), F.concat(F.lit("n:"), "n_nationkey").alias("downstream_id"), F.lit("r_name").alias("upstream_column"), F.lit("region").alias("downstream_column"))
    named = F.col("c_nationkey") % 5 != 0
    customer = t["customer"].select(F.lit("node").alias("upstream_kind"), F.concat(F.lit("n:"), "c_nationkey").alias("upstream_id"), F.concat(F.lit("c:"), "c_custkey").alias("downstream_id"), F.when(named, "region").alias("upstream_column"), F.when(named, "region").alias("downstream_column"))
    orders = t["orders"].select(F.lit("node").alias("upstream_kind"), F.concat(F.lit("c:"), "o_custkey").alias("upstream_id"), F.concat(F.lit("o:"), "o_orderkey").alias("downstream_id"), F.lit("region").alias("upstream_column"), F.lit("region").alias("downstream_column"))
    number = {"n": 0, "c": 1 << 40, "o": 2 << 40}  # edges and nodes count by key, a table after the other
    idx = F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.substring("downstream_id", 1, 1)) + F.substring_index("downstream_id", ":", -1).cast("long")
    edges = nation.unionByName(customer).unionByName(orders).select(idx.alias("edge_idx"), "*")
    ids = edges.select("downstream_id")
    nodes = ids.select(idx.alias("node_idx"), F.col("downstream_id").alias("node_id"), F.col("downstream_id").alias("name"), F.lit(None).cast("string").alias("package"), F.lit("table").alias("materialization"), F.array().cast("array<string>").alias("joins"), F.lit(False).alias("unresolved"))
    columns = ids.select(F.col("downstream_id").alias("node_id"), F.lit(0).alias("ordinal"), F.lit("region").alias("column_name"), F.lit(None).cast("string").alias("data_type"), F.lit(None).cast("string").alias("expression"), F.lit(None).cast("array<struct<name:string,data_type:string>>").alias("struct_fields"))
    origins = t["region"].select(F.concat(F.lit("r:"), "r_regionkey").alias("origin_id"), F.col("r_name").alias("name"))
    return Project(nodes, columns, origins, edges)


TYPE_NAMES = ("tinyint", "smallint", "int", "bigint", "varchar")


def part_columns(spark: SparkSession, sf_dir: str, state: str) -> Project:
    """Parts as columns: a node per brand, a column per part, typed by size. The new state lost every 7th part, retyped every 3rd, and has every 11th anew."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    rows = part.filter(key % 11 != 0) if state == "old" else part.filter(key % 7 != 0)
    size = F.col("p_size") + (F.when(key % 3 == 0, 2).otherwise(0) if state == "new" else 0)
    typed = F.element_at(F.array(*[F.lit(x) for x in TYPE_NAMES]), (size % 5 + 1).cast("int"))
    columns = rows.select(F.col("p_brand").alias("node_id"), key.cast("int").alias("ordinal"), F.concat(F.lit("p"), key).alias("column_name"), typed.alias("data_type"), F.lit(None).cast("string").alias("expression"), F.lit(None).cast("array<struct<name:string,data_type:string>>").alias("struct_fields"))
    brands = part.select("p_brand").distinct()
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    nodes = brands.select(F.coalesce(number, F.lit(0)).alias("node_idx"), F.col("p_brand").alias("node_id"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("package"), F.when(F.coalesce(number, F.lit(0)) % 2 == 0, "incremental").otherwise("table").alias("materialization"), F.array().cast("array<string>").alias("joins"), F.lit(False).alias("unresolved"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    edges = line.select(F.monotonically_increasing_id().alias("edge_idx"), F.lit("node").alias("upstream_kind"), F.col("p_brand").alias("upstream_id"), F.concat(F.lit("s:"), "l_suppkey").alias("downstream_id"), F.concat(F.lit("p"), "l_partkey").alias("upstream_column"), F.concat(F.lit("q"), "l_partkey", F.lit("_"), "l_orderkey", F.lit("_"), "l_linenumber").alias("downstream_column"))
    origins = local(spark, [], "origin_id string, name string")
    return Project(nodes, columns, origins, edges)


JOIN_OF_EVENT = {"click": "inner", "view": "left", "purchase": "full"}


def event_joins(spark: SparkSession, sf_dir: str, state: str) -> DataFrame:
    """(node_idx, node_id, joins): a node per user; its joins are the kinds of its events in order, in the old state without every fourth event, in the new without every third."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.element_at(F.array(F.lit("inner"), F.lit("left"), F.lit("right"), F.lit("full"), F.lit("cross")), (F.abs(F.hash("event_type")) % 5 + 1).cast("int"))
    kept = e.filter("event_id % 4 != 0") if state == "old" else e.filter("event_id % 3 != 0")
    return kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", kind.alias("k")))), lambda x: x["k"]).alias("joins")).select(F.col("user_id").alias("node_idx"), F.col("user_id").cast("string").alias("node_id"), "joins")
