"""The relations that a project is made of, as Spark DDL."""

FIELDS = "array<struct<name:string,data_type:string>>"

#: One compiled manifest; what is not named here is not read.
MANIFEST = (
    "metadata struct<adapter_type:string>,"
    "nodes map<string,struct<unique_id:string,resource_type:string,name:string,database:string,schema:string,alias:string,"
    "depends_on:struct<nodes:array<string>>,compiled_code:string,columns:map<string,struct<data_type:string>>,config:struct<materialized:string>>>,"
    "sources map<string,struct<unique_id:string,name:string,database:string,schema:string,identifier:string>>,"
    "_broken string"
)
NODES = "node_idx long, node_id string, name string, package string, materialization string, joins array<string>, unresolved boolean"
COLUMNS = f"node_id string, ordinal int, column_name string, data_type string, expression string, struct_fields {FIELDS}"
ORIGINS = "origin_id string, name string"
EDGES = "edge_idx long, upstream_kind string, upstream_id string, downstream_id string, upstream_column string, downstream_column string"
CHANGES = "change_idx array<long>, type string, node string, `column` string, field string, from_type string, to_type string, position int, from_kind string, to_kind string"
FINDINGS = "finding_idx array<long>, severity string, rule string, node string, `column` string, field string, reached string, reached_column string, from_type string, to_type string, position int, from_kind string, to_kind string"
