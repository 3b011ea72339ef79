"""Compiled manifests as DataFrames: models, sources, the relation catalog and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..storage import hold


class ManifestError(Exception):
    """A manifest that cannot be read, or is no manifest."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest's one row. Broken JSON and entries without an id, a name or a type are refused."""
    size = lambda c, test: F.coalesce(F.size(F.filter(F.map_values(c), test)), F.lit(0))
    lacks = size("nodes", lambda n: n["unique_id"].isNull() | n["name"].isNull() | n["resource_type"].isNull()) + size("sources", lambda n: n["unique_id"].isNull() | n["name"].isNull())
    try:
        df = hold(spark.read.schema(schemas.MANIFEST).option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True))
        found = df.agg(F.count("*").alias("rows"), F.count("_broken").alias("broken"), F.sum(lacks).alias("lacking")).first()
    except Exception as e:  # Spark reports missing and unreadable files by several classes
        raise ManifestError(f"could not read {path}: {str(e).splitlines()[0]}") from e
    if found.broken or found.rows != 1:
        raise ManifestError(f"{path} is not a valid manifest")
    if found.lacking:
        raise ManifestError(f"{path} is not a valid manifest: {found.lacking} entries lack an id, a name or a type")
    return df


def adapter_type(manifest: DataFrame) -> str | None:
    return manifest.select("metadata.adapter_type").first()[0]


def package_of(node_id):
    """The second dotted part of an id."""
    return F.when(F.size(F.split(node_id, r"\.")) > 1, F.element_at(F.split(node_id, r"\."), 2))


def all_nodes(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("nodes").alias("key", "n")).select("key", "n.*")


def models(manifest: DataFrame) -> DataFrame:
    """Models with a full relation name. Materialization is 'view' unless stated; other text stays as it is."""
    rows = all_nodes(manifest).filter("resource_type = 'model' AND database IS NOT NULL AND schema IS NOT NULL AND alias IS NOT NULL")
    return rows.select(
        F.col("unique_id").alias("node_id"),
        "name",
        package_of(F.col("unique_id")).alias("package"),
        "database",
        "schema",
        F.col("alias").alias("identifier"),
        F.coalesce("depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"),
        "compiled_code",
        F.transform_values(F.coalesce("columns", F.create_map().cast("map<string,struct<data_type:string>>")), lambda _, v: v["data_type"]).alias("documented"),
        F.coalesce("config.materialized", F.lit("view")).alias("materialization"),
    )


def sources(manifest: DataFrame) -> DataFrame:
    """Sources with a full relation name."""
    rows = manifest.select(F.explode("sources").alias("key", "s")).select("s.*")
    return rows.filter("database IS NOT NULL AND schema IS NOT NULL AND identifier IS NOT NULL").select(F.col("unique_id").alias("origin_id"), "name", "database", "schema", "identifier")


def relation_identities(manifest: DataFrame) -> DataFrame:
    """(node_id, database, schema, identifier) of each model."""
    return models(manifest).select("node_id", "database", "schema", "identifier")


def relation_catalog(manifest: DataFrame) -> DataFrame:
    """(database, schema, identifier, upstream_kind, upstream_id): one owner per relation; a model wins over a source."""
    name = ("database", "schema", "identifier")
    both = models(manifest).select(*name, F.lit("node").alias("upstream_kind"), F.col("node_id").alias("upstream_id"), F.lit(0).alias("rank"))
    both = both.unionByName(sources(manifest).select(*name, F.lit("origin").alias("upstream_kind"), F.col("origin_id").alias("upstream_id"), F.lit(1).alias("rank")))
    first = Window.partitionBy(*name).orderBy("rank", "upstream_id")
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "rank")


def dependencies(manifest: DataFrame) -> DataFrame:
    """(downstream_id, position, upstream_kind, upstream_id) of each dependency of a model on a model or source; others give no row."""
    deps = models(manifest).select(F.col("node_id").alias("downstream_id"), F.posexplode("depends_on").alias("position", "dep"))
    nodes = all_nodes(manifest).select(F.col("key").alias("n_key"), "resource_type", F.col("unique_id").alias("n_id"))
    origins = manifest.select(F.explode("sources").alias("s_key", "s")).select("s_key", F.col("s.unique_id").alias("s_id"))
    found = deps.join(nodes, F.col("dep") == F.col("n_key"), "left").join(origins, F.col("dep") == F.col("s_key"), "left")
    kind = F.when(F.col("resource_type") == "model", "node").when(F.col("n_key").isNull() & F.col("s_key").isNotNull(), "origin")
    return found.withColumn("upstream_kind", kind).filter("upstream_kind IS NOT NULL").select("downstream_id", "position", "upstream_kind", F.when(F.col("upstream_kind") == "node", F.col("n_id")).otherwise(F.col("s_id")).alias("upstream_id"))
