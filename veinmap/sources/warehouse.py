"""Live looks at whether a model's relation exists."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..storage import local
from .config import split_words

#: Adapter types that the macro strategy supports.
ADAPTERS = ("snowflake", "bigquery", "databricks", "duckdb")
MARKER = "VEINMAP_RELATION_EXISTS:"
MACRO = "veinmap_relation_exists"
MACRO_BODY = (
    "{% macro " + MACRO + "(relation_database=none, relation_schema=none, relation_identifier=none) %}\n"
    "  {% set found = adapter.get_relation(database=relation_database, schema=relation_schema, identifier=relation_identifier) %}\n"
    '  {{ log("' + MARKER + '" ~ ("true" if found is not none else "false"), info=True) }}\n'
    "{% endmacro %}\n"
)


class WarehouseError(Exception):
    """A look that failed or gave no clear answer."""


Lookup = Callable[[str | None, str | None, str], bool]


def spark_catalog(spark: SparkSession) -> Lookup:
    """Looks into the session's catalog."""

    def exists(database: str | None, schema: str | None, identifier: str) -> bool:
        return spark.catalog.tableExists(".".join(f"`{x.replace('`', '``')}`" for x in (database, schema, identifier) if x))

    return exists


def dbt_macro(project_dir: Path, command: str = "dbt", extra: list[str] = ()) -> Lookup:
    """Asks the warehouse by a macro, written for the call and removed after it."""

    def exists(database: str | None, schema: str | None, identifier: str) -> bool:
        folder = Path(project_dir) / "macros"
        folder.mkdir(parents=True, exist_ok=True)
        macro = folder / f"__{MACRO}_{os.getpid()}.sql"
        macro.write_text(MACRO_BODY)
        args = {k: v for k, v in (("relation_database", database), ("relation_schema", schema), ("relation_identifier", identifier)) if v is not None}
        try:
            done = subprocess.run([*split_words(command, "dbt command"), "run-operation", MACRO, "--args", json.dumps(args), *extra], cwd=project_dir, capture_output=True, text=True)
        except OSError as e:
            raise WarehouseError(f"could not run {command!r}: {e}") from e
        finally:
            macro.unlink(missing_ok=True)
        if done.returncode:
            raise WarehouseError(f"dbt run-operation failed:\n{done.stderr}")
        answer = next((line.split(MARKER, 1)[1].strip() for line in done.stdout.splitlines() if MARKER in line), None)
        if answer not in ("true", "false"):
            raise WarehouseError(f"no clear answer: {answer!r}")
        return answer == "true"

    return exists


def unsupported(adapter_type: str | None) -> str | None:
    """Why relations of such a warehouse cannot be looked up; None where they can."""
    if adapter_type is None:
        return "the manifest does not say which warehouse it is for"
    return None if adapter_type in ADAPTERS else f"no lookups in {adapter_type!r} warehouses"


def check_relations(identities: DataFrame, nodes: list[str], lookup: Lookup) -> tuple[DataFrame, list[str]]:
    """((node, present) for the nodes, and what failed). A failed or impossible look leaves present NULL. nodes: those of a report."""
    spark = identities.sparkSession
    wanted = local(spark, [(n,) for n in dict.fromkeys(nodes)], "node_id string")
    rows, failed = [], []
    for r in identities.join(wanted, "node_id", "left_semi").collect():
        try:
            rows.append((r.node_id, lookup(r.database, r.schema, r.identifier)))
        except WarehouseError as e:
            failed.append(str(e))
            rows.append((r.node_id, None))
    return local(spark, rows, "node string, present boolean"), failed
