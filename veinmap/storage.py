"""Cut lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_written: list[str] = []
_held: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent a local master gets a folder of its own; a real
    cluster without the setting is refused, since a machine-local folder would
    lose data there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="veinmap-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/veinmap/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written() -> int:
    """How many paths this process has taken in the shared folder and not discarded."""
    return len(_written)


def discard(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Remove what this process wrote to the shared folder since written() was so many, but for paths that hold one of the names in keep; for what has been read. Returns how many paths were there."""
    gone, kept = 0, [p for p in _written[since:] if any(f"/{k}-" in p for k in keep)]
    for name in [p for p in _written[since:] if p not in kept]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written[since:] = kept
    return gone


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """df, cached until release()."""
    _held.append(df.cache())
    return _held[-1]


def release() -> None:
    """Let go of what hold() keeps. What is still in use is worked out again; files that have changed since are read anew."""
    while _held:
        _held.pop().unpersist()


def local(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows held by the driver as a local relation: its size is known to the planner, which then need not shuffle it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)
