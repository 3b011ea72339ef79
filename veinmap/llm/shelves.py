"""Rows by key as files in the shared folder, which workers look up instead of having them joined to their own rows.

A shelf has buckets of about BUCKET_BYTES, picked by a hash of the key. A worker
reads a bucket when it first needs it and keeps those used last, KEPT bytes of
them. Where a shelf is larger than that, whoever looks things up should have its
rows come in order of their buckets.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch
from .files import filesystem, new_file

BUCKET_BYTES = 4 << 20
KEPT = 32 << 20

_kept: dict[tuple[str, int], tuple[list, int]] = {}


@dataclass(frozen=True)
class Shelf:
    """Where a shelf stands, its buckets, and the bytes of its rows in all."""

    folder: str
    buckets: int
    size: int

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def holds(self, bucket: int) -> bool:
        return (self.folder, bucket) in _kept

    def rows(self, bucket: int) -> list[tuple]:
        """The rows of a bucket; none if no row fell into it."""
        at = self.folder, bucket
        found = _kept.pop(at, None)
        if found is None:
            fs, path = filesystem(f"{self.folder}/bucket-{bucket}")
            data = b""
            if fs.get_file_info(path).is_file:
                with fs.open_input_stream(path, compression=None) as f:
                    data = f.read()
            found = pickle.loads(data) if data else [], len(data)
            while _kept and sum(n for _, n in _kept.values()) + len(data) > KEPT:
                _kept.pop(next(iter(_kept)))
        _kept[at] = found
        return found[0]


def put_on_shelf(rows: DataFrame, name: str, key: str = "host") -> Shelf:
    """Shelve rows by a column. Each bucket is written by one task, which a lost executor lets another do again."""
    spark = rows.sparkSession
    rows = materialize(rows, name)
    sized = [F.length(f.name) if f.dataType.simpleString() in ("string", "binary") else 12 * F.size(f.name) if f.dataType.simpleString().startswith("array") else F.lit(8) for f in rows.schema]
    size = int(rows.agg(F.sum(sum((F.coalesce(F.greatest(x, F.lit(0)), F.lit(0)) for x in sized), F.lit(0)))).first()[0] or 0)
    shelf = Shelf(scratch(spark, f"{name}-shelf"), max(1, -(-size // BUCKET_BYTES)), size)
    names = rows.columns

    def write(batches):
        import pyarrow as pa

        bucket, held = None, []

        def put():
            with new_file(f"{shelf.folder}/bucket-{bucket}") as out:
                out.write(pickle.dumps(held))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for k, row in zip(batch.column("_bucket").to_pylist(), zip(*columns)):
                if k != bucket:
                    if held:
                        put()
                    bucket, held = k, []
                held.append(row)
        if held:
            put()
        yield pa.RecordBatch.from_pydict({"done": pa.array([True])})

    dealt = rows.withColumn("_bucket", shelf.bucket(F.col(key))).repartition("_bucket").sortWithinPartitions("_bucket")
    dealt.mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()
    return shelf
