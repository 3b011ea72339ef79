"""What differs between two states of a project, as a relation of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .project import Project

#: A change before it has its node's place: four levels of order within the node, then what it says.
CHANGE = "struct<o0:int,o1:int,o2:int,o3:int,type:string,`column`:string,field:string,from_type:string,to_type:string,position:int,from_kind:string,to_kind:string>"
SAID = ("type", "node", "column", "field", "from_type", "to_type", "position", "from_kind", "to_kind")
ORDER = ("node_idx", "o0", "o1", "o2", "o3")
JOIN_CHANGES = "array<struct<position:int,from_kind:string,to_kind:string>>"


def _change(order: tuple[Column | int, ...], **values: Column | str) -> Column:
    places = [*order, *[0] * (4 - len(order))]
    names = ("column", "field", "from_type", "to_type", "position", "from_kind", "to_kind")
    cells = [F.lit(values["type"]), *(values.get(k, F.lit(None)) for k in names)]
    return F.struct(*[(F.lit(x) if isinstance(x, int) else x).alias(f"o{k}") for k, x in enumerate(places)], *[c.alias(k) for c, k in zip(cells, ("type", *names))]).cast(CHANGE)


def column_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(node, c): columns added, retyped or removed, and changes of their struct fields, one CHANGE a row.

    baseline, current: columns. Types are compared as text and only where both
    are documented; struct fields only where both shapes are known. Of baseline
    columns that share a name a lookup finds the first. One aggregation and one
    full outer join on the same key: each side is read and dealt once.
    """
    old = baseline.groupBy(F.col("node_id").alias("b_node"), F.col("column_name").alias("b_column")).agg(
        F.min(F.struct("ordinal", F.struct("data_type", "struct_fields").alias("d"))).alias("first"), F.sort_array(F.collect_list("ordinal")).alias("ordinals")
    )  # ordinals of one name in one node
    both = current.join(old, (F.col("node_id") == F.col("b_node")) & (F.col("column_name") == F.col("b_column")), "full_outer")
    place, name = F.col("ordinal"), F.col("column_name")
    was, was_fields, fields = F.col("first.d.data_type"), F.col("first.d.struct_fields"), F.col("struct_fields")
    added = F.when(F.col("b_node").isNull(), F.array(_change((0, place), type="column_added", column=name)))
    removed = F.when(F.col("node_id").isNull(), F.transform("ordinals", lambda o: _change((1, o), type="column_removed", column=F.col("b_column"))))
    retyped = F.when(F.col("data_type") != was, F.array(_change((0, place), type="column_type_changed", column=name, from_type=was, to_type=F.col("data_type"))))

    def of_ours(f: Column, k: Column) -> Column:
        before = F.filter(was_fields, lambda x: x["name"] == f["name"])
        new = _change((0, place, 1, k), type="struct_field_added", column=name, field=f["name"])
        other = _change((0, place, 1, k), type="struct_field_type_changed", column=name, field=f["name"], from_type=before[0]["data_type"], to_type=f["data_type"])
        return F.when(F.size(before) == 0, new).when(before[0]["data_type"] != f["data_type"], other)

    def of_theirs(f: Column, k: Column) -> Column:
        return F.when(~F.exists(fields, lambda x: x["name"] == f["name"]), _change((0, place, 2, k), type="struct_field_removed", column=name, field=f["name"]))

    # Only shapes that differ are looked into, so lookups never meet an empty array.
    differ = fields.isNotNull() & was_fields.isNotNull() & ~fields.eqNullSafe(was_fields)
    shaped = F.when(differ, F.filter(F.concat(F.transform(fields, of_ours), F.transform(was_fields, of_theirs)), lambda c: c.isNotNull()))
    none = F.array().cast(f"array<{CHANGE}>")
    found = F.concat(*[F.coalesce(x, none) for x in (added, removed, retyped, shaped)])
    return both.select(F.coalesce("node_id", "b_node").alias("node"), F.explode(found).alias("c"))


def align(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """An edit script from old to new: ('=', kind), ('-', kind), ('+', kind), by a longest common subsequence.

    Read from the end, equal ends are kept; otherwise an addition is taken if
    that loses nothing, else a removal.
    """
    common: dict[tuple[int, int], int] = {}
    for i in range(len(old) + 1):
        for j in range(len(new) + 1):
            common[i, j] = 0 if not i or not j else common[i - 1, j - 1] + 1 if old[i - 1] == new[j - 1] else max(common[i - 1, j], common[i, j - 1])
    script, at = [], (len(old), len(new))
    while at != (0, 0):
        i, j = at
        if i and j and old[i - 1] == new[j - 1]:
            step, at = ("=", old[i - 1]), (i - 1, j - 1)
        elif j and common[i, j - 1] >= common.get((i - 1, j), 0):
            step, at = ("+", new[j - 1]), (i, j - 1)
        else:
            step, at = ("-", old[i - 1]), (i - 1, j)
        script.insert(0, step)
    return script


def join_edits(old: list[str] | None, new: list[str] | None) -> list[dict]:
    """Changes of a join sequence. A removal right before an addition is one change of kind; positions count what the new sequence has so far."""
    out, position, pending = [], 0, None

    def flush() -> None:
        nonlocal pending
        if pending is not None:
            out.append({"position": position, "from_kind": pending, "to_kind": None})
            pending = None

    for op, kind in align(old or [], new or []):
        if op == "-":
            flush()
            pending = kind
        elif op == "+":
            out.append({"position": position, "from_kind": pending, "to_kind": kind})
            pending, position = None, position + 1
        else:
            flush()
            position += 1
    flush()
    return out


def join_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(node, c): changes of nodes' join sequences; only nodes whose sequences differ reach the alignment."""
    edits = F.udf(join_edits, JOIN_CHANGES, useArrow=True)
    pairs = current.select("node_id", "joins").join(baseline.select(F.col("node_id").alias("b_node"), F.col("joins").alias("b_joins")), F.col("node_id") == F.col("b_node"))
    each = pairs.filter("NOT joins <=> b_joins").select(F.col("node_id").alias("node"), F.posexplode(edits("b_joins", "joins")).alias("k", "e"))
    return each.select("node", _change((2, F.col("k")), type="join_changed", position=F.col("e.position"), from_kind=F.col("e.from_kind"), to_kind=F.col("e.to_kind")).alias("c"))


def indexed(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """df with one column in place of those of order: an array that sorts as they do, so that no global sort is needed."""
    rest = [c for c in df.columns if c not in order]
    return df.select(F.concat(*[F.col(c) if dict(df.dtypes)[c].startswith("array") else F.array(F.col(c).cast("long")) for c in order]).alias(name), *[F.col(f"`{c}`") for c in rest])


def diff(baseline: Project, current: Project) -> DataFrame:
    """changes of schemas.py, in report order: by current node, its columns, then what it lost, then its joins.

    Nodes that only one state has give nothing.
    """
    shared = current.nodes.select("node_idx", "node_id").join(baseline.nodes.select("node_id"), "node_id")
    found = column_changes(baseline.columns, current.columns).unionByName(join_changes(baseline.nodes, current.nodes))
    placed = found.join(shared, F.col("node") == F.col("node_id")).select("node_idx", "node", "c.*")
    return indexed(placed.select(*ORDER, *SAID), ORDER, "change_idx")
