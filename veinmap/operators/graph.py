"""Graph operators over lineage edges: closures of nodes and of columns, layers, build sets, degrees.

Closures run as frontier loops of joins. Each level is written to the shared
folder, so plans stay short and lost executors cost one level. Small graphs
(SMALL edges or fewer, counted first) are walked on the driver with the same
rows. Rows come with their depth and their rank: their place in breadth-first
order, from 0, in which a row's successors stand in the order of their edges.
Rows of kind unresolved have the depth and rank of the column at which the walk
first ended; the order of all rows is that of depth, then rank.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import local, materialize
from .project import Project

#: Edges that a driver holds easily: some tens of MB.
SMALL = 200_000
MAX_LEVELS = 100_000


class LineageError(Exception):
    """A target that is unknown, ambiguous, or lacks the column asked for."""


class UnknownTarget(LineageError):
    def __init__(self, name: str):
        super().__init__(f"no model named {name!r} found")


class AmbiguousTarget(LineageError):
    def __init__(self, name: str, ids: list[str]):
        self.ids = ids
        super().__init__(f"{name!r} matches more than one model: {', '.join(ids)}; narrow it with --package")


class UnknownColumn(LineageError):
    def __init__(self, model: str, column: str):
        super().__init__(f"model {model!r} has no column {column!r}")


def parse_target(text: str) -> tuple[str, str | None, str]:
    """(model, column, direction) of [+]model[.column][+]; both sides unless one plus says which."""
    up, down = text.startswith("+"), len(text) > 1 and text.endswith("+")
    name = text[up : len(text) - down]
    model, dot, column = name.partition(".")
    return model, column if dot else None, "both" if up == down else "upstream" if up else "downstream"


def find_node(project: Project, name: str, package: str | None = None) -> str:
    """The id of the model of that name, in that package if one is given."""
    found = project.nodes.filter(F.col("name") == name)
    if package is not None:
        found = found.filter(F.col("package") == package)
    ids = sorted(r.node_id for r in found.select("node_id").collect())  # nodes of one name
    if not ids:
        raise UnknownTarget(name)
    if len(ids) > 1:
        raise AmbiguousTarget(name, ids)
    return ids[0]


def _oriented(edges: DataFrame, side: str) -> DataFrame:
    """Edges as (edge_idx, at, at_column, kind, to, to_column): from where a walk stands to where it goes."""
    if side == "upstream":
        names = ("downstream_id", "downstream_column", F.col("upstream_kind"), "upstream_id", "upstream_column")
        rows = edges
    else:
        names = ("upstream_id", "upstream_column", F.lit("node"), "downstream_id", "downstream_column")
        rows = edges.filter("upstream_kind = 'node'")
    return rows.select("edge_idx", F.col(names[0]).alias("at"), F.col(names[1]).alias("at_column"), names[2].alias("kind"), F.col(names[3]).alias("to"), F.col(names[4]).alias("to_column"))


def _level(rows: DataFrame, order: str, first: int, name: str) -> tuple[DataFrame, int]:
    """(rows stored in order, with a rank that counts from first; how many). Ranks come from places in parts and sums over parts, of which there are few."""
    place = F.monotonically_increasing_id()  # the part in the upper 31 bits, the place in the lower 33
    stored = materialize(rows.orderBy(order).drop(order).withColumn("place", place), name)
    parts = sorted(tuple(r) for r in stored.groupBy(F.shiftright("place", 33).alias("part")).count().collect())  # one row per part
    if not parts:
        return stored.withColumnRenamed("place", "rank"), 0
    bases = dict(zip((p for p, _ in parts), accumulate((n for _, n in parts), initial=first)))
    base = F.lit(first) if len(parts) == 1 else F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in bases.items() for x in kv]), F.shiftright("place", 33))
    rank = base + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("place", rank.cast("long")).withColumnRenamed("place", "rank"), sum(n for _, n in parts)


class TooDeep(LineageError):
    def __init__(self):
        super().__init__(f"a walk went on for more than {MAX_LEVELS} levels")


class _Visited:
    """Levels reached so far, as one relation: their files side by side, rewritten as one when there are many."""

    def __init__(self, first: DataFrame, most: int = 16):
        self.levels, self.most = [first], most

    def add(self, level: DataFrame) -> None:
        self.levels.append(level)
        if len(self.levels) > self.most:
            self.levels = [materialize(self.all(), "visited")]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.levels)


REACHED = "kind string, id string, depth int, rank long"
REACHED_COLUMNS = "kind string, id string, `column` string, depth int, rank long"


def closure(edges: DataFrame, seeds: DataFrame, side: str, small: int = SMALL) -> DataFrame:
    """(kind, id, depth, rank) of all that seeds (id) reach, seeds excluded; origins end a walk."""
    steps = _oriented(edges, side).select("edge_idx", "at", "kind", "to")
    spark = edges.sparkSession
    if (few := _few(steps, small)) is not None and (starts := _few(seeds.select("id"), small)) is not None:
        return local(spark, _walk_nodes(few, [x for (x,) in starts]), REACHED)
    steps = materialize(steps, "edges")
    began = materialize(seeds.select("id", F.monotonically_increasing_id().alias("o")), "seeds").groupBy("id").agg(F.min("o").alias("o"))
    frontier, _ = _level(began.select(F.lit("node").alias("kind"), "id", F.lit(0).alias("depth"), "o"), "o", 0, "frontier")
    visited, found = _Visited(frontier), 0
    for depth in range(1, MAX_LEVELS):
        reached = frontier.filter("kind = 'node'").join(steps.withColumnRenamed("kind", "to_kind"), F.col("id") == F.col("at")).groupBy(F.col("to_kind").alias("kind"), F.col("to").alias("id")).agg(F.min(F.struct("rank", "edge_idx")).alias("o"))
        fresh = reached.join(visited.all().select("kind", "id"), ["kind", "id"], "left_anti")
        frontier, n = _level(fresh.select("kind", "id", F.lit(depth).alias("depth"), "o"), "o", found, "frontier")
        if not n:
            return visited.all().filter("depth > 0")
        found += n
        visited.add(frontier)
    raise TooDeep


def _few(df: DataFrame, most: int) -> list[tuple] | None:
    """The rows of df on the driver if there are most or fewer, else None."""
    found = df.limit(most + 1).toArrow()
    return list(zip(*(c.to_pylist() for c in found.columns))) if found.num_rows <= most else None


def _walk_nodes(steps: list[tuple], seeds: list[str]) -> list[tuple]:
    out_of = defaultdict(list)
    for _, at, kind, to in sorted(steps, key=lambda s: s[0]):
        out_of[at].append((kind, to))
    level, seen, out, depth = list(dict.fromkeys(seeds)), {("node", s) for s in seeds}, [], 0
    while level:
        depth += 1
        reached = dict.fromkeys(x for at in level for x in out_of[at] if x not in seen)
        seen |= reached.keys()
        out += [(kind, to, depth, len(out) + k) for k, (kind, to) in enumerate(reached)]
        level = [to for kind, to in reached if kind == "node"]
    return out


def column_closure(edges: DataFrame, seeds: DataFrame, side: str, small: int = SMALL) -> DataFrame:
    """(kind, id, column, depth, rank) of all columns that seeds (id, column) reach, over edges that name columns.

    A visited column on a node that has edges on this side, none of which names
    the column, gives one row of kind 'unresolved' for its node, without column;
    the walk ends there.
    """
    steps = _oriented(edges, side)
    spark = edges.sparkSession
    if (few := _few(steps, small)) is not None and (starts := _few(seeds.select("id", "column"), small)) is not None:
        return local(spark, _walk_columns(few, starts), REACHED_COLUMNS)
    steps = materialize(steps, "edges")
    nodes = materialize(steps.select(F.col("at").alias("id")).distinct(), "connected")
    named = steps.filter("at_column IS NOT NULL").withColumnRenamed("kind", "to_kind")
    began = materialize(seeds.select("id", "column", F.monotonically_increasing_id().alias("o")), "seeds").groupBy("id", "column").agg(F.min("o").alias("o"))
    frontier, _ = _level(began.select(F.lit("node").alias("kind"), "id", "column", F.lit(0).alias("depth"), "o"), "o", 0, "frontier")
    visited, stuck, found = _Visited(frontier), None, 0
    key = ["kind", "id", "column"]
    for depth in range(1, MAX_LEVELS):
        here = frontier.filter("kind = 'node'")
        on = (F.col("id") == F.col("at")) & (F.col("column") == F.col("at_column"))
        ended = here.join(named.select("at", "at_column"), on, "left_anti").join(nodes, "id", "left_semi").select("id", "depth", "rank")
        ended = materialize(ended, "unresolved")
        if stuck is None:
            stuck = _Visited(ended)
        else:
            stuck.add(ended)
        reached = here.join(named, on).groupBy(F.col("to_kind").alias("kind"), F.col("to").alias("id"), F.col("to_column").alias("column")).agg(F.min(F.struct("rank", "edge_idx")).alias("o"))
        fresh = reached.join(visited.all().select(*key), key, "left_anti")
        frontier, n = _level(fresh.select(*key, F.lit(depth).alias("depth"), "o"), "o", found, "frontier")
        if not n:
            break
        found += n
        visited.add(frontier)
    else:
        raise TooDeep
    once = stuck.all().groupBy("id").agg(F.min(F.struct("depth", "rank")).alias("o")).select(F.lit("unresolved").alias("kind"), "id", F.lit(None).cast("string").alias("column"), "o.depth", "o.rank")
    return visited.all().filter("depth > 0").unionByName(once)


def _walk_columns(steps: list[tuple], seeds: list[tuple[str, str]]) -> list[tuple]:
    out_of, connected = defaultdict(list), set()
    for _, at, at_column, kind, to, to_column in sorted(steps, key=lambda s: s[0]):
        connected.add(at)
        if at_column is not None:
            out_of[at, at_column].append((kind, to, to_column))
    level, out, depth, stuck = [(rank, *s) for rank, s in enumerate(dict.fromkeys(seeds))], [], 0, {}
    seen = {("node", node, column) for _, node, column in level}
    while level:
        for rank, node, column in level:
            if node in connected and not out_of.get((node, column)):
                stuck.setdefault(node, (depth, rank))
        depth += 1
        reached = dict.fromkeys(x for _, node, column in level for x in out_of.get((node, column), ()) if x not in seen)
        seen |= reached.keys()
        level = [(rank, to, column) for rank, (kind, to, column) in enumerate(reached, len(out)) if kind == "node"]
        out += [(*x, depth, rank) for rank, x in enumerate(reached, len(out))]
    return out + [("unresolved", node, None, d, rank) for node, (d, rank) in stuck.items()]


def trace(project: Project, name: str, direction: str = "both", package: str | None = None, small: int = SMALL) -> DataFrame:
    """(side, kind, id, depth, rank): what a model is made from and what is made from it."""
    start = local(project.nodes.sparkSession, [(find_node(project, name, package),)], "id string")
    return _sides(lambda side: closure(project.edges, start, side, small), direction)


def trace_column(project: Project, name: str, column: str, direction: str = "both", package: str | None = None, small: int = SMALL) -> DataFrame:
    """(side, kind, id, column, depth, rank): what a column is made from and what is made from it."""
    node = find_node(project, name, package)
    if project.columns.filter((F.col("node_id") == node) & (F.col("column_name") == column)).isEmpty():
        raise UnknownColumn(name, column)
    start = local(project.nodes.sparkSession, [(node, column)], "id string, `column` string")
    return _sides(lambda side: column_closure(project.edges, start, side, small), direction)


def _sides(walk, direction: str) -> DataFrame:
    sides = [s for s in ("upstream", "downstream") if direction in (s, "both")]
    found = [walk(s).select(F.lit(s).alias("side"), "*") for s in sides]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, layer): 0 without an upstream, else one more than the furthest upstream; origins count as 0.

    Only nodes that moved pass their layer on. Rounds are bounded by the number
    of nodes, so cycles end as well.
    """
    between = materialize(edges.select(F.when(F.col("upstream_kind") == "node", F.col("upstream_id")).alias("up"), F.col("downstream_id").alias("d")).distinct(), "edges")
    least = between.groupBy("d").agg(F.lit(1).alias("least"))
    found, rounds = nodes.select("node_id", F.lit(0).alias("layer")), max(1, nodes.count())
    for _ in range(rounds):
        raised = F.greatest("layer", F.coalesce("least", F.lit(0)))
        state = materialize(found.join(least, F.col("node_id") == F.col("d"), "left").select("node_id", raised.alias("layer"), (raised > F.col("layer")).alias("moved")), "layers")
        found, moved = state.select("node_id", "layer"), state.filter("moved")
        if moved.isEmpty():
            break
        least = moved.join(between, F.col("node_id") == F.col("up")).groupBy("d").agg((F.max("layer") + 1).alias("least"))
    return found


def defer_set(edges: DataFrame, build: DataFrame, small: int = SMALL) -> DataFrame:
    """(id): nodes upstream of those in build (id) that are not in it themselves; ordered by id."""
    return closure(edges.filter("upstream_kind = 'node'"), build, "upstream", small).select("id").orderBy("id")


def out_degrees(project: Project) -> DataFrame:
    """(kind, id, consumers): how many edges start at each node and origin, 0 for those without."""
    every = project.nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(project.origins.select(F.lit("origin").alias("kind"), F.col("origin_id").alias("id")))
    counts = project.edges.groupBy(F.col("upstream_kind").alias("kind"), F.col("upstream_id").alias("id")).agg(F.count("*").alias("n"))
    return every.join(counts, ["kind", "id"], "left").select("kind", "id", F.coalesce("n", F.lit(0)).alias("consumers"))


def exported_nodes(project: Project) -> DataFrame:
    """(kind, id, name, layer, place): the whole graph's nodes, by layer, then name; origins before nodes among equals."""
    placed = layers(project.nodes, project.edges)
    every = project.origins.select(F.lit("origin").alias("kind"), F.col("origin_id").alias("id"), "name", F.lit(0).alias("layer"), F.lit(0).alias("first"))
    every = every.unionByName(project.nodes.join(placed, "node_id").select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "name", "layer", F.lit(1).alias("first")))
    # Sorted in parts of their own; the place in a layer comes from the places in parts and sums over parts, so no layer has to fit in a task.
    sorted_ = materialize(every.orderBy("layer", "name", "first", "id").withColumn("at", F.monotonically_increasing_id()), "exported")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted_.groupBy("layer", part).agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("layer").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per layer and part
    bases = sizes.select(F.col("layer").alias("b_layer"), F.col("part").alias("b_part"), "least", before.alias("before"))
    placed = sorted_.join(bases, (F.col("layer") == F.col("b_layer")) & (F.shiftright("at", 33) == F.col("b_part")))
    return placed.select("kind", "id", "name", "layer", (F.col("before") + F.col("at") - F.col("least") + 1).cast("int").alias("place"))
