"""Small models and what each says of its columns, one family per registered query.

Relations: t (id, a, b) and u (id, c) are models, raw is a source. A case is SQL
and the sources of each column, or None where the schema is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.shapes import Catalog, Known, Upstream, query_shape
from .operators import diffing, graph
from .plans.catalyst import SqlParser
from .storage import local

RELATIONS = {("d", "s", "t"): Upstream("node", "t"), ("d", "s", "u"): Upstream("node", "u"), ("d", "s", "raw"): Upstream("origin", "raw")}
COLUMNS = {"t": ["id", "a", "b"], "u": ["id", "c"]}

EXPRESSIONS = {
    "paths": ("select a.f.g as v, x.b.h as w from {t} x", {"v": "t.a", "w": "t.b"}),
    "variant path": ("select a:p.q as v from {t}", {"v": "t.a"}),
    "subscripts": ("select a[id] as v, x.b[0].f as w, a['k'] as m from {t} x", {"v": "t.a,t.id", "w": "t.b", "m": "t.a"}),
    "calls": ("select coalesce(a, b, 0) as v, sum(a) filter (where b > 1) as w from {t}", {"v": "t.a,t.b", "w": "t.a"}),
    "window calls": ("select row_number() over (partition by a order by b) as n, sum(a) over () + b as m from {t}", {"n": "", "m": "t.b"}),
    "casts": ("select cast(a as int) as x, b::int as y, try_cast(id as int) as z from {t}", {"x": "t.a", "y": "t.b", "z": "t.id"}),
    "unary, extract": ("select -a as p, not b as q, extract(year from id) as r from {t}", {"p": "t.a", "q": "t.b", "r": "t.id"}),
    "position": ("select position(a in b) as v from {t}", {"v": "t.a,t.b"}),
    "substring": ("select substring(a from id for 2) as v from {t}", {"v": "t.a,t.id"}),
    "trim": ("select trim(both 'x' from a) as v from {t}", {"v": "t.a"}),
    "overlay": ("select overlay(a placing b from 1) as v from {t}", {"v": "t.a,t.b"}),
    "binary operators": ("select a + b * id as v, a || b as w, a > b and id = 1 as x from {t}", {"v": "t.a,t.b,t.id", "w": "t.a,t.b", "x": "t.a,t.b,t.id"}),
    "case": ("select case a when 1 then b else id end as v from {t}", {"v": "t.a,t.b,t.id"}),
    "silent predicates": ("select a is null as p, b in (1) as q, a between b and id as r, a like 'x' as s from {t}", {"p": "", "q": "", "r": "", "s": ""}),
    "silent subqueries": ("select (select max(c) from {u}) as v, exists (select 1 from {u}) as w from {t}", {"v": "", "w": ""}),
    "names without parentheses": ("select current_date as d, a from {t}", {"d": "", "a": "t.a"}),
}
NAMES = {
    "one relation": ("select a, b as bb from {t}", {"a": "t.a", "bb": "t.b"}),
    "many relations": ("select c, a from {t} x join {u} y on x.id = y.id", {"c": "", "a": ""}),
    "qualified": ("select x.a, y.c from {t} x join {u} y on x.id = y.id", {"a": "t.a", "c": "u.c"}),
    "one open relation": ("with k as (select id as kid from {u}) select kid, a from {t} x join k on x.id = k.kid", {"kid": "u.id", "a": "t.a"}),
    "two ctes with the column": ("with k as (select a from {t}), l as (select c as a from {u}) select a from k join l on true", {"a": ""}),
    "hop": ("with k as (select a + b as s from {t}) select s from k", {"s": "t.a,t.b"}),
    "same alias twice": ("select x.a from {t} x join {u} x on true", {"a": ""}),
    "star over two relations": ("select *, 1 as one from {t} x join {u} y on x.id = y.id", None),
    "star over a model": ("select *, 1 as one from {t}", {"id": "t.id", "a": "t.a", "b": "t.b", "one": ""}),
    "star of an alias": ("select y.*, x.a from {t} x join {u} y on x.id = y.id", {"id": "u.id", "c": "u.c", "a": "t.a"}),
    "star over a source": ("select *, 1 as one from {raw}", None),
    "unnamed expression": ("select a  +\n b from {t}", {"a + b": "t.a,t.b"}),
    "set operation": ("select a from {t} union all select c from {u}", None),
    "text that does not parse": ("select (a from {t}", None),
}
DIALECTS = {
    "type names": ("select a::varchar as v, b::timestamptz as w, cast(id as text) as x, a::number(10,2) as y, b::double precision as z from {t}", {"v": "t.a", "w": "t.b", "x": "t.id", "y": "t.a", "z": "t.b"}),
    "time zone": ("select a at time zone 'utc' as v, id::int8 as w from {t}", {"v": "", "w": "t.id"}),
    "array constructor": ("select array[a, b] as v, a[1] as w from {t}", {"v": "", "w": "t.a"}),
    "json arrows": ("select a->>'k' as v, a->'p'->>'q' as w from {t}", {"v": "t.a", "w": "t.a"}),
    "regular expressions": ("select a ~ 'x' as v, a !~* b as w from {t}", {"v": "t.a", "w": "t.a,t.b"}),
    "safe cast": ("select safe_cast(a as int64) as v from {t}", {"v": "t.a"}),
    "exclude": ("select * exclude (a) from {t}", None),
    "materialized": ("with k as materialized (select a from {t}) select a from k", {"a": "t.a"}),
    "fetch first": ("select a from {t} order by b fetch first 10 rows only", {"a": "t.a"}),
    "distinct on": ("select distinct on (a) b from {t}", {"b": "t.b"}),
    "qualify": ("select a from {t} qualify row_number() over (partition by a order by b) = 1", {"a": "t.a"}),
}
STRUCTS = {
    "cast(a as struct<f int, g decimal(10,2)>)": "f INT,g DECIMAL(10,2)",
    "struct<f int, g struct<h: string>>(a, b)": "f INT,g STRUCT<h: STRING>",
    "struct(a as f, b as g)": "f ?,g ?",
    "struct(a as f, b)": None,
    "named_struct('f', a, 'g', b)": "f ?,g ?",
    "named_struct(a, b)": None,
    "a": None,
}
#: Old and new join kinds of a model, and the changes between them: (position, from, to).
JOINS = {
    "nothing": ("left inner", "left inner", []),
    "kind": ("left inner", "full inner", [(0, "left", "full")]),
    "added": ("left", "left cross", [(1, None, "cross")]),
    "removed": ("left cross inner", "left inner", [(1, "cross", None)]),
    "first": ("", "inner", [(0, None, "inner")]),
    "last": ("inner", "", [(0, "inner", None)]),
    "one by two": ("left", "inner full", [(0, "left", "inner"), (1, None, "full")]),
    "swapped": ("left inner", "inner left", [(0, "left", None), (1, None, "left")]),
}
TARGETS = {"m": ("m", None, "both"), "+m": ("m", None, "upstream"), "m+": ("m", None, "downstream"), "+m+": ("m", None, "both"), "m.c": ("m", "c", "both"), "+m.c": ("m", "c", "upstream"), "m.c.d+": ("m", "c.d", "downstream")}


def _shape(parsed):
    found = query_shape(parsed, Catalog(RELATIONS, COLUMNS)) if parsed else None
    return found if isinstance(found, Known) else None


def sources(spark: SparkSession, cases: dict) -> DataFrame:
    """(case, column, sources): a row per column; one without a column where the schema is unknown."""
    texts = [sql.format(t='"d"."s"."t"', u='"d"."s"."u"', raw='"d"."s"."raw"') for sql, _ in cases.values()]
    rows = []
    for name, parsed in zip(cases, SqlParser(spark).parse_all(texts)):
        shape = _shape(parsed)
        rows += [(name, None, None)] if shape is None else [(name, c.name, ",".join(f"{up.id}.{x}" for up, x in c.sources)) for c in shape.columns]
    return local(spark, rows, "`case` string, `column` string, sources string")


def source_rows(cases: dict) -> list[tuple]:
    return [(name, c, s) for name, (_, expected) in cases.items() for c, s in ([(None, None)] if expected is None else expected.items())]


def structs(spark: SparkSession) -> DataFrame:
    """(expression, fields): the struct shape that an expression states, unknown types as ?."""
    parsed = SqlParser(spark).parse_all([f'select {e} as v from "d"."s"."t"' for e in STRUCTS])
    fields = [_shape(p).columns[0].fields for p in parsed]
    return local(spark, [(e, None if f is None else ",".join(f"{n} {k or '?'}" for n, k in f)) for e, f in zip(STRUCTS, fields)], "expression string, fields string")


def joins(spark: SparkSession) -> DataFrame:
    """(node, position, from_kind, to_kind): changes of the join sequences, by the operator that diffs projects."""
    old, new = (local(spark, [(k, name, x[side].split()) for k, (name, x) in enumerate(JOINS.items())], "node_idx long, node_id string, joins array<string>") for side in (0, 1))
    return diffing.join_changes(old, new).select("node", "c.position", "c.from_kind", "c.to_kind")


def targets(spark: SparkSession) -> DataFrame:
    return local(spark, [(t, *graph.parse_target(t)) for t in TARGETS], "target string, model string, `column` string, direction string")
