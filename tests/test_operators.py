"""Diff, rules, graph and report on small hand-made projects."""

import itertools
import random

import pytest

from veinmap import schemas
from veinmap.operators import diffing, graph, report, rules
from veinmap.operators.project import Project
from veinmap.text import report_text, trace_text


def project(spark, nodes, edges=(), origins=()):
    """nodes: {id: (columns, joins, materialization)}; columns: (name, type, fields or None)."""
    n, c = [], []
    for k, (i, spec) in enumerate(nodes.items()):
        columns, joins, kind = (*spec, [], "table")[:3] if len(spec) == 1 else (*spec, "table")[:3]
        n.append((k, i, i.split(".")[-1], i.split(".")[1] if i.count(".") > 1 else None, kind, list(joins), False))
        c += [(i, o, x[0], x[1] if len(x) > 1 else None, None, list(x[2]) if len(x) > 2 and x[2] is not None else None) for o, x in enumerate(columns)]
    e = [(k, *x) for k, x in enumerate(edges)]
    make = spark.createDataFrame
    return Project(make(n, schemas.NODES), make(c, schemas.COLUMNS), make(list(origins), schemas.ORIGINS), make(e, schemas.EDGES))


def changes_of(spark, old, new):
    rows = diffing.diff(project(spark, old), project(spark, new)).orderBy("change_idx").collect()
    return [tuple(v for v in (r.type, r.node, r.column, r.field, r.from_type, r.to_type, r.position, r.from_kind, r.to_kind) if v is not None) for r in rows]


def test_column_changes_come_in_report_order(spark):
    old = {"m": ([("a", "int"), ("b", "int"), ("gone",), ("e", "int")],)}
    new = {"m": ([("b", "bigint"), ("new",), ("a", "int"), ("e", None)],)}
    assert changes_of(spark, old, new) == [("column_type_changed", "m", "b", "int", "bigint"), ("column_added", "m", "new"), ("column_removed", "m", "gone")]


def test_types_are_compared_as_text_and_only_where_both_are_known(spark):
    assert changes_of(spark, {"m": ([("a", "BIGINT"), ("b", None), ("c", "int")],)}, {"m": ([("a", "bigint"), ("b", "int"), ("c", None)],)}) == [("column_type_changed", "m", "a", "BIGINT", "bigint")]


def test_names_keep_their_case(spark):
    assert changes_of(spark, {"m": ([("a",)],)}, {"m": ([("A",)],)}) == [("column_added", "m", "A"), ("column_removed", "m", "a")]


def test_new_and_lost_nodes_give_nothing(spark):
    assert changes_of(spark, {"m": ([("a",)],)}, {"n": ([("a",)],)}) == []


def test_struct_fields(spark):
    old = {"m": ([("s", None, [("f", "int"), ("g", None), ("h", "int")]), ("u", None, None)],)}
    new = {"m": ([("s", None, [("h", "bigint"), ("f", None), ("k", None)]), ("u", None, [("x", None)])],)}
    assert changes_of(spark, old, new) == [("struct_field_type_changed", "m", "s", "h", "int", "bigint"), ("struct_field_added", "m", "s", "k"), ("struct_field_removed", "m", "s", "g")]


def test_nodes_follow_the_current_order_and_joins_come_last(spark):
    old = {"b": ([("x",)], ["inner"]), "a": ([("x",)],)}
    new = {"a": ([("y",)],), "b": ([], ["left"])}
    assert changes_of(spark, old, new) == [("column_added", "a", "y"), ("column_removed", "a", "x"), ("column_removed", "b", "x"), ("join_changed", "b", 0, "inner", "left")]


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        (["left", "left"], ["inner", "inner"], [(0, "left", None), (0, "left", "inner"), (1, None, "inner")]),
        (["inner"], ["left"], [(0, "inner", "left")]),
        (["inner", "inner"], ["inner", "left", "inner"], [(1, None, "left")]),
        (["inner", "left", "full"], ["inner", "full"], [(1, "left", None)]),
        ([], ["cross"], [(0, None, "cross")]),
        (["cross"], [], [(0, "cross", None)]),
        (["left", "inner"], ["left", "inner"], []),
        (None, None, []),
    ],
)
def test_join_edits(old, new, expected):
    assert [(x["position"], x["from_kind"], x["to_kind"]) for x in diffing.join_edits(old, new)] == expected


def test_alignment_is_shortest_and_leads_from_old_to_new():
    random.seed(1)
    kinds = ["inner", "left", "right", "full"]
    for _ in range(200):
        old, new = ([random.choice(kinds) for _ in range(random.randint(0, 6))] for _ in "ab")
        script = diffing.align(old, new)
        assert [k for op, k in script if op != "+"] == old and [k for op, k in script if op != "-"] == new
        best = max(n for n in range(len(old) + 1) for c in itertools.combinations(old, n) if _is_subsequence(c, new))
        assert sum(op == "=" for op, _ in script) == best


def _is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_rules(spark):
    old = {"m": ([("a", "bigint"), ("b", " INT "), ("c", "varchar"), ("d", "integer"), ("gone",)], ["inner", "left", "full", "cross"])}
    new = {"m": ([("a", "int"), ("b", "SmallInt"), ("c", "int"), ("d", "int"), ("new",)], ["left", "right", "inner", "full"])}
    edges = [("node", "m", "x", "gone", "g"), ("node", "m", "y", "gone", "h"), ("node", "m", "y", "a", "a"), ("origin", "m", "z", "gone", "z"), ("node", "m", "y", None, None)]
    p = project(spark, old, edges)
    found = rules.evaluate(p.edges, diffing.diff(p, project(spark, new))).orderBy("finding_idx").collect()
    assert [(r.severity, r.rule, r.column, r.reached, r.reached_column, r.position) for r in found] == [
        ("warn", "column-type-narrowed", "a", None, None, None),
        ("warn", "column-type-narrowed", "b", None, None, None),
        ("pass", "column-added", "new", None, None, None),
        ("error", "column-removed-with-active-references", "gone", "x", "g", None),
        ("error", "column-removed-with-active-references", "gone", "y", "h", None),
    ] + [(r.severity, r.rule, None, None, None, r.position) for r in found[5:]]
    assert all(r.rule == "join-cardinality-loosened" for r in found[5:])


@pytest.mark.parametrize(("a", "b", "fires"), [("inner", "left", True), ("inner", "full", True), ("left", "full", True), ("left", "right", False), ("full", "left", False), ("inner", "cross", False), ("cross", "full", False)])
def test_loosened_joins(spark, a, b, fires):
    p, q = project(spark, {"m": ([], [a])}), project(spark, {"m": ([], [b])})
    assert rules.evaluate(p.edges, diffing.diff(p, q)).count() == fires


def test_severities():
    assert rules.severities()["column-added"] == "pass"
    assert rules.severities("strict") == {r: {"error": "error", "warn": "error", "pass": "warn"}[s] for r, s in rules.RULES.items()}
    assert rules.severities("lenient", {"column-added": "error"})["column-added"] == "error"


DIAMOND = [("origin", "s", "a", None, None), ("node", "a", "b", None, None), ("node", "a", "c", None, None), ("node", "b", "d", None, None), ("node", "c", "d", None, None)]


@pytest.mark.parametrize("small", [0, 1000])
def test_closures(spark, small):
    p = project(spark, {k: ([],) for k in "abcd"}, DIAMOND, [("s", "s")])

    def sides(name):
        rows = graph.trace(p, name, small=small).collect()
        return [[(r.kind, r.id, r.depth) for r in sorted(rows, key=lambda r: (r.depth, r.rank)) if r.side == side] for side in ("upstream", "downstream")]

    assert sides("d") == [[("node", "b", 1), ("node", "c", 1), ("node", "a", 2), ("origin", "s", 3)], []]
    assert sides("a") == [[("origin", "s", 1)], [("node", "b", 1), ("node", "c", 1), ("node", "d", 2)]]


@pytest.mark.parametrize("small", [0, 1000])
def test_cycles_end(spark, small):
    p = project(spark, {k: ([],) for k in "ab"}, [("node", "a", "b", None, None), ("node", "b", "a", None, None)])
    assert [r.id for r in graph.trace(p, "a", "upstream", small=small).collect()] == ["b"]
    assert {r.node_id: r.layer for r in graph.layers(p.nodes, p.edges).collect()}.keys() == {"a", "b"}


@pytest.mark.parametrize("small", [0, 1000])
def test_column_closure_and_where_it_gets_stuck(spark, small):
    edges = [("origin", "s", "a", "x", "x"), ("node", "a", "b", "x", "y"), ("node", "a", "b", None, None), ("node", "b", "c", None, None), ("node", "a", "c", "x", "z")]
    p = project(spark, {"a": ([("x",), ("lit",)],), "b": ([("y",)],), "c": ([("z",)],)}, edges, [("s", "s")])
    trace = lambda n, c, d="both": sorted((r.side, r.kind, r.id, r.column or "") for r in graph.trace_column(p, n, c, d, small=small).collect())
    assert trace("a", "x") == [("downstream", "node", "b", "y"), ("downstream", "node", "c", "z"), ("downstream", "unresolved", "b", ""), ("upstream", "origin", "s", "x")]
    assert trace("a", "lit") == [("downstream", "unresolved", "a", ""), ("upstream", "unresolved", "a", "")]
    assert trace("c", "z", "downstream") == []


def test_driver_and_distributed_walks_agree_on_random_graphs(spark):
    random.seed(5)
    for _ in range(3):
        ids = [f"n{k}" for k in range(12)]
        edges = [("node", *random.sample(ids, 2), random.choice(["x", "y", None]), "x") for _ in range(25)]
        edges = [(k, a, b, u, None if u is None else random.choice("xy")) for k, a, b, u, _ in edges]
        p = project(spark, {i: ([("x",), ("y",)],) for i in ids}, edges)
        seeds = spark.createDataFrame([("n0", "x"), ("n1", "y")], "id string, `column` string")
        for walk, s in ((graph.closure, seeds.select("id")), (graph.column_closure, seeds)):
            for side in ("upstream", "downstream"):
                got = [sorted(map(repr, walk(p.edges, s, side, small=n).collect())) for n in (0, 1000)]
                assert got[0] == got[1]


@pytest.mark.parametrize("small", [0, 1000])
def test_ranks_are_places_in_breadth_first_order(spark, small):
    p = project(spark, {k: ([],) for k in ("m0", "m1", "x", "m2", "m3")}, [("node", "m0", "m1", None, None), ("node", "m0", "x", None, None), ("node", "m1", "m2", None, None), ("node", "x", "m3", None, None)])
    rows = graph.trace(p, "m0", "downstream", small=small)
    assert sorted((r.rank, r.id) for r in rows.collect()) == [(0, "m1"), (1, "x"), (2, "m2"), (3, "m3")]
    assert [x.split()[-1] for x in trace_text(rows, "downstream").splitlines()[1:]] == ["m1", "x", "m2", "m3"]


def test_walks_that_do_not_end_fail(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_LEVELS", 3)
    p = project(spark, {k: ([("x",)],) for k in "abcde"}, [("node", a, b, "x", "x") for a, b in zip("abcd", "bcde")])
    with pytest.raises(graph.TooDeep):
        graph.trace(p, "a", "downstream", small=0)
    with pytest.raises(graph.TooDeep):
        graph.trace_column(p, "a", "x", "downstream", small=0)


def test_places_in_layers_count_through(spark):
    p = project(spark, {k: ([],) for k in "dacb"}, [("origin", "s", "a", None, None)], [("s", "z")])
    got = sorted((r.layer, r.place, r.kind, r.name) for r in graph.exported_nodes(p).collect())
    assert got == [(0, 1, "node", "b"), (0, 2, "node", "c"), (0, 3, "node", "d"), (0, 4, "origin", "z"), (1, 1, "node", "a")]


def test_targets(spark):
    assert graph.parse_target("m") == ("m", None, "both")
    assert graph.parse_target("+m.c") == ("m", "c", "upstream")
    assert graph.parse_target("m.c.d+") == ("m", "c.d", "downstream")
    assert graph.parse_target("+m+") == ("m", None, "both")
    p = project(spark, {"model.p.m": ([("a",)],), "model.q.m": ([("a",)],), "model.p.n": ([],)})
    with pytest.raises(graph.AmbiguousTarget) as e:
        graph.find_node(p, "m")
    assert e.value.ids == ["model.p.m", "model.q.m"]
    assert graph.find_node(p, "m", "q") == "model.q.m"
    with pytest.raises(graph.UnknownTarget):
        graph.find_node(p, "zzz")
    with pytest.raises(graph.UnknownColumn):
        graph.trace_column(p, "m", "zzz", package="p")


def test_layers_take_the_longest_path(spark):
    edges = [*DIAMOND, ("node", "a", "d", None, None), ("node", "d", "e", None, None), ("node", "missing", "f", None, None)]
    p = project(spark, {k: ([],) for k in "abcdefg"}, edges, [("s", "s")])
    assert {r.node_id: r.layer for r in graph.layers(p.nodes, p.edges).collect()} == {"a": 1, "b": 2, "c": 2, "d": 3, "e": 4, "f": 1, "g": 0}


def test_defer_set_leaves_out_what_is_built(spark):
    p = project(spark, {k: ([],) for k in "abcd"}, DIAMOND)
    build = spark.createDataFrame([("d",), ("b",)], "id string")
    assert [r.id for r in graph.defer_set(p.edges, build).collect()] == ["a", "c"]


def test_report(spark):
    old = project(spark, {"model.p.a": ([("x", "bigint"), ("gone",)], [], "incremental"), "model.p.b": ([("y",)],)}, [("node", "model.p.a", "model.p.b", "gone", "y"), ("node", "model.p.z", "model.p.b", None, None)])
    new = project(spark, {"model.p.a": ([("x", "int")], ["left"], "incremental"), "model.p.b": ([("y",)],)}, [("node", "model.p.z", "model.p.b", None, None)])
    changes = diffing.diff(old, new)
    findings = rules.evaluate(old.edges, changes)
    r = report.build_report(changes, findings, new, target="prod", stale=True)
    assert r.breaking and report.is_breaking(findings)
    assert r.impacted_models == ["a", "b"] and r.defer_plan == {"build": ["a", "b"], "defer": ["z"], "target": "prod"}
    assert [w["node"] for w in r.schema_evolution_warnings] == ["model.p.a", "model.p.a"]
    assert report.to_json(r)["changes"][0] == {"type": "column_type_changed", "node": "model.p.a", "column": "x", "from_type": "bigint", "to_type": "int"}
    assert "state" not in report.to_json(r)["defer_plan"]
    text = report_text(r, changes, findings)
    assert text == (
        "warning: analysis may be stale, consider rebasing\n\n"
        "Changed:\n  model model.p.a:\n    ~ column type changed: x (bigint -> int)\n    - column removed: gone\n    ~ join changed at position 0: none -> left\n"
        "\nDownstream impact:\n  model model.p.a:\n    [WARN] x type narrowed from bigint to int (column-type-narrowed)\n"
        "  model model.p.b:\n    [BREAKING] gone removed from model model.p.a breaks reference via y (column-removed-with-active-references)\n"
        "\nSummary: 1 model(s) changed, 2 column(s) changed, 1 breaking, 1 warning\n"
        "\nImpacted models: a, b\n"
        "\nDefer plan:\n  Build: a, b\n  Defer (assumed available): z\n  Target: prod\n"
        "\nSchema evolution:\n" + "".join(f"  model model.p.a: if this incrementally-materialized model already exists in your target environment, this change requires manual schema evolution: {x}\n" for x in ("~ column type changed: x (bigint -> int)", "- column removed: gone"))
    )
    checks = spark.createDataFrame([("model.p.a", True)], "node string, present boolean")
    assert report.build_report(changes, findings, new, checks=checks).schema_evolution_warnings[0]["message"].startswith("this incrementally-materialized model exists in your target environment;")
    gone = spark.createDataFrame([("model.p.a", False)], "node string, present boolean")
    assert report.build_report(changes, findings, new, checks=gone).schema_evolution_warnings == []


def test_report_without_changes(spark):
    p = project(spark, {"m": ([("a",)],)})
    changes = diffing.diff(p, p)
    findings = rules.evaluate(p.edges, changes)
    assert report_text(report.build_report(changes, findings, p), changes, findings) == "No changes detected.\n"


def test_trace_text(spark):
    p = project(spark, {"a": ([("x",)],), "b": ([("y",)],)}, [("origin", "s", "a", "x0", "x"), ("node", "a", "b", None, None)], [("s", "s")])
    assert trace_text(graph.trace(p, "a"), "both") == "Upstream:\n  source s\nDownstream:\n  model b\n"
    assert trace_text(graph.trace_column(p, "a", "x"), "both") == "Upstream:\n  source s.x0\nDownstream:\n  model a (unresolved)\n"
    assert trace_text(graph.trace(p, "b", "downstream"), "downstream") == "Downstream:\n  (none)\n"
