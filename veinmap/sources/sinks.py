"""What a run leaves in the project's target folder."""

from __future__ import annotations

import html
import json
import os
import re
import sys
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from ..operators.graph import exported_nodes
from ..operators.project import Project


def target(project_dir: Path) -> Path:
    return Path(project_dir) / "target" / "veinmap"


def write_whole(path: Path, text: str) -> None:
    """Under a name of its own first, then renamed: readers see all or nothing."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{os.getpid()}.part")
    part.write_text(text)
    part.replace(path)


def best_effort(what: str, action) -> None:
    """Side outputs never fail a run."""
    try:
        action()
    except OSError as e:
        print(f"warning: could not write {what}: {e}", file=sys.stderr)


def edges_json(project: Project) -> list[dict]:
    rows = project.edges.orderBy("edge_idx").collect()
    return [{"upstream": {"kind": r.upstream_kind, "id": r.upstream_id}, "downstream": r.downstream_id} | ({"column": {"upstream_column": r.upstream_column, "downstream_column": r.downstream_column}} if r.upstream_column is not None else {}) for r in rows]


def run_metadata(report: dict, current: Project) -> dict:
    return report | {"lineage_edges": edges_json(current)}


def _given(**values) -> dict:
    return {k: v for k, v in values.items() if v is not None}


def full_lineage(project: Project) -> dict:
    """The whole graph: nodes by layer and name with their columns, and all edges."""
    columns = project.columns.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type", "expression"))).alias("columns"))
    nodes = exported_nodes(project).join(columns, "id", "left").orderBy("layer", "place").collect()
    edges = project.edges.orderBy("edge_idx").collect()
    return {
        "nodes": [{"id": n.id, "name": n.name, "kind": n.kind, "layer": n.layer, "columns": [{"name": c.column_name, **_given(data_type=c.data_type, expression=c.expression)} for c in n.columns or []]} for n in nodes],
        "edges": [{"upstream": e.upstream_id, "downstream": e.downstream_id, **_given(upstream_column=e.upstream_column, downstream_column=e.downstream_column)} for e in edges],
        "node_term": "model",
        "origin_term": "source",
    }


def html_path(project_dir: Path, parsed: tuple[str, str | None, str] | None, package: str | None) -> Path:
    folder = target(project_dir) / "lineage_graphs"
    if parsed is None:
        return folder / "full_lineage.html"
    model, column, direction = parsed
    name = "_".join(["partial_lineage", *([package] if package else []), model, *([column] if column else [])])
    return folder / f"{name}{'' if direction == 'both' else f'_{direction}_only'}.html"


def lineage_page(graph: dict, target_id: str | None = None, column: str | None = None, direction: str = "both") -> str:
    """A page of its own with the graph's data: layers drawn side by side, search, and a panel for the node or column selected.

    A target restricts the page to what it reaches on the sides asked for, until
    all is shown. Columns are followed as in a trace: a column that no edge of its
    node names is marked unresolved there.
    """
    data = json.dumps(graph | _given(initial_target=target_id, initial_column=column, initial_direction=direction if target_id else None)).replace("</", "<\\/")
    title = html.escape(target_id or "Lineage")
    return PAGE.replace("@TITLE@", title).replace("@DATA@", data)


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>@TITLE@</title>
<style>
body{font:14px sans-serif;margin:0;display:flex;height:100vh}#left{flex:1;overflow:auto;padding:1em}#side{width:24em;overflow:auto;padding:1em;border-left:1px solid #ccc}
ul{list-style:none;padding:0}li{cursor:pointer}h3{margin:.5em 0}rect{fill:#eef;stroke:#88a}g.origin rect{fill:#efe}g.on rect{stroke-width:3}g.dim,path.dim{opacity:.2}path{fill:none;stroke:#99a}path.on{stroke:#226;stroke-width:2}text{font-size:12px}
</style></head>
<body><div id="left"><input id="find" placeholder="model or model.column"> <button id="all">show all</button><div><svg id="map" xmlns="http://www.w3.org/2000/svg"></svg></div></div><div id="side"></div>
<script type="application/json" id="data">@DATA@</script>
<script>
'use strict';
const g = JSON.parse(document.getElementById('data').textContent), byId = new Map(g.nodes.map(n => [n.id, n]));
// Edges by where they start, on both sides: from each to its neighbours.
const sides = {up: new Map(), down: new Map()};
for (const e of g.edges) {
  const add = (m, at, to, here, there) => { if (!m.has(at)) m.set(at, []); m.get(at).push({to, here, there}); };
  add(sides.up, e.downstream, e.upstream, e.downstream_column, e.upstream_column);
  add(sides.down, e.upstream, e.downstream, e.upstream_column, e.downstream_column);
}
// What a node, or a column of it, reaches on a side: [{id, column, unresolved}] in breadth-first order.
function reach(id, column, side) {
  const key = (i, c) => JSON.stringify([i, c === undefined ? null : c]), seen = new Set([key(id, column)]), out = [], stuck = new Set(), todo = [[id, column]];
  for (let k = 0; k < todo.length; k++) {
    const [at, c] = todo[k], every = sides[side].get(at) || [], edges = column === undefined ? every : every.filter(e => e.here !== undefined && e.here === c);
    if (column !== undefined && every.length && !edges.length && !stuck.has(at)) { stuck.add(at); out.push({id: at, unresolved: true}); }
    for (const e of edges) {
      const there = column === undefined ? undefined : e.there;
      if (seen.has(key(e.to, there))) continue;
      seen.add(key(e.to, there));
      out.push({id: e.to, column: there});
      todo.push([e.to, there]);
    }
  }
  return out;
}
const label = x => x.id + (x.unresolved ? ' (unresolved)' : x.column === undefined ? '' : '.' + x.column);
let scope = null, chosen = null, sorted = false, filter = '';
const make = (tag, attributes, parent, ns) => { const x = ns ? document.createElementNS('http://www.w3.org/2000/svg', tag) : document.createElement(tag); for (const k in attributes) x.setAttribute(k, attributes[k]); if (parent) parent.append(x); return x; };
// Layers are columns of boxes; a node stands where the mean of its upstream neighbours stands, as far as its layer has room.
function layout(nodes) {
  const layers = new Map(), place = new Map();
  for (const n of nodes) { if (!layers.has(n.layer)) layers.set(n.layer, []); layers.get(n.layer).push(n); }
  [...layers.keys()].sort((a, b) => a - b).forEach((layer, x) => {
    const mean = n => { const ys = (sides.up.get(n.id) || []).filter(e => place.has(e.to)).map(e => place.get(e.to).row); return ys.length ? ys.reduce((a, b) => a + b, 0) / ys.length : 0; };
    layers.get(layer).map((n, k) => [mean(n), k, n]).sort((a, b) => a[0] - b[0] || a[1] - b[1]).forEach(([, , n], row) => place.set(n.id, {x: 20 + x * 260, y: 20 + row * 44, row}));
  });
  return place;
}
function draw() {
  const [model, column] = document.getElementById('find').value.toLowerCase().split('.', 2), map = document.getElementById('map');
  const found = n => n.name.toLowerCase().includes(model) && (!column || n.columns.some(c => c.name.toLowerCase().includes(column)));
  const nodes = g.nodes.filter(n => (!scope || scope.has(n.id)) && found(n)), place = layout(nodes), related = new Set();
  if (chosen) { related.add(chosen.id); for (const side of ['up', 'down']) for (const x of reach(chosen.id, chosen.column, side)) related.add(x.id); }
  map.replaceChildren();
  map.setAttribute('width', 300 + Math.max(0, ...[...place.values()].map(p => p.x)));
  map.setAttribute('height', 80 + Math.max(0, ...[...place.values()].map(p => p.y)));
  const drawn = new Set();
  for (const e of g.edges) {
    const a = place.get(e.upstream), b = place.get(e.downstream), key = e.upstream + '\\n' + e.downstream;
    if (!a || !b || drawn.has(key)) continue;
    drawn.add(key);
    const both = related.has(e.upstream) && related.has(e.downstream);
    make('path', {d: `M${a.x + 200},${a.y + 15} C${a.x + 230},${a.y + 15} ${b.x - 30},${b.y + 15} ${b.x},${b.y + 15}`, class: !chosen ? '' : both ? 'on' : 'dim'}, map, true);
  }
  for (const n of nodes) {
    const p = place.get(n.id), box = make('g', {class: n.kind + (!chosen ? '' : n.id === chosen.id ? ' on' : related.has(n.id) ? '' : ' dim'), transform: `translate(${p.x},${p.y})`}, map, true);
    make('rect', {width: 200, height: 30, rx: 4}, box, true);
    make('text', {x: 8, y: 20}, box, true).textContent = n.name.length > 28 ? n.name.slice(0, 27) + '\u2026' : n.name;
    make('title', {}, box, true).textContent = n.id;
    box.onclick = () => select(n.id);
  }
}
function list(title, items, click) {
  const side = document.getElementById('side'); make('h3', {}, side).textContent = title;
  const ul = make('ul', {}, side);
  for (const x of items) { const li = make('li', {}, ul); li.textContent = x.text; li.onclick = () => click(x); }
}
function panel() {
  const side = document.getElementById('side'); side.replaceChildren();
  const n = chosen && byId.get(chosen.id); if (!n) return;
  make('h2', {}, side).textContent = label(chosen);
  const find = make('input', {placeholder: 'filter columns'}, side), order = make('button', {}, side);
  find.value = filter; order.textContent = sorted ? 'in order' : 'by name';
  find.onchange = () => { filter = find.value; panel(); };
  order.onclick = () => { sorted = !sorted; panel(); };
  const columns = n.columns.filter(c => c.name.toLowerCase().includes(filter.toLowerCase()));
  if (sorted) columns.sort((a, b) => a.name < b.name ? -1 : a.name > b.name ? 1 : 0);
  list('Columns', columns.map(c => ({text: c.name + (c.data_type ? ' ' + c.data_type : '') + (c.expression ? ' = ' + c.expression : ''), name: c.name})), x => select(n.id, x.name));
  for (const [name, way] of [['Upstream', 'up'], ['Downstream', 'down']]) list(name, reach(chosen.id, chosen.column, way).map(x => ({...x, text: label(x)})), x => select(x.id, x.column));
}
function select(id, column) { chosen = {id, column}; panel(); draw(); }
document.getElementById('find').oninput = draw;
document.getElementById('all').onclick = () => { scope = null; draw(); };
if (g.initial_target) {
  const wanted = {upstream: ['up'], downstream: ['down']}[g.initial_direction] || ['up', 'down'];
  scope = new Set([g.initial_target]);
  for (const way of wanted) for (const x of reach(g.initial_target, g.initial_column, way)) scope.add(x.id);
  select(g.initial_target, g.initial_column);
} else draw();
</script></body></html>
"""


def append_log(project_dir: Path, text: str, today: date | None = None) -> None:
    path = target(project_dir) / "logs" / f"{today or datetime.now(UTC).date()}.log"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a") as f:
        f.write(text if text.endswith("\n") else text + "\n")


def purge_logs(project_dir: Path, days: int, today: date | None = None) -> list[Path]:
    """Remove logs dated more than days before today; other files stay."""
    least = (today or datetime.now(UTC).date()) - timedelta(days=days)
    gone = []
    for p in sorted((target(project_dir) / "logs").glob("*.log")):
        if re.fullmatch(r"\d{4}-\d\d-\d\d", p.stem):
            try:
                old = date.fromisoformat(p.stem) < least
            except ValueError:
                continue
            if old:
                p.unlink()
                gone.append(p)
    return gone
