import json
import os
import stat
import subprocess

import pytest

from veinmap import cli, sample
from veinmap.sources.manifest import ManifestError, adapter_type, read_manifest, relation_identities


@pytest.fixture
def shop(tmp_path):
    """A project folder in its new state, with the old state's manifest beside it."""
    d = tmp_path / "shop"
    (d / "target").mkdir(parents=True)
    (d / "dbt_project.yml").write_text("name: shop\n")
    (d / "target" / "manifest.json").write_text(sample.manifest_json(sample.NEW))
    (tmp_path / "old.json").write_text(sample.manifest_json())
    return d


def run(spark, capsys, *args):
    code = cli.main([str(a) for a in args], spark)
    out, err = capsys.readouterr()
    return code, out, err


def test_check_fails_on_what_is_breaking_and_diff_does_not(spark, capsys, shop):
    state = shop.parent / "old.json"
    code, out, _ = run(spark, capsys, "check", "--project-dir", shop, "--state", state, "--no-color")
    assert code == 1 and "Summary: 3 model(s) changed, 9 column(s) changed, 5 breaking, 3 warning" in out
    meta = json.loads((shop / "target" / "veinmap" / "run-metadata.json").read_text())
    assert set(meta) == {"changes", "findings", "impacted_models", "defer_plan", "schema_evolution_warnings", "lineage_edges"}
    assert {"upstream": {"kind": "origin", "id": "source.shop.raw.customer"}, "downstream": "model.shop.stg_customers"} in meta["lineage_edges"]
    code, out, _ = run(spark, capsys, "diff", "--project-dir", shop, "--state", state, "--format", "json", "--defer-target", "prod")
    wire = json.loads(out)
    assert code == 0 and len(wire["changes"]) == 10 and len(wire["findings"]) == 10 and wire["defer_plan"]["target"] == "prod"
    assert list((shop / "target" / "veinmap" / "logs").iterdir())


def test_settings_and_equal_states(spark, capsys, shop):
    (shop / "veinmap.yml").write_text("preset: lenient\ndefer: {state: artefacts}\n")
    code, out, _ = run(spark, capsys, "check", "--project-dir", shop, "--state", shop.parent / "old.json")
    assert code == 0 and "State: artefacts" in out and "[WARN]" in out and "BREAKING" not in out
    code, out, _ = run(spark, capsys, "check", "--project-dir", shop, "--state", shop / "target" / "manifest.json")
    assert code == 0 and out == "No changes detected.\n"


def test_failures_exit_with_two(spark, capsys, shop, tmp_path):
    assert run(spark, capsys, "check", "--project-dir", shop, "--state", tmp_path / "none.json")[0] == 2
    (tmp_path / "broken.json").write_text("{")
    code, _, err = run(spark, capsys, "check", "--project-dir", shop, "--state", tmp_path / "broken.json")
    assert code == 2 and err.startswith("error: ")
    (shop / "veinmap.yml").write_text("preset: odd\n")
    assert run(spark, capsys, "diff", "--project-dir", shop, "--state", tmp_path / "old.json")[0] == 2
    (shop / "veinmap.yml").unlink()
    assert run(spark, capsys, "check", "--project-dir", shop)[0] == 2  # no git repository


def test_lineage(spark, capsys, shop):
    code, out, _ = run(spark, capsys, "lineage", "+dim_customers.order_count", "--text", "--project-dir", shop)
    assert code == 0 and out == "Upstream:\n  source source.shop.raw.orders.o_orderkey\n  model model.shop.stg_orders.order_id\n"
    full = json.loads((shop / "target" / "veinmap" / "full_lineage.json").read_text())
    assert [n["name"] for n in full["nodes"]][:3] == ["customer", "lineitem", "orders"] and full["node_term"] == "model"
    assert next(n for n in full["nodes"] if n["name"] == "stg_customers")["columns"][0] == {"name": "customer_id", "data_type": "int"}
    assert run(spark, capsys, "lineage", "--project-dir", shop)[0] == 0
    assert run(spark, capsys, "lineage", "stg_orders+", "--project-dir", shop)[0] == 0
    pages = shop / "target" / "veinmap" / "lineage_graphs"
    assert {p.name for p in pages.iterdir()} == {"full_lineage.html", "partial_lineage_stg_orders_downstream_only.html"}
    for target in ("nothing", "stg_orders.nothing"):
        code, _, err = run(spark, capsys, "lineage", target, "--text", "--project-dir", shop)
        assert code == 2 and "nothing" in err
    assert run(spark, capsys, "lineage", "--text", "--project-dir", shop)[0] == 2


def test_baseline_from_git(spark, capsys, shop):
    """The merge base is compiled by a stand-in for dbt that copies a committed file."""
    tool = shop.parent / "dbt.sh"
    tool.write_text('#!/bin/sh\nmkdir -p target && cp compiled.json target/manifest.json && echo "ran $*"\n')
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=shop, check=True, capture_output=True)
    git("init", "-q", "-b", "master")
    (shop / ".gitignore").write_text("target/\n")
    (shop / "compiled.json").write_text(sample.manifest_json())
    git("add", "-A")
    git("commit", "-qm", "old")
    git("checkout", "-qb", "work")
    (shop / "compiled.json").write_text(sample.manifest_json(sample.NEW))
    git("commit", "-qam", "new")
    os.utime(shop / "target" / "manifest.json")
    code, out, _ = run(spark, capsys, "check", "--project-dir", shop, "--dbt-command", tool)
    assert code == 1 and "3 model(s) changed" in out and "stale" not in out
    assert (shop / "target" / "veinmap" / "baseline_manifest.json").exists()
    git("checkout", "-q", "master")
    (shop / "other").write_text("x")
    git("add", "-A")
    git("commit", "-qm", "moved on")
    git("checkout", "-q", "work")
    os.utime(shop / "target" / "manifest.json")
    code, out, _ = run(spark, capsys, "diff", "--project-dir", shop, "--dbt-command", tool)
    assert code == 0 and out.startswith("warning: analysis may be stale")
    assert run(spark, capsys, "check", "--project-dir", shop, "--dbt-command", tool, "--against", "no-such-branch")[0] == 2
    assert b"prunable" not in subprocess.run(["git", "worktree", "list", "--porcelain"], cwd=shop, capture_output=True).stdout


def test_extra_arguments_and_the_log(spark, capsys, shop):
    """Extra arguments reach deps and compile of the base; what the tool prints is in the log, also when it fails."""
    tool = shop.parent / "dbt.sh"
    tool.write_text('#!/bin/sh\n[ "$1" = deps ] || { mkdir -p target && cp compiled.json target/manifest.json; }\necho "ran $*"\necho "warned" >&2\n')
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=shop, check=True, capture_output=True)
    git("init", "-q", "-b", "master")
    (shop / ".gitignore").write_text("target/\n")
    (shop / "packages.yml").write_text("packages: []\n")
    (shop / "compiled.json").write_text(sample.manifest_json())
    git("add", "-A")
    git("commit", "-qm", "old")
    os.utime(shop / "target" / "manifest.json")
    assert run(spark, capsys, "check", "--project-dir", shop, "--dbt-command", tool, "--dbt-arg=--profiles-dir", "--dbt-arg=p")[0] == 1
    log = next((shop / "target" / "veinmap" / "logs").iterdir())
    said = log.read_text()
    assert "$ dbt deps (in " in said and "ran deps --profiles-dir p" in said and "ran compile --profiles-dir p" in said and "warned" in said
    (shop / "veinmap.yml").write_text(f"dbt-command: {tool}\ndbt-args: --threads 3\n")
    assert run(spark, capsys, "lineage", "stg_orders", "--text", "--compile", "--project-dir", shop)[0] == 0
    assert "ran compile\n" in log.read_text()
    tool.write_text("#!/bin/sh\necho went wrong\nexit 3\n")
    assert run(spark, capsys, "lineage", "stg_orders", "--text", "--compile", "--project-dir", shop)[0] == 2
    assert "went wrong" in log.read_text()


def test_lineage_export_that_cannot_be_written_fails(spark, capsys, shop):
    (shop / "target" / "veinmap" / "full_lineage.json").mkdir(parents=True)
    (shop / "target" / "veinmap" / "full_lineage.json" / "x").write_text("")
    code, _, err = run(spark, capsys, "lineage", "stg_orders", "--text", "--project-dir", shop)
    assert code == 2 and err.startswith("error: ")


def test_live_checks_know_their_warehouses(spark, capsys, shop):
    state = shop.parent / "old.json"
    manifest = json.loads((shop / "target" / "manifest.json").read_text())
    for adapter, word in (("oracle", "'oracle'"), (None, "does not say")):
        manifest.setdefault("metadata", {})["adapter_type"] = adapter
        (shop / "target" / "manifest.json").write_text(json.dumps(manifest))
        code, out, err = run(spark, capsys, "diff", "--project-dir", shop, "--state", state, "--check-relations", "--dbt-command", "/no/such/tool")
        assert code == 0 and word in err and "Schema evolution" in out


def test_schemas_that_are_lost_are_pointed_out(spark, capsys, shop):
    manifest = json.loads((shop / "target" / "manifest.json").read_text())
    model = next(n for n in manifest["nodes"].values() if n["name"] == "stg_orders")
    model["compiled_code"] = "select from where ("
    (shop / "target" / "manifest.json").write_text(json.dumps(manifest))
    code, out, err = run(spark, capsys, "diff", "--project-dir", shop, "--state", shop.parent / "old.json", "--no-color")
    assert code == 0 and "column removed: status" in out
    assert "the columns of model.shop.stg_orders are not known any more" in err and "all_ids" not in err


def test_addons(tmp_path, monkeypatch):
    program = tmp_path / "veinmap-hello"
    program.write_text('#!/bin/sh\nexit "$1"\n')
    program.chmod(0o755)
    (tmp_path / "veinmap-check").write_text("#!/bin/sh\nexit 9\n")
    (tmp_path / "veinmap-check").chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert cli.addon(["hello", "5"]) == 5
    assert cli.addon(["check"]) is None and cli.addon(["nothing"]) is None and cli.addon([]) is None


def test_example_addon(tmp_path, monkeypatch, capfd):
    from pathlib import Path

    monkeypatch.setenv("PATH", f"{Path(cli.__file__).parent.parent / 'examples'}:{os.environ['PATH']}")
    assert cli.addon(["hello", "--project-dir", str(tmp_path)]) == 2
    (tmp_path / "target" / "veinmap").mkdir(parents=True)
    node = lambda i, kind: {"id": i, "name": i, "kind": kind, "layer": 0, "columns": []}
    graph = {"nodes": [node("s", "origin"), node("a", "node"), node("b", "node")], "edges": [{"upstream": "s", "downstream": "a"}, {"upstream": "a", "downstream": "b"}, {"upstream": "b", "downstream": "a"}]}
    (tmp_path / "target" / "veinmap" / "full_lineage.json").write_text(json.dumps(graph))
    assert cli.addon(["hello", "--project-dir", str(tmp_path)]) == 0
    assert "origin s: 2 downstream" in capfd.readouterr().out
    assert json.loads((tmp_path / "target" / "veinmap" / "hello.json").read_text()) == {"nodes": 3, "edges": 3, "downstream": {"s": 2, "a": 1, "b": 1}}


def test_page_holds_the_graph():
    from veinmap.sources.sinks import lineage_page

    graph = {"nodes": [{"id": "a</script>", "name": "a", "kind": "node", "layer": 1, "columns": []}], "edges": []}
    page = lineage_page(graph, "a</script>", "c", "upstream")
    assert page.count("</script>") == 2 and "a&lt;/script&gt;" in page.split("</title>")[0]
    data = page.split('id="data">')[1].split("</script>")[0]
    assert json.loads(data) == graph | {"initial_target": "a</script>", "initial_column": "c", "initial_direction": "upstream"}


def test_manifest(spark, tmp_path):
    def read(value):
        path = tmp_path / f"{abs(hash(str(value)))}.json"
        path.write_text(value if isinstance(value, str) else json.dumps(value))
        return read_manifest(spark, str(path))

    for bad in ("{", "[]x", {"nodes": {"a": {"name": "a", "resource_type": "model"}}, "sources": {}}, {"nodes": {}, "sources": {"s": {"unique_id": "s"}}}):
        with pytest.raises(ManifestError):
            read(bad)
    with pytest.raises(ManifestError):
        read_manifest(spark, str(tmp_path / "none.json"))
    assert adapter_type(read({"metadata": {"adapter_type": "duckdb"}, "nodes": {}, "sources": {}})) == "duckdb"
    node = {"unique_id": "m", "resource_type": "model", "name": "m", "database": "d", "schema": "s", "alias": "m", "other": [1, {"x": 2}]}
    ids = relation_identities(read({"nodes": {"m": node, "n": node | {"unique_id": "n", "alias": None}, "t": node | {"unique_id": "t", "resource_type": "test"}}, "sources": {}}))
    assert [tuple(r) for r in ids.collect()] == [("m", "d", "s", "m")]
