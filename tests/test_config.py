import os
import time
from datetime import date

import pytest

from veinmap.sources import baseline, config, sinks, warehouse


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_nothing_set(tmp_path):
    c = config.load(tmp_path)
    assert c.preset is None and c.severities()["column-type-narrowed"] == "warn"


def test_nearer_files_win_key_by_key(tmp_path):
    (tmp_path / ".git").mkdir()
    write(tmp_path / "veinmap.yml", "preset: strict\nagainst: main\nrules: {column-added: error, column-type-narrowed: pass}\ndefer: {target: prod}\n")
    write(tmp_path / "p" / "veinmap.yml", "preset: lenient\nrules: {column-added: warn}\ndefer: {state: s}\nlog: {level: debug, retention_days: 3}\nsomething: else\n")
    c = config.load(tmp_path / "p")
    assert (c.preset, c.against, c.defer_target, c.defer_state, c.log_level, c.log_retention_days) == ("lenient", "main", "prod", "s", "debug", 3)
    assert c.rules == {"column-added": "warn", "column-type-narrowed": "pass"}
    assert c.severities()["struct-field-added"] == "warn" and c.severities()["column-added"] == "warn"


def test_without_a_repository_only_the_own_file_counts(tmp_path):
    write(tmp_path / "veinmap.yml", "preset: strict\n")
    write(tmp_path / "p" / "veinmap.yml", "")
    assert config.load(tmp_path / "p").preset is None


@pytest.mark.parametrize("text", ["preset: odd", "rules: {odd: error}", "rules: {column-added: odd}", "log: {level: odd}", "log: {retention_days: -1}", "a: [", "- a", "against: [1]"])
def test_errors(tmp_path, text):
    write(tmp_path / "veinmap.yml", text)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path)


def test_tool(tmp_path):
    with pytest.raises(baseline.ToolError):
        baseline.resolve_tool(tmp_path, None)
    with pytest.raises(baseline.ToolError):
        baseline.resolve_tool(tmp_path, "odd")
    assert baseline.resolve_tool(tmp_path, "dbt") == "dbt"
    write(tmp_path / "dbt_project.yml", "")
    assert baseline.resolve_tool(tmp_path, "odd") == "dbt"
    both = (("a", lambda _: True), ("b", lambda _: True))
    with pytest.raises(baseline.ToolError):
        baseline.resolve_tool(tmp_path, None, both)
    assert baseline.resolve_tool(tmp_path, "b", both) == "b"


def test_freshness(tmp_path):
    manifest = tmp_path / "target" / "manifest.json"
    baseline.check_fresh(tmp_path, manifest)
    write(manifest, "{}")
    baseline.check_fresh(tmp_path, manifest)
    write(tmp_path / "models" / "x" / "m.sql", "select 1")
    os.utime(manifest, (time.time() - 60,) * 2)
    with pytest.raises(baseline.StaleManifest):
        baseline.check_fresh(tmp_path, manifest)
    os.utime(tmp_path / "models" / "x" / "m.sql", (time.time() - 120,) * 2)
    baseline.check_fresh(tmp_path, manifest)


def test_dbt_commands(tmp_path):
    with pytest.raises(baseline.ToolError):
        baseline.dbt("compile", tmp_path, "")
    with pytest.raises(baseline.ToolError):
        baseline.dbt("compile", tmp_path, "no-such-program-here")
    with pytest.raises(baseline.ToolError, match="went wrong"):
        baseline.dbt("compile", tmp_path, "sh -c 'echo went wrong; exit 3'")
    assert baseline.dbt("compile", tmp_path, "echo 'a b'", ["--x"]) == "a b compile --x\n"


def test_logs(tmp_path):
    for day in ("2024-01-01", "2024-01-09", "2024-01-10"):
        sinks.append_log(tmp_path, "x", date.fromisoformat(day))
    sinks.append_log(tmp_path, "y\n", date(2024, 1, 10))
    logs = sinks.target(tmp_path) / "logs"
    write(logs / "notes.log", "")
    assert (logs / "2024-01-10.log").read_text() == "x\ny\n"
    assert [p.name for p in sinks.purge_logs(tmp_path, 1, date(2024, 1, 10))] == ["2024-01-01.log"]
    assert sorted(p.name for p in logs.iterdir()) == ["2024-01-09.log", "2024-01-10.log", "notes.log"]


def test_html_paths(tmp_path):
    name = lambda *a: sinks.html_path(tmp_path, *a).name
    assert name(None, None) == "full_lineage.html"
    assert name(("m", None, "both"), None) == "partial_lineage_m.html"
    assert name(("m", "c", "upstream"), "p") == "partial_lineage_p_m_c_upstream_only.html"
    assert name(("m", None, "downstream"), None) == "partial_lineage_m_downstream_only.html"


def test_live_checks(spark, tmp_path):
    ids = spark.createDataFrame([("a", None, None, "vm_live_view"), ("b", None, None, "vm_no_such_view"), ("c", None, None, "x")], "node_id string, database string, schema string, identifier string")
    spark.range(1).createOrReplaceTempView("vm_live_view")
    found, failed = warehouse.check_relations(ids, ["a", "b"], warehouse.spark_catalog(spark))
    assert {r.node: r.present for r in found.collect()} == {"a": True, "b": False} and not failed
    script = tmp_path / "tool.sh"
    write(script, '#!/bin/sh\nls macros | grep -q __veinmap || exit 9\ncase "$*" in *vm_live_view*) echo "12:00 VEINMAP_RELATION_EXISTS:true";; *no_such*) echo "VEINMAP_RELATION_EXISTS: false ";; *) echo odd;; esac\n')
    found, failed = warehouse.check_relations(ids, ["a", "b", "c"], warehouse.dbt_macro(tmp_path, f"sh {script}"))
    assert {r.node: r.present for r in found.collect()} == {"a": True, "b": False, "c": None} and len(failed) == 1
    assert not list((tmp_path / "macros").iterdir())
