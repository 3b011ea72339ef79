"""The older state to compare with: a manifest given, or one compiled from the merge base in a git worktree."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from .config import split_words

#: The project files and folders whose changes make a compiled manifest stale.
SOURCE_FILES = ("dbt_project.yml", "packages.yml", "dependencies.yml")
SOURCE_DIRS = ("models", "macros", "seeds", "snapshots", "analyses", "tests")


class ToolError(Exception):
    """A project whose tool is not clear, or a tool that failed."""


class GitError(Exception):
    """What git could not do."""


class StaleManifest(Exception):
    """A manifest older than the project's sources."""


def detect(project_dir: Path) -> bool:
    return (Path(project_dir) / "dbt_project.yml").exists()


def resolve_tool(project_dir: Path, configured: str | None, detectors=(("dbt", detect),)) -> str:
    """The one tool whose marker is there; the configured one where markers do not decide."""
    found = [name for name, seen in detectors if seen(project_dir)]
    if len(found) == 1:
        return found[0]
    known = [name for name, _ in detectors]
    if configured is not None:
        if configured not in known:
            raise ToolError(f"unknown tool {configured!r} configured; known: {', '.join(known)}")
        return configured
    if found:
        raise ToolError(f"{project_dir} looks like a project of more than one tool: {', '.join(found)}; set tool: in the configuration")
    raise ToolError(f"could not tell which tool {project_dir} is a project of; set tool: in the configuration")


def _run(args: list[str], cwd: Path, what: str) -> subprocess.CompletedProcess:
    try:
        return subprocess.run(args, cwd=cwd, capture_output=True, text=True)
    except OSError as e:
        raise ToolError(f"could not run {what}: {e}") from e


def dbt(action: str, project_dir: Path, command: str = "dbt", extra: list[str] = (), log: Callable[[str], object] = lambda said: None) -> str:
    """Run dbt compile or dbt deps; returns its output. log gets what it printed, whether it failed or not, as one block."""
    words = split_words(command, "dbt command")
    if not words:
        raise ToolError(f"could not run {command!r}: command not found")
    done = _run([*words, action, *extra], project_dir, repr(command))
    log(f"$ dbt {action} (in {project_dir})\n{done.stdout}\n{done.stderr}\n")
    if done.returncode:
        raise ToolError(f"dbt {action} failed:\n{done.stdout}{done.stderr}")
    return done.stdout + done.stderr


def git(project_dir: Path, *args: str) -> str:
    if not Path(project_dir).is_dir():
        raise GitError(f"project directory {project_dir} not found")
    try:
        done = subprocess.run(["git", *args], cwd=project_dir, capture_output=True, text=True)
    except OSError as e:
        raise GitError(f"could not run git: {e}") from e
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout.strip()


def merge_base(project_dir: Path, against: str) -> str:
    try:
        git(project_dir, "rev-parse", "--show-toplevel")
    except GitError as e:
        raise GitError(f"{project_dir} is not in a git repository: {e}") from e
    try:
        return git(project_dir, "merge-base", "HEAD", against)
    except GitError as e:
        raise GitError(f"could not find the merge base of HEAD and {against!r}: {e}") from e


@contextmanager
def worktree(project_dir: Path, commit: str):
    """The project's folder in a detached worktree of a commit, removed afterwards."""
    top = Path(git(project_dir, "rev-parse", "--show-toplevel"))
    below = Path(project_dir).resolve().relative_to(top.resolve())
    place = Path(tempfile.mkdtemp(prefix="veinmap-baseline-"))
    try:
        git(project_dir, "worktree", "add", "--detach", "--force", str(place / "tree"), commit)
        yield place / "tree" / below
    finally:
        subprocess.run(["git", "worktree", "remove", "--force", str(place / "tree")], cwd=project_dir, capture_output=True)
        shutil.rmtree(place, ignore_errors=True)


def baseline_manifest(project_dir: Path, against: str, command: str = "dbt", extra: list[str] = (), log: Callable[[str], object] = lambda said: None) -> Path:
    """A copy of the merge base's manifest, under target/veinmap. Packages are fetched and the base compiled with the same extra arguments."""
    with worktree(project_dir, merge_base(project_dir, against)) as tree:
        if any((tree / f).exists() for f in ("packages.yml", "dependencies.yml")):
            dbt("deps", tree, command, list(extra), log)
        dbt("compile", tree, command, list(extra), log)
        kept = Path(project_dir) / "target" / "veinmap" / "baseline_manifest.json"
        kept.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(tree / "target" / "manifest.json", kept)
    return kept


def is_stale(project_dir: Path, against: str) -> bool:
    """Whether the target branch has moved on since the merge base; what cannot be told is not stale."""
    try:
        return merge_base(project_dir, against) != git(project_dir, "rev-parse", f"{against}^{{commit}}")
    except GitError:
        return False


def check_fresh(project_dir: Path, manifest: Path) -> None:
    """Refuse a manifest that is older than a source file of the project. Nothing to compare passes."""
    project_dir = Path(project_dir)
    files = [project_dir / f for f in SOURCE_FILES] + [p for d in SOURCE_DIRS for p in (project_dir / d).rglob("*") if p.is_file()]
    newest = max((p.stat().st_mtime_ns for p in files if p.exists()), default=None)
    if newest is None or not Path(manifest).exists():
        return
    if newest > Path(manifest).stat().st_mtime_ns:
        raise StaleManifest(f"{manifest} looks stale: files of {project_dir} have changed since. Compile the project anew, or go on with --allow-stale-manifest.")
