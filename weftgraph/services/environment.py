"""Around the engine: checked paths, whole files, limits of a rebuild, and hooks of a git repository."""

from __future__ import annotations

import os
import resource
import shlex
import subprocess
import sys
import tempfile
from pathlib import Path

#: Lines between these are ours in a hook that may have others.
BEGIN, END = "# >>> weftgraph >>>", "# <<< weftgraph <<<"
#: After a commit that touches metadata, and after a change of branch, the graph is updated in the background.
HOOKS = {
    "post-commit": "if git diff-tree --no-commit-id --name-only -r --root HEAD | grep -qE '\\.(cls|trigger|page|component|cmp|js|html|md)$|-meta\\.xml$'; then\n  {command} >/dev/null 2>&1 &\nfi",
    "post-checkout": 'if [ "$3" = 1 ]; then\n  {command} >/dev/null 2>&1 &\nfi',
}


def checked_path(path: str, inside: str | None = None) -> Path:
    """The resolved path of an existing file, within a folder if one is given; ``ValueError`` otherwise."""
    at = Path(path).resolve()
    if not at.exists():
        raise ValueError(f"{at} doesn't exist")
    if not at.is_file():
        raise ValueError(f"{at} is no file")
    if inside is not None and not at.is_relative_to(Path(inside).resolve()):
        raise ValueError(f"{at} lies outside {Path(inside).resolve()}")
    return at


def write_whole(path: str | Path, text: str, mode: int = 0o644) -> None:
    """Write aside and move into place: readers see the old file or the new one."""
    path = Path(path)
    handle, aside = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.chmod(aside, mode)
        os.replace(aside, path)
    except BaseException:
        Path(aside).unlink(missing_ok=True)
        raise


def limit(nice: int = 10, memory_mb: int | None = None) -> None:
    """Lower this process's priority, and bound its memory, for a rebuild in the background."""
    os.nice(nice)
    if memory_mb:
        hard = resource.getrlimit(resource.RLIMIT_AS)[1]
        most = memory_mb << 20
        resource.setrlimit(resource.RLIMIT_AS, (most if hard == resource.RLIM_INFINITY else min(most, hard), hard))


def git_root(start: str) -> Path | None:
    """The nearest folder upwards that is a repository's."""
    return next((p for p in (Path(start).resolve(), *Path(start).resolve().parents) if (p / ".git").exists()), None)


def hooks_folder(start: str) -> Path:
    """Where a repository's hooks lie; a configured folder outside the repository isn't touched."""
    root = git_root(start)
    if root is None:
        raise ValueError(f"{start} is in no git repository")
    said = subprocess.run(["git", "-C", str(root), "rev-parse", "--git-path", "hooks"], capture_output=True, text=True, check=True).stdout.strip()
    at = (root / said).resolve()
    if not at.is_relative_to(root):
        raise ValueError(f"hooks lie outside the repository: {at}")
    return at


def without_section(text: str) -> str:
    """A hook without our lines."""
    before, begun, rest = text.partition(BEGIN + "\n")
    return before + rest.partition(END + "\n")[2] if begun else text


def hook(action: str, root: str, out: str) -> dict[str, bool]:
    """Install, uninstall or (``status``) look for our section in each hook; whether each has it after that."""
    folder = hooks_folder(root)
    command = shlex.join(["nice", "-n", "10", sys.executable, "-m", "weftgraph.cli", "build", str(Path(root).resolve()), "--update", "--no-viz", "--out", str(Path(out).resolve())])
    there = {}
    for name, script in HOOKS.items():
        at = folder / name
        text = at.read_text() if at.exists() else ""
        if action == "install":
            folder.mkdir(parents=True, exist_ok=True)
            write_whole(at, (without_section(text) or "#!/bin/sh\n") + f"{BEGIN}\n{script.format(command=command)}\n{END}\n", 0o755)
        elif action == "uninstall" and BEGIN in text:
            left = without_section(text)
            if left.strip() in ("", "#!/bin/sh"):
                at.unlink()
            else:
                write_whole(at, left, 0o755)
        elif action not in ("uninstall", "status"):
            raise ValueError(f"no such action: {action}")
        there[name] = at.exists() and BEGIN in at.read_text()
    return there


def merge_driver(root: str) -> None:
    """Let git merge graph documents by union."""
    at = git_root(root)
    if at is None:
        raise ValueError(f"{root} is in no git repository")
    for key, value in (("name", "union of graphs"), ("driver", shlex.join([sys.executable, "-m", "weftgraph.cli", "merge-driver"]) + " %O %A %B")):
        subprocess.run(["git", "-C", str(at), "config", f"merge.weftgraph.{key}", value], check=True)
    attributes = at / ".gitattributes"
    line, text = "graph.json merge=weftgraph\n", attributes.read_text() if attributes.exists() else ""
    if line not in text:
        write_whole(attributes, text + ("" if not text or text.endswith("\n") else "\n") + line)
