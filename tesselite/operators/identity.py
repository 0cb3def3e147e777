"""The identity of a project: its remote in normal form, or its path."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselite.functions.text import col, stripped

# fixed values: schemes of remotes, stripped in this order, each at most once
PREFIXES = ("https://", "http://", "git@", "ssh://")


def normal_remote(url: Column | str) -> Column:
    """A remote without scheme, ending `.git` and capitals; NULL stays NULL."""
    url = stripped(col(url))
    for p in PREFIXES:
        url = F.when(url.startswith(p), F.substring(url, len(p) + 1, 1 << 20)).otherwise(url)
    return F.lower(F.regexp_replace(url, r"\.git$", ""))


def project_id(root_path: Column | str, git_remote: Column | str) -> Column:
    """`git:` and the remote, or `local:` and the root where there is no remote."""
    remote = col(git_remote)
    return F.when(F.coalesce(stripped(remote), F.lit("")) != "", F.concat(F.lit("git:"), normal_remote(remote))).otherwise(F.concat(F.lit("local:"), col(root_path)))


def resolve(path: str) -> tuple[str, str, str | None]:
    """project_id, root and remote of a directory of this machine; asks git on the driver."""
    start = Path(path).expanduser().resolve()
    start = start.parent if start.is_file() else start
    root = next((p for p in (start, *start.parents) if (p / ".git").is_dir()), start)
    try:
        said = subprocess.run(["git", "-C", str(root), "remote", "get-url", "origin"], capture_output=True, text=True, timeout=5, check=True)
        remote = said.stdout.strip() or None
    except (subprocess.SubprocessError, OSError):
        remote = None
    if not remote:
        return f"local:{root}", str(root), None
    name = remote
    for p in PREFIXES:
        name = name.removeprefix(p)
    return "git:" + name.removesuffix(".git").lower(), str(root), remote
