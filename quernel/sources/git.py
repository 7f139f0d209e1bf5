"""Driver-side helpers around the git command, for corpora that are working trees."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _run(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode("utf-8", "surrogateescape")


def parse_paths(listing: str, separator: str = "\0") -> list[str]:
    """The paths of a listing, blank entries left out."""
    return [p for p in (x.strip() if separator == "\n" else x for x in listing.split(separator)) if p]


def head_commit(root: str) -> str:
    return _run(root, "rev-parse", "HEAD").strip()


def changes_since(spark: SparkSession, root: str, base: str | None) -> DataFrame:
    """(path, status) of what changed since a commit: committed, staged, unstaged and untracked.

    A renamed file is a deleted and a new one. Without a base commit there is no change.
    """
    import os

    status: dict[str, str] = {}
    if base and base.strip():
        listed: list[str] = []
        for extra in ([base, "HEAD"], [], ["--cached"]):
            listed += parse_paths(_run(root, "diff", "--name-only", "--no-renames", "-z", *extra))
        for p in listed:
            status[p] = "modified" if os.path.lexists(os.path.join(root, p)) else "deleted"
        for p in parse_paths(_run(root, "ls-files", "--others", "--exclude-standard", "-z")):
            status.setdefault(p, "new")
    return spark.createDataFrame(sorted(status.items()), "path string, status string")
