"""Ignore files (``.ignore``, ``.gitignore``, ``.git/info/exclude``): which files of a tree they leave out.

An entry of an ignored folder is ignored, whatever rules it matches itself: the folder is never
opened. Of the rules that an entry matches, those of ``.ignore`` files go before those of
``.gitignore`` files, these before the repository's own exclude file, and this before the user's;
among files of one kind the one nearest to the entry decides, and in a file the last line.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """``pattern`` is searched in the path of an entry relative to the folder of the ignore file."""

    pattern: str
    ignores: bool = True
    only_folders: bool = False


def glob_to_regex(glob: str) -> str:
    """A path glob as a regular expression that Java and Python both know."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("/**", k) and k + 3 == len(glob):
            out, k = out + "/.+", k + 3
        elif c == "*":
            out, k = out + "[^/]*", k + 1
            while glob[k : k + 1] == "*":
                k += 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, k = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        elif c == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return out


def parse_rule(line: str) -> Rule | None:
    """The rule of a line of an ignore file; null for blanks and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line if ignores else line[1:]
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    return Rule(("^" if anchored else "^(?:.*/)?") + glob_to_regex(line.lstrip("/")) + "$", ignores, only_folders)


def parse_rules(lines: Iterable[str]) -> tuple[Rule, ...]:
    return tuple(r for r in map(parse_rule, lines) if r)


@lru_cache(maxsize=100_000)
def _compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error:  # a glob that is none, such as [z-a], names nothing
        return re.compile(r"(?!)")


def verdict(rules: Sequence[Rule], path: str, is_folder: bool) -> bool | None:
    """Whether the last rule that an entry matches ignores it; null if it matches none."""
    for r in reversed(rules):
        if (is_folder or not r.only_folders) and _compiled(r.pattern).search(path):
            return r.ignores
    return None


@dataclass
class IgnoreRules:
    """The rules of one ignore file over the paths below its folder."""

    rules: Sequence[Rule] = field(default_factory=list)

    def ignored(self, path: str) -> bool:
        """Whether a file or a folder above it is ignored."""
        parts = path.split("/")
        return any(verdict(self.rules, "/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1))

    def matches(self, path: Column) -> Column:
        """The same as a column, for the paths of a table."""
        if not self.rules:
            return F.lit(False)
        parts = F.split(path, "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k < F.size(parts)).alias("is_folder")))

        def one(entry: Column) -> Column:
            hits = [F.when((entry["is_folder"] if r.only_folders else F.lit(True)) & entry["path"].rlike(r.pattern), k).otherwise(-1) for k, r in enumerate(self.rules)]
            last = F.greatest(F.lit(-1), *hits)
            return (last >= 0) & F.array(*(F.lit(r.ignores) for r in self.rules))[F.greatest(last, F.lit(0))]

        return F.exists(above, one)


def _read(path: str) -> tuple[Rule, ...]:
    try:
        with open(path, encoding="utf-8", errors="replace") as lines:
            return parse_rules(lines)
    except OSError:
        return ()


class Folder(NamedTuple):
    """What a local folder says of the entries below it."""

    path: str
    ignore: tuple[Rule, ...]
    git: tuple[Rule, ...]
    exclude: tuple[Rule, ...]
    is_repository: bool


@lru_cache(maxsize=10_000)
def folder(path: str) -> Folder:
    at = lambda name: os.path.join(path, name)
    return Folder(path, _read(at(".ignore")), _read(at(".gitignore")), _read(at(".git/info/exclude")), os.path.exists(at(".git")))


def folders_above(path: str) -> tuple[Folder, ...]:
    """The folders from the top of the file system down to ``path``, which is one of them."""
    parts = os.path.abspath(path).split("/")[1:]
    names = ["/"] + ["/" + "/".join(parts[: k + 1]) for k in range(len(parts)) if parts[k]]
    return tuple(map(folder, names))


def is_ignored(above: Sequence[Folder], path: str, is_folder: bool, user: Sequence[Rule] = ()) -> bool | None:
    """Whether the entry at an absolute path is ignored by the folders above it; null if nothing names it.

    Rules for repositories hold only within one, and only its own.
    """

    def said(rules: Sequence[Rule], f: Folder) -> bool | None:
        return verdict(rules, path[len(f.path.rstrip("/")) + 1 :], is_folder) if rules else None

    for f in reversed(above):
        if (v := said(f.ignore, f)) is not None:
            return v
    top = max((k for k, f in enumerate(above) if f.is_repository), default=None)
    if top is None:
        return None
    for f in reversed(above[top:]):
        if (v := said(f.git, f)) is not None:
            return v
    for rules in (above[top].exclude, user):
        if (v := said(rules, above[top])) is not None:
            return v
    return None


def user_rules() -> tuple[Rule, ...]:
    """The rules of the user's own ignore file, if there is one."""
    try:
        done = subprocess.run(["git", "config", "--global", "--get", "--type=path", "core.excludesFile"], capture_output=True, check=False)
        path = done.stdout.decode(errors="replace").strip()
    except OSError:
        path = ""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return _read(path or os.path.join(home, "git", "ignore"))
