"""Listing and reading files below a folder, by the tasks, without following links.

Local folders are those that driver and executors all see under one path; other roots are
URIs of a store that pyarrow knows (``s3://``, ``gs://``, ``hdfs://``). Spark's own file source is
not used, as it passes over every file whose name starts with an underscore.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs

from quernel.sources.ignore import Rule, folder, folders_above, is_ignored

#: The driver opens folders until it has so many subtrees to hand out, or has opened so many.
SUBTREES = 1000
#: Contents are handed on in batches of about so many bytes.
BATCH_BYTES = 8 << 20


def is_local(root: str) -> bool:
    return root.startswith("file:") or "://" not in root


def local_path(root: str) -> str:
    path = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
    return os.path.abspath(path)


class Local:
    """A local tree with its ignore files."""

    def __init__(self, root: str, user: Sequence[Rule] = ()):
        self.base, self.user = local_path(root), user
        folder.cache_clear()  # a worker lives longer than what it read

    def exists(self) -> bool:
        return os.path.exists(self.base)

    def is_file(self) -> bool:
        return os.path.isfile(self.base)

    def entries(self, below: str) -> Iterator[tuple[str, bool, int | None]]:
        """(path, whether it is a folder, size) of what the folder at a relative path holds and no rule leaves out.

        A folder that cannot be opened holds nothing.
        """
        at = os.path.join(self.base, below) if below else self.base
        try:
            found = list(os.scandir(at))
        except OSError:
            return
        above = folders_above(at)
        for e in found:
            try:
                if e.is_symlink() or not (is_folder := e.is_dir(follow_symlinks=False)) and not e.is_file(follow_symlinks=False):
                    continue
            except OSError:
                continue
            ignored = is_ignored(above, os.path.join(at, e.name), is_folder, self.user)
            if ignored or ignored is None and e.name.startswith("."):
                continue
            try:
                size = None if is_folder else e.stat(follow_symlinks=False).st_size
            except OSError:
                size = None
            yield (f"{below}/{e.name}" if below else e.name), is_folder, size

    def size(self) -> int | None:
        try:
            return os.path.getsize(self.base)
        except OSError:
            return None

    def read(self, path: str, most: int | None = None) -> bytes | None:
        """The bytes of a file, of the first ``most``; null if it cannot be read."""
        try:
            with open(os.path.join(self.base, path) if path else self.base, "rb") as f:
                return f.read(-1 if most is None else most)
        except OSError:
            return None


class Remote:
    """A tree of a store that has neither links nor ignore files."""

    def __init__(self, root: str):
        self.fs, self.base = pafs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
        self.base = self.base.rstrip("/")

    def _at(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base

    def exists(self) -> bool:
        return self.fs.get_file_info(self.base).type != pafs.FileType.NotFound

    def is_file(self) -> bool:
        return self.fs.get_file_info(self.base).is_file

    def size(self) -> int | None:
        return self.fs.get_file_info(self.base).size

    def entries(self, below: str) -> Iterator[tuple[str, bool, int | None]]:
        for e in self.fs.get_file_info(pafs.FileSelector(self._at(below), allow_not_found=True)):
            is_folder = e.type == pafs.FileType.Directory
            if not e.base_name.startswith(".") and (is_folder or e.is_file):
                yield (f"{below}/{e.base_name}" if below else e.base_name), is_folder, e.size

    def read(self, path: str, most: int | None = None) -> bytes | None:
        try:
            with self.fs.open_input_stream(self._at(path)) as f:
                return f.read(most)
        except OSError:
            return None


def tree(root: str, user: Sequence[Rule] = ()) -> Local | Remote:
    return Local(root, user) if is_local(root) else Remote(root)


def subtrees(t: Local | Remote, enough: int | None = None) -> list[tuple[bytes, bool]]:
    """(folder, whether with all below it): together they are the tree, each file once.

    Only folders are held here; a folder's files are listed by the task that gets it.
    """
    enough = enough or SUBTREES
    waiting, opened = deque([""]), []
    while waiting and len(waiting) < enough and len(opened) < enough:
        at = waiting.popleft()
        opened.append((os.fsencode(at), False))
        waiting.extend(path for path, is_folder, _ in t.entries(at) if is_folder)
    return opened + [(os.fsencode(at), True) for at in waiting]


def files(t: Local | Remote, at: str, deep: bool) -> Iterator[tuple[str, int | None]]:
    """(path, size) of the files in a folder, or in the whole tree below it."""
    waiting = [at]
    while waiting:
        for path, is_folder, size in t.entries(waiting.pop()):
            if not is_folder:
                yield path, size
            elif deep:
                waiting.append(path)


def lister(largest: int | None, window: int, user: Sequence[Rule]):
    """Arrow operator from (n, root, at, deep) to the files (n, root, path, location, size).

    Files above ``largest`` bytes are left out, as are those with a zero byte among the first ``window``.
    ``path`` is text whatever the file's name, ``location`` the name as it is.
    """

    def wanted(t: Local | Remote, path: str, size: int | None) -> bool:
        return (largest is None or size is None or size <= largest) and not (window and b"\0" in (t.read(path, window) or b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Local | Remote] = {}
        for b in batches:
            for n, root, at, deep in zip(*(b.column(c).to_pylist() for c in ("n", "root", "at", "deep"))):
                if root not in trees:
                    trees[root] = tree(root, user)
                t = trees[root]
                held: list[tuple[str, int | None]] = []
                for path, size in [("", t.size())] if t.is_file() else files(t, os.fsdecode(at), deep):
                    if wanted(t, path, size):
                        held.append((path, size))
                    if len(held) >= 10_000:
                        yield _rows(n, root, held)
                        held = []
                if held:
                    yield _rows(n, root, held)

    return run


def _rows(n: int, root: str, held: list[tuple[str, int | None]]) -> pa.RecordBatch:
    raw = [os.fsencode(p) for p, _ in held]
    shown = [p.decode("utf-8", "replace") if p else os.path.basename(root.rstrip("/")) for p in raw]
    return pa.RecordBatch.from_arrays([pa.array([n] * len(held), pa.int32()), pa.array([root] * len(held)), pa.array(shown), pa.array(raw, pa.binary()), pa.array([s for _, s in held], pa.int64())], names=["n", "root", "path", "location", "size"])


def read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow operator from (doc_id, root, path, location) to (doc_id, root, path, content); null if unreadable."""
    trees: dict[str, tuple[Local | Remote, bool]] = {}
    for b in batches:
        held: list[bytes | None] = []
        n, start = 0, 0
        roots, places = b.column("root").to_pylist(), b.column("location").to_pylist()
        for k, (root, place) in enumerate(zip(roots, places)):
            if root not in trees:
                t = tree(root)
                trees[root] = t, t.is_file()
            t, alone = trees[root]
            held.append(t.read("" if alone else os.fsdecode(place)))
            n += len(held[-1] or b"")
            if n >= BATCH_BYTES or k + 1 == len(roots):
                part = b.slice(start, len(held))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("root"), part.column("path"), pa.array(held, pa.binary())], names=["doc_id", "root", "path", "content"])
                held, n, start = [], 0, k + 1
