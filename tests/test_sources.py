import subprocess

import pytest
from pyspark.sql import functions as F

from quernel.operators.index import build
from quernel.operators.search import Searcher
from quernel.sources import corpus as C
from quernel.sources.git import changes_since, head_commit, parse_paths
from quernel.sources import walk
from quernel.sources.ignore import IgnoreRules, Rule, glob_to_regex, parse_rule


@pytest.fixture
def tree(tmp_path):
    files = {
        "a/b": b"one\n", "a.txt": b"two\n", "z.log": b"log\n", "keep.log": b"kept\n", ".hidden": b"h", ".git/config": b"g", "build/x.o": b"o", "src/build/y.c": b"yy\n",
        "binary": b"a\0b", "late": b"x" * 16_384 + b"\0", "edge": b"x" * 16_383 + b"\0", "big": b"b" * 20_000, "sp ace+%20": b"odd name\n",
    }
    for name, content in files.items():
        path = tmp_path / "r" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "r" / ".gitignore").write_text("# comment\n*.log\n!keep.log\n/build/\n")
    (tmp_path / "r" / "link").symlink_to(tmp_path / "r" / "a.txt")
    (tmp_path / "single.txt").write_bytes(b"alone foo\n")
    return tmp_path


def test_directories(spark, tree):
    files = C.from_directories(spark, [str(tree / "r"), str(tree / "single.txt")], C.IndexConfig(max_file_size=18_000))
    rows = sorted((r["doc_id"], r["path"]) for r in files.select("doc_id", "path").collect())
    assert [p for _, p in rows] == ["a/b", "a.txt", "keep.log", "late", "sp ace+%20", "src/build/y.c", "single.txt"]
    assert [k for k, _ in rows] == list(range(7))
    assert [r["path"] for r in Searcher(files, build(files)).files("foo").collect()] == ["single.txt"]


def listed(spark, *roots, **options):
    return [r["path"] for r in C.from_directories(spark, [str(r) for r in roots], C.IndexConfig(**options)).orderBy("doc_id").collect()]


def test_names_with_an_underscore_are_kept(spark, tmp_path):
    for name in ("__init__.py", "a.py", "_private/c.py", "pkg/_util.py", "pkg/b.py", "_config.yml", "__tests__/deep/_x/y.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = C.from_directories(spark, [str(tmp_path)])
    assert [r["path"] for r in found.orderBy("doc_id").collect()] == ["__init__.py", "__tests__/deep/_x/y.js", "_config.yml", "_private/c.py", "a.py", "pkg/_util.py", "pkg/b.py"]
    assert {bytes(r["content"]) for r in found.collect()} == {b"x = 1\n"}
    assert listed(spark, f"file://{tmp_path}") == listed(spark, tmp_path)


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "secret.py").write_text("s")
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "own.py").write_text("o")
    (tmp_path / "r" / "linked").symlink_to(tmp_path / "out")
    (tmp_path / "r" / "gone").symlink_to(tmp_path / "nowhere")
    (tmp_path / "r" / "self").symlink_to(tmp_path / "r")
    assert listed(spark, tmp_path / "r") == ["own.py"]


def test_ignored_folders_are_not_opened(spark, tmp_path):
    files = {
        ".git/info/exclude": "secret\n", ".gitignore": "build/\n!build/keep.py\n*.log\n!.shown\n/top\n", ".ignore": "!kept.log\nonly.txt\n", "build/keep.py": "", "a.py": "", "secret": "", "x.log": "", "kept.log": "", ".shown": "", ".hidden": "",
        "only.txt": "", "top": "", "sub/top": "", "sub/.gitignore": "!x.log\nb.py\n", "sub/x.log": "", "sub/b.py": "", "sub/c/b.py": "", "b.py": "", "inner/.git/HEAD": "", "inner/x.log": "", "inner/only.txt": "", "inner/secret": "",
    }
    for name, content in files.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(content)
    # a repository inside keeps its own rules, but .ignore files hold for all that is below them
    assert listed(spark, tmp_path / "r") == [".shown", "a.py", "b.py", "inner/secret", "inner/x.log", "kept.log", "sub/top", "sub/x.log"]
    assert listed(spark, tmp_path / "r" / "sub") == ["top", "x.log"]  # the rules of the folders above count
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / ".gitignore").write_text("*.log\n")
    (tmp_path / "plain" / "x.log").write_text("")
    assert listed(spark, tmp_path / "plain") == ["x.log"]  # no repository


def test_many_folders_and_odd_names(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(walk, "SUBTREES", 3)
    want = []
    for k in range(12):
        for d in ("", "deep/er"):
            at = tmp_path / f"d{k:02d}" / d
            at.mkdir(parents=True, exist_ok=True)
            (at / "f").write_text(f"{k}{d}")
            want.append((f"d{k:02d}/{d}/f".replace("//", "/"), f"{k}{d}"))
    assert len(walk.subtrees(walk.tree(str(tmp_path)), 3)) < 20
    got = C.from_directories(spark, [str(tmp_path)])
    assert sorted((r["path"], bytes(r["content"]).decode()) for r in got.collect()) == sorted(want)
    with open(os.path.join(os.fsencode(tmp_path), b"n\xffme"), "wb") as f:
        f.write(b"odd")
    assert [bytes(r["content"]) for r in C.from_directories(spark, [str(tmp_path)]).where("path like 'n%'").collect()] == [b"odd"]
    (tmp_path / "d00" / "f").unlink()
    assert got.where("path = 'd00/f'").first()["content"] is None
    with pytest.raises(ValueError):
        C.from_directories(spark, [])


def test_stores_that_are_not_local(tmp_path):
    (tmp_path / "_a").mkdir()
    (tmp_path / "_a" / "b").write_bytes(b"abc")
    (tmp_path / ".h").write_bytes(b"")
    t = walk.Remote(f"file://{tmp_path}")
    assert list(walk.files(t, "", True)) == [("_a/b", 3)] and t.read("_a/b") == b"abc" and t.read("_a/b", 2) == b"ab" and t.read("none") is None
    assert not t.is_file() and walk.Remote(f"file://{tmp_path}/_a/b").is_file() and [x for x, _ in walk.subtrees(t)] == [b"", b"_a"]


@pytest.mark.parametrize(
    ("rule", "path", "hit"),
    [("*.log", "x/y.log", True), ("*.log", "x.logs", False), ("/a", "a/b", True), ("/a", "b/a", False), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/b", True), ("a/**", "a/b/c", True), ("a/**", "a", False), ("dir/", "dir/x", True), ("dir/", "dir", False), ("f?o", "foo", True), ("[ab]c", "bc", True), ("[!ab]c", "bc", False), (r"\#x", "#x", True), ("x ", "x", True), ("doc/*.txt", "doc/a/b.txt", False)],
)
def test_rules(rule, path, hit):
    found = parse_rule(rule)
    assert found.ignores and IgnoreRules([found]).ignored(path) == hit


def test_rules_as_column(spark):
    rules = IgnoreRules([parse_rule(x) for x in ("*.log", "!keep.log", "build/", "!build/kept.py", "/x/y")])
    paths = ["a.log", "keep.log", "b", "build/kept.py", "a/build/z", "build", "x/y/z", "a/x/y"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r[0] for r in df.where(~rules.matches(F.col("path"))).collect()) == ["a/x/y", "b", "build", "keep.log"]
    assert [rules.ignored(p) for p in paths] == [True, False, False, True, True, False, True, False]
    assert not spark.range(1).where(IgnoreRules().matches(F.lit("a"))).count()
    assert parse_rule("# no") is None and parse_rule("  ") is None and glob_to_regex("a.b") == r"a\.b"
    assert IgnoreRules([Rule("(")]).ignored("(") is False


def test_lines(spark):
    cases = {"": [], "\n": [""], "\n\n": ["", ""], "a\n": ["a"], "a": ["a"], "a\r\nb\r\n": ["a", "b"], "a\r": ["a\r"], "a\n\nb": ["a", "", "b"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", C.lines(F.col("t")).alias("x")).collect()} == cases


def test_filters(spark):
    df = spark.createDataFrame([(".a",), ("a/.b/c",), ("a/b.c",), ("./a",)], "p string")
    assert sorted(r[0] for r in df.where(C.is_visible(F.col("p"))).collect()) == ["./a", "a/b.c"]
    sizes = spark.createDataFrame([(5,), (6,), (None,)], "n long")
    assert sorted(str(r[0]) for r in sizes.where(C.is_small(F.col("n"), C.IndexConfig(max_file_size=5))).collect()) == ["5", "None"]


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for name in ("same", "changed", "gone", "old name"):
        (tmp_path / name).write_text(name * 20)
    git("add", "-A")
    git("commit", "-qm", "one")
    base = head_commit(str(tmp_path))
    (tmp_path / "changed").write_text("other")
    (tmp_path / "gone").unlink()
    git("mv", "old name", "néw")
    (tmp_path / "fresh").write_text("f")
    got = {r["path"]: r["status"] for r in changes_since(spark, str(tmp_path), base).collect()}
    assert got == {"changed": "modified", "gone": "deleted", "old name": "deleted", "néw": "modified", "fresh": "new"}
    assert changes_since(spark, str(tmp_path), None).count() == 0
    assert parse_paths("a\0\0b c\0") == ["a", "b c"] and parse_paths(" a \n\n", "\n") == ["a"]
    with pytest.raises(RuntimeError):
        head_commit("/")
