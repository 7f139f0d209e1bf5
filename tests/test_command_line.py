import subprocess

import pytest

from quernel.__main__ import main


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text("fn main() {\n    // TODO: foo\n}\n")
    (tmp_path / "src.txt").write_text("Foo\nfoo\n")
    (tmp_path / "b.py").write_text("def bar():\n    pass\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    return tmp_path


def run(capsys, *args):
    code = main([str(a) for a in args])
    return code, capsys.readouterr().out.splitlines()


def test_index_and_search(spark, project, capsys):
    assert main(["index", str(project), "-v"]) == 0
    assert "3 files" in capsys.readouterr().err
    assert run(capsys, "search", "foo", project) == (0, ["src/a.rs:    // TODO: foo", "src.txt:foo"])
    assert run(capsys, "search", "-n", "-i", "FOO", project) == (0, ["src/a.rs:2:    // TODO: foo", "src.txt:1:Foo", "src.txt:2:foo"])
    assert run(capsys, "search", "-c", "-i", "foo", project) == (0, ["src/a.rs:1", "src.txt:2"])
    assert run(capsys, "search", "-l", "-c", "fn|def", project) == (0, ["b.py", "src/a.rs"])
    assert run(capsys, "search", "-f", r"\.rs$", "foo", project) == (0, ["src/a.rs:    // TODO: foo"])
    assert run(capsys, "search", "absent", project) == (1, [])
    assert run(capsys, "search", "(", project)[0] == 2
    assert run(capsys, "search", "foo", project / "src")[0] == 2


def test_fresh(spark, project, capsys):
    assert main(["index", str(project)]) == 0
    (project / "new.txt").write_text("foo new\n")
    (project / "src.txt").write_text("changed foo\n")
    (project / "src" / "a.rs").unlink()
    assert run(capsys, "search", "--fresh", "foo", project) == (0, ["new.txt:foo new", "src.txt:changed foo"])
    assert run(capsys, "search", "--fresh", "-c", "foo", project) == (0, ["new.txt:1", "src.txt:1"])


def test_several_paths_and_options(spark, project, tmp_path, capsys):
    other, out = tmp_path / "other", tmp_path / "out"
    other.mkdir()
    (other / "_x.txt").write_text("foo in other\n")
    (other / "large.txt").write_text("foo " * 100)
    assert main(["index", str(project / "src"), str(other), str(project / "b.py"), "-o", str(out), "--max-file-size", "100"]) == 0
    assert "3 files" in capsys.readouterr().err
    assert run(capsys, "search", "foo|bar", project, "--index-dir", out) == (0, ["b.py:def bar():", "_x.txt:foo in other", "a.rs:    // TODO: foo"])
    assert run(capsys, "search", "-l", "large", project, "--index-dir", out) == (1, [])
    (other / "_x.txt").unlink()  # a file that is gone is passed over
    assert run(capsys, "search", "foo", project, "--index-dir", out) == (0, ["a.rs:    // TODO: foo"])
    assert main(["index", str(tmp_path / "none"), "-o", str(out)]) == 2
