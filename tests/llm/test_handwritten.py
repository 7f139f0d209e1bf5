import pytest

from quernel.llm import handwritten as H

CODE = "import os\n\n\ndef run(a, b=3):\n    for x in range(a):\n        if x > b:\n            return os.sep * x\n    # do not edit this while the queue is open\n    return None\n"


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a/b.py", CODE, None), ("a/b.py", "# Code generated by protoc-x 1.2. DO NOT EDIT.\n" + CODE, "generated"), ("a/b.py", 'HEADER = "Code generated by {}. DO NOT EDIT."\n' + CODE, None), ("a/b.go", "// @generated by tool\n" + CODE, "generated"),
        ("a/b.ts", "/* This file was produced automatically by xgen; changes will be lost. */\nlet a = 1;\n", "generated"), ("a/b.c", "// Diese Datei wurde automatisch aus x.idl erzeugt.\nint a;\n", "generated"), ("a/b.py", "# values generated by x are clipped to 3\n" + CODE, None),
        ("a/b.rs", "// machine made from x.y (xgen 1.2.3)\nfn a() {}\n", "generated"), ("a/b.js", "// plots of the generated load, tuned by hand for x\n" + CODE, None), ("a/yarn.lock", "[[package]]\n", "generated"), ("a/__snapshots__/x.test.js.snap", "exports[`a`] = 1;", "generated"),
        ("a/src/vendors/x.py", CODE, None), ("a/b.py", "# Taken verbatim from left-pad 1.3.0\n" + CODE, "vendored"), ("a/b.py", "# works with left 1.2.3 or later\n" + CODE, None), ("a/build/external_x.js", "// talks to the third_party gateway, see vendor portal\n" + CODE, None),
        ("a/b.js", "// Bundled copy of left 1.2.3. Upstream changes only.\nlet a = 1;\n", "vendored"), ("a/b.js", "/*! @license left v1.2.3 | (c) left contributors */\nlet a = 1;\n", "vendored"), ("a/b.py", "# left 1.2.3 - embedded here to avoid a dependency\n" + CODE, "vendored"),
        ("a/b.js", "!function(a){a.b=" + ";".join(f'x{k}=function(e){{return e.t{k}}}' for k in range(40)) + "}(t);", "minified"), ("a/b.css", "".join(f".a{k}{{margin:{k}px;color:#fff}}" for k in range(60)), "minified"),
        ("a/b.py", f'PATTERN = r"{"|".join(f"word{k}" for k in range(150))}"\n' + CODE, None), ("a/b.c", "const unsigned char x[] = {\n" + "0x1f,0x2e,0x3d,\n" * 60 + "};\n", "data"), ("a/b.sql", "INSERT INTO t VALUES (1, 'abc', 2);\n" * 30, "data"),
        ("a/b.js", "var t = [" + ", ".join(f'{{"id": {k}, "name": "n{k}"}}' for k in range(80)) + "];\n", "data"), ("a/b.py", "SMALL = [1, 2, 3, 5, 8]\n" + CODE, None), ("a/b.go", "".join(f"func (m *T{k}) GetA{k}() int32 {{ return m.a{k} }}\n" for k in range(9)), "generated"),
        ("a/notes.md", "- generated by hand\n" * 20, None), ("a/x.yaml", "a: 1\n" * 40, None), ("a/e.py", "", None), ("a/e.py", "\n\n", None), (None, CODE, None), ("a/b.py", "x", None), ("README", "do not edit\n" * 9, None),
    ],
)
def test_classes(path, text, want):
    assert H.classify(path, text) == want


SCHEMA = "id long, root int, path string, content binary, at timestamp, kind string"


def row(k, root, path, text, at=None):
    return (k, root, path, None if text is None else bytearray(text if isinstance(text, bytes) else text.encode()), at, "z")


def found(df, **options):
    return {r["key"]: r["kind"] for r in H.find_not_handwritten(df, "id", "root", "path", "content", "at", **options).collect()}


def own(root, n=8):
    """Files that no other root has."""
    return [row(1000 * root + k, root, f"src/own{k}.py", CODE * 3 + f"z = {root}, {k}\n") for k in range(n)]


def marked(df, **options):
    return {k: v for k, v in found(df, **options).items() if v}


def test_shared_subtrees(table):
    body = CODE * 3
    rows = [
        row(1, 1, "app/copied/lib/a.py", body), row(2, 1, "app/copied/lib/sub/b.py", body + "x = 1\n"), row(3, 2, "other/copied/lib/a.py", "# Copyright\r\n" + body.replace("\n", "\r\n")), row(4, 2, "other/copied/lib/sub/b.py", body + "x = 1\n"),
        row(5, 1, "app/own/a.py", body + "y = 1\n"), row(6, 2, "other/own/a.py", body + "z = 1\n"), row(7, 1, "x/same/a.py", body + "w = 1\n"), row(8, 1, "y/same/a.py", body + "w = 1\n"), row(9, 3, "t/tiny/a.py", "a = 1\n"), row(10, 4, "t/tiny/a.py", "a = 1\n"),
        row(11, 3, "one/file.py", body + "v = 1\n"), row(12, 4, "alone/file.py", body + "v = 1\n"),
    ]
    rows += own(1) + own(2) + own(3) + own(4)
    assert marked(table(rows, SCHEMA, files=2)) == dict.fromkeys((1, 2, 3, 4), "vendored")


def library(k, root, folder):
    """Five files in two folders, with the notes that came with them."""
    texts = [CODE * 2 + f"u = {j}\n" for j in range(4)] + ["# how to use it " * 20]
    return [row(k + j, root, f"{folder}/{name}", t) for j, (name, t) in enumerate(zip(("a.py", "b.py", "in/c.py", "in/d.py", "README.md"), texts))]


def test_a_renamed_copy_is_found(table):
    rows = own(1) + own(2) + own(3) + library(1, 1, "app/left-1.0") + library(11, 2, "deep/down/here/renamed") + library(21, 3, "left")
    assert marked(table(rows, SCHEMA, files=2)) == dict.fromkeys([*range(1, 6), *range(11, 16), *range(21, 26)], "vendored")


def test_forks_are_no_copies(table):
    fork = [row(k + 500, 2, p.replace("src", "source"), bytes(c)) for k, _, p, c, _, _ in own(1)]
    rows = own(1) + fork + [row(9001, 2, "source/new.py", CODE * 4)]
    assert marked(table(rows, SCHEMA)) == {}
    # what a fork and its origin took from elsewhere is still a copy
    rows += own(3) + library(1, 1, "app/left") + library(11, 2, "app/left") + library(21, 3, "x/right")
    assert set(marked(table(rows, SCHEMA))) == {*range(1, 6), *range(11, 16), *range(21, 26)}


def test_folders_of_copies_are_learned(table):
    rows, k = [], 0
    for root in range(1, 9):
        rows += own(root)
        for lib in range(4):  # each package is in two roots
            k += 1
            rows.append(row(k, root, f"web/extlib/p{lib}/x.py", CODE * 3 + f"p = {lib}, {root // 2}\n"))
        k += 1
        rows.append(row(k, root, f"web/extlib/own{root}/x.py", CODE * 3 + f"q = {root}\n"))  # of no other root
        rows.append(row(k + 5000, root, f"web/pages/p{root}/x.py", CODE * 3 + f"r = {root}\n"))
    assert marked(table(rows, SCHEMA, files=2)) == dict.fromkeys(range(1, k + 1), "vendored")
    alone = [row(1, 1, "a/vendor/lib/x.go", CODE), row(2, 1, "a/node_modules/p/README.md", "# p"), row(3, 1, "a/vendor/x.go", CODE), row(4, 1, "a/vendor/lib/empty.go", " "), row(5, 1, "a/vendor/lib/y.go", "// Code generated by x. DO NOT EDIT.\n"), row(6, 1, "a/extlib/lib/x.go", CODE)]
    assert marked(table(alone, SCHEMA)) == {1: "vendored", 2: "vendored", 5: "generated"}
    assert marked(table(alone, SCHEMA), managed=frozenset(["extlib"])) == {5: "generated", 6: "vendored"}


def test_merkle_hash_sees_names_and_contents(table):
    def hashes(rows):
        files = H.file_features(table(rows, SCHEMA), "id", "root", "path", "content", "at")
        return {"/".join(r["dir"]): (r["h1"], r["h2"]) for r in H.merkle_tree(files).collect()}

    base = hashes([row(1, 1, "a/b/x.py", CODE), row(2, 1, "a/y.py", CODE)])
    assert set(base) == {"a", "a/b"} and base == hashes([row(2, 1, "a/y.py", CODE), row(1, 1, "a/b/x.py", CODE)])
    renamed, changed = hashes([row(1, 1, "a/b/z.py", CODE), row(2, 1, "a/y.py", CODE)]), hashes([row(1, 1, "a/b/x.py", CODE + "q = 1"), row(2, 1, "a/y.py", CODE)])
    assert renamed["a"] != base["a"] != changed["a"] and renamed["a/b"] != base["a/b"] != changed["a/b"]


def test_odd_rows(table):
    import datetime as dt

    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    gen = "# @generated\n" + CODE
    rows = [row(1, 1, "a.py", CODE, early), row(1, 1, "a.py", gen, late), row(2, 1, "b.py", gen, None), row(2, 1, "b.py", CODE, early), row(3, None, None, None), row(None, 1, "c.py", gen), row(4, 1, "/".join("d" * 100) + "/x.py", b"\xff\xfe" + CODE.encode()), row(5, 1, "big.py", CODE * 20_000), row(6, 1, "", ""), row(1, 1, "a.py", gen, late)]
    assert found(table(rows, SCHEMA)) == {1: "generated", 2: None, 3: None, 4: None, 5: None, 6: None}
    assert found(table([], SCHEMA)) == {}


LICENCE = [*(f"Line {k} of a licence, under which this file is distributed without warranties" for k in range(17)), "", "limitations under the License."]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a/b.go", "\n".join(f"// {x}" for x in LICENCE) + "\n\n// Code generated by protoc-gen-x. DO NOT EDIT.\npackage a\n" + CODE, "generated"), ("a/b.py", "\n".join(f"# {x}" for x in LICENCE) + "\n# @generated by tool\n" + CODE, "generated"),
        ("a/b.c", "/*\n" + "\n".join(f" * {x}" for x in LICENCE) + "\n */\n/* This file was generated by xgen */\nint a;\n", "generated"), ("a/b.c", "/*\n" + "\n".join(LICENCE) + "\n*/\n// Bundled copy of left 1.2.3. Upstream changes only.\nint a;\n", "vendored"),
        ("a/b.php", "<?php\n/*\n" + "\n".join(LICENCE) + "\n@generated\n*/\n" + CODE, "generated"), ("a/b.c", "/*\n" + "\n".join(LICENCE) + "\n*/\n" + CODE, None), ("a/b.py", "\n".join(f"# {x}" for x in LICENCE) + "\n" + CODE + "# @generated by tool\n", None),
        ("a/b.c", "#include <a.h>\n" * 14 + "// @generated is what the writer puts here\n" + CODE, None), ("a/b.py", 'x = """\na\n"""\n' + CODE * 3 + "emit('@generated')\n", None),
    ],
)
def test_header_of_any_length(path, text, want):
    assert H.classify(path, text) == want


WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tre") for b in ("ran", "stol", "vik") for c in ("a", "en", "ost", "ulf")]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a/b.html", "<html><head><title>x</title></head>" + "".join(f'<div><a href="/p{k}">n{k}</a></div>' for k in range(40)) + "</html>", "minified"), ("a/b.svg", "<svg>" + "".join(f"<g><use/><set/><a/></g><v{k}/>" for k in range(30)) + "</svg>", "minified"),
        ("a/b.html", "<html>\n" + "".join(f'  <p class="x">\n    some words of number {k}\n  </p>\n' for k in range(9)) + "</html>\n", None), ("a/b.svg", "<svg>\n" + '  <rect width="1" height="2"/>\n' * 20 + "</svg>\n", None),
        ("a/b.py", "WORDS = [" + ", ".join(f'"{w}"' for w in WORDS) + "]\n", "data"), ("a/b.js", "const w = [\n" + "".join("  " + ", ".join(f"'{w}'" for w in WORDS[k : k + 3 + k % 4]) + ",\n" for k in range(0, 40, 5)) * 2 + "];\n", "data"),
        ("a/b.json", "{" + ", ".join(f'"{w}": "{w}"' for w in WORDS) + "}\n", None), ("a/b.py", 'SMALL = ["ka", "lo", "mi"]\n' + CODE, None), ("a/b.py", "".join(f"    if name == '{w}' and state.open:\n        return handler.{w}(name, state)\n" for w in WORDS[:6]), None),
    ],
)
def test_rules_reach_their_cases(path, text, want):
    assert H.classify(path, text) == want
