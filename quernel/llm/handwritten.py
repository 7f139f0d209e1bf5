"""Generated, minified, vendored and bulk-data files among source code.

Vendored copies: Merkle hashes are computed bottom-up over each root's directory tree, from the
files' normalised contents and the names in a directory, but not its own. A subtree of several
files that unrelated roots share is a copy of third-party code, whatever it is called; roots are
related if most of their files are the same, as forks are. Shared subtrees of any size also tell
the folders that people keep copies in: of a folder's name it is asked how much of what lies below
such folders is shared, and whether that is more like the folders of package managers or like all
others. What lies in such a folder is vendored, shared or not. Files whose header names the package and
version that they were taken from are vendored, too.

Generated files: headers by which tools sign their output, and layouts that only tools produce.
Minified files and bulk data: layout of lines, blanks and literals. Each file's features are
computed where it is read; only hashes and marks are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.runtime import stored

#: A shared subtree must hold so many normalised characters to be evidence, and so many files to be
#: vendored by itself: people copy single files of their own from one project to the next.
LEAST_SHARED = 200
LEAST_FILES = 2
#: Folders that package managers make and fill; one more folder, the package, must follow.
MANAGED = frozenset("node_modules bower_components jspm_packages site-packages godeps vendor carthage pods".split())
#: Odds, before anything is seen, that a folder of another name holds third-party code.
PRIOR_ODDS = 0.02
#: What is shared of third-party code, as parts of ten files, until there is more to go by.
EXPECTED = (2.5, 10.0)
#: Registers of the sketches that tell whether two roots are related.
SKETCH = 16
#: Rounds in which files are dealt to the folder above them that explains best why they are shared.
ROUNDS = 3

CODE = frozenset("py pyi js mjs cjs jsx ts tsx rs go c h cc cpp cxx hpp cs java kt kts scala rb php swift m mm pl pm lua r jl sh bash zsh ps1 sql css scss less vue dart ex exs erl hs ml fs clj groovy zig nim v sv vhd asm s proto thrift".split())
LOCKS = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock cargo.lock gemfile.lock composer.lock go.sum mix.lock flake.lock podfile.lock packages.lock.json uv.lock pdm.lock bun.lock".split())
NOTES = frozenset("md markdown rst txt adoc org toml yaml yml cfg ini conf json5 env properties editorconfig".split())

_GENERATED_PATH = re.compile(r"(?:^|/)__(?:generated|snapshots)__/|\.snap$", re.I)
_MINIFIED_NAME = re.compile(r"[.-]min\.(?:js|css|mjs)$|\.bundle\.(?:js|css)$", re.I)

_COMMENT = re.compile(r"^\s*(?://+!?|/\*+!?|\*|#+!?|--+|;+|%+|<!--|\"\"\"|''')\s?")
#: Signatures that tools are known to put on their output.
_SIGNED = re.compile(r"@generated\b|<auto-?generated\b|\bcode generated\b.*\bdo not edit\b|^auto-?generated\b", re.I)
#: Sentences that say so: that something was made, of what or by whom, and what becomes of changes.
_MADE = re.compile(r"\b(?:auto-?)?(?:generated|produced|created|emitted|compiled|erzeugt|generiert|erstellt|généré|produite?|generad[oa]|cread[oa])\b|\bmachine[- ](?:made|generated|written)\b|\b(?:output|result) of\b", re.I)
_OF = re.compile(r"\b(?:automatic(?:ally)?|automatisch|automatiquement|automáticamente)\b|\b(?:by|from|with|using|aus|von|de|par|por)\s+\S", re.I)
_SUBJECT = re.compile(r"^(?:auto|machine)|\b(?:files?|code|source|modules?|bindings?|parser|this|datei|fichier|archivo)\b", re.I)
_CHANGES = re.compile(r"\b(?:do not|don't|never) (?:edit|modify|change)\b|\b(?:will be|are) (?:lost|overwritten)\b|\bregenerate\b|\b(?:edit|modify|change) \S+ instead\b", re.I)
#: A prohibition with nothing after it is meant for the whole file.
_KEEP_OFF = re.compile(r"\b(?:do not|don't|never)\s+(?:edit|modify|change)(?:\s+(?:by hand|manually|this file|directly))?\s*[.!]*\s*(?:\*/|-->)?\s*$", re.I)
#: A package with its version, and a word of where things come from.
_VERSION = re.compile(r"(?:^|[\s,(])[\w@][\w./@-]*[ -]v?\d+(?:\.\d+)+")
_ORIGIN = re.compile(r"\b(?:third[- ]party|vendored|bundled|embedded|verbatim|unmodified|upstream)\b|@licen[sc]e\b|\b(?:copied|imported|taken|adapted) (?:\w+ )?from\b", re.I)
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|0x[0-9a-fA-F]+|-?\b\d+(?:\.\d+)?\b|[\[\]{}(),:;\s]')
_BLOB = re.compile(r"""["'](?:data:[\w/+.;=-]+,)?[A-Za-z0-9+/=_\\-]*["']""")
_MARKS = ("//", "/*", "*", "#", "--", ";", "%", "<!--", '"""', "'''")
#: What a template leaves of a line: its punctuation and blanks.
_TEMPLATE = {c: None for c in range(128) if chr(c).isalnum() or chr(c) == "_"}
#: Files with smaller shares of digits and, if code, of quotes hold no bulk data worth a closer look:
#: literals of less than 200 characters that make three quarters of a text need as many quotes.
_DIGITS = 0.06
_QUOTES = 0.0075
#: Comments among so many lines count as the header even if code stands between.
_HEADER_LINES = 12
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
#: What goes on with a header beyond those; not directives, attributes, operators and rules of style sheets.
_LINE_COMMENT = re.compile(r"//|/\*|#+(?:\s|$)|##|--+(?:\s|$)|;+(?:\s|$)|%+(?:\s|$)|<!--")


def _header(lines: list[str]) -> list[str]:
    """The comments among the first lines, and all of the comment block that they begin or end in."""
    out, close, leading = [], "", True
    for n, line in enumerate(lines):
        m = _COMMENT.match(line)
        if not close and (m is None or n >= _HEADER_LINES and not _LINE_COMMENT.match(line)):
            if n >= _HEADER_LINES:
                break
            leading = False
            continue
        text = line[m.end() if m else 0 :].strip()
        out.append(text.rstrip("*/->").strip() if line.endswith(("*/", "-->")) else text)
        if close:
            close = "" if close in line else close
        else:
            begin = next((x for x in _BLOCKS if line.startswith(x)), None)
            # three quotes after code may be the end of a text
            if begin is not None and (leading or begin in ("/*", "<!--")) and _BLOCKS[begin] not in line[len(begin) :]:
                close = _BLOCKS[begin]
    return out


def says_generated(comment: str) -> bool:
    """Whether a line of a header says that a tool wrote the file."""
    if _SIGNED.search(comment) or _KEEP_OFF.search(comment):
        return True
    made = _MADE.search(comment)
    return made is not None and bool(_CHANGES.search(comment) or _OF.search(comment) and (made.start() == 0 or _SUBJECT.search(comment)))


def says_vendored(comment: str) -> bool:
    """Whether a line of a header names the package that the file was taken from."""
    return bool(_VERSION.search(comment) and _ORIGIN.search(comment))


def _literal(text: str) -> float:
    """Share of a text that is literals and the punctuation between them.

    A long string counts only if it is encoded bytes; a long pattern or message is one value.
    """
    return sum(len(m) for m in _LITERAL.findall(text) if len(m) < 200 or _BLOB.fullmatch(m)) / max(1, len(text))


def _decode(content: bytes | None) -> str:
    return (content or b"").decode("utf-8", "replace").removeprefix("\ufeff").replace("\r", "")


def classify(path: str | None, text: str) -> str | None:
    """``generated``, ``minified``, ``vendored``, ``data`` or null, by name and content alone."""
    path = path or ""
    name = path.rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if not text.strip():
        return None
    if name.lower() in LOCKS or extension == "lock" or _GENERATED_PATH.search(path):
        return "generated"
    if extension in NOTES or (not extension and not text.startswith("#!")):
        return None
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    head = _header(lines)
    if any(map(says_generated, head)):
        return "generated"
    if any(map(says_vendored, head)):
        return "vendored"
    body = [x for x in lines if not x.startswith(_MARKS) or x.startswith("#include")]
    size = sum(map(len, body))
    if not body or extension not in CODE and extension not in ("json", "html", "svg"):
        return None
    longest = max(body, key=len)
    if extension in CODE and text.count('"') + text.count("'") >= _QUOTES * len(text) or extension not in ("html", "svg") and sum(map(text.count, "0123456789")) >= _DIGITS * len(text):
        if size >= 400 and _literal("\n".join(body)) > 0.75:
            return "data"
        if len(longest) >= 400 and len(longest) > 0.7 * size and _literal(longest) > 0.75:
            return "data"
    if extension in ("js", "mjs", "cjs", "css", "ts", "html", "svg") and len(longest) >= 250 and len(longest) > 0.5 * size:
        blanks = sum(map(longest.count, " \t")) / len(longest)
        if blanks < (0.1 if _MINIFIED_NAME.search(name) else 0.075):
            return "minified"
    if extension in ("html", "svg"):
        return None
    if len(body) >= 5:
        shape, n = Counter(x.translate(_TEMPLATE) for x in body).most_common(1)[0]
        if n >= 0.75 * len(body) and len(shape.strip()) >= 3:
            return "data" if extension == "sql" and body[0].lower().startswith("insert") else "generated"
    return None


def _normalised(text: str) -> str:
    """Content without comment lines, blank lines, indentation and line ends."""
    return "\n".join(x for x in map(str.strip, text.split("\n")) if x and not x.startswith(_MARKS))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        kinds, size, hashes, blank = [], [], [], []
        for path, content in zip(b.column("path").to_pylist(), (c.as_py() for c in b.column("content"))):
            text = _decode(content)
            kinds.append(classify(path, text))
            blank.append(not text.strip())
            body = _normalised(text)
            size.append(len(body))
            hashes.append(xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("root"), b.column("path"), b.column("at"), pa.array(kinds, pa.string()), pa.array(size, pa.int64()), pa.array(hashes, pa.int64()), pa.array(blank, pa.bool_())], names=["key", "root", "path", "at", "kind", "size", "hash", "blank"])


def file_features(df: DataFrame, key: str, root: str, path: str, content: str, at: str) -> DataFrame:
    """One row per key, of its latest version: its mark by name and content, its size and hash, and whether it is blank."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(root).cast("string").alias("root"), F.col(path).cast("string").alias("path"), F.col(content).alias("content"), F.col(at).alias("at"))
    kind = {f.name: f.dataType for f in rows.schema}
    names = [("key", kind["key"]), ("root", T.StringType()), ("path", T.StringType()), ("at", kind["at"]), ("kind", T.StringType()), ("size", T.LongType()), ("hash", T.LongType()), ("blank", T.BooleanType())]
    marked = rows.mapInArrow(_features, T.StructType([T.StructField(n, t) for n, t in names]))
    # latest first; without a time, or at the same time, by hash, so that the result is determined
    best = F.max(F.struct(F.col("at"), F.col("hash"), F.col("root"), F.col("path"), F.col("kind"), F.col("size"), F.col("blank"))).alias("best")
    return marked.groupBy("key").agg(best).select("key", "best.root", "best.path", "best.kind", "best.size", "best.hash", "best.blank")


def merkle_tree(files: DataFrame) -> DataFrame:
    """(root, dir, h1, h2, size, n_files) of every directory, from the rows of ``file_features``.

    A directory's hash is the sum of hashes of its entries' names and hashes, computed level by
    level from the deepest; a sum does not depend on order and combines before the shuffle, so a
    directory with a third of all files is no hot spot. Two independent sums make 128 bits. There
    are as many rounds as the deepest file has folders.
    """
    placed = files.where("path is not null and root is not null").select("root", F.filter(F.split("path", "/"), lambda p: p != "").alias("parts"), "hash", "size").where(F.size("parts") > 0)
    level = F.size("parts")
    leaves = stored(placed.select("root", F.slice("parts", 1, level - 1).alias("dir"), F.element_at("parts", -1).alias("name"), (level - 1).alias("depth"), F.col("hash").alias("h1"), F.col("hash").alias("h2"), "size", F.lit(1).cast("long").alias("n_files")), "leaves")
    depths = [r["depth"] for r in leaves.select("depth").distinct().collect()]  # a row for each depth
    levels, below = [], None
    for d in range(max(depths, default=0), 0, -1):
        entries = leaves.where(F.col("depth") == d).select("root", "dir", "name", "h1", "h2", "size", "n_files") if d in depths else None
        if below is not None:
            entries = below if entries is None else entries.unionByName(below)
        add = [F.expr(f"sum(cast(xxhash64(name, {h}, {s}) as decimal(38, 0)) % 18446744073709551616)") for h, s in (("h1", 1), ("h2", 2))]
        small = [(a % F.lit(2**61 - 1).cast("decimal(38,0)")).cast("long").alias(h) for a, h in zip(add, ("h1", "h2"))]
        here = stored(entries.groupBy("root", "dir").agg(*small, F.sum("size").alias("size"), F.sum("n_files").alias("n_files")), f"dirs{d}")
        levels.append(here)
        below = here.select("root", F.slice("dir", 1, d - 1).alias("dir"), F.element_at("dir", -1).alias("name"), "h1", "h2", "size", "n_files") if d > 1 else None
    out = None
    for here in levels:
        out = here if out is None else out.unionByName(here)
    return out if out is not None else leaves.select("root", "dir", "h1", "h2", "size", "n_files").where("false")


def root_families(files: DataFrame) -> DataFrame:
    """(root, family): related roots, of which most files are the same, are of one family.

    Each root's file hashes are sketched by minima of hash classes. For each minimum the first root
    that has it stands for all; the root that stands for more than half of a root's minima names
    its family.
    """
    h = F.xxhash64("hash")
    minima = files.where("root is not null").groupBy("root", F.pmod(h, F.lit(SKETCH)).alias("class")).agg(F.min(F.xxhash64(h)).alias("least"))
    first = minima.groupBy("class", "least").agg(F.min("root").alias("family"))
    votes = minima.join(first, ["class", "least"]).groupBy("root", "family").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("root").agg(F.sum("n").alias("of"), F.max(F.struct("n", "family")).alias("best"))
    return best.select("root", F.when(F.col("best.n") * 2 > F.col("of"), F.col("best.family")).otherwise(F.col("root")).alias("family"))


def shared_subtrees(tree: DataFrame, families: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(root, dir, n_files) of the directories whose contents occur in unrelated roots, under any name."""
    big = tree.where(F.col("size") >= least)
    copies = big.join(families, "root").groupBy("h1", "h2").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a <> b").select("h1", "h2")
    return big.join(copies, ["h1", "h2"], "left_semi").select("root", "dir", "n_files")


def _folders(files: DataFrame) -> DataFrame:
    """(key, name, depth): the folders above a file that hold it in a further folder."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    above = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p, i: F.struct(F.lower(p).alias("name"), (i + 1).alias("depth")))
    return files.where("path is not null and root is not null").select("key", F.explode(above).alias("f")).select("key", "f.name", "f.depth")


def copy_folders(folders: DataFrame, shared: DataFrame, managed: frozenset[str] = MANAGED) -> DataFrame:
    """(name, n, s, odds) of the folder names whose odds of holding third-party code exceed those against it.

    ``folders`` (key, name, depth) lists the folders above each file, ``shared`` (key, deepest) the depth
    of the deepest shared subtree that a file lies in. Of the files that no folder explains better, n lie
    below folders of a name and s of these in a shared subtree below it. The odds compare s of n with
    the rates among package managers' folders and among all others. Of one name's sharing the folders
    around it have part; so each file is dealt to the folder with the highest rate, in ``ROUNDS`` rounds.
    """
    hits = folders.join(shared, "key", "left").groupBy("key", "name").agg(F.max("depth").alias("depth"), F.coalesce(F.max(F.col("deepest") > F.col("depth")), F.lit(False)).cast("long").alias("hit"))
    counts = stored(hits.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("s")), "folder-names")
    known = F.col("name").isin(sorted(managed)) if managed else F.lit(False)
    sums = counts.agg(*(F.coalesce(F.sum(F.when(k, F.col(c)).otherwise(0)), F.lit(0)).alias(f"{c}{i}") for i, k in enumerate((~known, known)) for c in ("n", "s"))).first()
    copied = (sums["s1"] + EXPECTED[0]) / (sums["n1"] + EXPECTED[1])
    other = min((sums["s0"] + 0.5) / (sums["n0"] + 10.0), copied / 2)
    log_odds = lambda n, s: F.lit(math.log(PRIOR_ODDS)) + s * math.log(copied / other) + (n - s) * math.log((1 - copied) / (1 - other))
    rate = (F.col("s") + 10 * other) / (F.col("n") + 10)
    # names that can't be shown to hold copies need not compete
    rivals = counts.where(~known & (log_odds(F.col("s"), F.col("s")) > 0)).select("name", rate.alias("rate"))
    pairs = stored(hits.join(rivals.select("name"), "name", "left_semi").select("key", "name", "depth", "hit"), "rivals")
    settled = pairs.join(hits.where(known).select("key").distinct(), "key", "left_anti")  # what managers' folders explain
    for _ in range(ROUNDS):
        best = settled.join(rivals, "name").groupBy("key").agg(F.max(F.struct("rate", "depth", "name", "hit")).alias("best"))
        dealt = stored(best.groupBy("best.name").agg(F.count(F.lit(1)).alias("n"), F.sum("best.hit").alias("s")), "dealt")
        rivals = dealt.select("name", rate.alias("rate"))
    return dealt.select("name", "n", "s", log_odds(F.col("n"), F.col("s")).alias("odds")).where("odds > 0")


def find_not_handwritten(df: DataFrame, key: str, root: str, path: str, content: str, at: str, managed: frozenset[str] = MANAGED) -> DataFrame:
    """(key, root, path, kind): every file with the reason why it is not hand-written, else null.

    ``kind`` is generated, minified, vendored or data. ``managed`` are the names of folders, in lower
    case, that are known to hold third-party packages; others are learned from what roots share.

    Cases: rows with a null key are left out; of a key's rows the latest counts, rows without a
    time being the oldest; null or blank contents are hand-written, wherever they lie; files without a
    path or root are judged by what there is; bytes that are not UTF-8 are replaced for judging; an
    empty table gives an empty result; other columns are not read.
    """
    files = stored(file_features(df, key, root, path, content, at), "files")
    shared = shared_subtrees(merkle_tree(files), root_families(files))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    above = files.where("path is not null and root is not null").select("key", "root", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.slice(parts, 1, k))).alias("dir"))
    inside = stored(above.join(shared, ["root", "dir"]).groupBy("key").agg(F.max(F.size("dir")).alias("deepest"), F.max("n_files").alias("n_files")), "inside")
    folders = _folders(files)
    names = copy_folders(folders, inside.select("key", "deepest"), managed).select("name")
    if managed:
        names = names.unionByName(df.sparkSession.createDataFrame([(n,) for n in sorted(managed)], "name string"))
    copied = inside.where(F.col("n_files") >= LEAST_FILES).select("key").unionByName(folders.join(names, "name", "left_semi").select("key")).select(F.col("key").alias("copied")).distinct()
    joined = files.join(copied, F.col("key") == F.col("copied"), "left")
    vendored = F.col("copied").isNotNull() & ~F.col("blank") & ~F.coalesce(F.col("kind") == "generated", F.lit(False))
    return joined.select("key", "root", "path", F.when(vendored, F.lit("vendored")).otherwise(F.col("kind")).alias("kind"))
