"""Texts cut off by field limits or in mid-transfer.

Lengths: per source, a log-normal length distribution is fitted by maximum likelihood, lengths at
candidate limits (values far more frequent than their neighbours) being right-censored. What the
fit expects at a limit against what stands there gives the limit's censoring posterior.

Endings: each text's end is put into one of a few classes. Two distributions over the classes are
needed. How cut texts end shows in self-made cuts of the same texts, at positions hashed from their
keys; a cut that falls between two sentences is none. Whether a source marks its cuts, which
self-made cuts can't show, is learned at its limits, where the censoring posterior tells what was
cut. How whole texts end is learned by expectation maximisation over all texts, the same for all
sources, while each source and each limit has its own share of cut texts: sources that hardly cut
show what whole texts never end with.

A text is truncated if the posterior odds, its limit's or source's share times the likelihood ratio
of its ending, exceed one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.runtime import stored

CLASSES = ("stop", "structure", "formula", "enumerator", "marked", "open", "empty")
#: Characters before the end that the ending's class may depend on.
TAIL = 600
#: Length classes per octave, for the density around a length.
BINS = 64
#: Rounds of expectation maximisation over all sources, and within each.
ROUNDS, INNER = 8, 60
#: Share of cut texts that a source is expected to have, and the weight of this, in texts.
BASE_SHARE, BASE_WEIGHT = 0.02, 10.0
#: Weight of a limit's censoring posterior against the endings found there, in texts.
LIMIT_WEIGHT = 2.0

_MARK = re.compile(r"\s*(?:\.{3,}|…|\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|[\[(<{]\s*(?:text )?(?:truncated|abridged|continued|cut|snip|more|gekürzt|tronqué|truncado)[^\])>}]*[\])>}])\s*$", re.I)
_STOP = re.compile(r"""[.!?。！？][\])}"'’”»]*$""")
_ENUM = re.compile(r"(?:^|\n|[.;:!?]\s)\s*(?:\[(?:[A-Za-zÀ-ÿ]+ ?)?\d+\]|\(?\d{1,3}[.)]|\([a-z]\)|[a-z]\))$")
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:FIGS?|Figs?|Abb|Nos?|Nr|Math|Eq|approx|ca|e\.g|i\.e|cf|vgl|z\.B|bzw|resp|incl|Dr|Prof)\.$")
_BRACKETS = re.compile(r"(?:\([^()]*\)|\[[^\[\]]*\]|(-{2,}|={2,}|\*{2,}) ?[^\n]*\1)$")
_PAGE = re.compile(r"(?:(?:page|seite|página|pagina|p\.) ?\d+(?: ?(?:of|von|de|sur|/) ?\d+)?|-? ?\d+ ?[-/] ?\d* ?)$", re.I)
_CAPTION = re.compile(r"(?:fig|figure|figura|abb|abbildung|table|tabelle|tabla|tableau|tab)\b\.? ?\d+", re.I)
_ROW = re.compile(r"[^|\n]+(?:\|[^|\n]+)+\|?$|[^\t\n]+(?:\t[^\t\n]+)+$")
_ITEM = re.compile(r"(?:\d{1,4}[a-z]?|[-*•–]) +\S+(?: \S+){0,6}$")
_LABELS = re.compile(r"\w[\w .]{2,40}: ?\d+[a-z]? [^.;:]*$")
_EQUATION = re.compile(r"\s*\([^()]{0,20}\d+\)$")
_WORD = re.compile(r"[(\[\"'“„]*[^\W\d_]{3,}[)\]\"'”,.;:!?]*$")
_MATH = re.compile(r"[=∑∫√□≤≥≈±×]|\\[a-z]+|[\^_]\{|&#x|</?su[bp]|[A-Z]\w*[–-][A-Z]{2,}|(?:^|\s)[A-Za-z] \? [A-Za-z0-9]")


def _formula(text: str) -> bool:
    """Whether the text ends with a formula: the last tokens that are no words hold mathematics."""
    tail: list[str] = []
    for token in reversed(_EQUATION.sub("", text)[-160:].split()):
        if (_WORD.match(token) and not _MATH.search(token)) or len(tail) > 24:
            break
        tail.append(token)
    return bool(_MATH.search(" ".join(reversed(tail))))


def ending(text: str | None) -> str:
    """The class of a text's end; truncation marks are taken off first and remembered."""
    if not text or not text.strip():
        return "empty"
    t = text[-TAIL:].rstrip()
    bare = _MARK.sub("", t)
    marked = bare != t and not _STOP.search(bare.rstrip())
    if marked:
        return "marked"
    t = bare.rstrip() if bare.strip() else t
    if _ENUM.search(t) or _ABBREVIATION.search(t):
        return "enumerator"
    lines = t.split("\n")
    last = lines[-1].strip()
    before = lines[-2].strip() if len(lines) > 1 else ""
    paragraph = " ".join(re.split(r"\n\s*\n", t)[-1].split())
    own = len(lines) > 1 and (not before or before[-1] in ".!?:" or bool(_ITEM.match(before)) or bool(_ROW.match(before)))
    if _STOP.search(t):
        return "stop"
    if _ROW.match(last) or _PAGE.match(last) or (own and _ITEM.match(last)) or (len(paragraph) < len(t) and (_LABELS.match(paragraph) or _CAPTION.match(paragraph))):
        return "structure"
    inside = re.split(r"(?<=[.!?:]) |\[\d+\] ?|\n", t)[-1].strip()
    if inside and (_BRACKETS.fullmatch(inside) or _BRACKETS.fullmatch(last)):
        return "structure"
    if own and any(c.isalpha() for c in last) and (last.isupper() or (last.istitle() and len(last.split()) <= 6)) and len(last) <= 60:
        return "structure"
    return "formula" if _formula(t) else "open"


def _between(text: str, k: int) -> bool:
    """Whether a cut at k falls between two sentences, or within the blanks there."""
    return bool(text[k : k + 1].isspace() or text[k - 1 : k].isspace()) and bool(_STOP.search(text[max(0, k - 40) : k].rstrip()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        chars, size, end, cut = [], [], [], []
        for text, at in zip((t.as_py() for t in b.column("text")), b.column("at").to_pylist()):
            n = len(text or "")
            chars.append(n)
            size.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
            end.append(ending(text))
            k = int(n * (0.2 + 0.7 * at))
            cut.append(ending(text[:k]) if n > 40 and not _between(text, k) else None)
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("source"), pa.array(chars, pa.int64()), pa.array(size, pa.int64()), pa.array(end), pa.array(cut, pa.string())], names=["key", "source", "chars", "bytes", "ending", "cut"])


def features(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, chars, bytes, ending, cut) of every non-null text."""
    u = F.shiftrightunsigned(F.xxhash64(F.col(key)), 11) / F.lit(float(1 << 53))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), u.alias("at"))
    kind = {f.name: f.dataType for f in rows.schema}
    names = [("key", kind["key"]), ("source", kind["source"]), ("chars", T.LongType()), ("bytes", T.LongType()), ("ending", T.StringType()), ("cut", T.StringType())]
    return rows.mapInArrow(_features, T.StructType([T.StructField(n, t) for n, t in names]))


def _sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """(mu, sigma) of log lengths by maximum likelihood; ``censored`` of the counts are at least so long."""
    y, w = np.log(np.maximum(lengths, 1).astype(float)), counts.astype(float)
    whole = w - censored
    mu = float(np.average(y, weights=w))
    sigma = max(1e-3, float(np.sqrt(np.average((y - mu) ** 2, weights=w))))
    at = np.flatnonzero(censored > 0)
    for _ in range(rounds if len(at) else 0):
        z = (y[at] - mu) / sigma
        hazard = np.array([math.exp(-x * x / 2) / math.sqrt(2 * math.pi) / max(_sf(x), 1e-300) for x in z])
        first = mu + sigma * hazard
        second = mu * mu + sigma * sigma + sigma * (y[at] + mu) * hazard
        total = w.sum()
        m1 = ((whole * y).sum() + (censored[at] * first).sum()) / total
        m2 = ((whole * y * y).sum() + (censored[at] * second).sum()) / total
        mu, sigma = float(m1), max(1e-3, math.sqrt(max(m2 - m1 * m1, 1e-6)))
    return mu, sigma


def length_classes(rows: DataFrame) -> DataFrame:
    """(source, unit, bin, n, low, high): how many texts have lengths in each class of lengths, from low up to high."""
    low = F.ceil(F.pow(F.lit(2.0), F.col("bin") / BINS))
    high = F.greatest(F.ceil(F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS)), low + 1)
    return rows.groupBy("source", "unit", _bin().alias("bin")).agg(F.sum("n").alias("n")).select("source", "unit", "bin", "n", low.cast("long").alias("low"), high.cast("long").alias("high"))


def _bin():
    return F.floor(F.log2(F.greatest("length", F.lit(1)).cast("double")) * BINS + F.lit(1e-9))


def candidate_limits(exact: DataFrame, classes: DataFrame) -> DataFrame:
    """(source, unit, length, n): lengths far more frequent than those around them.

    ``exact`` has (source, unit, length, n). The density around a length is that of its class and the two
    beside it, without the length itself.
    """
    w = W.partitionBy("source", "unit").orderBy("bin").rangeBetween(-1, 1)  # some thousand classes at most
    around = classes.select("source", "unit", "bin", F.sum("n").over(w).alias("n_around"))
    width = F.pow(F.lit(2.0), (F.col("bin") + 2) / BINS) - F.pow(F.lit(2.0), (F.col("bin") - 1) / BINS)
    expected = (F.col("n_around") - F.col("n")) / F.greatest(width, F.lit(1.0))
    frequent = exact.where((F.col("n") >= 4) & (F.col("length") > 16)).withColumn("bin", _bin())
    return frequent.join(around, ["source", "unit", "bin"]).where(F.col("n") > expected + 6 * F.sqrt(expected) + 3).select("source", "unit", "length", "n")


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """The censoring posterior of each candidate limit of a source; rows are length classes and limits."""
    out = []
    for unit, g in pdf.groupby("unit"):
        at = g[g["is_limit"]]
        rest = g[~g["is_limit"]]
        if at.empty:
            continue
        x = np.r_[rest["length"].to_numpy(float), at["length"].to_numpy(float)]
        n = np.r_[rest["n"].to_numpy(float), at["n"].to_numpy(float)]
        k = np.arange(len(rest), len(x))
        censored = np.zeros(len(x))
        censored[k] = 0.9 * n[k]
        for _ in range(3):
            mu, sigma = fit_censored(x, n, censored)
            z = (np.log(x[k]) - mu) / sigma
            natural = n.sum() * np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * sigma * x[k])
            censored[k] = n[k] * np.clip(1 - natural / n[k], 0.01, 0.99)
        out += [(pdf["source"].iloc[0], unit, int(x[i]), int(n[i]), censored[i] / n[i]) for i in k]
    return pd.DataFrame(out, columns=["source", "unit", "limit", "n", "censored"])


_MARKED = CLASSES.index("marked")
_SHARES = "source string, unit string, limit long, share double, marking double, " + ", ".join(f"whole_{c} double" for c in CLASSES)


def _explain(shape: np.ndarray, whole: np.ndarray, marking: float):
    """Per source: the shares of cut texts in its strata, how often it marks a cut, and how its whole texts end.

    ``shape`` is how cut texts without a mark end, ``whole`` how whole texts do, ``marking`` how often cuts
    are marked where nothing is known of the source.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf[list(CLASSES)].to_numpy(float)
        is_limit = (pdf["unit"] != "none").to_numpy()
        prior = np.where(is_limit, pdf["censored"].to_numpy(float), BASE_SHARE)
        weight = np.where(is_limit, LIMIT_WEIGHT, BASE_WEIGHT)
        share, marks = prior.copy(), marking
        for _ in range(INNER):
            cut = shape * (1 - marks)
            cut[_MARKED] = marks
            r = share[:, None] * cut / (share[:, None] * cut + (1 - share[:, None]) * whole)
            share = np.clip(((k * r).sum(1) + weight * prior) / (k.sum(1) + weight), 1e-5, 1 - 1e-5)
            # what a mark means is learned where lengths tell what was cut
            sure = (k * r)[is_limit]
            marks = float(np.clip((sure[:, _MARKED].sum() + marking) / (sure.sum() + 1), 1e-4, 1 - 1e-4))
        out = pdf[["source", "unit", "limit"]].assign(share=share, marking=marks)
        left = k * (1 - r)
        return out.assign(**{f"whole_{c}": left[:, i] for i, c in enumerate(CLASSES)})

    return run


def detect_truncation(df: DataFrame, key: str, source: str, text: str, use_lengths: bool = True) -> DataFrame:
    """(key, source, chars, bytes, ending, odds, is_truncated) of every non-null text.

    ``use_lengths=False`` leaves the lengths out, to show what they are good for.

    Cases: null texts are left out; empty or blank texts are whole; a null source is a source of
    its own; repeated rows are judged alike; an empty table gives an empty result; only the last
    600 characters of a text bear on its ending, its length being that of the whole text; other
    columns are not read.
    """
    rows = stored(features(df, key, source, text).withColumn("source", F.col("source").cast("string")), "endings")
    named = rows.withColumn("real_source", F.col("source")).withColumn("source", F.coalesce("source", F.lit("\0")))
    counts = {r["cut"]: r["n"] for r in rows.where("cut is not null").groupBy("cut").agg(F.count(F.lit(1)).alias("n")).collect()}  # 7 rows at most
    shape = np.array([0.0 if c in ("marked", "empty") else counts.get(c, 0) + 0.5 for c in CLASSES])
    shape = np.maximum(shape / shape.sum(), 1e-9)
    lengths = named.select("source", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")))).alias("x"))
    exact = lengths.groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    exact = stored(exact if use_lengths else exact.where("false"), "lengths")
    classes = stored(length_classes(exact), "length-classes")
    limits = stored(candidate_limits(exact, classes), "candidates")
    taken = limits.groupBy("source", "unit", _bin().alias("bin")).agg(F.sum("n").alias("taken"))
    rest = classes.join(taken, ["source", "unit", "bin"], "left").select("source", "unit", ((F.col("low") + F.col("high") - 1) / 2).alias("length"), (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n"), F.lit(False).alias("is_limit")).where("n > 0")
    both = rest.unionByName(limits.select("source", "unit", F.col("length").cast("double").alias("length"), "n", F.lit(True).alias("is_limit")))
    fitted = stored(both.groupBy("source").applyInPandas(_fit_source, "source string, unit string, limit long, n long, censored double"), "limits")

    placed = named
    for unit in ("chars", "bytes"):
        one = fitted.where(F.col("unit") == unit).select("source", F.col("limit").alias(unit), F.col("censored").alias(f"{unit}_censored"))
        placed = placed.join(one, ["source", unit], "left")
    by_bytes = F.coalesce("bytes_censored", F.lit(0.0)) > F.coalesce("chars_censored", F.lit(0.0))
    unit = F.when(by_bytes, "bytes").when(F.col("chars_censored").isNotNull(), "chars").otherwise("none")
    placed = placed.withColumn("unit", unit).withColumn("limit", F.when(by_bytes, F.col("bytes")).when(F.col("chars_censored").isNotNull(), F.col("chars")).otherwise(0)).withColumn("censored", F.greatest(F.coalesce("bytes_censored", F.lit(0.0)), F.coalesce("chars_censored", F.lit(0.0))))
    placed = stored(placed.drop("bytes_censored", "chars_censored", "cut"), "placed")
    strata = stored(placed.groupBy("source", "unit", "limit").agg(F.max("censored").alias("censored"), *(F.sum((F.col("ending") == c).cast("double")).alias(c) for c in CLASSES)), "strata")

    sums = lambda d, names: np.array([float(x or 0) for x in d.agg(*(F.sum(c) for c in names)).first()])
    known = strata.where("unit <> 'none'").select((F.col("censored") * F.col("marked")).alias("m"), (F.col("censored") * sum(F.col(c) for c in CLASSES)).alias("n"))
    m, n = sums(known, ["m", "n"])
    marking = (m + 0.5) / (n + 50)
    whole = sums(strata.where("unit = 'none'"), CLASSES)
    for _ in range(ROUNDS):
        whole = (whole + 0.02) / (whole.sum() + 0.02 * len(CLASSES))
        shares = stored(strata.groupBy("source").applyInPandas(_explain(shape, whole, marking), _SHARES), "shares")
        whole = sums(shares, [f"whole_{c}" for c in CLASSES])
    whole = (whole + 0.02) / (whole.sum() + 0.02 * len(CLASSES))
    found = placed.join(shares.select("source", "unit", "limit", "share", "marking"), ["source", "unit", "limit"])
    ratio = F.lit(0.0)
    for i, c in enumerate(CLASSES):
        given_cut = F.col("marking") if c == "marked" else (1 - F.col("marking")) * F.lit(float(shape[i]))
        ratio = F.when(F.col("ending") == c, given_cut / F.lit(float(whole[i]))).otherwise(ratio)
    odds = F.col("share") / (1 - F.col("share")) * ratio
    return found.select("key", F.col("real_source").alias("source"), "chars", "bytes", "ending", odds.alias("odds"), (odds > 1).alias("is_truncated"))


def truncation_report(found: DataFrame) -> DataFrame:
    """(source, n_docs, n_truncated, share) per source."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("is_truncated").cast("long")).alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_docs"))
