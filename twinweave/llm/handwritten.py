"""Files that nobody wrote by hand: generated, minified, vendored, or data stored as code.

Two linear support-vector classifiers on hashed features, one of a file's body
(character n-grams of its bytes and of their shape) and one of its path
(components, parts and shape of the name). Nobody has labelled the files, so
labels come from giveaways: banners that tools and vendors put into the first or last comment,
and directories and name endings that say so. What gave a label away
is masked from the classifier that learns it: leading and trailing comments never
reach the body's features, and the body's labels come from banners and paths,
the path's from banners alone. So a file without any banner, in an ordinary place, is
found by what its body or its name is like. Training, on a bounded sample, holds
out whole repositories in turn: accuracy is measured on them, and files that look
made to classifiers of the other repositories are not taken for hand-written ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm.parse.check import check_source, extension
from twinweave.llm.syntax import repository
from twinweave.session import drawn, spread

#: Hash buckets of each kind of feature.
BUCKETS = 1 << 12
#: Length of n-grams of bytes and of shapes.
BYTE_GRAM, SHAPE_GRAM = 4, 6
#: Files drawn for training, of which the labelled are used.
SAMPLE = 9000
#: Parts into which repositories are divided; each is judged by classifiers that haven't seen it.
FOLDS = 4

# How tools and vendors mark their files in any collection: that something made the file, that edits are of no use, where it is from.
_MADE = r"(?:generated|produced|created|emitted|built|written|compiled|bundled|derived|erzeugt|generiert|erstellt|généré|generado)"
_BY = r"(?:by|from|with|using|via|automatically|durch|von|aus|par|por)"
TOOL_BANNERS = (
    r"@generated\b",
    r"<?auto-?matically[ -]generated|<?auto-?generated",
    r"\bmachine[- ](?:written|made|generated|produced)\b",
    rf"\b(?:code|file|source|module|script|header|datei|fichier|archivo)\b[^\n]{{0,25}}\b{_MADE}\b[^\n]{{0,20}}\b{_BY}\b",
    rf"^\W*{_MADE}\s+(?:automatically\s+)?{_BY}\b|\b{_MADE}\s+automatically\b|\bautomati(?:cally|sch)\s+{_MADE}\b",
    rf"\b{_MADE}\b[^\n]{{0,60}}\bdo\s+not\s+(?:edit|modify|change|touch)\b",
    r"\b(?:edits?|changes?|modifications?|änderungen)\b[^\n]{0,40}\b(?:lost|overwritten|discarded|wiped|undone|überschrieben)\b",
)
VENDOR_BANNERS = (
    r"^\W*(?:upstream|origin|homepage)\s*:\s*\S+/\S+",
    r"\b(?:imported|copied|taken|vendored|mirrored|forked|synced|adapted|pulled)\s+(?:verbatim\s+|unchanged\s+)?from\b[^\n]{0,60}(?:release|tag|version|commit|upstream|v?\d+\.\d+|https?://)",
    r"^\W*\w[\w.-]* (?:v|- version |version |release )\d+\.\d+\.\d+",
    r"(?:\(c\)|copyright)[^\n]{0,40}\b(?:project|authors|contributors|foundation)\b",
)
# Directories and name parts that are kept for such files, in lower case.
VENDOR_DIRS = ("vendor", "vendored", "third_party", "thirdparty", "node_modules", "contrib", "external", "deps", "bower_components", "site-packages")
TOOL_DIRS = ("generated", "__generated__", "gen", "dist", "build", "out")
TOOL_PARTS = ("min", "bundle", "pb", "gen", "g", "generated", "designer")
DATA_DIRS = ("resources", "tables", "data", "assets")

#: Unlabelled files that others' classifiers score above this are no examples of hand-written ones.
DOUBT = -0.4

#: Characters at either end of a file in which banners are looked for.
BANNER_CHARS = 1500

_COMMENT = r"(?://[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->)"
_LEADING = re.compile(rf"\A(?:\s*{_COMMENT})+")
_LEADING_PY = re.compile(r"\A(?:\s*#[^\n]*)+")
_TRAILING = re.compile(r"(?:(?:\A|\n)\s*(?://[^\n]*|/\*(?:[^*]|\*(?!/))*\*/))+\s*\Z")
_TRAILING_PY = re.compile(r"(?:\n\s*#[^\n]*)+\s*\Z")

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(65, 91), *range(97, 123), 95, *range(128, 256)]] = ord("a")
_SHAPE[48:58] = ord("0")
_SHAPE[[9, 13]] = ord(" ")
_FOLDS = np.zeros(256, bool)
_FOLDS[[ord("a"), ord("0"), ord(" ")]] = True


def masked(text: str, ext: str) -> str:
    """The text without the comments it begins and ends with."""
    python = ext == "py"
    if m := (_LEADING_PY if python else _LEADING).match(text):
        text = text[m.end() :]
    tail = max(0, len(text) - 2000)
    if m := (_TRAILING_PY if python else _TRAILING).search(text, tail):
        text = text[: m.start()]
    return text.strip()


def _grams(b: np.ndarray, n: int) -> np.ndarray:
    """log(1 + count) of the hashed n-grams of bytes, of length 1."""
    if len(b) < n:
        return np.zeros(BUCKETS, np.float32)
    w = b.astype(np.uint32)
    h = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        h *= np.uint32(0x01000193)
        h += w[i : len(w) - n + 1 + i]
    h *= np.uint32(0x9E3779B1)
    out = np.log1p(np.bincount(h >> np.uint32(32 - 12), minlength=BUCKETS)).astype(np.float32)
    return out / np.sqrt(out @ out)


def body_features(text: str, ext: str) -> np.ndarray:
    """Features of a file's body, without its leading and trailing comments."""
    raw = np.frombuffer(masked(text, ext).encode("utf-8", "replace"), np.uint8)
    shape = _SHAPE[raw]
    if len(shape):
        keep = np.ones(len(shape), bool)
        keep[1:] = (shape[1:] != shape[:-1]) | ~_FOLDS[shape[1:]]
        shape = shape[keep]
    return np.concatenate([_grams(raw, BYTE_GRAM), _grams(shape, SHAPE_GRAM), np.ones(1, np.float32)])


def path_features(path: str) -> np.ndarray:
    """Features of a path: what it is made of below its repository, and the shape of its name."""
    parts = path.replace("\\", "/").split("/")
    name = parts[-1].lower()
    stem, *middle = name.split(".")
    # numbered directories are alike, so that none is known by its number
    found = {"dir=" + re.sub(r"\W[0-9a-f]{1,8}$", "", c.lower()) for c in parts[1:-1]} | {f"part={m}" for m in middle[:-1]} | {"shape=" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", stem)), f"parts={len(middle)}"}
    if len(parts) > 1 and parts[-2].lower() == stem:
        found.add("named like its directory")
    out = np.zeros(BUCKETS + 1, np.float32)
    for f in found:
        out[zlib.crc32(f.encode()) & (BUCKETS - 1)] = 1
    out /= max(1.0, np.sqrt(out @ out))
    out[-1] = 1
    return out


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, positive_weight: float = 1.0, epochs: int = 10, seed: int = 0) -> np.ndarray:
    """A linear support-vector classifier (squared hinge loss) by dual coordinate descent; y is +1 or -1."""
    n, d = x.shape
    w = np.zeros(d, np.float32)
    a = np.zeros(n)
    cost = np.where(y > 0, c * positive_weight, c)
    diagonal = 0.5 / cost
    q = np.einsum("ij,ij->i", x, x, dtype=np.float64) + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            g = y[i] * float(x[i] @ w) - 1 + diagonal[i] * a[i]
            step = max(a[i] - g / q[i], 0.0) - a[i]
            if step:
                a[i] += step
                w += np.float32(step * y[i]) * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


@dataclass(frozen=True)
class Model:
    """Weights of the two classifiers, and how they did on held-out repositories: (name, files, precision, recall)."""

    body: np.ndarray
    path: np.ndarray
    held_out: list[tuple[str, int, float, float]] = field(default_factory=list)

    def score(self, path: str, text: str) -> tuple[float, float]:
        return float(body_features(text, extension(path)) @ self.body), float(path_features(path) @ self.path)


def _banner(patterns: tuple[str, ...]) -> Column:
    ends = F.concat(F.substring("content", 1, BANNER_CHARS), F.lit("\n"), F.right(F.col("content"), F.lit(BANNER_CHARS)))
    return F.coalesce(ends.rlike("(?im)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def weak_labels(source_files: DataFrame) -> DataFrame:
    """source_files with what gives a file away: tool_banner, vendor_banner, tool_path, vendor_path, data_path, and its repo."""
    dirs = F.slice(F.split(F.lower(F.replace("path", F.lit("\\"), F.lit("/"))), "/"), 2, 1000)
    within = lambda names: F.exists(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), lambda d: d.isin(*names))
    parts = F.split(F.element_at(dirs, -1), r"\.")
    part = F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p.isin(*TOOL_PARTS))
    usable = source_files.where(F.col("content").isNotNull() & F.col("path").contains("/") & (F.length("content") > 0))
    return usable.select(
        "path", "content", repository("path").alias("repo"), _banner(TOOL_BANNERS).alias("tool_banner"), _banner(VENDOR_BANNERS).alias("vendor_banner"),
        (within(TOOL_DIRS) | part).alias("tool_path"), within(VENDOR_DIRS).alias("vendor_path"), within(DATA_DIRS).alias("data_path"),
    )


#: label, vendor banner, fold, features of body and path; features as the places and values of what isn't 0
_EXAMPLES = "label string, vendor_banner boolean, fold int, body_at binary, body binary, path_at binary, path binary"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for label, banner, repo, path, text in zip(*(c.to_pylist() for c in batch.columns)):
            row: list = [label, banner, zlib.crc32(repo.encode()) % FOLDS]
            for f in (body_features(text, extension(path)), path_features(path)):
                at = np.flatnonzero(f)
                row += [at.astype(np.uint16).tobytes(), f[at].astype(np.float32).tobytes()]
            out.append(row)
        if out:
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in _EXAMPLES.split(", ")])


def fit(source_files: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on the labelled among about ``sample`` files, drawn by the hash of their path.

    Files are drawn before they are looked at, so the table's other texts are
    not read twice. Without labelled files of both kinds (an empty table, say)
    the weights are zero and nothing is found.
    """
    labelled = weak_labels(drawn(source_files, sample, "path"))
    body = F.col("tool_banner") | F.col("tool_path") | F.col("data_path")
    label = F.when(body, "made").when(F.col("vendor_banner") | F.col("vendor_path"), "vendor").otherwise("plain")
    rows = labelled.select(label.alias("label"), (F.col("vendor_banner") & ~body).alias("vendor_banner"), "repo", "path", "content")
    # of hand-written files a third is enough
    rows = rows.where((F.col("label") != "plain") | (F.pmod(F.xxhash64("path", F.lit(1)), F.lit(3)) == 0))
    examples = rows.mapInArrow(_examples, _EXAMPLES).limit(2 * sample).collect()
    return _fit_examples(sorted(examples, key=lambda r: (r["path_at"], r["body_at"])))


def _fit_examples(rows: list) -> Model:
    def dense(at: str, value: str, size: int) -> np.ndarray:
        out = np.zeros((len(rows), size), np.float32)
        for x, r in zip(out, rows):
            x[np.frombuffer(r[at], np.uint16)] = np.frombuffer(r[value], np.float32)
        return out

    if not rows:
        return Model(np.zeros(2 * BUCKETS + 1, np.float32), np.zeros(BUCKETS + 1, np.float32))
    fold = np.array([r["fold"] for r in rows])
    label = np.array([r["label"] for r in rows])
    made = label != "vendor"
    # a vendored file without a banner is no example of a path: its place gave it away
    banner = np.array([r["vendor_banner"] for r in rows], bool)
    named = banner | (label == "plain")
    body, report = _cross_fitted(dense("body_at", "body", 2 * BUCKETS + 1)[made], np.where(label == "made", 1, -1)[made], fold[made], "body")
    path, more = _cross_fitted(dense("path_at", "path", BUCKETS + 1)[named], np.where(banner, 1, -1)[named], fold[named], "path")
    return Model(body, path, report + more)


def _cross_fitted(x: np.ndarray, y: np.ndarray, fold: np.ndarray, name: str) -> tuple[np.ndarray, list[tuple[str, int, float, float]]]:
    """Train where a negative label only means that nothing gave the file away.

    Each fold of repositories is scored by a classifier of the other folds;
    what that finds among the unlabelled is left out, twice over, and what is
    left trains the last classifier. The report is of the folds' second scores.
    """
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1], np.float32), []
    use = np.ones(len(y), bool)
    score = np.zeros(len(y), np.float32)
    for _ in range(2):
        for k in range(FOLDS):
            rest = use & (fold != k)
            if len(set(y[rest].tolist())) > 1:
                score[fold == k] = x[fold == k] @ train_svm(x[rest], y[rest])
        use = ~((y < 0) & (score > DOUBT))
    found = score > 0
    hit = float((found & (y > 0)).sum())
    return train_svm(x[use], y[use]), [(name, len(y), hit / max(1.0, float(found.sum())), hit / float((y > 0).sum()))]


def _scored(batches: Iterator[pa.RecordBatch], body: np.ndarray, path: np.ndarray, parse: bool) -> Iterator[pa.RecordBatch]:
    model = Model(body, path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            ids, b, p = [], [], []
            for i, name, text in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                if not name or not text:
                    continue
                s = model.score(name, text)
                # a file that doesn't parse is broken, whoever wrote it
                if parse and max(s) > 0 and (v := check_source(name, text)) is not None and not v.valid:
                    continue
                ids.append(i)
                b.append(s[0])
                p.append(s[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(b, pa.float64()), pa.array(p, pa.float64())], ["file_idx", "body_score", "path_score"])


def _unmade(batches: Iterator[pa.RecordBatch], body: np.ndarray, path: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = Model(body, path)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            keep = []
            for name, text in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                made = bool(name and text) and max(model.score(name, text)) > 0
                keep.append(not made or ((v := check_source(name, text)) is not None and not v.valid))
            yield part.filter(pa.array(keep, pa.bool_()))


def scored_files(source_files: DataFrame, model: Model | None = None, parse: bool = True) -> DataFrame:
    """(file_idx, body_score, path_score) of every file; either above 0 means not written by hand.

    Files with a null or empty content or path have no row, nor, with parse,
    have files that would be found but aren't valid for their language.
    Repeated rows stay repeated.
    """
    model = model or fit(source_files)
    slim = spread(source_files.select("file_idx", "path", "content"), "file_idx")
    return slim.mapInArrow(lambda it: _scored(it, model.body, model.path, parse), "file_idx bigint, body_score double, path_score double")


def unwritten_files(source_files: DataFrame, model: Model | None = None) -> DataFrame:
    """(file_idx) of the files that nobody wrote by hand and that are valid for their language."""
    return scored_files(source_files, model).where("body_score > 0 or path_score > 0").select("file_idx")


def kept_files(source_files: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of source_files, all columns, but for those of unwritten_files: what is left was written by hand, doesn't parse, or has no content or path."""
    model = model or fit(source_files)
    return spread(source_files, "file_idx").mapInArrow(lambda it: _unmade(it, model.body, model.path), source_files.schema)


def held_out_accuracy(source_files: DataFrame) -> DataFrame:
    """(classifier, n_files, precision, recall) on the held-out repositories, against the weak labels."""
    return source_files.sparkSession.createDataFrame(fit(source_files).held_out, "classifier string, n_files bigint, precision double, recall double")


def ignored_by_pattern(source_files: DataFrame, scan_configs: DataFrame) -> DataFrame:
    """(file_idx, ignored): whether a pattern of the repository's configuration is part of the path, to compare with what was found."""
    patterns = scan_configs.select(F.col("directory").alias("repo"), F.explode("ignore_patterns").alias("pattern")).where(F.col("pattern").isNotNull()).groupBy("repo").agg(F.collect_set("pattern").alias("patterns"))
    joined = source_files.select("file_idx", "path", repository("path").alias("repo")).join(patterns, "repo", "left")
    return joined.select("file_idx", F.coalesce(F.exists("patterns", lambda p: F.col("path").contains(p)), F.lit(False)).alias("ignored"))
