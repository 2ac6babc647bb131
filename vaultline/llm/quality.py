"""Quality rules: base rules, then gradient-boosted trees over statistics.

Each document is reduced to a row of statistics in one scan of the texts.
Trees are fitted on a bounded sample of labelled rows (``max_rows``, chosen
by a hash of the doc_id): logistic loss, histogram splits, and monotonic
constraints on chosen statistics (more symbols, repeats or capitals can only
lower the score). The fitted trees are flattened into numpy node arrays, and
a batch of rows walks all trees level by level, without a Python loop over rows.

Defined results: a null or wordless text has zero counts and fails the base
rules. Rows without a label, or with a null label, are not learned from. If
the sample lacks a class, the verdict is the base rules'. Repeated rows each
return.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_D, KEY_H, KEYS, Scratch, doc_texts, id_or_null, map_arrow

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_ROWS = 20_000
THRESHOLD = 0.5
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# statistic: -1 if the score must not rise with it, 0 if free
FEATURES = {
    "words": 0, "word_length": 0, "line_words": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": -1, "mark_share": -1, "comma_share": 0, "symbol_word_share": -1,
    "same_word_share": -1, "distinct_share": 0, "link_share": -1,
}


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split(None, 1):
            seen.add(line)
    return len(words), chars, symbols, dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    n = len(words)
    if n <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    hit = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.fromiter((count[w] > 1 for w in windows), bool, len(windows)))
    np.add.at(hit, at, 1)
    np.add.at(hit, at + WINDOW, -1)
    return int((np.cumsum(hit)[:n] > 0).sum())


_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?;:\"()[]{}=_~^\\/@+"
_LINK = re.compile(rb"https?://|www\.|\.com|@")


def statistics(text: str, base: tuple) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n, chars, symbols, dup, repeat = base
    size = max(1, chars)
    share = lambda chosen: (len(raw) - len(raw.translate(None, chosen))) / size
    words = raw.split()
    count = Counter(words)
    lines = raw.count(b"\n") + 1
    marked = sum(c for w, c in count.items() if w[-1:] in b"#*$%&|<>!")
    return [np.log1p(n), chars / max(1, n), np.log1p(n / lines), symbols / size, dup / lines, repeat / max(1, n),
            share(_UPPER), share(_DIGITS), share(_MARKS), share(b",."), marked / max(1, n),
            max(count.values(), default=0) / max(1, n), len(count) / max(1, n) * np.log1p(n), len(_LINK.findall(raw)) / max(1, n)]


class Trees:
    """Boosted trees as flat node arrays (feature, cut, left, right, value);
    a leaf points at itself, so a walk of ``depth`` steps ends at a leaf."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.feature, self.cut, self.left, self.right, self.value, self.roots = [], [], [], [], [], []

    def add(self, feature=0, cut=np.inf, value=0.0) -> int:
        k = len(self.value)
        for a, v in ((self.feature, feature), (self.cut, cut), (self.left, k), (self.right, k), (self.value, value)):
            a.append(v)
        return k

    def flat(self) -> Trees:
        for a, kind in (("feature", np.int32), ("cut", np.float64), ("left", np.int32), ("right", np.int32),
                        ("value", np.float64), ("roots", np.int32)):
            setattr(self, a, np.array(getattr(self, a), kind))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good class for each row of ``x``."""
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at:at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                go = np.take_along_axis(part, self.feature[node].astype(np.int64), 1) <= self.cut[node]
                node = np.where(go, self.left[node], self.right[node])
            out[at:at + 4096] = self.start + self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = 48, least: int = 20, ridge: float = 1.0) -> Trees:
    """Gradient boosting with logistic loss. A split on a constrained statistic
    is allowed only if its child values are ordered as the sign says, and the
    children's values are then kept on their sides of the middle, also for all
    splits below."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    p0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    trees = Trees(depth, float(np.log(p0 / (1 - p0))))
    margin = np.full(len(y), trees.start)

    def grow(rows, g, h, level, lo, hi):
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))
        best = None
        if level < depth and len(rows) >= 2 * least:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                code, size = codes[rows, f], len(cut) + 1
                gl = np.cumsum(np.bincount(code, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(code, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(code, minlength=size))[:-1]
                vl = np.clip(-gl / (hl + ridge), lo, hi)
                vr = np.clip(-(gs - gl) / (hs - hl + ridge), lo, hi)
                ok = (nl >= least) & (len(rows) - nl >= least)
                if signs[f]:
                    ok &= signs[f] * (vr - vl) >= 0
                # reduction of the second-order loss at the clipped values
                gain = -(gl * vl + 0.5 * (hl + ridge) * vl**2) - ((gs - gl) * vr + 0.5 * (hs - hl + ridge) * vr**2)
                gain = np.where(ok, gain + (gs * value + 0.5 * (hs + ridge) * value**2), -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, vl[k], vr[k])
        if best is None:
            node = trees.add(value=rate * value)
            margin[rows] += rate * value
            return node
        _, f, k, vl, vr = best
        node = trees.add(f, cuts[f][k])
        mid = (vl + vr) / 2
        bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[signs[f]]
        goes = codes[rows, f] <= k
        trees.left[node] = grow(rows[goes], g, h, level + 1, *bounds[0])
        trees.right[node] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return node
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    return trees.flat()


def measured(docs: DataFrame) -> DataFrame:
    """(key, the base counts, stats) of every document row."""
    def run(batch):
        base, stats = [], []
        for t in batch.column(2).to_pylist():
            base.append(base_counts(t))
            stats.append(statistics(t, base[-1]))
        cols = zip(*base, strict=True) if base else [[] for _ in _BASE]
        return {KEY_D: batch.column(0), KEY_H: batch.column(1), **dict(zip(_BASE, map(list, cols), strict=True)), "stats": stats}
    return map_arrow(doc_texts(docs), run, f"{KEY_D} long, {KEY_H} long, " + ", ".join(f"{c} long" for c in _BASE)
                     + ", stats array<double>")


def train(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees | None:
    """Trees from measured rows and labels (doc_id, quality); None without both classes."""
    good = labels.select(F.col("doc_id").cast("long").alias(KEY_D), "quality").dropna().where(F.col("quality").isin(0, 1)).distinct()
    total = good.count()
    share = F.pmod(F.xxhash64(KEY_D), F.lit(1 << 30)) < F.lit(int(min(1.0, max_rows / max(1, total)) * (1 << 30)))
    got = rows.join(good.where(share), KEY_D).select("stats", "quality").toPandas()
    y = got["quality"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return fit(np.array(got["stats"].tolist(), np.float64).reshape(-1, len(FEATURES)), y, list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept (and the trees' score) per document row."""
    spark = docs.sparkSession
    rows = Scratch(spark, "quality").save(measured(docs), "measured")
    shared = spark.sparkContext.broadcast(train(rows, labels, max_rows))

    def run(batch):
        trees = shared.value
        x = np.array(batch.column(6).to_pylist(), np.float64).reshape(-1, len(FEATURES))
        score = trees.score(x) if trees is not None else np.ones(len(x))
        return {KEY_D: batch.column(0), **{c: batch.column(i) for i, c in enumerate(_BASE, 1)}, "score": score}
    out = map_arrow(rows.select(KEY_D, *_BASE, "stats"), run,
                    f"{KEY_D} long, " + ", ".join(f"{c} long" for c in _BASE) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(id_or_null(F.col(KEY_D)).alias("doc_id"), *_BASE, failed.alias("base_failed"),
                      (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
