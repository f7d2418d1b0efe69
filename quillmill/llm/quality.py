"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, vectorised over a batch's bytes. Trees are grown on the driver from a
bounded sample of labelled rows and flattened into arrays; a batch descends all trees at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._sample import labelled

_CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\r\x0b\x0c", "newline": "\n", "stop": ".", "comma": ",", "mark": "!?", "bar": "|", "bracket": "<>{}[]()", "quote": "\"'`", "sign": "=+*/\\&%$#@^~_-:;"}
_CLASS = np.full(256, len(_CLASSES), dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS[list(_chars.encode())] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2

FEATURES = (*(f"share_{k}" for k in _CLASSES), "share_control", "share_high", "log_chars", "log_words", "log_lines", "word_length", "word_length_sd", "long_words", "short_words", "distinct_words", "distinct_pairs", "top_word", "repeats", "marked_words", "capital_words", "shouted_words", "words_a_line", "distinct_lines", "line_length_sd", "words_a_stop")


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent one's count, of each of n documents."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    of = (key[new] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(new, len(key))))
    return np.bincount(of, minlength=n).astype(float), most


def statistics(parts: list) -> np.ndarray:
    """One row of FEATURES for each text (bytes or None); an empty text has zeros."""
    n = len(parts)
    data, off = T.joined(parts)
    size = np.diff(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    counts = np.bincount(doc * _N_CLASSES + _CLASS[data], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES).astype(float)
    counts[:, list(_CLASSES).index("newline")] -= 1
    chars = np.maximum(1, size)
    x = np.zeros((n, len(FEATURES)))
    x[:, :_N_CLASSES] = counts / chars[:, None]
    starts, ends = T.words(data, T.NOT_SPACE)
    at, length, h = doc[starts], (ends - starts).astype(float), T.word_hashes(data, starts, ends)
    words = np.bincount(at, minlength=n).astype(float)
    some = np.maximum(1, words)
    per = lambda v: np.bincount(at, weights=v, minlength=n) / some
    mean = per(length)
    same = at[1:] == at[:-1]
    at2, h2 = at[1:][same], T.mix64(h[1:] * np.uint64(3) + h[:-1])[same]
    pairs = np.bincount(at2, minlength=n).astype(float)
    distinct, top = _distinct(at, h, n)
    last = data[ends - 1]
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    shouted = (upper[ends] - upper[starts]) * 2 > length
    l_starts, l_ends = T.words(data, np.arange(256) != 10)
    l_at = doc[l_starts]
    lines = np.bincount(l_at, minlength=n).astype(float)
    l_some, l_len = np.maximum(1, lines), np.log1p(l_ends - l_starts)
    l_mean = np.bincount(l_at, weights=l_len, minlength=n) / l_some
    l_sq = np.bincount(l_at, weights=l_len**2, minlength=n) / l_some
    stops = counts[:, list(_CLASSES).index("stop")] + counts[:, list(_CLASSES).index("mark")]
    x[:, _N_CLASSES:] = np.stack(
        [
            np.log1p(size), np.log1p(words), np.log1p(lines),
            mean, np.sqrt(np.maximum(0, per(length**2) - mean**2)), per(length > 12), per(length < 4),
            distinct / some, _distinct(at2, h2, n)[0] / np.maximum(1, pairs), top / some,
            np.bincount(at2, weights=(h[1:] == h[:-1])[same], minlength=n) / np.maximum(1, pairs),
            per((last < 128) & ~T.WORDY[last]), per(capital), per(shouted),
            np.log1p(words / l_some), _distinct(l_at, T.word_hashes(data, l_starts, l_ends), n)[0] / l_some, np.sqrt(np.maximum(0, l_sq - l_mean**2)),
            np.log1p(words / np.maximum(1, stops)),
        ],
        axis=1,
    )
    return x


@dataclass
class Trees:
    """All trees in one set of arrays: node i sends x[feature] <= threshold to left, else right; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.roots):
            row = np.arange(len(x))[:, None]
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, least: int = 15, l2: float = 2.0) -> Trees:
    """Boosts logistic loss; splits are searched in histograms of gradients over quantile bins.

    Without rows the score is 0.5 throughout; with one label only it is that label's smoothed share.
    """
    n, m = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    raw = np.full(n, base)
    flat = binned + np.arange(m) * bins
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, hess = p - y, p * (1 - p)
        roots.append(node())
        work = [(roots[-1], np.arange(n), 0)]
        while work:
            i, rows, level = work.pop()
            gs, hs = g[rows].sum(), hess[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                f = flat[rows].ravel()
                hist = [np.bincount(f, weights=np.repeat(w, m) if w is not None else None, minlength=m * bins).reshape(m, bins).cumsum(axis=1)[:, :-1] for w in (g[rows], hess[rows], None)]
                gl, hl, nl = hist
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-3 and b < len(cuts[j]):
                    best = int(j), int(b)
            if best is None:
                value[i] = -rate * gs / (hs + l2)
                raw[rows] += value[i]
                continue
            j, b = best
            feature[i], threshold[i], left[i], right[i] = j, cuts[j][b], node(), node()
            go = binned[rows, j] <= b
            work += [(left[i], rows[go], level + 1), (right[i], rows[~go], level + 1)]
    return Trees(base, *(np.array(a, dtype=k) for a, k in ((roots, int), (feature, int), (threshold, float), (left, int), (right, int), (value, float))), depth)


def _featurise(batches):
    import pyarrow as pa

    for batch in batches:
        parts = T.binaries(batch.column(1))
        x = np.concatenate([statistics(parts[a:b]) for a, b in T.chunks(parts)] or [np.zeros((0, len(FEATURES)))])
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, bound: int = 20_000, seed: str = "quality-1") -> Trees:
    """Trees from at most ``bound`` labelled documents; rows of the held-out remainder are never read as labels."""
    rows = labelled(docs, labels, label, modulus, held, bound, seed).select("y", "text").mapInArrow(_featurise, "y int, x array<double>").toArrow()
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.array(rows["y"].combine_chunks(), dtype=float)
    order = np.lexsort([*x.T, y])  # the same trees however the rows arrive
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1), predicted, for every row and its whole text.

    Null and empty texts have all statistics 0 and are scored so. Repeated rows each get the same score. An
    empty table gives no rows. Columns other than doc_id and text are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts = T.binaries(batch.column(1))
            found = np.concatenate([model.score(statistics(parts[a:b])) for a, b in T.chunks(parts)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


