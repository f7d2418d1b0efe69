"""Language identification by rank-order n-gram profiles and out-of-place distance.

N-grams are of 1 to 4 UTF-8 bytes of lower-cased text, where every run of other ASCII is one blank; blanks
stand at an n-gram's ends only. A profile ranks a language's most frequent n-grams; a document's distance to
it is the sum, over the document's own ranked n-grams, of how far out of place each one is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text as T
from ._sample import remainder

UNKNOWN = "und"
#: Profiles that are learned at most, of the labels that most documents have.
MAX_LANGUAGES = 1000
_FOLD = T.LOWER.copy()
_FOLD[:128][~T.byte_set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", False)[:128]] = 32


def _ngrams(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, n-gram code and count, sorted by doc and code, of every distinct n-gram of each text."""
    raw, off = T.joined(parts)
    data = _FOLD[raw]
    doc = np.repeat(np.arange(len(parts)), np.diff(off))
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[keep].astype(np.uint64), doc[keep].astype(np.uint64)
    blank, keys = data == 32, []
    for n in range(1, 5):
        m = len(data) - n + 1
        if m <= 0:
            break
        code, ok = np.zeros(m, dtype=np.uint64), doc[:m] == doc[n - 1 :]
        for i in range(n):
            code = (code << np.uint64(8)) | data[i : m + i]
            if 0 < i < n - 1:
                ok &= ~blank[i : m + i]
        ok &= ~blank[:m] if n == 1 else ~(blank[:m] & blank[n - 1 :])
        keys.append(((doc[:m] << np.uint64(35)) | (np.uint64(n) << np.uint64(32)) | code)[ok])
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.uint64)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
    return (keys[new] >> np.uint64(35)).astype(np.int64), (keys[new] & np.uint64((1 << 35) - 1)).astype(np.int64), np.diff(np.append(new, len(keys)))


@dataclass
class Profiles:
    """Languages, the n-gram codes of all profiles in order, and each code's rank in each language (``size`` if absent)."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def distances(self, parts: list) -> np.ndarray:
        """Mean distance (0 to 1) of each text to each language; 1 for a text without n-grams."""
        n = len(parts)
        doc, code, count = _ngrams(parts)
        order = np.lexsort((-count, doc))  # stable: ties by code
        doc, code = doc[order], code[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        top = rank < self.size
        doc, code, rank = doc[top], code[top], rank[top]
        out = np.full((n, len(self.languages)), float(self.size))
        if len(doc) and len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
            ranked = np.bincount(doc, minlength=n)
            for j in range(len(self.languages)):
                place = self.ranks[at, j]
                far = np.where(known & (place < self.size), np.abs(place - rank), self.size)
                out[:, j] = np.where(ranked, np.bincount(doc, weights=far, minlength=n) / np.maximum(1, ranked), self.size)
        return out / self.size


def _counted(batches):
    import pyarrow as pa

    for batch in batches:
        langs, parts = np.array(batch.column(0).to_pylist(), dtype=object), T.binaries(batch.column(1))
        for lang in sorted(set(langs)):
            own = [p for p, x in zip(parts, langs, strict=True) if x == lang]
            total: dict = {}
            for a, z in T.chunks(own):
                _, code, count = _ngrams(own[a:z])
                codes, at = np.unique(code, return_inverse=True)
                for c, k in zip(codes.tolist(), np.bincount(at, weights=count).tolist(), strict=True):
                    total[c] = total.get(c, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(list(total), pa.int64()), pa.array([int(k) for k in total.values()], pa.int64())], names=["lang", "code", "n"])


def learn(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = 1500, size: int = 400, seed: str = "language-1") -> Profiles:
    """Profiles of every non-null lang of the rows outside the held-out remainder.

    Of each language about ``per_language`` documents are read (least seeded hash; all, if there are fewer).
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    # Profiles are kept on the driver; of more values than MAX_LANGUAGES those of most documents are learned.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    rows = rows.where(F.col("lang").isin(*counts)) if len(counts) == MAX_LANGUAGES else rows
    if not counts:
        return Profiles([], np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.int64), size)
    share = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))))
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    ngrams = rows.where(part < F.element_at(share, F.col("lang"))).select("lang", "text").mapInArrow(_counted, "lang string, code long, n long")
    ngrams = ngrams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")) - 1
    best = ngrams.select("lang", "code", place.alias("rank")).where(F.col("rank") < size).collect()
    languages = sorted({r.lang for r in best})
    codes = np.unique(np.array([r.code for r in best], dtype=np.int64))
    ranks = np.full((len(codes), len(languages)), size)
    for r in best:
        ranks[np.searchsorted(codes, r.code), languages.index(r.lang)] = r.rank
    return Profiles(languages, codes, ranks, size)


def _has_letter(part: bytes | None) -> bool:
    return bool(part) and (any(65 <= b <= 90 or 97 <= b <= 122 for b in part[:256]) or any(c.isalpha() for c in part.decode("utf-8", "replace")))


def _answers(profiles: Profiles, parts: list) -> tuple[list[str], list[float]]:
    best, score = [], []
    for a, z in T.chunks(parts):
        for p, row in zip(parts[a:z], profiles.distances(parts[a:z]), strict=True):
            if len(row) and _has_letter(p):
                j = int(np.argmin(row))
                best.append(profiles.languages[j])
                score.append(1 - float(row[j]))
            else:
                best.append(UNKNOWN)
                score.append(0.0)
    return best, score


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score (1 less the mean distance) for every row and its whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned.
    Languages at equal distance: the first by name. Repeated rows each get the same answer; an empty table
    gives no rows; columns other than doc_id and text are ignored.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            best, score = _answers(profiles, T.binaries(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def known(docs: DataFrame, profiles: Profiles, least: float = 0.15) -> DataFrame:
    """docs, all columns, without the rows whose text is ``und`` or scores under ``least``.

    If nothing could be learned, nothing is rejected: every row stays.
    """
    if not profiles.languages:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            best, score = _answers(profiles, T.binaries(batch.column(at)))
            yield batch.filter(pa.array([b != UNKNOWN and s >= least for b, s in zip(best, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
