"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores by logistic regression over its distinct hashed words and
word beginnings (inflected forms share a beginning); a document's score is the noisy-or of its sentences. Only documents have labels: the gradient of the document's
loss is passed down to the sentences, which then say where the offence is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._sample import labelled
from ._store import save

BITS = 20
#: Bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6)
_IN_SENTENCE = ~T.byte_set(".!?\n", False)


def instances(parts: list):
    """doc, start and end byte of every sentence with a word, then (sentence << BITS | bucket), distinct and sorted.

    Also the chunk's bytes and document offsets.
    """
    raw, off = T.joined(parts)
    data = T.LOWER[raw]
    s_start, s_end = T.words(data, _IN_SENTENCE)
    starts, ends = T.words(data, T.WORDY)
    sentence = np.searchsorted(s_start, starts, side="right") - 1
    keys = []
    for salt, k in enumerate((len(data), *BEGINNINGS)):
        long = ends - starts >= (k if salt else 0)
        h = T.word_hashes(data, starts[long], np.minimum(ends[long], starts[long] + k))
        bucket = T.mix64(h + np.uint64(salt)) >> np.uint64(64 - BITS)
        keys.append((sentence[long] << BITS) | bucket.astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    used, dense = np.unique(keys >> BITS, return_inverse=True)
    keys = (dense << BITS) | (keys & ((1 << BITS) - 1))
    doc = np.searchsorted(off, s_start[used], side="right") - 1
    return doc, s_start[used], s_end[used], keys, raw, off


@dataclass
class Bag:
    weights: np.ndarray
    bias: float

    def logits(self, keys: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(keys >> BITS, weights=self.weights[keys & ((1 << BITS) - 1)], minlength=n) + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))


def train(y: np.ndarray, doc: np.ndarray, keys: np.ndarray, steps: int = 120, rate: float = 0.25, l2: float = 3e-6) -> Bag:
    """Adam on the documents' log loss through the noisy-or. doc: document of each sentence, in order.

    Without both labels every sentence's score is the smoothed share of toxic documents, as a bias.
    """
    n, m = len(y), len(doc)
    share = (y.sum() + 0.5) / (n + 1)
    if not 0 < y.sum() < n:
        return Bag(np.zeros(1 << BITS), float(np.log(share / (1 - share))) if n else -4.0)
    sentence, (used, word) = keys >> BITS, np.unique(keys & ((1 << BITS) - 1), return_inverse=True)
    w, b = np.zeros(len(used)), -np.log(max(2.0, m / n / -np.log1p(-share)))
    moments = [np.zeros(len(used) + 1) for _ in range(2)]
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(sentence, weights=w[word], minlength=m) + b)
        d = np.clip(_noisy_or(p, doc, n), 1e-9, 1 - 1e-9)
        pull = np.where(y > 0, -(1 - d) / d, 1.0)[doc] * p / n
        grad = np.append(np.bincount(word, weights=pull[sentence], minlength=len(used)) + l2 * w, pull.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        step = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-7)
        w -= step[:-1]
        b -= step[-1]
    full = np.zeros(1 << BITS)
    full[used] = w
    return Bag(full, float(b))


def _bags(batches):
    """For each document, its number of sentences and its features as sentence << BITS | bucket."""
    import pyarrow as pa

    for batch in batches:
        parts, rows, count = T.binaries(batch.column(1)), [], []
        for a, z in T.chunks(parts):
            doc, _, _, keys, _, _ = instances(parts[a:z])
            of = doc[keys >> BITS]
            first = np.searchsorted(doc, np.arange(z - a + 1))  # sentences count from 0 in each document
            local = keys - (first[of] << BITS)
            cut = np.searchsorted(of, np.arange(z - a + 1))
            rows += [local[cut[i] : cut[i + 1]] for i in range(z - a)]
            count += np.diff(first).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["y", "n", "keys"])


def _counts(batches):
    """For each bucket in a batch, the documents and the toxic documents that have it."""
    import pyarrow as pa

    for batch in batches:
        y = np.array(batch.column(0), dtype=np.int64)
        every, toxic = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for label, keys in zip(y, batch.column(1), strict=True):
            own = np.unique(np.asarray(keys.values) & ((1 << BITS) - 1))
            every[own] += 1
            toxic[own] += label
        own = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(every[own]), pa.array(toxic[own])], names=["bucket", "every", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, bound: int = 20_000, seed: str = "toxic-1", least: int = 3, lift: float = 4.0) -> Bag:
    """The model from at most ``bound`` labelled documents; labels of the held-out remainder are never read.

    Features are the buckets in at least ``least`` toxic documents whose odds of toxic documents are over ``lift``
    times the overall ones, which is possible at every share of toxic labels: 2**BITS at most, whatever the corpus.
    """
    rows = labelled(docs, labels, label, modulus, held, bound, seed).select("y", "text")
    bags = save(rows.mapInArrow(_bags, "y int, n long, keys array<long>"), "toxicity-bags")
    share = bags.agg(F.sum("y"), F.count("*")).first()
    base = (share[0] or 0) / max(1, share[1])
    seen = bags.select("y", "keys").mapInArrow(_counts, "bucket int, every long, toxic long").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("toxic").alias("toxic"))
    seen = seen.where((F.col("toxic") >= least) & ((F.col("toxic") + base) * (1 - base) > lift * base * (F.col("every") - F.col("toxic") + 1 - base))).toArrow()
    good = np.zeros(1 << BITS, dtype=bool)
    good[np.array(seen["bucket"].combine_chunks(), dtype=np.int64)] = True

    def chosen(batches):
        import pyarrow as pa

        for batch in batches:
            lists = [k[good[k & ((1 << BITS) - 1)]] for k in (np.asarray(x.values) for x in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["y", "n", "keys"])

    rows = bags.mapInArrow(chosen, "y int, n long, keys array<long>").toArrow()
    y, n = (np.array(rows[c].combine_chunks(), dtype=np.int64) for c in ("y", "n"))
    lists = [np.asarray(x.values) for x in rows["keys"].combine_chunks()]
    order = sorted(range(len(y)), key=lambda i: (y[i], n[i], lists[i].tobytes()))  # however the rows arrive
    base_of = np.concatenate([[0], np.cumsum(n[order])])
    keys = [lists[i] + (int(base_of[k]) << BITS) for k, i in enumerate(order)]
    return train(y[order].astype(float), np.repeat(np.arange(len(y)), n[order]), np.concatenate([*keys, np.zeros(0, dtype=np.int64)]))


def score(docs: DataFrame, model: Bag, threshold: float = 0.7, sentence_threshold: float = 0.5) -> DataFrame:
    """doc_id, score (noisy-or, 0 to 1), predicted, n_sentences, spans, for every row and its whole text.

    spans holds start and end (code points, end exclusive) and score of each sentence at or above
    ``sentence_threshold``. Texts without a word (null, empty) have no sentences, no spans and score 0.
    Repeated rows each get the same score; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            parts, found, count, spans = T.binaries(batch.column(1)), [], [], []
            for a, z in T.chunks(parts):
                doc, start, end, keys, raw, off = instances(parts[a:z])
                p = _sigmoid(model.logits(keys, len(doc)))
                found.append(_noisy_or(p, doc, z - a))
                count.append(np.bincount(doc, minlength=z - a))
                rows: list[list] = [[] for _ in range(z - a)]
                bad = np.flatnonzero(p >= sentence_threshold)
                if len(bad):
                    before = T.code_points_before(raw)
                    for i in bad:
                        base = before[off[doc[i]]]
                        rows[doc[i]].append({"start": int(before[start[i]] - base), "end": int(before[end[i]] - base), "score": float(p[i])})
                spans += rows
            none = [np.zeros(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(found or none)), pa.array(np.concatenate(count or none).astype(np.int64)), pa.array(spans, pa.list_(span))],
                names=["doc_id", "score", "n_sentences", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_sentences long, spans array<struct<start:long,end:long,score:double>>")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
