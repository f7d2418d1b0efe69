"""Threshold-scaled document sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range. Sketches of unequal
documents are comparable and the union of two sketches is the sketch of both: containment needs no common size.
Short texts keep a larger fraction, by their length class; two sketches are compared, and merged, below the smaller
of their thresholds, so classes mix freely.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import conf_partitions

#: Bytes of a shingle; the share of hashes that is kept, 1 / scale, of texts up to so many bytes and of all longer ones.
SHINGLE = 16
SCALES = ((256, 1), (1024, 4))
SCALE = 16


def scale(size: int) -> int:
    """The scale of a text of ``size`` bytes."""
    return next((s for most, s in SCALES if size <= most), SCALE)


def below(hashes: np.ndarray, of: int) -> np.ndarray:
    """The part of a sorted sketch that a sketch of scale ``of`` has too."""
    return hashes[: np.searchsorted(hashes, np.uint64((1 << 64) // of))] if of > 1 else hashes


def sketch(part: bytes) -> np.ndarray:
    """Sorted distinct hashes below the text's threshold, of all shingles of SHINGLE bytes; a shorter text is one shingle."""
    n, of = len(part), scale(len(part))
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    if n < SHINGLE:
        part, n = part + b"\0" * (SHINGLE - n), SHINGLE
    view = lambda at: np.ndarray((n - SHINGLE + 1,), "<u8", part, at, (1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = T.mix64(T.mix64(view(0)) * np.uint64(0x9E3779B97F4A7C15) + view(8))
    return np.unique(h if of == 1 else h[h < np.uint64((1 << 64) // of)])


def merge(*sketches: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """The sketch of several texts together, from pairs of a sketch and its scale; none give an empty one of scale 1.

    Equal hashes count once, and empty sketches add nothing but their scale.
    """
    of = max((s for _, s in sketches), default=1)
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(below(h, of) for h, _ in sketches)])), of


def containment(a: np.ndarray, b: np.ndarray, of: int = 1) -> float:
    """Estimated share of a's shingles that b has, below the threshold of scale ``of``; 0 if a has none there."""
    a, b = below(a, of), below(b, of)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, equal: bool, of: int = 1) -> float:
    """Estimated Jaccard index below the threshold of scale ``of``; equal texts have 1, others with two empty sketches 0."""
    if equal:
        return 1.0
    a, b = below(a, of), below(b, of)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def render(part: bytes, hashes: np.ndarray) -> str:
    """Sixteen hex digits of the text's BLAKE2 digest, a colon, the scale, a colon, and eight digits of each hash in order."""
    of = scale(len(part))
    kept = (hashes * np.uint64(of)) >> np.uint64(32)  # the digits that vary
    return f"{hashlib.blake2b(part, digest_size=8).hexdigest()}:{of}:{kept.astype('>u4').tobytes().hex()}"


def _blocks(docs: DataFrame, count: int):
    """Descending boundaries of about ``count`` even ranges of doc_id, from all ids' approximate quantiles."""
    points = [i / count for i in range(1, count)]
    found = docs.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", F.lit(points), F.lit(min(100 * count, 1_000_000)))).first()[0] if count > 1 else None
    return np.unique(np.array(found or [], dtype=np.int64))


def compare(docs: DataFrame, blocks_per_partition: int = 8) -> DataFrame:
    """Each document against its edited text and against the next document.

    Order: descending doc_id, null ids last, equal ids by text; after the last comes the first. The edited text
    has its last floor(n_chars / 3) code points replaced by the next document's first as many, or all. Null
    texts count as empty. A single document is its own next. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, contained_edited, contained_next. An empty table
    gives no rows; other columns are ignored.

    Texts are shuffled once: ids are dealt into ranges, each range's first document also goes to the range
    before it, and a task reads its ranges in order, holding one document at a time.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    partitions = conf_partitions(spark)
    cuts = _blocks(docs, partitions * blocks_per_partition)

    @F.pandas_udf("int")
    def block(ids):  # descending: the largest ids are block 0, null ids are in the last
        out = len(cuts) - np.searchsorted(cuts, ids.fillna(-(1 << 63)).to_numpy(dtype=np.int64), side="left")
        return type(ids)(out.astype(np.int32))

    # An id that is null must not pass through floating point with the others: nulls go to the last block here.
    of = F.coalesce(F.when(F.col("doc_id").isNotNull(), block(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))), F.lit(len(cuts)))
    ids = docs.select("doc_id", of.alias("block"), "text")
    # Each block's first document: one id for each block, so as many rows as there are blocks.
    heads = ids.groupBy("block").agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    if not heads:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double")
    before = {heads[i].block: heads[i - 1].block for i in range(len(heads))}
    plan = spark.createDataFrame([(r.block, before[r.block], r.head) for r in heads], f"block int, before int, head {kind}")
    rows = ids.join(F.broadcast(plan), "block")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    home = F.struct(F.col("block").alias("block"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.col("before").alias("block"), F.lit(1).alias("ahead"))
    rows = rows.select("doc_id", "text", F.explode(F.when(is_head, F.array(home, ahead)).otherwise(F.array(home))).alias("_to"))
    rows = rows.select(F.col("_to.block").alias("block"), F.col("_to.ahead").alias("ahead"), "doc_id", "text")
    rows = rows.repartition(partitions, "block").sortWithinPartitions("block", "ahead", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        import pyarrow as pa

        def made(i, text, own, a, nxt, other, c):
            n = len(text)
            m = n // 3
            changed = (text[: n - m] + nxt[:m]).encode("utf-8", "replace")
            b = sketch(changed)
            of, far = max(scale(len(own)), scale(len(changed))), max(scale(len(own)), scale(len(other)))
            return (i, n, hashlib.sha256(changed).hexdigest(), render(own, a), render(changed, b), likeness(a, b, own == changed, of), likeness(a, c, own == other, far), containment(a, b, of), containment(a, c, far))

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_edited", "contained_next"]
        last = None  # block, and doc_id, text, bytes and sketch of the row that waits for its next
        for batch in batches:
            out = []
            for b, ahead, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = text.encode("utf-8", "replace")
                kept = sketch(own)
                if last is not None and last[0] == b:
                    out.append(made(*last[1:], text, own, kept))
                # The first row from the next block ends this one; ties after it are not used.
                last = None if ahead else (b, i, text, own, kept)
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(2).type), pa.array(cols[1], pa.int64()), *(pa.array(c) for c in cols[2:])], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double")
