"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has SIZE coordinates. Round i hashes every shingle into a bin with a value in [i, i + 1); after SIZE
such rounds, round SIZE + j puts every shingle into bin j. A bin keeps its least value, and rounds stop once all
bins are filled: every coordinate fills, and the sketch estimates the Jaccard index with concentration bounds as
strong as those of independent min-hashes, at a cost of about n + SIZE log SIZE hashes.

Equal shingle sets are one node. Nodes that share a band are candidates. Links are confirmed on the full sets,
first between each bucket and its least node; what that leaves unconnected in a bucket is compared pair by pair
in blocks, so that a dense group costs about as many comparisons as it has members, and no candidate is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._graph import components
from ._rows import key, once, without
from ._store import discard, mark, save, settle

#: Coordinates of a sketch; bands of ROWS coordinates. At a Jaccard index of 0.85 a link is missed with
#: probability (1 - 0.85**5)**20, under 1e-5.
SIZE = 100
ROWS = 5
BANDS = SIZE // ROWS
#: Members of a block on the one and the other side of a pairwise comparison.
BLOCK = 256
CHUNK = 512


def sketches(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A row of SIZE uint64 values for each of n documents; ``doc`` says whose each shingle hash is."""
    empty = np.uint64((1 << 64) - 1)
    out = np.full(n * SIZE, empty, dtype=np.uint64)
    filled = np.zeros(n, dtype=np.int64)
    with np.errstate(over="ignore"):
        for i in range(2 * SIZE):
            h = T.mix64(hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            bins = (h >> np.uint64(32)) % np.uint64(SIZE) if i < SIZE else np.uint64(i - SIZE)
            slot = doc * SIZE + bins.astype(np.int64)
            value = (np.uint64(i) << np.uint64(48)) | (T.mix64(h) >> np.uint64(16))  # a later round's values are all larger
            free = out[slot] >= (np.uint64(i) << np.uint64(48))
            slot, value = slot[free], value[free]
            new = np.unique(slot[out[slot] == empty])
            np.minimum.at(out, slot, value)
            filled += np.bincount(new // SIZE, minlength=n)
            active = filled[doc] < SIZE
            if not active.any():
                break
            if not active.all():
                hashes, doc = hashes[active], doc[active]
    return out.reshape(n, SIZE)


def shingle_sets(parts: list, words: int):
    """For each text its sorted distinct shingle hashes (64 bits)."""
    raw, off = T.joined(parts)
    data = T.LOWER[raw]
    starts, ends = T.words(data, T.NOT_SPACE)
    h = T.word_hashes(data, starts, ends)
    cut = np.searchsorted(starts, off)
    return [np.unique(T.ngram_hashes(h[cut[i] : cut[i + 1]], words)) for i in range(len(parts))]


def _sketched(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts, size, node, bands = T.binaries(batch.column(2)), [], [], []
            for a, z in T.chunks(parts):
                sets = shingle_sets(parts[a:z], words)
                of = np.repeat(np.arange(z - a), [len(s) for s in sets])
                sk = sketches(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), of, z - a)
                for b in range(BANDS):
                    h = T.row_hashes(sk[:, b * ROWS : (b + 1) * ROWS])
                    sk[:, b] = T.mix64(h + np.uint64(b))
                size += [len(s) for s in sets]
                node += [_node(s) for s in sets]
                bands += [sk[i, :BANDS].view(np.int64) if len(s) else None for i, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "node", "bands"])

    return run


def _node(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            parts, sets = T.binaries(batch.column(0)), []
            for a, z in T.chunks(parts):
                sets += shingle_sets(parts[a:z], words)
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    return run


def _confirmed(percent: int):
    """Links of one block: its left rows against its other rows of a like size and another component.

    In a bucket's blocks a pair counts only at the first band that it shares, and two rows that both come as
    left count once. Components that an earlier link of the block has joined are not compared again: links of a
    block make a forest over its components, which connects all that its full links would.
    """

    def run(pdf):
        import pandas as pd

        left = pdf[pdf["left"]].sort_values("node")
        right = pdf[~pdf["left"]].sort_values("node")
        sets = [np.frombuffer(s, dtype=np.uint64) for s in right["set"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values, of = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
        nodes, twice = (right[c].to_numpy() for c in ("node", "twice"))
        number = {c: i for i, c in enumerate(sorted({*right["comp"], *left["comp"]}))}
        comp, joined = np.array([number[c] for c in right["comp"]], dtype=np.int64), np.arange(len(number))
        band = int(pdf["band"].iloc[0])
        earlier = np.stack([np.asarray(b[:band]) for b in right["bands"]]) if band > 0 and len(right) else None
        found = []
        for x in left.itertuples(index=False):
            own = np.frombuffer(x.set, dtype=np.uint64)
            may = (sizes * 100 >= percent * len(own)) & (len(own) * 100 >= percent * sizes) & (joined[comp] != joined[number[x.comp]])
            if twice.any():
                may &= ~(twice & (nodes <= x.node))
            if earlier is not None:
                may &= ~(earlier == np.asarray(x.bands[:band])).any(axis=1)
            if not may.any():
                continue
            pick = may[of]
            at = np.minimum(np.searchsorted(own, values[pick]), len(own) - 1)
            both = np.bincount(of[pick], weights=own[at] == values[pick], minlength=len(sets)).astype(np.int64)
            for j in np.flatnonzero(may & (100 * both >= percent * (len(own) + sizes - both))):
                mine, other = joined[number[x.comp]], joined[comp[j]]
                if mine != other:
                    joined[joined == other] = mine
                    found.append((x.node, nodes[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _links(members: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Confirmed links (a, b) of members (block, left, twice, node, comp, band, bands)."""
    rows = members.join(sets, "node")
    return save(rows.groupBy("block").applyInPandas(_confirmed(percent), "a binary, b binary"), name)


def group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles and component_id for every row of docs (doc_id, text).

    Texts whose sets of ``words``-word shingles (ASCII lower case, split at ASCII white space) have a Jaccard
    index of at least ``percent`` / 100 are linked; component_id is the least doc_id that links lead to. With
    fewer words the whole sequence is the one shingle; a null or empty text has none and is linked with
    nothing. Repeated rows are linked with each other. A null id is a row like any other, but is no group's
    least id unless the group has no other. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", key().alias("key"), "text")
    sketched = save(keyed.mapInArrow(_sketched(words), f"doc_id {kind}, key long, n_shingles long, node binary, bands array<long>"), "neardup-sketches")
    # One row for each distinct set: its least id stands for all its copies.
    least = sketched.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = save(least, "neardup-nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.min("node").alias("center"), F.max("node").alias("_last")).where("center <> _last").drop("_last")
    buckets = save(banded.join(shared, ["band", "value"]), "neardup-buckets")

    # Full sets, of the nodes in buckets only, made again from the text of each node's least id.
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    wanted = save(wanted, "neardup-wanted")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = save(texts.mapInArrow(_sets(words), "node binary, set binary").where("node is not null"), "neardup-sets")

    # First each bucket's least node against the others; a center's members are dealt into blocks.
    stars = buckets.where("node <> center").select("center", "node").distinct()
    blocks = stars.groupBy("center").agg(F.ceil(F.count("*") / CHUNK).alias("_k"))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_s")
    no_bands = F.lit(None).cast("array<long>").alias("bands")
    flags = lambda left, twice: (F.lit(left).alias("left"), F.lit(twice).alias("twice"))
    member = stars.join(blocks, "center").withColumn("_s", F.pmod(F.xxhash64("node"), F.col("_k")))
    member = member.select(F.struct("center", "_s").alias("block"), *flags(False, False), "node", F.col("node").alias("comp"), F.lit(0).alias("band"), no_bands)
    center = blocks.select("center", salt).select(F.struct("center", "_s").alias("block"), *flags(True, False), F.col("center").alias("node"), F.col("center").alias("comp"), F.lit(0).alias("band"), no_bands)
    links = _links(member.unionByName(center), sets, percent, "neardup-links")
    comps = save(components(links, "neardup-first"), "neardup-first")
    discard(wanted, links)

    # Then whatever is still apart in a bucket, its center aside: rows outside the bucket's largest component
    # against all rows, in blocks.
    apart = buckets.where("node <> center").drop("center").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = apart.groupBy("band", "value", "comp").agg(F.count("*").alias("_n"))
    sizes = counts.groupBy("band", "value").agg(F.sum("_n").alias("_m"), F.max(F.struct("_n", "comp")).alias("_hub"))
    sizes = sizes.where(F.col("_m") > F.col("_hub._n")).select(
        "band", "value", F.col("_hub.comp").alias("_hub"), F.ceil((F.col("_m") - F.col("_hub._n")) / BLOCK).alias("_kl"), F.ceil(F.col("_m") / CHUNK).alias("_kr")
    )
    apart = apart.join(sizes, ["band", "value"]).join(nodes.select("node", "bands"), "node").withColumn("_other", F.col("comp") != F.col("_hub"))
    h = F.xxhash64("node")
    block = F.struct("band", "value", "_l", "_r").alias("block")
    rows = ("node", "comp", "band", "bands")
    left = apart.where("_other").withColumns({"_l": F.pmod(h, F.col("_kl")), "_r": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_kr") - 1))})
    right = apart.withColumns({"_r": F.pmod(h, F.col("_kr")), "_l": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_kl") - 1))})
    members = left.select(block, *flags(True, False), *rows).unionByName(right.select(block, F.lit(False).alias("left"), F.col("_other").alias("twice"), *rows))
    more = _links(members, sets, percent, "neardup-more")
    discard(sets, buckets)

    comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), "neardup-last")
    named = save(nodes.select("node", "doc_id").join(comps, "node").select("node", "comp", "doc_id"), "neardup-comps")
    ids = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(ids, "comp").select("node", "component_id")
    alone = nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return sketched.drop("bands").join(alone, "node", "left").select("doc_id", "key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that of least doc_id; all columns stay, and texts without words.

    Of rows that repeat an id and text one stays.
    """
    since = mark()
    groups = settle(group(docs, words, percent), "neardup-groups", since)
    repeated = save(groups.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1"), "neardup-repeated")
    gone = save(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "key"), "neardup-gone")
    discard(groups)
    return once(without(docs, gone), repeated)
