"""Page generation: column placement, packing, line balance, retry rounds. Sequential within a page only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import uniform
from .grouped import per_group
from ..sources.store import save

PAGE = (600, 800)
#: Height that a block can be shrunk to.
LEAST = 24


def place(pages: DataFrame, gutter: int = 18, margin: int = 48) -> DataFrame:
    """page_id, block, column_no, x, y, w, h, shrunk: blocks of an even split of the lines (12 at most), filled down one or two columns.

    A running sum inside an array: no shuffle, no Python. Every block is placed: one that would pass the bottom
    margin, or leave the blocks after it in its column less than ``LEAST`` each, is shrunk to what is left.
    """
    width, height = PAGE
    u = lambda stream, k: uniform(stream, F.col("page_id"), k)
    columns = F.when(uniform("cols", F.col("page_id")) < 0.4, 2).otherwise(1)
    blocks = F.least(F.lit(12), F.greatest(F.lit(1), F.col("line_count"))).cast("int")
    rows = pages.select("page_id", columns.alias("_c"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    rows = rows.withColumn("column_no", (F.col("block") % F.col("_c")).cast("int")).withColumn("h", (20 + F.floor(u("height", F.col("block")) * 90)).cast("int"))
    listed = rows.groupBy("page_id", "column_no", "_c").agg(F.array_sort(F.collect_list(F.struct("block", "h"))).alias("b"))
    kind = "array<struct<block:int,y:int,h:int,shrunk:boolean>>"
    start = F.struct(F.lit(margin).alias("y"), F.array().cast(kind).alias("out"))

    def add(acc, b):
        after = F.size("b") - F.size(acc["out"]) - 1
        h = F.least(b["h"], F.greatest(F.least(b["h"], F.lit(LEAST)), height - margin - acc["y"] - after * (LEAST + gutter))).cast("int")
        one = F.struct(b["block"].alias("block"), acc["y"].alias("y"), h.alias("h"), (h < b["h"]).alias("shrunk"))
        return F.struct((acc["y"] + h + gutter).cast("int").alias("y"), F.concat(acc["out"], F.array(one)).alias("out"))

    stack = F.aggregate("b", start, add, lambda acc: acc["out"])
    rows = listed.withColumn("w", F.floor((width - 2 * margin - (F.col("_c") - 1) * gutter) / F.col("_c")).cast("int")).select("page_id", "column_no", "w", F.explode(stack).alias("s"))
    return rows.select("page_id", "s.block", "column_no", (margin + F.col("column_no") * (F.col("w") + gutter)).cast("int").alias("x"), "s.y", "w", "s.h", "s.shrunk")


def pack(boxes: DataFrame, width: int, height: int, tries: int = 24) -> DataFrame:
    """page, pos, x, y, w, h, moved, overlaps: boxes by falling area, each at the first of its seeded places that overlaps none before.

    A page is one group in one task; pages are independent. A box without a free place is put, inside the page if
    it can be, where it covers least of those before; ``overlaps`` says so.
    """

    def run(rows):
        import hashlib

        placed, out = [], []
        for page, pos, bx, by, w, h in sorted(rows, key=lambda r: (-r[4] * r[5], r[1])):
            best = None
            for k in range(tries):
                x, y = bx, by
                if k:
                    seed = int.from_bytes(hashlib.blake2b(f"{page}|{pos}|{k}".encode(), digest_size=8).digest(), "big")
                    x, y = seed % max(1, width - w), (seed >> 32) % max(1, height - h)
                free = x + w <= width and y + h <= height and all(x + w <= c or c + cw <= x or y + h <= d or d + ch <= y for c, d, cw, ch in placed)
                if free:
                    best = (0, k, x, y)
                    break
                x, y = max(0, min(x, width - w)), max(0, min(y, height - h))
                covered = sum(max(0, min(x + w, c + cw) - max(x, c)) * max(0, min(y + h, d + ch) - max(y, d)) for c, d, cw, ch in placed)
                best = min(best or (covered, k, x, y), (covered, k, x, y))
            covered, _, x, y = best
            placed.append((x, y, w, h))
            out.append((page, pos, x, y, w, h, (x, y) != (bx, by), covered > 0))
        return out

    return per_group(boxes.select("page", "pos", "x", "y", "w", "h"), "page", ["pos"], run, "page long, pos long, x long, y long, w long, h long, moved boolean, overlaps boolean")


def rebalance(boxes: DataFrame, target: int) -> DataFrame:
    """page, pos, lines: planned lines of each block, moved one by one to ``target`` for the page, by slack."""

    def run(rows):
        cap = [max(1, h // 6) for _, _, h in rows]
        lines = [max(1, c * 6 // 10) for c in cap]
        while sum(lines) < target and any(n < c for n, c in zip(lines, cap, strict=True)):
            lines[max(range(len(cap)), key=lambda i: cap[i] - lines[i])] += 1
        while sum(lines) > target and any(n > 1 for n in lines):
            lines[max(range(len(cap)), key=lambda i: lines[i])] -= 1
        return [(page, pos, n) for (page, pos, _), n in zip(rows, lines, strict=True)]

    return per_group(boxes.select("page", "pos", "h"), "page", ["pos"], run, "page long, pos long, lines long")


def retry_until_valid(pages: DataFrame, max_tries: int, accept: float = 0.6) -> DataFrame:
    """page_id, attempt, status: seeded attempts until one is valid; what is left after the last is a fallback.

    Round k tries only what no earlier round accepted; each round is written, so that plans stay short.
    """
    left, done = save(pages.select("page_id").distinct(), "retry-pages"), None
    for k in range(max_tries):
        tried = left.withColumn("_ok", uniform("attempt", F.col("page_id"), F.lit(k)) < accept)
        good = tried.where("_ok").select("page_id", F.lit(k).alias("attempt"), F.lit("ok").alias("status"))
        done = good if done is None else done.unionByName(good)
        left = save(tried.where("not _ok").select("page_id"), "retry-left")
    last = left.select("page_id", F.lit(max_tries).alias("attempt"), F.lit("fallback").alias("status"))
    return last if done is None else done.unionByName(last)
