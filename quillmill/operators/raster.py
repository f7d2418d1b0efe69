"""Raster measures in numpy: pages as ink masks of filled boxes; a PNG encoder for sinks."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame


def mask(boxes, width: int, height: int):
    """A uint8 page, 255 under every box (x, y, w, h), clipped to the page."""
    import numpy as np

    page = np.zeros((height, width), dtype=np.uint8)
    for x, y, w, h in boxes:
        page[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = 255
    return page


def is_binary(page) -> bool:
    import numpy as np

    return page.dtype == np.uint8 and bool(np.isin(page, (0, 255)).all())


def png(page) -> bytes:
    """An 8-bit PNG of a (H, W) or (H, W, 3) uint8 array; other arrays raise."""
    if page.dtype.name != "uint8":
        raise TypeError("uint8 only")
    if page.ndim not in (2, 3) or page.ndim == 3 and page.shape[2] != 3:
        raise ValueError("(H, W) or (H, W, 3) only")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + page[i].tobytes() for i in range(page.shape[0]))
    head = struct.pack(">IIBBBBB", page.shape[1], page.shape[0], 8, 0 if page.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def ink_shares(boxes, width: int, height: int, pad: int) -> tuple[float, ...]:
    """Shares of text, content and padded figures, and of text outside these, of a page with boxes (x, y, w, h, kind).

    The page is cut at the boxes' edges only; every cell counts with its pixels, as many as a full mask would have.
    """
    import numpy as np

    clip = lambda v, most: min(max(0, int(v)), most)
    rows = []
    for x, y, w, h, kind in boxes:
        layer = 0 if kind in ("title", "paragraph", "list", "caption") else 1 if kind == "table" else 2 if kind == "figure" else None
        p = pad if layer == 2 else 0
        x1, x2, y1, y2 = clip(x - p, width), clip(x + w + p, width), clip(y - p, height), clip(y + h + p, height)
        if layer is not None and x1 < x2 and y1 < y2:
            rows.append((layer, x1, x2, y1, y2))
    xs, ys = sorted({0, width, *(v for r in rows for v in r[1:3])}), sorted({0, height, *(v for r in rows for v in r[3:])})
    across, down = {v: i for i, v in enumerate(xs)}, {v: i for i, v in enumerate(ys)}
    ink = np.zeros((3, len(ys) - 1, len(xs) - 1), dtype=bool)
    for layer, x1, x2, y1, y2 in rows:
        ink[layer, down[y1] : down[y2], across[x1] : across[x2]] = True
    text, other, figures = ink
    wide, high = np.diff(xs), np.diff(ys)
    pixels = lambda cells: int(high @ (cells @ wide))
    area, covered = width * height, pixels(figures)
    counts = (pixels(text) / area, pixels(text | other) / area, covered / area, pixels(text & ~figures) / max(1, area - covered))
    return tuple(round(v, 6) for v in counts)


def _batch_shares(boxes, width: int, height: int, pad: int):
    """ink_shares of many pages with equally many boxes: an integer array (page, box, 5) of x, y, w, h and layer (3: none)."""
    import numpy as np

    layer = boxes[:, :, 4]
    p = np.where(layer == 2, pad, 0)
    cut = lambda v, most: np.clip(v, 0, most)
    x1, x2 = cut(boxes[:, :, 0] - p, width), cut(boxes[:, :, 0] + boxes[:, :, 2] + p, width)
    y1, y2 = cut(boxes[:, :, 1] - p, height), cut(boxes[:, :, 1] + boxes[:, :, 3] + p, height)
    xs, ys = np.sort(np.concatenate([x1, x2], axis=1), axis=1), np.sort(np.concatenate([y1, y2], axis=1), axis=1)
    wide, high = np.diff(xs, axis=1), np.diff(ys, axis=1)
    ink = np.zeros((3, len(boxes), high.shape[1], wide.shape[1]), dtype=bool)
    for i in range(boxes.shape[1]):
        over = (xs[:, :-1] >= x1[:, i, None]) & (xs[:, 1:] <= x2[:, i, None])
        down = (ys[:, :-1] >= y1[:, i, None]) & (ys[:, 1:] <= y2[:, i, None])
        cells = down[:, :, None] & over[:, None, :]
        for k in range(3):
            ink[k] |= cells & (layer[:, i] == k)[:, None, None]
    text, other, figures = ink
    pixels = lambda cells: (high * (cells * wide[:, None, :]).sum(axis=2)).sum(axis=1)
    area, covered = width * height, pixels(figures)
    counts = (pixels(text) / area, pixels(text | other) / area, covered / area, pixels(text & ~figures) / np.maximum(1, area - covered))
    return [[round(float(v), 6) for v in column] for column in counts]


#: Pages of more boxes are cut one at a time, so that no batch holds many large grids.
MANY = 16


def density(boxes: DataFrame, width: int, height: int, pad: int = 6) -> DataFrame:
    """page, text_ratio, content_ratio, excluded, eligible_ratio: ink shares, overall and outside padded figures.

    Partitions arrive in order of pages; those of a batch that have equally many boxes are measured at once.
    """
    names = ["page", "text_ratio", "content_ratio", "excluded", "eligible_ratio"]
    layers = {"title": 0, "paragraph": 0, "list": 0, "caption": 0, "table": 1, "figure": 2}

    def measured(pdf):
        import numpy as np
        import pandas as pd

        pages = pdf["page"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], pages[1:] != pages[:-1]]))
        sizes = np.diff(np.append(starts, len(pages)))
        rows = np.column_stack([*(pdf[c].to_numpy(dtype=np.int64) for c in ("x", "y", "w", "h")), pdf["kind"].map(layers).fillna(3).to_numpy(dtype=np.int64)])
        named = {0: "title", 1: "table", 2: "figure"}
        out = []
        for n in np.unique(sizes):
            at = starts[sizes == n]
            if n <= MANY:
                columns = _batch_shares(rows[at[:, None] + np.arange(n)], width, height, pad)
            else:
                columns = list(zip(*(ink_shares([(*map(int, r[:4]), named.get(int(r[4]))) for r in rows[i : i + n]], width, height, pad) for i in at), strict=True))
            out.append(pd.DataFrame(dict(zip(names, [pages[at], *columns], strict=True))))
        return pd.concat(out)

    def partition(batches):
        import pandas as pd

        held = []  # rows of the page that the next batch may go on with
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf["page"] == pdf["page"].iloc[-1]
            if last.all() and (not held or held[0]["page"].iloc[0] == pdf["page"].iloc[0]):
                held.append(pdf)
                continue
            every = pd.concat([*held, pdf])
            ends = every["page"] == every["page"].iloc[-1]
            if (~ends).any():
                yield measured(every[~ends])
            held = [every[ends]]
        if held:
            yield measured(pd.concat(held))

    rows = boxes.select("page", "x", "y", "w", "h", "kind")
    schema = "page long, text_ratio double, content_ratio double, excluded double, eligible_ratio double"
    return rows.repartition("page").sortWithinPartitions("page").mapInPandas(partition, schema)
