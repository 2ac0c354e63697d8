"""Handwriting: strokes to notes. A page's strokes are one group; links between them are found by numpy over blocks of pairs of boxes that
stand near each other, components by minima, fragments go to the nearest host, lines in the margin become one note, and rows give the reading order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolake.functions import geometry as G
from annolake.operators.shared import by_group

CLUSTER = "cluster int, anchor_id string, min_x double, min_y double, max_x double, max_y double, row_top double, strokes array<string>"


def linked(n: int, pairs: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Components of 0..n-1, each in order and in the order of its first member."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    groups: dict[int, list[int]] = {}
    for i in range(n):
        groups.setdefault(top(i), []).append(i)
    return list(groups.values())


def components(n: int, blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
    """As ``linked``, over pairs that come in blocks: of each block only those count that join two components, so no more than a block is held."""
    root = np.arange(n)
    for a, b in blocks:
        a, b = root[a], root[b]
        apart = a != b
        while apart.any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            apart = a != b
    groups: dict[int, list[int]] = {}
    for i, top in enumerate(root.tolist()):
        groups.setdefault(top, []).append(i)
    return list(groups.values())


def _near(at: np.ndarray, reach: float, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs whose values are at most ``reach`` apart, in blocks of about ``block`` pairs; what is over the reach by rounding may be among them."""
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    after = np.searchsorted(ranked, ranked + reach * (1 + 1e-9) + 1e-6, "right") - np.arange(len(at)) - 1
    ends, a = np.cumsum(after), 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + block, "right")))
        many = after[a:b]
        left = np.repeat(np.arange(a, b), many)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
        yield order[left], order[right]
        a = b


def _gap(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap of intervals, 0 where they meet."""
    return np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a]))


def joined(box: np.ndarray, line: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of boxes (min x, min y, max x, max y) that are on one line and near each other. Their middles are never further apart than the tallest strokes of a line that overlap enough."""
    x0, y0, x1, y1 = box.T
    centre, tall = (y0 + y1) / 2, y1 - y0
    for a, b in _near(centre, line * max(G.VERTICAL_TOLERANCE, G.MAX_LINE_STROKE - G.VERTICAL_OVERLAP)):
        level = np.abs(centre[a] - centre[b]) <= line * G.VERTICAL_TOLERANCE
        overlap = np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
        level |= (np.maximum(tall[a], tall[b]) <= line * G.MAX_LINE_STROKE) & (overlap >= line * G.VERTICAL_OVERLAP)
        good = level & (_gap(x0, x1, a, b) <= line * G.HORIZONTAL_TOLERANCE)
        yield a[good], b[good]


def stacked(box: np.ndarray, line: float, left: float, right: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lines of handwriting that stand one below the other in the margin."""
    able = np.nonzero(((box[:, 2] > right) | (box[:, 0] < left)) & (box[:, 3] - box[:, 1] <= line * G.MAX_LINE_STROKE))[0]
    x0, y0, x1, y1 = box[able].T
    for a, b in _near(y0, line * G.MAX_LINE_STROKE * (1 + G.MARGIN_GAP)):
        tall = np.maximum(y1[a] - y0[a], y1[b] - y0[b])
        near = (_gap(y0, y1, a, b) <= tall * G.MARGIN_GAP) & (np.abs(x0[a] - x0[b]) <= line * G.MARGIN_LEFT)
        good = near & (np.minimum(x1[a], x1[b]) > np.maximum(x0[a], x0[b]))
        yield able[a[good]], able[b[good]]


def _union(box: np.ndarray) -> np.ndarray:
    return np.concatenate([box[:, :2].min(0), box[:, 2:].max(0)])


def _first_id(ids: list[str]) -> str:
    return min(ids, key=lambda i: (len(i), i))


def page_clusters(strokes: pd.DataFrame, line: float, column: tuple[float, float] | None = None) -> pd.DataFrame:
    """Notes of one page from (id, min_x, min_y, max_x, max_y) in drawing order; strokes without points have null boxes and no part."""
    names = ["cluster", "anchor_id", "min_x", "min_y", "max_x", "max_y", "row_top", "strokes"]
    return pd.DataFrame(_note_rows(strokes, line, column), columns=names)


def _note_rows(strokes: pd.DataFrame, line: float, column: tuple[float, float] | None) -> list[tuple]:
    box, ids = np.stack([strokes[c].to_numpy(float) for c in ("min_x", "min_y", "max_x", "max_y")], 1), strokes["id"].to_numpy()
    inked = ~np.isnan(box[:, 0])
    box, ids = box[inked], ids[inked].tolist()
    if not ids:
        return []
    parts = components(len(box), joined(box, line))
    outline = np.stack([_union(box[p]) for p in parts])
    width, height = outline[:, 2] - outline[:, 0], outline[:, 3] - outline[:, 1]
    small = (height < line * G.FRAGMENT_HEIGHT) | (width < line * G.FRAGMENT_WIDTH) & (height <= line * G.SLIVER_HEIGHT)
    hosts = np.nonzero(~small)[0]
    notes = [[list(parts[h]), _first_id([ids[i] for i in parts[h]])] for h in hosts] if len(hosts) else [[list(p), _first_id([ids[i] for i in p])] for p in parts]
    if len(hosts):
        for f in np.nonzero(small)[0]:
            gap = np.hypot(
                np.maximum(0, np.maximum(outline[f, 0] - outline[hosts, 2], outline[hosts, 0] - outline[f, 2])), np.maximum(0, np.maximum(outline[f, 1] - outline[hosts, 3], outline[hosts, 1] - outline[f, 3]))
            )
            near = int(gap.argmin())
            if gap[near] <= line * G.FRAGMENT_GAP:
                notes[near][0] += parts[f]
            else:
                notes.append([list(parts[f]), _first_id([ids[i] for i in parts[f]])])
    if column is not None:
        outline = np.stack([_union(box[m]) for m, _ in notes])
        groups = components(len(notes), stacked(outline, line, *column))
        notes = [[[m for i in g for m in notes[i][0]], _first_id([notes[i][1] for i in g])] for g in groups]
    rows = []
    for members, anchor in notes:
        rows.append((anchor, *_union(box[members]), [ids[i] for i in sorted(members)]))
    rows.sort(key=lambda r: (r[2], r[1]))
    out, top, row = [], None, -1
    for r in rows:  # a row takes in what starts within a line height of its first note
        if top is None or r[2] >= top + line:
            top, row = r[2], row + 1
        out.append((row, r[1], top, r))
    out.sort(key=lambda t: t[:2])
    return [(i, r[0], *r[1:5], top, r[5]) for i, (_, _, top, r) in enumerate(out)]


def clustered(strokes: DataFrame, line: str = "line_height", page: str = "page_id") -> DataFrame:
    """Notes of every page of (page_id, ord, id, min_x, min_y, max_x, max_y, line_height[, column_left, column_right])."""
    with_column = {"column_left", "column_right"} <= set(strokes.columns)

    def run(ordered: pd.DataFrame):
        column = (float(ordered.column_left.iloc[0]), float(ordered.column_right.iloc[0])) if with_column and ordered.column_left.notna().all() else None
        return ((ordered[page].iloc[0], *row) for row in _note_rows(ordered, float(ordered[line].iloc[0]), column))

    return by_group(strokes, page, ["ord"], run, f"{page} string, {CLUSTER}")


def merged_by_text(rows: pd.DataFrame) -> pd.DataFrame:
    """Highlights of a page whose sentences hold one another as one: (id, survivor_id). The topmost recorded one survives, an ink mark only where none is recorded."""
    texts, places = rows.sentence.tolist(), {}
    for i, text in enumerate(texts):
        places.setdefault(text or ("", i), []).append(i)  # without a sentence, alone
    own, out = list(places.values()), []
    for group in _held([t if isinstance(t, str) else "" for t in places]):
        members = sorted(i for k in group for i in own[k])
        recorded = [i for i in members if not rows.is_ink.iloc[i]] or members
        best = min(recorded, key=lambda i: (rows.top.iloc[i], i))
        out += [(rows.id.iloc[i], rows.id.iloc[best]) for i in members]
    return pd.DataFrame(out, columns=["id", "survivor_id"])


def _held(texts: list[str]) -> list[list[int]]:
    """Groups of different texts of which one holds another, each in order; memory for the texts alone."""
    by = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    return linked(len(texts), ((a, b) for k, a in enumerate(by) if texts[a] for b in by[k + 1 :] if texts[a] in texts[b]))


def merged_highlights(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """(page_id, id, survivor_id) of (page_id, ord, id, sentence, top, is_ink). Equal sentences are one row with its best highlight before a page's different sentences are compared."""
    known = F.coalesce("sentence", F.lit("")) != ""
    rank = F.struct(F.coalesce("is_ink", F.lit(False)).alias("ink"), F.col("top").isNull().alias("no_top"), F.coalesce(F.col("top").cast("double"), F.lit(0.0)).alias("top"), F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id"))
    best = rows.where(known).groupBy(page, "sentence").agg(F.min(rank).alias("best")).select(page, "sentence", "best.*")

    def run(frame: pd.DataFrame):
        texts, ranks, ids = frame.sentence.tolist(), frame[["ink", "no_top", "top", "ord"]].to_numpy().tolist(), frame.id.tolist()
        for group in _held(texts):
            first = min(group, key=lambda i: ranks[i])
            yield from ((frame[page].iloc[0], texts[i], ids[first]) for i in group)

    survivors = by_group(best, page, ["sentence"], run, f"{page} string, sentence string, survivor_id string")
    whole = rows.select(page, F.col("id").cast("string").alias("id"), F.when(known, F.col("sentence")).alias("sentence")).join(survivors, [page, "sentence"], "left")
    return whole.select(page, "id", F.coalesce("survivor_id", "id").alias("survivor_id"))
