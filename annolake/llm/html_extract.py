"""Main-text extraction by a linear-chain conditional random field over a page's leaf blocks.

A block's features are its ancestors' tags and attribute words (with how far up they stand) and shape of its text; labels are main text or not. The weights
maximise the conditional likelihood of labelled pages (forward-backward, batch gradient); a page is decoded by Viterbi, so a short line between
paragraphs is judged with its neighbours. The driver trains once on a bounded number of pages; each page is then a row by itself.

Cases: null html counts as empty and gives an empty text; pages without blocks or without main text give an empty text; very long pages are read in
one pass, with all their text (of tags nested more than 512 deep those in the middle are no features); of equally likely labellings the one that leaves out more blocks is taken; repeated rows are repeated; an
empty table gives an empty result; other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.html_blocks import Block, blocks
from annolake.llm.labelled_pages import PAGES, labelled_page
from annolake.llm.tables import table, text_or_empty

ROUNDS, RATE, RIDGE = 120, 0.15, 2e-4
_NEAR_TAGS = 3
_COOKIE = re.compile(r"cookie|consent|javascript|subscribe|newsletter|sign up|log ?in|all rights reserved|copyright|©|advert", re.I)


@functools.lru_cache(65536)
def _path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    found = set()
    for up, (tag, words) in enumerate(reversed(path)):
        found.add(f"in {tag}")
        if up < _NEAR_TAGS:
            found.add(f"{up} {tag}")
        for w in words.split():
            found.add(f"word {w}")
            if len(w) > 4 and w.endswith("s"):
                found.add(f"word {w[:-1]}")
    return tuple(found)


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        own = [*_path_features(b.path), f"words {min(words.bit_length(), 6)}", f"links {0 if share < 0.05 else 1 if share < 0.4 else 2 if share < 0.8 else 3}", "end " + ("." if b.text[-1] in ".!?…" else "-")]
        if i == 0:
            own.append("first")
        if i == len(page) - 1:
            own.append("last")
        if i and page[i - 1].path == b.path:
            own.append("same path")
        if _COOKIE.search(b.text):
            own.append("boilerplate word")
        out.append(own)
    return out


class Crf:
    """Two labels, weights by feature; unknown features count nothing."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, turns: np.ndarray):
        self.index, self.weights, self.turns = index, weights, turns

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi; of equal paths the one with less main text."""
        index, w = self.index, self.weights
        (stay0, to1), (to0, stay1) = self.turns.tolist()
        best0 = best1 = 0.0
        back = []
        for t, own in enumerate(page):
            ids = [index[f] for f in own if f in index]
            e0, e1 = w[ids].sum(0).tolist() if ids else (0.0, 0.0)
            if t == 0:
                best0, best1 = e0, e1
                continue
            a0, b0, a1, b1 = best0 + stay0, best1 + to0, best0 + to1, best1 + stay1
            back.append((int(b0 > a0), int(b1 > a1)))
            best0, best1 = max(a0, b0) + e0, max(a1, b1) + e1
        label = int(best1 > best0)
        out = [label] if page else []
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    most = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - most).sum(axis=axis)) + most.squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = ROUNDS) -> Crf:
    """Adam on the mean negative log-likelihood of the label chains."""
    index: dict[str, int] = {}
    for feats, _ in pages:
        for own in feats:
            for f in own:
                index.setdefault(f, len(index))
    n, longest = len(pages), max(len(labels) for _, labels in pages)
    where = [(p, t) for p, (_, labels) in enumerate(pages) for t in range(len(labels))]
    at = np.array(where)
    wide = max(len(own) for feats, _ in pages for own in feats)
    ids = np.full((len(at), wide), len(index))
    for r, own in enumerate(own for feats, _ in pages for own in feats):
        ids[r, : len(own)] = [index[f] for f in own]
    gold = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for p, (_, labels) in enumerate(pages):
        gold[p, : len(labels)] = labels
        mask[p, : len(labels)] = True
    weights, turns = np.zeros((len(index) + 1, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(x) for x in (weights, weights, turns, turns)]
    one_hot = np.eye(2)
    for step in range(1, rounds + 1):
        emit = np.zeros((n, longest, 2))
        emit[at[:, 0], at[:, 1]] = weights[ids].sum(1)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], _log_sum(ahead[:, t - 1, :, None] + turns, 1) + emit[:, t], ahead[:, t - 1])
        whole = _log_sum(ahead[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], _log_sum(turns + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2), behind[:, t + 1])
        chance = np.exp(ahead + behind - whole[:, None, None])
        wrong = (chance - one_hot[gold])[at[:, 0], at[:, 1]]
        grad = np.stack([np.bincount(ids.ravel(), np.repeat(wrong[:, k], wide), len(index) + 1) for k in (0, 1)], 1) / len(at)
        both = mask[:, 1:]
        pair = np.exp(ahead[:, :-1, :, None] + turns + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        seen = one_hot[gold[:, :-1]][..., :, None] * one_hot[gold[:, 1:]][..., None, :]
        turn_grad = ((pair - seen) * both[..., None, None]).sum((0, 1)) / len(at)
        for x, g, m, v in ((weights, grad + RIDGE * weights, *moments[:2]), (turns, turn_grad, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights[-1] = 0
    return Crf(index, weights[:-1], turns)


@functools.lru_cache(4)
def trained(pages: int = PAGES) -> Crf:
    examples = []
    for seed in range(pages):
        source, labels = labelled_page(seed)
        found = features(blocks(source))
        if len(found) != len(labels):
            raise ValueError(f"page {seed}: {len(found)} blocks, {len(labels)} labels")
        examples.append((found, labels))
    return train(examples)


def main_text(source: str, model: Crf) -> str:
    page = blocks(source)
    return "\n\n".join(b.text for b, label in zip(page, model.decode(features(page)), strict=True) if label)


def extract(pages: DataFrame, model: Crf | None = None, html: str = "html", id_col: str = "page_id", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text)."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_html")
            texts = [main_text(v.as_py(), model) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=[*batch.schema.names[:at], "text"])

    frame = pages.select(id_col, *keep, text_or_empty(html).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "_html")
    return frame.mapInArrow(run, f"{fields}, text string")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
