"""Words of whole columns of texts, by their bytes: a word is a maximal run of given bytes within a text, and A-Z count as a-z."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from annolake.llm.columns import joined, parts

#: Bytes of text whose places are worked out at once.
LOT = 4 << 20


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal runs of true start and end; none goes on from one text into the next."""
    before, after = np.zeros(len(inside) + 1, bool), np.zeros(len(inside) + 1, bool)
    before[1:], after[:-1] = inside, inside
    starts, stops = after & ~before, before & ~after
    cuts = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(inside))]
    both = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    starts[both] = stops[both] = True
    return np.nonzero(starts)[0], np.nonzero(stops)[0]


def words(texts: pa.Array, is_word: np.ndarray, is_cut: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a column without nulls, and for each word in order its number among them and its text, or, with ``is_cut``, its piece: a number that rises from
    piece to piece. ``is_word``, ``is_cut``: for each byte, if it belongs to words, and if it ends a piece."""
    data, ends = parts(texts)
    chunks, owners, at, cuts = [pa.array([], pa.binary())], [np.zeros(0, np.int64)], 0, 0
    while at < len(ends) - 1:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + LOT, side="right")) - 1)
        own, own_ends = lowered(data[ends[at] : ends[stop]]), ends[at : stop + 1] - ends[at]
        inside = is_word[own]
        starts, stops = runs(inside, own_ends)
        chunks.append(joined(own[inside], np.concatenate([[0], np.cumsum(stops - starts)])))
        owner = np.searchsorted(own_ends, starts, side="right") - 1 + at
        if is_cut is not None:
            passed = np.cumsum(is_cut[own])
            owner += cuts + passed[starts] if len(own) else 0
            cuts += int(passed[-1]) if len(own) else 0
        owners.append(owner)
        at = stop
    wide = any(pa.types.is_large_binary(c.type) for c in chunks)
    coded = pa.chunked_array([c.cast(pa.large_binary()) for c in chunks] if wide else chunks).dictionary_encode()
    if not coded.num_chunks:
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    return coded.chunk(coded.num_chunks - 1).dictionary, ids.astype(np.int64), np.concatenate(owners)
