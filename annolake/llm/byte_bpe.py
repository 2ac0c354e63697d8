"""Byte-level BPE encoding and decoding by a given rank file.

Each match of the split pattern is encoded by itself. A walk over its bytes (mapped to Latin-1 characters) takes the longest vocabulary entry that starts at a place, as
a pyahocorasick trie tells; where two neighbours could not stand side by side after
merging, the walk backs up to the next shorter entry. Whether two entries can be neighbours is decided
once, by playing their own merges against those across their border, and memoised. A position from which the walk backed up is never tried
again, so the work is linear in the bytes.

A batch of texts is cut in front of white space that follows something visible, where a match of the public pattern always ends; equal stretches
are encoded once a batch, and ids and decoded bytes are gathered by Arrow.

Cases: null text counts as empty, empty text gives no ids; ids are little-endian unsigned 32-bit
integers in one binary value; very long texts are encoded whole, alone in their batch; repeated rows are encoded again and give equal ids, ties cannot occur; an empty table
gives an empty result; columns of the input other than the id and
the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.columns import joined, parts, release, slices
from annolake.llm.tables import table, text_or_empty

#: Entries and bytes of keys of a memo before it is emptied: bound a worker's memory.
MEMO_ENTRIES, MEMO_BYTES = 300_000, 16 << 20
#: Bytes of text after which an output batch is closed.
BATCH_BYTES = 4 << 20
_NEVER = 1 << 40
#: The characters of several bytes in the pattern's white space, in UTF-8.
_WIDE_SPACE = [
    chr(c).encode()
    for c in (0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]


class _Memo(dict):
    """A dict that fills itself and is emptied when full."""

    def __init__(self, make: Callable, size: Callable = lambda key: 0):
        super().__init__()
        self.make, self.size, self.held = make, size, 0

    def __missing__(self, key):
        self.held += self.size(key)
        if len(self) >= MEMO_ENTRIES or self.held >= MEMO_BYTES:
            self.clear()
            self.held = self.size(key)
        value = self[key] = self.make(key)
        return value


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import public_tokenizers
        import regex

        self.ranks = read_ranks(path)
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        #: Of another pattern it isn't known where its matches end, so its texts stay whole.
        self.cuts = pattern == public_tokenizers.PATTERN
        # Only entries that merging really arrives at may take part in the walk.
        self.walkable = {t.decode("latin-1"): r for t, r in self.ranks.items() if self._merge(t) == [r]}
        trie = ahocorasick.Automaton()
        for t, r in self.walkable.items():
            trie.add_word(t, r)
        self.longest = trie.longest_prefix
        self.most = max(map(len, self.walkable), default=1)
        self.neighbours = _Memo(self._neighbours)
        self.edges = _Memo(self._edges)
        self.piece_ids = _Memo(self._packed_piece, len)

    def _merges(self, data: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """The rule itself: merge the pair of lowest rank, leftmost first, until none is left. (rank, parts) after each merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            ranks = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == _NEVER:
                return
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield best, parts

    def _merge(self, data: bytes) -> list[int]:
        parts = [data[i : i + 1] for i in range(len(data))]
        for _, parts in self._merges(data):  # noqa: B007
            pass
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """(rank, first part, last part) after each merge that makes the token."""
        return [(rank, parts[0], parts[-1]) for rank, parts in self._merges(self.token[token])] + [(_NEVER, b"", b"")]

    def _neighbours(self, pair: int) -> bool:
        """Whether merging the two tokens' bytes together leaves the two tokens: no merge across the border comes before those at its sides. Of equal ranks
        the leftmost comes first."""
        left, right = divmod(pair, 1 << 20)
        ours, theirs, get = self.edges[left], self.edges[right], self.ranks.get
        last, first, i, j = self.token[left][-1:], self.token[right][:1], 0, 0
        while True:
            a, b, across = ours[i][0], theirs[j][0], get(last + first, _NEVER)
            if across < a and across <= b:
                return False
            if a == b == _NEVER:
                return True
            if a <= b:
                last = ours[i][2]
                i += 1
            else:
                first = theirs[j][1]
                j += 1

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        s, n = data.decode("latin-1"), len(data)
        longest, walkable, neighbours, most = self.longest, self.walkable, self.neighbours, self.most
        dead: set[int] = set()
        out: list[int] = []
        last, at, size = -1, 0, longest(s[:most])
        while at < n:
            while size:
                end = at + size
                token = walkable.get(s[at:end], -1)
                if token >= 0 and end not in dead and (last < 0 or neighbours[last << 20 | token]):
                    break
                size -= 1
            if size:
                out.append(token)
                last, at = token, end
                size = longest(s[at : at + most])
            else:
                dead.add(at)
                size = len(self.token[out.pop()])
                last = out[-1] if out else -1
                at -= size
                size -= 1
        return out

    def _packed_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8", "surrogateescape"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def stretch(self, data: bytes) -> bytes:
        """Packed ids of a stretch that is split by itself. A plain word with marks behind it, the common case, needs no pattern."""
        text = data.decode("utf-8", "surrogateescape")
        if self.cuts and text.isascii():
            word = text.rstrip(",.;:!?|-")
            if word.isalpha() or word[:1] == " " and word[1:].isalpha():
                ids = self.piece_ids[word]
                return ids + self.piece_ids[text[len(word) :]] if len(word) < len(text) else ids
        return b"".join(map(self.piece_ids.__getitem__, self.pieces(text)))

    def encode(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text."""
        data, ends = parts(texts)
        bounds = _stretches(data, ends) if self.cuts else _distinct(ends)
        found = joined(data, bounds).dictionary_encode()
        own = pa.array(map(self.stretch, found.dictionary.to_pylist()), pa.binary())
        ids, stops = parts(own.take(found.indices))
        return joined(ids, stops[np.searchsorted(bounds, ends)])


def _stretches(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where stretches begin, with the end: at texts' ends, and in front of a space or line feed that follows a visible character."""
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    at = np.nonzero(((data[1:] == 32) | (data[1:] == 10)) & ~blank[:-1])[0] + 1
    # the character before is white space of several bytes
    wide = data[at - 1] >= 128
    if wide.any():
        some, gone = at[wide], np.zeros(int(wide.sum()), bool)
        for space in _WIDE_SPACE:
            same = some >= len(space)
            for k, byte in enumerate(reversed(space)):
                same &= data[np.maximum(some - 1 - k, 0)] == byte
            gone |= same
        at = np.concatenate([at[~wide], some[~gone]])
    return _distinct(np.concatenate([ends, at]))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


_LOADED: dict[tuple[str, str], ByteBpe] = {}
_TOKENS: dict[str, pa.Array] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """The tables of one vocabulary; a worker holds those of the latest only."""
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def tokens(path: str) -> pa.Array:
    """The bytes of each id, all that decoding needs; null where a rank is missing."""
    if path not in _TOKENS:
        token = {rank: token for token, rank in read_ranks(path).items()}
        _TOKENS.clear()
        _TOKENS[path] = pa.array([token.get(i) for i in range(max(token, default=-1) + 1)], pa.binary())
    return _TOKENS[path]


def unpacked_bytes(packed: pa.Array, token: pa.Array) -> pa.Array:
    """The bytes that packed ids stand for."""
    ids, ends = parts(packed)
    out, stops = parts(token.take(pa.array(np.frombuffer(np.ascontiguousarray(ids), "<u4"))))
    return joined(out, stops[ends // 4])


def _with_ids(part: pa.RecordBatch, c: ByteBpe) -> pa.RecordBatch:
    ids = c.encode(part.column("_text"))
    counts = np.diff(parts(ids)[1]) // 4
    return part.drop_columns(["_text"]).append_column("token_ids", ids).append_column("n_tokens", pa.array(counts, pa.int64()))


def _fields(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id", keep_digest: bool = False, decoded: bool = False) -> DataFrame:
    """(id, token_ids binary, n_tokens long) for each row; with ``keep_digest`` the text's SHA-256 in front of the ids, with ``decoded`` the bytes
    that the ids stand for behind them, from the same pass."""
    more = [F.sha2(text_or_empty(text), 256).alias("text_sha256")] if keep_digest else []
    kept = docs.select(id_col, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        c = codec(path, pattern)
        for part in slices(batches, "_text", BATCH_BYTES):
            out = _with_ids(part, c)
            yield out.append_column("decoded", unpacked_bytes(out.column("token_ids"), tokens(path))) if decoded else out
        c.piece_ids.clear()
        release()

    fields = f"{_fields(kept)}, token_ids binary, n_tokens bigint{', decoded binary' * decoded}"
    return docs.select(id_col, *more, text_or_empty(text).alias("_text")).mapInArrow(run, fields)


def decode(encoded: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """Appends the bytes that the ids stand for; null ids count as none."""
    frame = encoded.withColumn("token_ids", F.coalesce("token_ids", F.lit(b"")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "token_ids", BATCH_BYTES):
            yield part.append_column(out, unpacked_bytes(part.column("token_ids"), tokens(path)))

    return frame.mapInArrow(run, f"{_fields(frame)}, `{out}` binary")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    both = encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
