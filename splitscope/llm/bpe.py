"""Byte-level BPE by dynamic programming over byte prefixes.

For ranked merges every prefix of a piece has one token that can be the last of its encoding: a token T ends the prefix if
the tokens before it encode the rest and if merging by rank would keep the border in front of T. So one left-to-right pass that
stores the last token of each prefix encodes a piece; appending goes on from the stored prefixes, and an edit only redoes the
prefixes behind it until they agree with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.llm.common import fresh

#: Pieces in the newer half of a worker's cache; when it is full it becomes the older half.
CACHED_PIECES = 250_000
#: Token pairs after which the cache of borders starts anew.
CACHED_BORDERS = 500_000

#: Bytes up to which only the prefixes that the whole piece's encoding hangs on are settled.
SHORT_PIECE = 200


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank. Ranks are 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of ``piece`` after all merges of a rank under ``below``: lowest rank first, then leftmost."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        options = [(ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(options)
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(maxsize=4)
def split_table(path: str) -> tuple[list[bytes], list[int], list[int]]:
    """Tokens, and for each the two tokens of its last merge; -1 if merging its bytes never yields the token itself.

    A single byte is its own left and right part."""
    tokens = read_ranks(path)
    ranks = {t: i for i, t in enumerate(tokens)}
    left, right = list(range(len(tokens))), list(range(len(tokens)))
    for i, token in enumerate(tokens):
        if len(token) > 1:
            parts = merged(token, ranks, i)
            left[i], right[i] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
    return tokens, left, right


class Encoder:
    """Encodes pieces by the tables of :func:`split_table`."""

    def __init__(self, tokens: list[bytes], left: list[int], right: list[int]):
        self.tokens, self.left, self.right = tokens, left, right
        self.ranks = {t: i for i, t in enumerate(tokens)}
        reached = {t: i for i, t in enumerate(tokens) if left[i] >= 0}
        #: Every beginning of a token, with the token's rank, or -1 if it is none itself.
        self.beginnings = dict.fromkeys((t[:n] for t in reached for n in range(1, len(t))), -1) | reached
        self.longest = max(map(len, tokens))
        self.borders: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def border_holds(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves tokens ``a`` and ``b`` side by side.

        Undoes the merges of both sides in falling order of rank. ``limit`` is the first rank that came too late to
        cross the border at that point; a pair across it of a lower rank would have been merged."""
        known = self.borders.get(a << 32 | b)
        if known is not None:
            return known
        x, y, limit, holds = a, b, len(self.tokens), True
        while True:
            across = self.ranks.get(self.tokens[x] + self.tokens[y])
            if across is not None and across < limit:
                holds = False
                break
            # The later merge is undone first; of equal ranks the right one came later, as merging goes leftmost first.
            if self.right[x] == x and self.left[y] == y:
                break
            if self.right[x] != x and (x > y or self.left[y] == y):
                # A pair across the border of x's own rank would have stood to the right of x's merge: it lost the tie.
                limit, x = x, self.right[x]
            else:
                # One across of y's own rank stands to the left of y's merge: it would have won.
                limit, y = y + 1, self.left[y]
        if len(self.borders) >= CACHED_BORDERS:
            self.borders.clear()
        self.borders[a << 32 | b] = holds
        return holds

    def ids_of_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern; a piece that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > SHORT_PIECE:
            return Prefixes(self, piece).ids()
        last = [-1] * (len(piece) + 1)
        self._settle(piece, last, len(piece))
        return walk_back(last, self.tokens)

    def _settle(self, piece: bytes, last: list[int], n: int) -> int:
        """Fills in the last token of the prefix of n bytes, and of those shorter prefixes that the answer hangs on."""
        ranks, borders = self.ranks, self.borders
        for begin in range(max(0, n - self.longest), n):
            token = ranks.get(piece[begin:n])
            if token is None or self.left[token] < 0:
                continue
            if begin:
                before = last[begin]
                if before < 0:
                    before = self._settle(piece, last, begin)
                holds = borders.get(before << 32 | token)
                if holds is None:
                    holds = self.border_holds(before, token)
                if not holds:
                    continue
            last[n] = token
            return token
        raise ValueError("a byte of the piece is no token")

    def _known(self, pieces: list[str]) -> dict[str, bytes]:
        """The cache, with the ids of all these pieces in it."""
        if len(self.pieces) >= CACHED_PIECES:
            self.pieces, self.older = {}, self.pieces
        known, older = self.pieces, self.older
        for piece in pieces:
            if piece not in known:
                known[piece] = older.get(piece) or struct.pack(f"<{len(i := self.ids_of_piece(piece.encode()))}I", *i)
        return known

    def encode(self, pieces: list[str]) -> bytes:
        """The ids of pre-split text as little-endian unsigned 32-bit integers."""
        known = self._known(pieces)
        return b"".join([known[piece] for piece in pieces])

    def sizes(self, pieces: list[str]) -> list[int]:
        """How many tokens each piece has."""
        known = self._known(pieces)
        return [len(known[piece]) >> 2 for piece in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def walk_back(last: list[int], tokens: list[bytes]) -> list[int]:
    """The encoding that ends with the last entry."""
    out, n = [], len(last) - 1
    while n:
        out.append(last[n])
        n -= len(tokens[last[n]])
    return out[::-1]


class Prefixes:
    """The last token of every prefix of a piece: ``last[n]`` ends the encoding of the first n bytes."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.piece, self.last = encoder, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Goes on behind the stored prefixes, none of which changes. Each token is tried from where it begins."""
        e, last, known = self.encoder, self.last, len(self.piece)
        piece = self.piece = self.piece + more
        size = len(piece)
        last += [-1] * len(more)
        beginnings, borders = e.beginnings, e.borders
        for j in range(max(0, known - e.longest), size):
            before = last[j] << 32
            for end in range(j + 1, size + 1):
                token = beginnings.get(piece[j:end])
                if token is None:
                    break
                if token >= 0 and end > known and last[end] < 0:
                    holds = j == 0 or borders.get(before | token)
                    if holds or holds is None and e.border_holds(last[j], token):
                        last[end] = token

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of the bytes from start to end; returns how many prefixes were worked out again."""
        old_last, old_piece = self.last, self.piece
        self.piece = old_piece[:start] + new + old_piece[end:]
        self.last = old_last[: start + 1] + [-1] * (len(self.piece) - start)
        shift, steady, span = len(new) - (end - start), 0, self.encoder.longest
        for n in range(start + 1, len(self.piece) + 1):
            self.last[n] = self._last_of(n, span)
            same = n - shift > end and self.last[n] == old_last[n - shift]
            steady = steady + 1 if same else 0
            if steady >= span:  # no token reaches behind the stretch that agrees
                self.last[n + 1 :] = old_last[n - shift + 1 :]
                return n - start
        return len(self.piece) - start

    def _last_of(self, n: int, span: int) -> int:
        for begin in range(n - 1, max(-1, n - span - 1), -1):
            token = self.encoder.beginnings.get(self.piece[begin:n], -1)
            if token >= 0 and (begin == 0 or self.encoder.border_holds(self.last[begin], token)):
                return token
        raise ValueError("a byte of the piece is no token")

    def ids(self) -> list[int]:
        return walk_back(self.last, self.encoder.tokens)


_encoders: dict[str, Encoder] = {}


def shared_tables(spark: SparkSession, path: str) -> Broadcast:
    """The tables, read on the driver; their size is that of the rank file."""
    return spark.sparkContext.broadcast(split_table(path))


def worker_encoder(tables: Broadcast, path: str) -> Encoder:
    """One encoder per worker process, made anew when the rank file changes."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(*tables.value)
    return _encoders[path]


def _per_text(docs: DataFrame, path: str, pattern: str, text_col: str, keep: list[str], added: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    """The columns ``keep`` and one more for each of ``added``; make(encoder, ids) gives their values for one text."""
    tables = shared_tables(docs.sparkSession, path)
    inner = docs.select(*keep, F.col(text_col).alias(fresh(docs, "text_to_encode")))
    out = inner.select(*keep).schema
    for name, spark_type, _ in added:
        out = out.add(name, spark_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = worker_encoder(tables, path), regex.compile(pattern).findall
        for batch in batches:
            rows = [make(encoder, encoder.encode(split(t or ""))) for t in batch.column(len(keep)).to_pylist()]
            new = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=out.names)

    return inner.mapInArrow(run, out)


def token_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, then ``token_ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    Each match of the pattern is encoded on its own, without special tokens. Null and empty texts have no ids. Rows are
    independent: repeats give repeats, an empty table gives no rows. Columns that are called like the new ones give way."""
    keep = [c for c in docs.columns if c not in (text_col, "token_ids", "n_tokens")]
    added = [("token_ids", "binary", pa.binary()), ("n_tokens", "long", pa.int64())]
    return _per_text(docs, path, pattern, text_col, keep, added, lambda _, ids: (ids, len(ids) // 4))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, and the SHA-256 digests ``ids_sha256`` of the ids (little-endian unsigned 32-bit
    integers) and ``decoded_sha256`` of the bytes they decode to. Cases as in :func:`token_ids`."""
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    added = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    make = lambda encoder, ids: (len(ids) // 4, hexed(ids), hexed(encoder.decode(ids)))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _per_text(named, path, pattern, "text", ["doc_id"], added, make)
