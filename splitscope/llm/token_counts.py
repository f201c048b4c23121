"""Token counts that follow edits.

A document's pre-tokens (matches of the tokenizer's pattern) are the leaves of a segment tree that sums characters and tokens. An
edit is found by descending on characters. Only pre-tokens that it touches are split and encoded anew, with the context a
match can look at: it starts at the first pre-token whose match could see the edit and ends at the first old border that
comes out again behind it. Leaves are replaced and the sums above them updated; all else stays as it was.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.bpe import Encoder, shared_tables, worker_encoder

#: Pre-tokens in a block of leaves; a block that grows to twice that is split.
FAN = 64
#: Characters behind its end that a match can depend on: white space looks at the character after the next border.
SEES = 2

Edit = tuple[int, int, str]


class Node:
    """A subtree: its characters, tokens and pre-tokens, and either two children or a block of pre-tokens."""

    __slots__ = ("chars", "tokens", "count", "left", "right", "pieces", "sizes")

    def __init__(self, pieces: list[str], sizes: list[int]):
        if len(pieces) <= FAN:
            self.left = self.right = None
            self.pieces, self.sizes = pieces, sizes
        else:
            half = len(pieces) // 2
            self.left, self.right = Node(pieces[:half], sizes[:half]), Node(pieces[half:], sizes[half:])
            self.pieces = self.sizes = None
        self.sum_up()

    def sum_up(self) -> None:
        if self.left is None:
            self.chars, self.tokens, self.count = sum(map(len, self.pieces)), sum(self.sizes), len(self.pieces)
        else:
            a, b = self.left, self.right
            self.chars, self.tokens, self.count = a.chars + b.chars, a.tokens + b.tokens, a.count + b.count

    def find(self, at: int) -> tuple[int, int]:
        """The pre-token that holds character ``at`` (the last one beyond the end), and where it begins."""
        node, index, begin = self, 0, 0
        while node.left is not None:
            if at < begin + node.left.chars or not node.right.count:
                node = node.left
            else:
                index, begin, node = index + node.left.count, begin + node.left.chars, node.right
        for k, piece in enumerate(node.pieces):
            if at < begin + len(piece) or k == len(node.pieces) - 1:
                return index + k, begin
            begin += len(piece)
        return index, begin

    def walk(self, first: int) -> Iterator[str]:
        """The pre-tokens from number ``first`` on."""
        if self.left is None:
            yield from self.pieces[first:]
        elif first < self.left.count:
            yield from self.left.walk(first)
            yield from self.right.walk(0)
        else:
            yield from self.right.walk(first - self.left.count)

    def replace(self, first: int, last: int, pieces: list[str], sizes: list[int]) -> None:
        """Puts the pre-tokens in place of numbers first to last (exclusive) and updates the sums on the way up."""
        if self.left is None:
            self.pieces[first:last], self.sizes[first:last] = pieces, sizes
            if len(self.pieces) > 2 * FAN:
                self.__init__(self.pieces, self.sizes)
        else:
            n = self.left.count
            if last <= n and first < n:
                self.left.replace(first, last, pieces, sizes)
            elif first >= n:
                self.right.replace(first - n, last - n, pieces, sizes)
            else:
                self.left.replace(first, n, pieces, sizes)
                self.right.replace(0, last - n, [], [])
        self.sum_up()


class CountedText:
    """A text with its token count, kept up to date through edits."""

    def __init__(self, text: str, split: Callable[[str], list[str]], sizes: Callable[[list[str]], list[int]]):
        self.split, self.sizes, self.reencoded = split, sizes, 0
        pieces = split(text)
        self.root = Node(pieces, sizes(pieces))

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def text(self) -> str:
        return "".join(self.root.walk(0))

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` in place of the characters from start to end."""
        first, begin = self.root.find(max(0, start - SEES))
        if not self.root.count:
            pieces = self.split(new)
            self.root = Node(pieces, self.sizes(pieces))
            self.reencoded += len(pieces)
            return
        # Pull in old pre-tokens, ever more of them, until a border behind the edit comes out where one was before.
        old, total, taken, extra = self.root.walk(first), [], 0, 8
        ended = False
        while True:
            while not ended and (taken < end - begin or extra):
                piece = next(old, None)
                ended = piece is None
                if not ended:
                    extra -= taken >= end - begin
                    total.append(piece)
                    taken += len(piece)
            source = "".join(total)
            fresh = self.split(source[: start - begin] + new + source[end - begin :])
            shift = len(new) - (end - start)
            borders, at = set(), 0
            for k, piece in enumerate(total):
                at += len(piece)
                if at >= end - begin:
                    borders.add((at + shift, k + 1))
            known = dict(borders)
            place = start - begin + len(new)
            at, whole = 0, sum(map(len, fresh))
            for k, piece in enumerate(fresh):
                at += len(piece)
                # A border near the end of what was pulled in may owe to text being cut off there.
                if at >= place and at in known and (ended or at + SEES + 1 < whole):
                    pieces, last = fresh[: k + 1], first + known[at]
                    self.root.replace(first, last, pieces, self.sizes(pieces))
                    self.reencoded += k + 1
                    return
            if ended:
                self.root.replace(first, first + len(total), fresh, self.sizes(fresh))
                self.reencoded += len(fresh)
                return
            extra = 4 * len(total)


#: What the registered query takes out: mail addresses, and numbers of five or more digits, marks between them included.
REDACT = ((re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+"), "<mail>"), (re.compile(r"\d[\d .()-]{3,}\d"), "<number>"))


def redactions(text: str) -> list[Edit]:
    """Edits (start, end, new) that blank personal data, left to right and without overlaps."""
    found = sorted((m.start(), m.end(), new) for pattern, new in REDACT for m in pattern.finditer(text))
    out: list[Edit] = []
    for edit in found:
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


REPORT = "n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_pretokens_after long, n_tokens_after long"


def counts_through_edits(
    docs: DataFrame, path: str, pattern: str, edits: Callable[[str], list[Edit]] = redactions, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``n_pretokens``, ``n_tokens``, then what ``edits`` makes of it: ``n_edits``, ``n_reencoded``
    (pre-tokens that were encoded again), ``n_pretokens_after``, ``n_tokens_after``.

    ``edits`` gives non-overlapping (start, end, new) of a text in rising order. Null and empty texts have no tokens and are
    edited as empty texts. Rows are independent; an empty table gives no rows."""
    tables = shared_tables(docs.sparkSession, path)
    inner = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = inner.select("doc_id").schema
    for field in REPORT.split(", "):
        out = out.add(*field.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = worker_encoder(tables, path), regex.compile(pattern).findall
        for batch in batches:
            rows = [_followed(encoder, split, text or "", edits) for text in batch.column(1).to_pylist()]
            new = [pa.array([r[k] for r in rows], pa.int64()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=out.names)

    return inner.mapInArrow(run, out)


def _followed(encoder: Encoder, split, text: str, edits) -> tuple[int, ...]:
    counted = CountedText(text, split, encoder.sizes)
    before = (counted.root.count, counted.tokens)
    changes = edits(text)
    for start, end, new in reversed(changes):  # from the right, so that places to the left still hold
        counted.edit(start, end, new)
    return (*before, len(changes), counted.reencoded, counted.root.count, counted.tokens)
