"""Periodic runs in texts, word by word: dyadic catchers of squares whose squares merge into maximal runs.

Level s, a power of two, looks for periods q from 2s to 4s - 1 (level 1: from 1 on). Whenever s words from a multiple of s on are
complete, they become a catcher: it waits for itself to come back q words later, which every square of that period makes one of
its level's blocks do. Words that are appended advance all comparisons that end in them: of window hashes with the catchers that
still wait, and of the stretches that reach the end with the words one period before. A catch is extended word by word to the
whole stretch of that period; neighbouring catches are the same stretch. What lies in a stretch of a short period is not tried
again for longer ones, since it could only repeat it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import flat_text, mix64, runs_of_rows

U = np.uint64
#: Bytes of text whose words are appended at a time, and words compared at a time when a catch is extended.
CHUNK, STRIDE = 1 << 20, 16
#: Window hashes that are compared at a time.
TILE = 1 << 22


def _extended(words: np.ndarray, at: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, forwards or backwards, equal the word a period later."""
    n, size = len(words), np.zeros(len(at), np.int64)
    active, stride = np.arange(len(at)), STRIDE
    while len(active):
        i = at[active, None] + step * (size[active, None] + np.arange(stride))
        j = i + period[active, None]
        inside = (i >= 0) & (j < n)
        same = inside & (words[np.where(inside, i, 0)] == words[np.where(inside, j, 0)])
        run = np.where(same.all(axis=1), stride, same.argmin(axis=1))
        size[active] += run
        active = active[run == stride]
        stride = min(4 * stride, max(STRIDE, (1 << 20) // max(1, len(active))))
    return size


def _shortest(s: int) -> int:
    """The shortest period that level ``s`` looks for; the longest is 4s - 1."""
    return 2 * s if s > 1 else 1


class SquareCatcher:
    """Words are appended, in pieces of any size; :meth:`runs` tells the runs of what has come so far."""

    def __init__(self, exponent: int = 2, least: int = 0):
        self.exponent, self.least = exponent, least
        self.words = np.zeros(0, U)
        #: Window hashes of each level that later comparisons need, and the position of the first one.
        self.windows: list[tuple[int, np.ndarray]] = [(0, np.zeros(0, U))]
        self.covered = np.zeros(0, np.int64)
        #: Stretches (start, end, period) that are over, and those that reach the last word.
        self.over = np.zeros((0, 3), np.int64)
        self.open = np.zeros((0, 3), np.int64)

    def append(self, words: np.ndarray) -> None:
        """``words``: unsigned 64-bit numbers, equal for equal words."""
        old, n = len(self.words), len(self.words) + len(words)
        self.words = np.concatenate([self.words, words])
        self.covered = np.concatenate([self.covered, np.zeros(len(words), np.int64)])
        self._advance()
        first, known = self.windows[0]
        waiting, s, level, hashes = [self.open], 1, 0, mix64(self.words[first + len(known) :])
        while n >= s + _shortest(s):
            if level == len(self.windows):
                self.windows.append((0, np.zeros(0, U)))
            first, known = self.windows[level]
            known = np.concatenate([known, hashes])
            self._cover(np.concatenate(waiting), s)
            waiting.append(self._caught(s, first, known, old))
            hashes = self._doubled(s, level, first, known)
            cut = max(0, len(known) - 6 * s)
            self.windows[level] = (first + cut, known[cut:])
            s, level = 2 * s, level + 1

    def _doubled(self, s: int, level: int, first: int, known: np.ndarray) -> np.ndarray:
        """The window hashes of length 2s that have become complete."""
        there = self.windows[level + 1] if level + 1 < len(self.windows) else (0, np.zeros(0, U))
        begin = there[0] + len(there[1]) - first
        left, right = known[begin : len(known) - s], known[begin + s :]
        return mix64(left * U(0x9E3779B97F4A7C15) + right) if len(right) else np.zeros(0, U)

    def _advance(self) -> None:
        """Stretches that reached the former end go on as far as they do."""
        if len(self.open):
            start, end, period = self.open.T
            more = _extended(self.words, end - period, period, 1)
            self.open = np.empty((0, 3), np.int64)
            self._keep(np.stack([start, end + more, period], axis=1))

    def _keep(self, found: np.ndarray) -> None:
        ends = found[:, 1] == len(self.words)
        long = found[:, 1] - found[:, 0] >= np.maximum(self.least, self.exponent * found[:, 2])
        self.over = np.concatenate([self.over, found[~ends & long]])
        self.open = np.unique(np.concatenate([self.open, found[ends]]), axis=0)

    def _cover(self, found: np.ndarray, s: int) -> None:
        """Notes up to where stretches of periods that level ``s`` need not look into reach."""
        own = found[(found[:, 2] <= s) & (found[:, 1] - found[:, 0] >= 2 * found[:, 2])]
        own = own[self.covered[own[:, 0]] < own[:, 1]]
        for start, end, _ in own.tolist():
            np.maximum(self.covered[start:end], end, out=self.covered[start:end])

    def _caught(self, s: int, first: int, known: np.ndarray, old: int) -> np.ndarray:
        """The stretches that catchers of level ``s`` find in comparisons ending in the words from ``old`` on."""
        low, n = _shortest(s), len(self.words)
        width = 4 * s - low
        begin = -(-max(first, old + 1 - width - low - s + 1) // s) * s
        blocks = np.arange(begin, n - low - s + 1, s)
        hits: list[np.ndarray] = []
        padded = np.concatenate([known, np.zeros(width, U)])  # windows that are not complete yet: cut off below
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        rows = max(1, TILE // width)
        for i in range(0, len(blocks), rows):
            some = blocks[i : i + rows]
            found = known[some - first, None] == view[some - first + low]
            b, q = np.nonzero(found)
            b, q = some[b], q + low
            end = b + q + s
            hits.append(np.stack([q, b], axis=1)[(end <= n) & (end > old) & (self.covered[b] < end)])
        pairs = np.concatenate(hits) if hits else np.zeros((0, 2), np.int64)
        if not len(pairs):
            return np.zeros((0, 3), np.int64)
        q, b = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].T
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (b[1:] != b[:-1] + s)
        at = np.flatnonzero(new)
        head, period, tail = b[at], q[at], b[np.append(at[1:], len(b)) - 1] + s
        start = head - _extended(self.words, head - 1, period, -1)
        end = tail + _extended(self.words, tail, period, 1) + period
        found = np.unique(np.stack([start, end, period], axis=1), axis=0)
        self._keep(found)
        return found

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of the maximal stretches with their smallest period, by start and period."""
        found = np.unique(np.concatenate([self.over, self.open]), axis=0)
        length = found[:, 1] - found[:, 0]
        found = found[length >= np.maximum(self.least, self.exponent * found[:, 2])]
        reach, out = np.zeros(len(self.words) + 1, np.int64), []
        for start, end, period in found[np.argsort(found[:, 2], kind="stable")].tolist():
            if reach[start] < end:  # else a smaller period holds throughout
                np.maximum(reach[start:end], end, out=reach[start:end])
                out.append((start, end - start, period))
        return np.array(sorted(out), np.int64).reshape(-1, 3)


#: For a row's id and number of words: (a, p) if its words from a on are to repeat the p words there.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def _told(ids: list, texts: list[bytes], exponent: int, least: int, rewrite: Rewrite | None) -> Iterator[tuple]:
    """(words, runs) of each text. The texts are appended to one catcher, each behind a word that occurs nowhere else."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    lists, parts, at = [], [], [0]
    for i, text in zip(ids, texts, strict=True):
        words = text.split()  # at space and 9 to 13
        change = rewrite(i, len(words)) if rewrite else None
        if change:
            a, p = change
            words = words[:a] + [words[a + k % p] for k in range(len(words) - a)]
        lists.append(words)
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-len(lists)])]
        at.append(at[-1] + len(words) + 1)
    catcher = SquareCatcher(exponent, least)
    catcher.append(np.concatenate(parts).view(U))
    runs = catcher.runs()
    cuts = np.searchsorted(runs[:, 0], at)
    for k, words in enumerate(lists):
        yield words, runs[cuts[k] : cuts[k + 1]] - [at[k], 0, 0]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a space, each run cut down to its first period."""
    if len(runs):
        drop = np.zeros(len(words), bool)
        for start, length, period in runs.tolist():
            drop[start + period : start + length] = True
        words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
    return b" ".join(words)


FOUND = "words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
DIGESTS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _batches(batches: Iterator[pa.RecordBatch], *options) -> Iterator[tuple[pa.Array, list, list]]:
    for batch in batches:
        data, starts = flat_text(batch.column(1))
        raw = data.tobytes()
        for i, j in runs_of_rows(starts, CHUNK):
            ids = batch.column(0).slice(i, j - i)
            texts = [raw[starts[k] : starts[k + 1]] for k in range(i, j)]
            yield ids, list(range(i, j)), list(_told(ids.to_pylist(), texts, *options))


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``words`` (how many), ``runs`` and ``collapsed``, the text with each run cut to its first period.

    Words lie between spaces and control characters 9 to 13. A run is a stretch of at least ``least`` words and ``exponent`` times
    its smallest period that neither neighbour continues. Null and empty texts have no words, no run and an empty ``collapsed``.
    Each row is told by itself, whatever its id: ids may be null or repeat. Other columns are not looked at."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, told in _batches(batches, exponent, least, None):
            columns = [
                [len(words) for words, _ in told],
                [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()] for _, runs in told],
                [collapsed(words, runs).decode() for words, runs in told],
            ]
            kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]
            names = ["doc_id", "words", "runs", "collapsed"]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns, kinds)], names=names)

    return narrow.mapInArrow(run, f"doc_id long, {FOUND}")


def digests(
    docs: DataFrame, exponent: int = 4, least: int = 6, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """What :func:`periodic_runs` finds in each row, as digests: the number of runs, the longest one (of equal ones the first,
    then that of the smaller period; nulls if there is none), and hashes of all runs and of the collapsed text.

    ``rewrite`` can make texts repeat themselves before they are looked at."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, told in _batches(batches, exponent, least, rewrite):
            rows = []
            for words, runs in told:
                found = runs.tolist()
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=[None] * 3)
                milli = None if best[0] is None else 1000 * best[1] // best[2]
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in found).encode()
                shas = [hashlib.sha256(v).hexdigest() for v in (listed, collapsed(words, runs))]
                rows.append((len(found), *best, milli, *shas))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            names = [c.split()[0] for c in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, zip(*rows, strict=True), kinds)], names=names)

    return narrow.mapInArrow(run, DIGESTS)
