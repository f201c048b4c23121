"""Removes every byte that lies in a long string which also starts somewhere else in the corpus.

Strings of LENGTH bytes that are equal have their smallest hash of GRAM bytes in the same place, so a corpus of any size is
dealt out by those anchors, about one in 150 bytes. An anchor's context holds all strings of LENGTH bytes around it. Where a
whole context occurs twice, all of it repeats; this covers the inside of copies and needs digests only.

Where an anchor has several contexts, at the rims of what copies share, the contexts that agree in all but SLACK bytes of a
string meet in one task. There they are laid into a run-length index: a Burrows-Wheeler transform kept as runs, with the text
position at the ends of each run and the length that neighbours of different runs have in common. A position inside a run has
the longest match of the position before it, less one byte; so streaming on from the sampled run ends gives, for each position,
the longest string that starts there and elsewhere (its matching statistic), and stretches of LENGTH or more are marked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import done_with, flat_text, materialise, mix64, text_or_empty, with_row_id
from splitscope.llm.near_dedup import powers

#: Bytes of a string that counts as a repeat, and of the grams whose hashes choose anchors.
LENGTH, GRAM = 400, 100
#: Bytes of a context on either side of its gram.
SIDE = LENGTH - GRAM
#: Contexts meet if they agree in a string of LENGTH - SLACK bytes around their anchor.
SLACK = 60
#: Different pieces that may meet in one index. Larger meetings are settled by digests of every string of LENGTH bytes instead.
MEETING = 2_000
#: Bytes that are hashed, or indexed, at a time.
CHUNK = 1 << 20

U = np.uint64
PIECE = ["rid", "p0", "p1", "meet", "lo", "hi", "part"]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * down[: len(data) - size + 1])


def smallest_places(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest value of each window of ``width`` values stands, the leftmost if several are equal."""
    places = np.arange(len(values), dtype=U)
    keyed = (values >> U(32) << U(32)) | places
    pad = -len(keyed) % width
    blocks = np.concatenate([keyed, np.full(pad, U(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(values) - width + 1
    return (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & U(2**32 - 1)).astype(np.int64)


def _stretches(starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows i to j and the bytes a to b of them to look at together; a long row comes in overlapping stretches."""
    i, rows = 0, len(starts) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK, "right")) - 1)
        a = starts[i]
        while True:
            b = min(starts[j], a + CHUNK)
            yield i, j, int(a), int(b)
            if b == starts[j]:
                break
            a = b - LENGTH + 1
        i = j


def anchors(texts: DataFrame) -> DataFrame:
    """Rows (h, c0, c1, rid, at, lo, hi): gram hash, digest of the context, place of gram and context in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            data, starts = flat_text(batch.column(1))
            done = np.zeros(0, np.int64)
            for i, j, a, b in _stretches(starts):
                if b - a < LENGTH:
                    continue
                part = data[a:b]
                hashes = gram_hashes(part, GRAM)
                least = smallest_places(hashes, SIDE + 1)
                begins = np.arange(a, a + len(least))
                ends = starts[np.searchsorted(starts[i + 1 : j + 1], begins, "right") + i + 1]
                at = np.setdiff1d(least[begins + LENGTH <= ends] + a, done)
                done = at[at >= b - LENGTH]  # the next stretch may choose these once more
                row = np.searchsorted(starts, at, "right") - 1
                row[starts[row + 1] <= at] += 1
                lo, hi = np.maximum(at - SIDE, starts[row]), np.minimum(at + GRAM + SIDE, starts[row + 1])
                raw = data.data
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                own = starts[row]
                columns = [hashes[at - a].view(np.int64), digest[:, 0], digest[:, 1], rid[row], at - own, lo - own, hi - own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if k < 4 else pa.int32()) for k, c in enumerate(columns)],
                    names=["h", "c0", "c1", "rid", "at", "lo", "hi"],
                )

    return texts.mapInArrow(run, "h long, c0 long, c1 long, rid long, at int, lo int, hi int")


def run_length_index(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The run-length Burrows-Wheeler transform of the segments, each with an end mark of its own, as its sampled run ends.

    For each border between runs: the text positions on both sides of it, and how many bytes they have in common."""
    joined = b"\0".join(segments) + b"\0"
    text = np.frombuffer(joined, np.uint8)
    n = len(text)
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # bytes up to the end mark
    # Order by the first bytes, then double the compared length. Suffixes that reached their end mark differ by it.
    step = 7
    key = np.zeros(n, np.int64)
    for k in range(step):
        byte = np.zeros(n, np.int64)
        byte[: max(0, n - k)] = text[k:].astype(np.int64) + 1
        key = key * 257 + np.where(left > k, byte, 0)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (left[order][1:] < step)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + np.where(left >= step, after, 0)
        order = np.argsort(key)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        step *= 2
    before = np.where(np.isin(order - 1, ends) | (order == 0), -1 - np.arange(n), text[order - 1].astype(np.int64))
    border = np.flatnonzero(before[1:] != before[:-1])
    upper, lower = order[border], order[border + 1]
    most = np.minimum(left[upper], left[lower])
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    common, open_ = np.zeros(len(border), np.int64), np.flatnonzero(most > 0)
    while len(open_):
        x, y = wide[upper[open_] + common[open_]], wide[lower[open_] + common[open_]]
        differ = x != y
        more = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        common[open_] += more
        open_ = open_[(more == 8) & (common[open_] < most[open_])]
    return upper, lower, np.minimum(common, most)


def repeated_stretches(segments: list[bytes], length: int) -> np.ndarray:
    """Which bytes of the segments on end, with one mark after each, are covered by a string of ``length`` that recurs.

    Streams the matching statistics: a sampled position's match is known, and up to the next sample each match is one
    byte shorter than the one before. So all of them end where the sample's ends, and the sample's covers them."""
    upper, lower, common = run_length_index(segments)
    cover = np.zeros(sum(len(s) + 1 for s in segments) + 1, np.int64)
    long_ = common >= length
    for side in (upper, lower):
        np.add.at(cover, side[long_], 1)
        np.add.at(cover, side[long_] + common[long_], -1)
    return np.cumsum(cover[:-1]) > 0


def _slices(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (rid, lo, hi, p0, p1, meet, part) for each wanted context: pieces that may meet others, with their bytes.

    A string of LENGTH bytes that starts d before the gram belongs to the piece a <= d < a + SLACK. All strings of a piece hold
    the LENGTH - SLACK bytes whose digest is ``meet``, so equal ones meet there; the piece has what they cover, and
    p0 and p1 are its digest."""
    per_text = wanted.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))).alias("spots"))
    joined = texts.join(per_text.hint("shuffle_hash"), "rid").select("rid", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, spots in zip(*(batch.column(k) for k in range(3)), strict=True):
                data, rows = text.as_buffer().to_pybytes(), set()
                for s in spots.as_py():
                    for x in range(s["at"], s["at"] - SIDE - 1, -SLACK):  # d from 0 to SIDE, both included
                        y = x + LENGTH - SLACK
                        lo, hi = max(s["lo"], x - SLACK + 1), min(s["hi"], x + LENGTH)
                        if x >= s["lo"] and y <= s["hi"] and hi - lo >= LENGTH:
                            rows.add((lo, data[lo:hi], xxhash.xxh3_64_intdigest(data[x:y]) - 2**63))
                if rows:
                    lo, part, meet = zip(*sorted(rows), strict=True)
                    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, part)), "<i8").reshape(-1, 2)
                    hi = [a + len(p) for a, p in zip(lo, part, strict=True)]
                    columns = [[rid.as_py()] * len(rows), digest[:, 0], digest[:, 1], meet]
                    small = [pa.array(c, pa.int32()) for c in (lo, hi)]
                    long_ = [pa.array(c, pa.int64()) for c in columns]
                    yield pa.RecordBatch.from_arrays([*long_, *small, pa.array(part, pa.binary())], names=PIECE)

    return joined.mapInArrow(run, "rid long, p0 long, p1 long, meet long, lo int, hi int, part binary")


def _merge(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Overlapping stretches (rid, lo, bytes) of one text joined, so that no byte of a text stands there twice."""
    out: list[list] = []
    for rid, lo, part in sorted(rows):
        if out and out[-1][0] == rid and lo <= out[-1][1] + len(out[-1][2]):
            extra = lo + len(part) - out[-1][1] - len(out[-1][2])
            if extra > 0:
                out[-1][2] += part[-extra:]
        else:
            out.append([rid, lo, bytearray(part)])
    return [(r, a, bytes(p)) for r, a, p in out]


def _marked(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """The (rid, lo, hi) that repeat among the stretches of one index."""
    merged = _merge(rows)
    cover = repeated_stretches([p for _, _, p in merged], LENGTH)
    base = 0
    for rid, lo, part in merged:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover[base : base + len(part)].astype(np.int8), [0]])))
        for x, y in edge.reshape(-1, 2).tolist():
            yield rid, lo + x, lo + y
        base += len(part) + 1


def _indexed(meetings: DataFrame) -> DataFrame:
    """Spans (rid, lo, hi) that the run-length indexes of the meetings mark; whole meetings, CHUNK bytes to an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def marked() -> pa.RecordBatch:
            found = list(set(_marked(held)))
            columns = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["rid", "lo", "hi"])

        for batch in batches:
            for meet, rid, lo, part in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= CHUNK and meet != last:
                    yield marked()
                    held, size = [], 0
                held.append((rid, lo, part))
                size, last = size + len(part), meet
        if held:
            yield marked()

    dealt = meetings.select("meet", "rid", "lo", "part").repartition(F.col("meet")).sortWithinPartitions("meet")
    return dealt.mapInArrow(run, "rid long, lo int, hi int")


def _by_digest(slices: DataFrame) -> DataFrame:
    """Spans of strings of LENGTH bytes that recur, by the digest of each; for meetings too large for one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, lo, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                starts = np.arange(len(part) - LENGTH + 1)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(part[x : x + LENGTH]) for x in starts), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), rid)), pa.array((lo + starts).astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                    names=["rid", "lo", "d0", "d1"],
                )

    each = slices.select("rid", "lo", "part").distinct().mapInArrow(run, "rid long, lo int, d0 long, d1 long").distinct()
    twice = each.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d0", "d1")
    return each.join(twice, ["d0", "d1"]).select("rid", "lo", (F.col("lo") + LENGTH).alias("hi"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Spans (rid, lo, hi) of the texts (rid, text) that repeat; together they cover exactly the bytes to remove.

    Each step's tables go as soon as the next ones are written; only spans stay."""
    found = materialise(anchors(texts))
    one = [F.first(c).alias(c) for c in ("rid", "at", "lo", "hi")]  # of one row, whichever: its bytes are those of all
    contexts = materialise(found.groupBy("h", "c0", "c1").agg(F.count(F.lit(1)).alias("n"), *one))
    inside = materialise(found.join(contexts.filter("n > 1").select("h", "c0", "c1"), ["h", "c0", "c1"]).select("rid", "lo", "hi"))
    done_with(found)
    several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h")
    rims = contexts.join(several, "h").select("rid", "at", "lo", "hi")
    slices = materialise(_slices(texts, rims))
    done_with(contexts)
    # Pieces that are equal as a whole repeat as a whole; one of them stands for all from here on.
    one = [F.first(c).alias(c) for c in ("rid", "lo")]
    kinds = materialise(slices.groupBy("meet", "p0", "p1").agg(F.count(F.lit(1)).alias("n"), *one))
    equal = materialise(slices.join(kinds.filter("n > 1").select("meet", "p0", "p1"), ["meet", "p0", "p1"]).select("rid", "lo", "hi"))
    meetings = kinds.groupBy("meet").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = kinds.select("meet", "rid", "lo").join(meetings, "meet")
    met = materialise(met.join(slices.select("meet", "rid", "lo", "part"), ["meet", "rid", "lo"]))
    done_with(slices, kinds)
    small, large = met.filter(F.col("m") <= MEETING), met.filter(F.col("m") > MEETING)
    marked = materialise(_indexed(small).union(_by_digest(large)))
    done_with(met)
    return inside.union(equal).union(marked)


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of the text, and how many runs went."""
    kept, runs, end = [], 0, 0
    reach = -1
    for lo, hi in sorted(spans):
        if lo > reach:
            kept.append(text[end:lo])
            runs += 1
        reach = max(reach, hi)
        end = max(end, hi)
    kept.append(text[end:])
    return b"".join(kept), runs


def _per_text(texts: DataFrame, added: str, make) -> DataFrame:
    """Rows (rid, *added); make(bytes, what is left, runs) gives the values."""
    spans = repeated_spans(texts).groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = texts.join(spans.hint("shuffle_hash"), "rid", "left").select("rid", text_or_empty().alias("text"), "spans")
    out = joined.select("rid").schema
    for field in added.split(", "):
        out = out.add(*field.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.encode()
                spans = [(s["lo"], s["hi"]) for s in own.as_py()] if own.is_valid else []
                rows.append(make(raw, *_cut(raw, spans)))
            new = [pa.array([r[k] for r in rows]) for k in range(len(out) - 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=out.names)

    return joined.mapInArrow(run, out)


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    docs, rid = with_row_id(docs, id_col)
    return docs, docs.select(F.col(rid).cast("long").alias("rid"), F.col(text_col).alias("text")), rid


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs), ``kept_sha256`` of the bytes left.

    A byte goes if a string of 400 bytes around it also starts elsewhere in the column, in the same text too. Matches never
    cross texts. Null counts as empty; shorter texts lose nothing. Rows whose id is null or repeated are told apart, so
    repeated rows count as repeats of each other. An empty table gives no rows."""
    docs, texts, rid = _narrow(docs, id_col, text_col)
    make = lambda raw, left, runs: (len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest())
    out = _per_text(texts, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)
    if rid == id_col:
        return out.withColumnRenamed("rid", "doc_id")
    return out.join(docs.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id")), "rid").select("doc_id", *out.columns[1:])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``doc_id``, ``kept``): the bytes of each text that are left. A cut may fall inside a character."""
    docs, texts, rid = _narrow(docs, id_col, text_col)
    out = _per_text(texts, "kept binary", lambda raw, left, runs: (left,))
    return out.join(docs.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id")), "rid").select("doc_id", "kept")
