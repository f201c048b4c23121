"""Vectors compressed to codes of their nearest codebook entries, part by part, in whole numbers throughout.

Components become integers; each of 8 parts has a codebook of 16 entries, which rounds of assignment and averaging move. The
nearest entry is found on the integer Walsh-Hadamard transform of zero-padded parts and entries: the squared differences of all
P coefficients add up to P times the squared distance. They are added in order of sequency, where differences of smooth vectors
come first, and an entry is out as soon as its sum exceeds the whole sum of the entry that was ahead after the first few.

A round reads the vectors once and brings the sums of each part and entry together, a table of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Sums travel in pieces of so many bits, so that they may be of any size.
LIMB = 40
#: Rows whose distances are computed at a time.
TILE = 4096


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite numbers; as Python integers where 62 bits do not hold them."""
    x = vectors.astype(np.float64)
    if np.abs(x).max(initial=0.0) < 2.0**50:
        return np.floor(x * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    shape, h = x.shape, 1
    while h < shape[-1]:
        pairs = x.reshape(*shape[:-1], -1, 2, h)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(shape)
        h *= 2
    return x


@lru_cache(maxsize=8)
def by_sequency(size: int) -> np.ndarray:
    """The transform's coefficients by the number of sign changes of their rows."""
    rows = transformed(np.eye(size, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def _largest(x: np.ndarray) -> int:
    return max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the number of its nearest entry, the first one of equals, and their squared distance."""
    n, width = parts.shape
    size = 1 << max(0, width - 1).bit_length()
    exact = 4 * max(_largest(parts), _largest(entries)) ** 2 * size * max(1, width) < 2**62
    kind = np.int64 if exact else object

    def coefficients(x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), size), kind)
        wide[:, :width] = x
        return transformed(wide)[:, by_sequency(size)]

    index, distance = np.zeros(n, np.int64), np.zeros(n, kind)
    known = coefficients(entries)
    cuts = sorted({max(1, size // 4), max(1, size // 2), size})
    for i in range(0, n, TILE):
        rows = coefficients(parts[i : i + TILE])
        gap = lambda r, e, a, b: ((rows[r, a:b] - known[e, a:b]) ** 2).sum(axis=1)  # noqa: B023, E731
        every = np.arange(len(rows))
        sums = ((rows[:, None, : cuts[0]] - known[None, :, : cuts[0]]) ** 2).sum(axis=2)
        ahead = sums.argmin(axis=1)
        bound = sums[every, ahead] + gap(every, ahead, cuts[0], size)
        r, e = np.nonzero(sums <= bound[:, None])
        s = sums[r, e]
        for a, b in zip(cuts, cuts[1:], strict=False):
            s = s + gap(r, e, a, b)
            still = (s <= bound[r]).astype(bool)
            r, e, s = r[still], e[still], s[still]
        best = bound.copy()
        np.minimum.at(best, r, s)
        hit = (s == best[r]).astype(bool)
        r, e = r[hit], e[hit]
        rows_hit, first = np.unique(r, return_index=True)  # entries come in order, so the first one is the lowest
        index[i + rows_hit], distance[i + rows_hit] = e[first], best[rows_hit] // size
    return index, distance


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole(np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim))


def _cut(vectors: np.ndarray) -> np.ndarray:
    """(parts, rows, width): equal consecutive parts; where the dimension is no multiple, zeros follow."""
    width = -(-vectors.shape[1] // PARTS)
    wide = np.zeros((len(vectors), PARTS * width), vectors.dtype)
    wide[:, : vectors.shape[1]] = vectors
    return wide.reshape(len(vectors), PARTS, width).transpose(1, 0, 2)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    k = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value, k = value >> LIMB, k + 1
    yield k, value


Books = list[list[list[int]]]


def _as_array(entries: list[list[int]]) -> np.ndarray:
    big = any(abs(v) >= 1 << 62 for e in entries for v in e)
    return np.array(entries, object if big else np.int64)


def _sums(kept: DataFrame, vector: str, dim: int, books: Books) -> DataFrame:
    """(part, entry, position, limb, value): the sums of the parts that have an entry nearest; their number at position -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_as_array(b) for b in books]
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, rows in enumerate(_cut(_vectors(batch.column(0), dim))):
                index, _ = nearest(rows, known[p])
                safe = rows.dtype != object and _largest(rows) * len(rows) < 2**62
                for e in np.unique(index).tolist():
                    own = rows[index == e]
                    sums = (own if safe else own.astype(object)).sum(axis=0)
                    for at, v in [(-1, len(own)), *enumerate(sums.tolist())]:
                        total[p, e, at] = total.get((p, e, at), 0) + int(v)
        found = [(*k, limb, v) for k, t in total.items() for limb, v in _limbs(t)]
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        names = ["part", "entry", "position", "limb", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    rows = kept.select(vector).mapInArrow(run, "part long, entry long, position long, limb long, value long")
    return rows.groupBy("part", "entry", "position", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def _moved(books: Books, sums: list) -> Books:
    """Each entry replaced by the floored average of its parts; unused ones stay."""
    total: dict[tuple[int, int, int], int] = {}
    for part, entry, position, limb, value in sums:
        key = part, entry, position
        total[key] = total.get(key, 0) + (int(value) << LIMB * limb)
    used = lambda p, e: total.get((p, e, -1), 0)
    return [
        [[total[p, e, i] // used(p, e) for i in range(len(old))] if used(p, e) else old for e, old in enumerate(book)]
        for p, book in enumerate(books)
    ]


def kept_vectors(embeddings: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    x = F.col(vector_col)
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.filter(x.isNotNull() & ~broken & (F.size(x) > 0))


def trained(kept: DataFrame, id_col: str, vector_col: str) -> tuple[int, Books] | None:
    """The dimension and the codebooks; None without vectors. The first entries are the parts of the vectors of the smallest ids
    (then of the smaller vector; null ids last); vectors of another dimension than the first one are left out."""
    order = [F.col(id_col).asc_nulls_last(), F.col(vector_col).asc()]
    first = kept.orderBy(*order).select(F.size(vector_col)).first()
    if first is None:
        return None
    dim = first[0]
    alike = kept.filter(F.size(vector_col) == dim)
    seeds = alike.orderBy(*order).select(vector_col).limit(ENTRIES).collect()
    books = [b.tolist() for b in _cut(whole(np.array([s[0] for s in seeds], np.float64).reshape(-1, dim)))]
    for _ in range(ROUNDS):
        books = _moved(books, _sums(alike, vector_col, dim, books).collect())  # at most parts * entries * width rows
    return dim, books


def digest(dim: int, books: Books) -> str:
    """All entries' components in decimal, joined by commas and hashed; zeros that fill a part up are left out."""
    width = -(-dim // PARTS)
    numbers = [str(v) for p, b in enumerate(books) for e in b for v in e[: max(0, min(width, dim - p * width))]]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def coded(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: ``vec_id``, ``code`` (two hex digits a part), ``error`` (its squared distances), ``label_error`` (errors added
    up over its label) and ``codebooks_sha256``.

    Left out are vectors that are null, empty, of another dimension than that of the smallest id, or hold nulls or numbers that
    are not finite. Rows count each for itself where ids repeat; null labels are one label. Errors beyond 64 bits are null. An
    empty table, or one without such vectors, gives an empty result. Other columns are not looked at."""
    named = {"vec_id": "long", "code": "string", "error": "long"}
    kept = kept_vectors(embeddings, vector_col)
    found = trained(kept, id_col, vector_col)
    label = "of_label"
    kept = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias(label), F.col(vector_col).alias("vector"))
    dim, books = found or (0, [])
    sha = digest(dim, books) if found else ""
    schema = ", ".join(f"{n} {t}" for n, t in named.items()) + f", {label} {kept.schema[label].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_as_array(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, object)
            for p, rows in enumerate(_cut(_vectors(batch.column(2), dim))):
                index, distance = nearest(rows, known[p])
                codes[:, p] = index
                error += distance.astype(object)
            texts = [c.tobytes().hex() for c in codes]
            small = pa.array([v if v < 2**63 else None for v in error.tolist()], pa.int64())
            columns = [batch.column(0), pa.array(texts), small, batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*named, label])

    rows = kept.filter(F.size("vector") == dim).mapInArrow(run, schema)
    total = F.try_sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    sums = rows.groupBy(label).agg(F.when(F.count("error") == F.count(F.lit(1)), total).alias("label_error"))
    sums = sums.withColumnRenamed(label, "known")
    joined = rows.join(sums, F.col(label).eqNullSafe(F.col("known")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
