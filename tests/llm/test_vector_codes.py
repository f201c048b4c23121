"""Vector codes against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from splitscope.llm import vector_codes as vc

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()),
    T.StructField("code", T.StringType()), T.StructField("of_label", T.StringType()),
])


def plain(rows, rounds=vc.ROUNDS):
    kept = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    dim = len(kept[0][1])
    width = -(-dim // 8)
    floor = lambda v: math.floor(v * 4096) if abs(v) < 2**53 else int(v) * 4096
    parts = [[[floor(v) for v in r[1][p * width : (p + 1) * width]] for p in range(8)] for r in kept]
    books = [[list(x[p]) for x in parts[:16]] for p in range(8)]
    def best(x, book):  # noqa: E306
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):  # noqa: E305
        for p in range(8):
            nearest = [best(x[p], books[p])[1] for x in parts]
            for e in range(len(books[p])):
                own = [x[p] for x, i in zip(parts, nearest, strict=True) if i == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    told = [[best(x[p], books[p]) for p in range(8)] for x in parts]
    errors = [sum(d for d, _ in t) for t in told]
    label = {}
    for r, e in zip(kept, errors, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    small = lambda v: v if v < 2**63 else None
    of_label = {k: small(v) if all(e < 2**63 for r, e in zip(kept, errors, strict=True) if r[2] == k) else None for k, v in label.items()}
    return [
        (r[0], "".join(f"{i:02x}" for _, i in t), small(e), of_label[r[2]], sha) for r, t, e in zip(kept, told, errors, strict=True)
    ]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)


def check(spark, rows):
    got = sorted(map(tuple, vc.coded(table(spark, rows)).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)
    return got


@pytest.mark.parametrize("dim", [64, 24, 40, 13, 3])
def test_codes_are_those_of_plain_arithmetic(spark, dim):
    rnd = random.Random(dim)
    vector = lambda: [rnd.gauss(0, 0.2) if rnd.random() < 0.7 else rnd.choice([0.0, -0.25, 0.5]) for _ in range(dim)]
    rows = [(i, vector(), rnd.choice([None, 1, 2])) for i in rnd.sample(range(1000), 120)]
    rows += [(rows[0][0], rows[0][1], 7), (2000, rows[1][1], None), (None, vector(), 3)]
    check(spark, rows)


def test_broken_few_and_equal_vectors(spark):
    good = [0.5] * 16
    broken = [None, [], [float("nan")] + good[1:], [float("inf")] + good[1:], [None] + good[1:], good + [1.0]]
    rows = [(i, v, 1) for i, v in enumerate(broken, 1)] + [(0, good, 1), (20, good, None), (21, [-x for x in good], None)]
    assert len(check(spark, rows)) == 3
    assert vc.coded(table(spark, [(1, None, None)])).count() == 0
    assert vc.coded(table(spark, rows).filter("vec_id > 100")).count() == 0


def test_numbers_beyond_64_bits(spark):
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([1e30, -3e25, 0.1, 2.0**60, 1e-300]) for _ in range(16)], 1) for i in range(40)]
    rows += [(100 + i, [rnd.random() for _ in range(16)], 2) for i in range(10)]
    check(spark, rows)


def test_transform_keeps_scaled_distances_and_orders_sign_changes():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-1000, 1000, (2, 50, 16))
    scaled = ((vc.transformed(x) - vc.transformed(y)) ** 2).sum(axis=1)
    assert (scaled == 16 * ((x - y) ** 2).sum(axis=1)).all()
    rows = vc.transformed(np.eye(16, dtype=np.int64))[:, vc.by_sequency(16)]
    assert [(r[1:] != r[:-1]).sum() for r in rows.T] == list(range(16))


def test_ties_go_to_the_lower_entry():
    entries = np.array([[5, 0], [0, 0], [0, 0], [2, 0]])
    index, distance = vc.nearest(np.array([[1, 0], [0, 0], [9, 9]]), entries)
    assert index.tolist() == [1, 1, 0] and distance.tolist() == [1, 0, 97]
