"""Language identification by sparse multinomial logistic regression over TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and runs of one to three characters are hashed to buckets. The
document frequencies come from all learnable rows, the weights from a bounded sample of them, by follow-the-regularised-leader
steps with an L1 and L2 penalty; a temperature fitted on a part of the sample that the steps never saw makes scores
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitscope.llm.common import with_row_id

#: Buckets of n-grams, and the longest n-gram.
BUCKETS, LONGEST = 1 << 14, 3
#: Rows of each language that the weights are fitted on, at most. Counts and frequencies use all rows.
FIT_PER_LANGUAGE = 500
#: Share of the sample that only the temperature sees.
CALIBRATION = 0.2
#: Step size, its smoothing, and the L1 and L2 penalties of the fit, and how often it goes through the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 4
#: A frequency of one in a hundred n-grams counts as 1.
SCALE = 100.0
#: More languages than this are taken for a wrong column.
MOST_LANGUAGES = 500
#: Characters that are hashed at a time.
CHUNK = 1 << 19
UNKNOWN = "und"

U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the text that each belongs to (rising), and which texts have letters."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    letter = _letters()[points]
    lettered = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first stands as a space
    keep[:1] = True
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    keep[first] = True
    points = np.where(letter, points, 32)[keep].astype(U)
    owner = owner[keep]
    buckets, owners, h = [], [], np.zeros(len(points), U)
    for n in range(1, LONGEST + 1):
        size = max(0, len(points) - n + 1)
        h = (h[:size] + points[n - 1 : n - 1 + size] + U(n)) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(32)
        whole = owner[:size] == owner[n - 1 : n - 1 + size]
        buckets.append(((h * U(0xD6E8FEB86659FD93)) >> U(50))[whole].astype(np.int32))
        owners.append(owner[:size][whole])
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order], lettered


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each text and how often it has each bucket."""
    for i, part in _chunks(texts):
        b, o, _ = grams(part)
        at = np.searchsorted(o, np.arange(len(part) + 1))
        for k in range(len(part)):
            yield i + k, np.bincount(b[at[k] : at[k + 1]], minlength=BUCKETS)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """A row (bucket, df) for each bucket that occurs; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, c in counts(batch.column(0).to_pylist()):
                df += c > 0
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], names=["bucket", "df"])

    return texts.mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def _vectors(rows: DataFrame) -> DataFrame:
    """The bucket counts of each sample row (rank, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.flatnonzero(c).astype(np.int32), c) for _, c in counts(batch.column(2).to_pylist())]
            columns = [batch.column(0), batch.column(1), [i.tobytes() for i, _ in found], [c[i].astype(np.int32).tobytes() for i, c in found]]
            yield pa.RecordBatch.from_arrays(
                [*columns[:2], *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["rank", "lang", "at", "n"]
            )

    return rows.mapInArrow(run, "rank long, lang string, at binary, n binary")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and temperature from (buckets, values, language) rows."""
    z, n = np.zeros((BUCKETS, languages)), np.zeros((BUCKETS, languages))
    bias = np.zeros(languages)
    held = max(1, int(len(rows) * CALIBRATION)) if len(rows) > 4 else 0

    def weights(at: np.ndarray) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rng = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for k in held + rng.permutation(len(rows) - held):
            at, x, language = rows[k]
            w = weights(at)
            error = softmax(x @ w + bias)
            error[language] -= 1
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias -= 0.05 / (1 + epoch) * error
    w = weights(np.arange(BUCKETS))
    logits = [(x @ w[at] + bias, language) for at, x, language in rows[:held]]
    grid = np.geomspace(0.2, 20, 60)
    loss = [sum(-np.log(softmax(l / t)[y] + 1e-12) for l, y in logits) for t in grid]
    return w, bias, float(grid[int(np.argmin(loss))]) if held else 1.0


def learnable(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: those whose id, as text, has a CRC-32 that leaves another remainder by 4 than 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model, of a size set by the buckets and the languages; None if nothing can be learned from.

    Learnable are rows with an id, a text and a language whose id passes :func:`learnable`."""
    rows = docs.filter(learnable(id_col) & F.col("lang").isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    languages, total = sorted(sizes), sum(sizes.values())
    freq = np.zeros(BUCKETS)
    for r in document_frequencies(rows.select("text")).collect():
        freq[r["bucket"]] = r["df"]
    idf = np.log((1 + total) / (1 + freq)) + 1
    # A hash under a language's own bound takes twice what is wanted on average; the exact bound follows on that few.
    pairs = [x for name in languages for x in (F.lit(name), F.lit(min(1.0, 2 * FIT_PER_LANGUAGE / sizes[name])))]
    drawn = rows.filter(F.pmod("h", F.lit(1_000_003)) < F.create_map(*pairs)[F.col("lang")] * 1_000_003)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = drawn.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= FIT_PER_LANGUAGE)
    code = {name: k for k, name in enumerate(languages)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = []
        for r in pdf.sort_values(["rank", "lang"]).itertuples():
            at, n = np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32)
            if len(at):
                data.append((at, SCALE * n / n.sum() * idf[at], code[r.lang]))
        w, bias, temperature = fit(data, len(code))
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "bias": [list(bias)], "t": [temperature]})

    model = _vectors(sample.select("rank", "lang", "text")).groupBy().applyInPandas(run, "w binary, bias array<double>, t double").first()
    if model is None:
        return None
    w = np.frombuffer(model["w"], "<f4").reshape(BUCKETS, -1)
    return {
        "languages": languages,
        "weights": (w * idf[:, None] * SCALE).astype(np.float32),
        "bias": np.array(model["bias"]),
        "temperature": model["t"],
    }


def predict(texts: list[str], model: dict | None) -> tuple[list[str], np.ndarray]:
    """The language and its probability for each text; UNKNOWN and 0 without letters or without a model."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, scores
    for i, part in _chunks(texts):
        b, o, lettered = grams(part)
        rows = np.flatnonzero(lettered)
        if not len(rows):
            continue
        at = np.searchsorted(o, np.arange(len(part) + 1))
        sums = np.add.reduceat(model["weights"][b], at[:-1][at[:-1] < at[1:]], axis=0)
        sums = sums[np.searchsorted(np.flatnonzero(at[:-1] < at[1:]), rows)]
        p = softmax((sums / (at[rows + 1] - at[rows])[:, None] + model["bias"]) / model["temperature"])
        best = p.argmax(axis=1)
        scores[i + rows] = p.max(axis=1)
        for r, k in zip(rows, best, strict=True):
            names[i + r] = model["languages"][k]
    return names, scores


def _labelled(docs: DataFrame, model: dict | None, key: str, text_col: str) -> DataFrame:
    """Rows (key, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=[key, "lang_pred", "score"]
            )

    schema = inner.select(key).schema.add("lang_pred", "string").add("score", "double")
    return inner.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Learns from the rows of :func:`train`, predicts every row from its text alone. ``lang_pred`` is ``und`` with score 0 for
    null texts and texts without letters, and for all if no row is learnable. A null id is not held out, and not learned
    from. Repeated rows get equal predictions. More than MOST_LANGUAGES values of ``lang`` raise a ValueError: the column
    holds something else then."""
    model = train(docs, id_col, text_col)
    out = _labelled(docs, model, id_col, text_col)
    held = F.coalesce(~learnable(id_col), F.lit(False)).alias("held_out")
    return out.select(F.col(id_col).alias("doc_id"), held, "lang_pred", "score")


def drop_unknown(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a probability of ``least`` or more, with all their columns.

    Null texts and texts without letters go. Where no row is learnable no language can be told, and every row stays; an empty
    table gives an empty one."""
    model = train(docs, id_col, text_col)
    if model is None:
        return docs
    docs, rid = with_row_id(docs, id_col)
    good = _labelled(docs, model, rid, text_col).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    out = docs.join(good.select(rid), rid, "left_semi")
    return out if rid == id_col else out.drop(rid)
