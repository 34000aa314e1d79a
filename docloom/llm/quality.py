"""Quality classifier: regularised quadratic discriminant analysis on document statistics.

Statistics of the whole text (rates of characters, words, lines and repeats) are transformed to be
roughly normal. Each class has its mean and a covariance shrunk towards the pooled one and towards a
scaled identity; its Cholesky factor is computed once. A document's score is the logistic of the
difference of the classes' log densities, from Mahalanobis distances by forward substitution, plus
the log prior odds.

Fitting takes, from every labelled row, counts, sums and sums of products per class, added up in
Spark; what reaches the driver is one small matrix per class, whatever the input's size.

Inputs of a score are the text alone. Defined results: a null or empty text has the statistics of
an empty text and gets a score; null doc_id or label rows are scored but not learned from; several
labels of one doc_id count as several examples; repeated rows are rows of their own; without two
examples of each class the score is the prior (0.5 without any). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, null_safe_text, stored, word_hashes

STATS = ("words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "other_marks", "non_ascii", "lines", "repeat_next", "distinct", "top_word", "repeat_lines")
_N = len(STATS)
#: Rates are taken as if a text had this many unremarkable words more, so one number in a short text says little.
SMOOTH = 20.0


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars.encode())] = 1
    return out


_CLASSES = [_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("#$%&*@^~+=<>{}[]\\_`"), _class("|"), _class("!?"), _class("."), _class(","), _class(":;'\"()-/")]
_HIGH = np.zeros(256)
_HIGH[0xC0:] = 1  # lead bytes: one for each character outside ASCII


def statistics(col: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    out = [np.zeros((0, _N))]
    for _, _, data, offs in chunks(col):
        rows = len(offs) - 1
        x = np.zeros((rows, _N))
        size = np.diff(offs) + 6.0 * SMOOTH
        full = np.flatnonzero(np.diff(offs) > 0)

        def per_row(weights: np.ndarray, data=data, offs=offs, full=full, rows=rows) -> np.ndarray:
            got = np.zeros(rows)
            if len(full):
                got[full] = np.add.reduceat(weights[data], offs[:-1][full])
            return got

        h, s, e, row = word_hashes(data, offs, lower=True)
        n = np.bincount(row, minlength=rows).astype(float)
        one = n + SMOOTH
        counts = [per_row(c) for c in _CLASSES]
        x[:, 0] = np.log1p(n)
        x[:, 1] = np.log1p(np.bincount(row, e - s, minlength=rows) / one)
        for i, c in enumerate(counts):
            x[:, 2 + i] = np.log1p(100 * c / (size if i in (0, 1) else one))
        x[:, 10] = np.log1p(100 * per_row(_HIGH) / size)
        newline = np.zeros(256)
        newline[10] = 1
        lines = per_row(newline) + 1
        x[:, 11] = np.log1p(n / lines)
        if len(h):
            same = np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])]
            x[:, 12] = np.log1p(100 * np.bincount(row, same, minlength=rows) / one)
            by = np.lexsort((h, row))
            hs, rs = h[by], row[by]
            new = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])])
            runs = np.diff(np.r_[new, len(hs)])
            distinct = np.bincount(rs[new], minlength=rows)
            top = np.zeros(rows)
            np.maximum.at(top, rs[new], runs)
            # Distinct words against what a text of this length usually has (Heaps' law).
            x[:, 13] = np.log1p(distinct) - 0.8 * np.log1p(n)
            x[:, 14] = np.log1p(100 * top / one)
        x[:, 15] = _line_repeats(data, offs, rows)
        out.append(x)
    return np.concatenate(out)


def _line_repeats(data: np.ndarray, offs: np.ndarray, rows: int) -> np.ndarray:
    out, raw = np.zeros(rows), data.tobytes()
    for i in range(rows):
        lines = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if len(x) > 20]
        if len(lines) > 1:
            out[i] = np.log1p(100 * (1 - len(set(lines)) / len(lines)))
    return out


# ---------------------------------------------------------------------------------------------


def forward(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z with factor @ z = y, by forward substitution in the lower triangular factor."""
    z = np.empty_like(y)
    for i in range(len(factor)):
        z[i] = (y[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


class Model(NamedTuple):
    """Means, Cholesky factors of the covariances (lower) and log priors less log determinants of classes 0 and 1."""

    mean: tuple[np.ndarray, np.ndarray]
    factor: tuple[np.ndarray, np.ndarray]
    constant: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, constant in zip(*self, strict=True):
            z = forward(factor, (x - mean).T if len(mean) else np.zeros((0, len(x))))
            density.append(constant - 0.5 * (z**2).sum(0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(n: np.ndarray, total: np.ndarray, products: np.ndarray, to_pooled: float = 0.2, to_identity: float = 0.02) -> Model:
    """The model for classes 0 and 1 from counts (2), sums (2, d) and sums of products (2, d, d)."""
    d = total.shape[1]
    if n.min() < 2:
        odds = float(np.log((n[1] + 1) / (n[0] + 1)))
        return Model((np.zeros(0),) * 2, (np.zeros((0, 0)),) * 2, (0.0, odds))
    mean = total / n[:, None]
    cov = products / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
    pooled = np.einsum("k,kij->ij", n / n.sum(), cov)
    factor, constant = [], []
    for k in (0, 1):
        own = (1 - to_pooled) * cov[k] + to_pooled * pooled
        own = (1 - to_identity) * own + to_identity * max(1e-6, np.trace(own) / d) * np.eye(d)
        low = np.linalg.cholesky((own + own.T) / 2 + 1e-9 * np.eye(d))
        factor.append(low)
        constant.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum()))
    return Model(tuple(mean), tuple(factor), tuple(constant))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that nothing is learned from; none for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every document."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), _N).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def fit(known: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from all labelled rows of (doc_id, x) that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = np.zeros(2), np.zeros((2, _N)), np.zeros((2, _N, _N))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _N)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                total[k] += own.sum(0)
                products[k] += own.T @ own
        flat = np.concatenate([n[:, None], total, products.reshape(2, -1)], axis=1)
        k, i = np.indices(flat.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(flat.ravel())], names=["k", "i", "v"])

    got = marks.join(known, "doc_id").select("y", "x").mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros((2, 1 + _N + _N * _N))
    for r in got:  # as many rows as the matrices have cells
        flat[r["k"], r["i"]] = r["v"]
    return discriminant(flat[:, 0], flat[:, 1 : 1 + _N], flat[:, 1 + _N :].reshape(2, _N, _N))


def scored(known: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, _N))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return known.select("doc_id", "x", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    known = stored(features(docs), "features")
    return scored(known, fit(known, labels), least)


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Fitted on the documents' own statistics; the texts are read once more, never shuffled.
    """
    model = fit(features(docs.where("doc_id is not null").where(~held_out(F.col("doc_id")))), labels)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(statistics(b.column(0).cast(pa.string())))
            kept = b.column(1).filter(pa.array(s >= least))
            yield pa.RecordBatch.from_arrays([kept], names=["row"])

    # All columns travel as one struct, so no name can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    out = docs.select(null_safe_text().alias("text"), row)
    from pyspark.sql.types import StructField, StructType

    kept = out.mapInArrow(run, StructType([StructField("row", schema)]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
