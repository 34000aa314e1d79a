"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition turns its texts into a run: keys (digest, length) in sorted order, each once, with the
kept id and the count. Runs then travel, packed, through the rounds of a binomial (k-nomial) tree over
``radix ** rounds`` leaves, two rounds at least: in round r the part of a run with a given r-th base-``radix``
digit of the digest moves to the leaf whose r-th digit it is. The runs that meet in a leaf are merged two by two,
as sorted arrays, and equal keys fold into one. A group of copies, however large, is therefore one row per leaf
after the first merge, and one row in all after the last; no leaf ever holds more than its share of digests.

Equality is verified at each merge on the whole SHA-256 digest and the byte length, never on the
part of the digest that chose the leaf.

Defined results: null text counts as empty; empty texts equal each other; a null doc_id is smaller
than any other and is kept only if its text has no other row; repeated rows (same doc_id, same text)
are one document: they count in ``group_size`` and share a verdict; an empty table gives an empty
result. Columns besides doc_id and text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe_text, parts_for, spread_join, stored

#: A packed part of a run: 40-byte keys (digest, big-endian length), kept ids and counts.
RUN = "leaf int, run long, part int, keys binary, keep binary, n binary"
GROUP = "digest binary, n_bytes long, keep_id long, n long"
_KEY = np.dtype("S40")
Run = tuple[np.ndarray, np.ndarray, np.ndarray]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_bytes) of every row."""
    text = null_safe_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def merged(a: Run, b: Run) -> Run:
    """One sorted run of two."""
    at = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
    from_a = np.ones(len(a[0]) + len(b[0]), bool)
    from_a[at] = False
    out = []
    for x, y in zip(a, b, strict=True):
        z = np.empty(len(from_a), x.dtype)
        z[from_a], z[at] = x, y
        out.append(z)
    return tuple(out)


def folded(run: Run, better: np.ufunc) -> Run:
    """Equal neighbours as one: the better id, the sum of the counts."""
    keys, keep, n = run
    if not len(keys):
        return run
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], better.reduceat(keep, first), np.add.reduceat(n, first)


def merge_runs(runs: list[Run], better: np.ufunc) -> Run:
    """Multiway merge, by rounds of merges of two neighbours; equal keys fold at every level."""
    while len(runs) > 1:
        runs = [folded(merged(*runs[i : i + 2]), better) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _parts(run: Run, leaf: int, source: int, turn: int, radix: int, piece: int = 1 << 16) -> Iterator[tuple]:
    """The rows by which a run goes on to the leaves that its keys' digits for this turn name."""
    step = radix**turn
    digit = run[0].view(np.uint8).reshape(-1, 40)[:, 4:8].copy().view(">u4")[:, 0].astype(np.int64) // step % radix
    for d in np.unique(digit).tolist():
        own = np.flatnonzero(digit == d)  # still in order
        to = leaf - (leaf // step % radix) * step + d * step
        for part, at in enumerate(range(0, len(own), piece)):
            yield (to, source, part, *(x[own[at : at + piece]].tobytes() for x in run))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["leaf", "run", "part", "keys", "keep", "n"])


def _started(keep: str, radix: int, leaves: int):
    """The run of an input partition, whose rows come in the order of digest and length."""
    better, none = (np.maximum, np.iinfo(np.int64).min) if keep == "max" else (np.minimum, np.iinfo(np.int64).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source, held = TaskContext.get().partitionId(), []
        for batch in batches:
            if batch.num_rows:
                keys = np.empty((batch.num_rows, 40), np.uint8)
                keys[:, :32] = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 32)
                keys[:, 32:] = batch.column(1).to_numpy(zero_copy_only=False).astype(">u8").view(np.uint8).reshape(-1, 8)
                ids = batch.column(2).fill_null(none).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append(folded((keys.view(_KEY)[:, 0], ids, np.ones(len(ids), np.int64)), better))
        if held:
            whole = folded(tuple(np.concatenate(x) for x in zip(*held, strict=True)), better)
            for row in _parts(whole, source % leaves, source, 0, radix):
                yield _batch([row])

    return run


def _met(keep: str, turn: int, radix: int, rounds: int):
    """Merge the runs that meet in a leaf after ``turn`` exchanges, and send the result on, or out."""
    better, none = (np.maximum, np.iinfo(np.int64).min) if keep == "max" else (np.minimum, np.iinfo(np.int64).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[Run]] = {}
        leaf = None
        for batch in batches:
            for to, source, keys, ids, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                leaf = to
                runs.setdefault(source, []).append((np.frombuffer(keys, _KEY), np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64)))
        if leaf is None:
            return
        whole = merge_runs([tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for _, parts in sorted(runs.items())], better)
        if turn < rounds:
            for row in _parts(whole, leaf, leaf, turn, radix):
                yield _batch([row])
            return
        for at in range(0, len(whole[0]), 1 << 16):
            keys, ids, n = (x[at : at + (1 << 16)] for x in whole)
            raw = keys.view(np.uint8).reshape(-1, 40)
            digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw[:, :32]).tobytes())]).cast(pa.binary())
            size = raw[:, 32:].copy().view(">i8")[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([digest, pa.array(size), pa.array(ids, mask=ids == none), pa.array(n)], names=["digest", "n_bytes", "keep_id", "n"])

    return run


def tree(rows: int, rows_per_leaf: int, radix: int | None = None) -> tuple[int, int]:
    """(radix, rounds): two rounds at least, and more once the radix would exceed 32."""
    parts, rounds = parts_for(rows, rows_per_leaf), 2
    if radix:
        while radix**rounds < parts:
            rounds += 1
        return radix, rounds
    while 32**rounds < parts:
        rounds += 1
    radix = max(4, math.ceil(parts ** (1 / rounds)))
    return (radix, rounds) if radix**rounds >= parts else (radix + 1, rounds)


def groups(found: DataFrame, keep: str = "max", radix: int | None = None, rows_per_leaf: int = 1_000_000) -> DataFrame:
    """(digest, n_bytes, keep_id, n) of every distinct text among ``found`` rows of :func:`digests`."""
    radix, rounds = tree(found.count(), rows_per_leaf, radix)
    leaves = radix**rounds
    runs = found.select("digest", "n_bytes", "doc_id").sortWithinPartitions("digest", "n_bytes").mapInArrow(_started(keep, radix, leaves), RUN)
    for turn in range(1, rounds + 1):
        met = runs.repartitionById(leaves, F.col("leaf")).sortWithinPartitions("run", "part")
        runs = met.mapInArrow(_met(keep, turn, radix, rounds), RUN if turn < rounds else GROUP)
    return runs


def exact_duplicates(docs: DataFrame, keep: str = "max", radix: int | None = None, rows_per_leaf: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept."""
    found = stored(digests(docs), "digests")
    # Only texts with copies need the join; a large group is one row on that side, and dealt into parts on the other.
    copied = groups(found, keep, radix, rows_per_leaf).where("n > 1").select("digest", "n_bytes", F.col("keep_id").alias("group_keep"), "n")
    joined = spread_join(found, stored(copied, "copied"), ["digest", "n_bytes"], "n", "doc_id", found.count(), "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("group_keep"))
    return joined.select("doc_id", "digest", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat both doc_id and text are one document: all of them stay if it does. So do all rows with a
    null doc_id of a text that has no other row.
    """
    marked = exact_duplicates(docs, keep).where("not kept").select("doc_id", "digest").distinct()
    own = docs.withColumn("__digest", F.unhex(F.sha2(null_safe_text(), 256)))
    left = own.alias("a").join(marked.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.__digest") == F.col("b.digest")), "left_anti")
    return left.drop("__digest")
