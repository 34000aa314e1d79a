"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in cells (by hash of the id and of what else orders them). How many rows of each cell go to each destination is drawn
from the multivariate hypergeometric law, which is what a uniform random permutation of all rows
would give; then a cell's rows are permuted locally and dealt out by those counts, exchanged, and
permuted again where they arrive. Shard sizes are therefore exact (at most one apart), not expected.

A destination is a piece of a shard with a fixed number of slots, so neither a cell nor a
destination grows with the input. The matrix is never held anywhere: the counts of one cell are
found by walking down a binary tree over the cells, at each node splitting the capacities between
its halves with a generator seeded by the node, so every cell finds its own row of the same matrix.

Every draw follows the hypergeometric law, at any size (:func:`split_counts`). A cell's rows meet its row of the
matrix in one task, where each row's piece is found by binary search.

Law ``rows``: counts at most one apart. Everything is decided by the ids, the row count and the seed;
a rerun, or a recomputed task, gives the same result.

Defined results: null text has no bytes (size 16, CRC of nothing); rows with a null doc_id are dealt
like others, by size and CRC; repeated rows are rows of their own, and interchangeable; with fewer rows
than shards some shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import null_safe_text, parts_for, stored

MOST = 8192
_EXACT = 10**9 - 1  # numpy's generator takes populations up to this


def split_counts(rng: np.random.Generator, capacity: np.ndarray, draw: int) -> np.ndarray:
    """How many of ``draw`` rows, a uniform sample of all, fall into each destination of the given capacities.

    Two ways to draw from one and the same law: numpy's generator where it takes the population, else Bernoulli
    trials corrected to the exact number. There is no approximation in either.
    """
    total = int(capacity.sum())
    if draw <= 0:
        return np.zeros_like(capacity)
    if draw >= total:
        return capacity.copy()
    if total <= _EXACT:
        return rng.multivariate_hypergeometric(capacity, draw, method="marginals")
    if 2 * draw > total:
        return capacity - split_counts(rng, capacity, total - draw)
    if draw <= 64:  # one after the other
        out = np.zeros_like(capacity)
        for _ in range(draw):
            left = np.cumsum(capacity - out)
            out[np.searchsorted(left, rng.integers(left[-1]), side="right")] += 1
        return out
    # Every row is taken by itself with the wanted share. Given how many that gives, they are a uniform sample,
    # so what is over is drawn back out of them, and what is short out of the rest: about sqrt(draw) rows.
    out = rng.binomial(capacity, draw / total)
    over = int(out.sum()) - draw
    return out - split_counts(rng, out, over) if over > 0 else out + split_counts(rng, capacity - out, -over)


def matrix_row(cell: int, rows: np.ndarray, capacity: np.ndarray, seed: int) -> np.ndarray:
    """Counts from one cell to every destination. rows: of every cell."""
    ahead = np.concatenate([[0], np.cumsum(rows)])
    low, high, node = 0, len(rows), 1
    while high - low > 1:
        mid = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, node]), capacity, int(ahead[mid] - ahead[low]))
        if cell < mid:
            high, node, capacity = mid, 2 * node, left
        else:
            low, node, capacity = mid, 2 * node + 1, capacity - left
    return capacity


def destinations(total: int, shards: int, piece_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, capacity) of every piece."""
    of = np.full(shards, total // shards, np.int64)
    of[: total % shards] += 1
    shard, first, size = [], [], []
    for s, n in enumerate(map(int, of)):
        k = parts_for(n, piece_rows)
        cuts = [n * i // k for i in range(k + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            shard.append(s), first.append(a), size.append(b - a)
    return np.array(shard, np.int64), np.array(first, np.int64), np.array(size, np.int64)


def shuffle_into_shards(rows: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = (), shards: int = 40, seed: int = 20, cell_rows: int = 20_000, piece_rows: int = 20_000) -> DataFrame:
    """``rows`` with the columns shard and slot (gapless from 0 in each shard) added.

    The columns go along in one struct, so their names cannot clash with anything in here.
    """
    order = [F.col(f"row.{c}") for c in (key, *ties)]
    total = rows.count()
    # The matrix has cells times pieces entries: beyond MOST of either they grow instead (a sort that can spill).
    cells, piece_rows = min(MOST, parts_for(total, cell_rows)), max(piece_rows, -(-total // MOST))
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    mark = lambda salt: F.xxhash64(F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("")) for c in order])
    packed = packed.withColumn("cell", F.pmod(mark(seed), F.lit(cells)).cast("int"))
    counted = {r["cell"]: r["n"] for r in packed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number per cell
    sizes = np.array([counted.get(i, 0) for i in range(cells)], np.int64)
    shard, first, capacity = destinations(int(sizes.sum()), shards, piece_rows)

    # Permute locally: in the order of a hash; exchange by the cell's counts.
    local = packed.withColumn("mark", mark(seed + 1)).withColumn("tie", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))
    kept = local.select("cell", "mark", "tie", "row").repartition(parts_for(total, 50_000), "cell").sortWithinPartitions("cell", "mark", "tie")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, done, to, upto = None, 0, None, None
        for batch in batches:
            cells_ = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, cells_[1:] != cells_[:-1]]) if len(cells_) else []
            pieces = np.empty(len(cells_), np.int64)
            for at, end in zip(starts, [*starts[1:], len(cells_)], strict=True):
                if cells_[at] != cell:
                    cell, done = int(cells_[at]), 0
                    got = matrix_row(cell, sizes, capacity, seed)
                    to = np.flatnonzero(got)
                    upto = np.cumsum(got[to])
                pieces[at:end] = to[np.searchsorted(upto, np.arange(done, done + end - at), side="right")]
                done += int(end - at)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.array(pieces), pa.array(shard[pieces].astype(np.int32)), pa.array(first[pieces])], names=["row", "tie", "piece", "shard", "first"])

    sent = kept.mapInArrow(deal, StructType([kept.schema["row"], kept.schema["tie"], StructField("piece", LongType()), StructField("shard", IntegerType()), StructField("first", LongType())]))
    # Permute again where they arrive.
    there = Window.partitionBy("piece").orderBy(F.xxhash64(F.lit(seed + 2), "tie"), "tie")
    out = sent.withColumn("slot", F.col("first") + F.row_number().over(there) - 1)
    extra = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in extra], "shard", F.col("slot").cast("long").alias("slot"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32 of every document."""
    text = null_safe_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    placed = shuffle_into_shards(stored(described(docs), "described"), "doc_id", ("size", "text_crc32"), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
