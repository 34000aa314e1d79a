"""Exact top-k inner products on a bit-sliced index.

The index keeps the quantised components of a block of vectors as bit slices: bitmap (d, b) has one
bit per vector, bit b of component d (two's complement). The scores of a whole block for one query
are sums of slices: every slice is added once for each set bit of the query's component, at the
weight of the two bits, by carry-save adders over whole bitmaps; negative weights are added as
complements. The result is again bit-sliced. The k best rows are selected from the most significant
slice downward, keeping the rows that are surely in and those still tied; rows tied at the boundary
are resolved exactly, by smaller id.

The index is built once and stored, a row per block; the queries are a table of chunks. Every block meets
every chunk in one join, so a task holds one of each, returns the k best per query, and these are merged.

Vectors are compared with those of their own length only. Every row is a query of its own, but rows that repeat
an id and its vector are one; a query skips every row that has its own id.

Defined results: a vector that is null, empty, or that holds a null or non-finite component takes no part; rows
with a null id take no part; repeated ids are rows of their own; with fewer than k candidates all are returned; a
component beyond 64 bits, and a score beyond them, saturates (scores are exact before that, and tie where they
saturate); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stored

RESULT = "query long, query_id long, vec_id long, score long"
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q) with q = floor(scale * x), without the vectors that take no part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


class Slices:
    """Bit slices of one block of vectors."""

    def __init__(self, q: np.ndarray):
        self.n, self.dims = q.shape
        self.words = (self.n + 63) // 64
        low, high = int(q.min(initial=0)), int(q.max(initial=0))
        self.bits = max(1, int(max(high, -low - 1)).bit_length() + 1)  # two's complement: the top bit weighs -2**(bits-1)
        flat = np.zeros((self.dims, self.bits, self.words * 64), np.uint8)
        for b in range(self.bits):
            flat[:, b, : self.n] = ((q >> b) & 1).T
        self.maps = np.packbits(flat, axis=2, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, maps: bytes, n: int, dims: int, bits: int) -> Slices:
        """Slices that were stored."""
        self = cls.__new__(cls)
        self.n, self.dims, self.bits, self.words = n, dims, bits, (n + 63) // 64
        self.maps = np.frombuffer(maps, np.uint64).reshape(dims, bits, self.words)
        return self

    @property
    def live(self) -> np.ndarray:
        return np.packbits(np.r_[np.ones(self.n, np.uint8), np.zeros(self.words * 64 - self.n, np.uint8)], bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of score + offset, offset): all as unsigned, so the order of scores is that of slices."""
        columns: dict[int, list[np.ndarray]] = {}
        offset = 0
        for d, value in enumerate(map(int, query)):
            sign, size = (1, value) if value >= 0 else (-1, -value)
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for b in range(self.bits):
                        if sign * (-1 if b == self.bits - 1 else 1) > 0:
                            columns.setdefault(j + b, []).append(self.maps[d, b])
                        else:  # -w * bit = w * (1 - bit) - w
                            columns.setdefault(j + b, []).append(self.inverted[d, b])
                            offset += 1 << (j + b)
        out, at = [], 0
        while columns:
            column = columns.pop(at, [])
            carries = columns.setdefault(at + 1, []) if column or columns else []
            while len(column) >= 3:  # a full adder turns three slices into one and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.append(x ^ c)
                x &= c
                carries.append(x | (a & b))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                carries.append(a & b)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            if not columns.get(at + 1):
                columns.pop(at + 1, None)
            at += 1
        return out, offset

    @property
    def inverted(self) -> np.ndarray:
        if not hasattr(self, "_inverted"):
            self._inverted = ~self.maps
        return self._inverted

    def select(self, slices: list[np.ndarray], k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows surely among the k highest, rows tied at the boundary)."""
        sure, tied = np.zeros(self.words, np.uint64), allowed
        count = 0
        for s in reversed(slices):
            up = tied & s
            n = int(np.bitwise_count(up).sum())
            if count + n > k:
                tied = up
            else:
                sure, tied, count = sure | up, tied & ~s, count + n
                if count == k:
                    tied = np.zeros(self.words, np.uint64)
                    break
        return _rows(sure), _rows(tied)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return at[w] * 64 + b


def _value(slices: list[np.ndarray], row: int) -> int:
    return sum((int(s[row // 64]) >> (row % 64) & 1) << i for i, s in enumerate(slices))


def block_top(ids: np.ndarray, index: Slices, asked: Iterator[tuple[int, np.ndarray]], k: int) -> Iterator[tuple[int, int, int]]:
    """(place of the query, id, score) of the k best rows of a block for each query (id, vector)."""
    where: dict[int, list[int]] = {}
    for i, x in enumerate(ids.tolist()):
        where.setdefault(x, []).append(i)
    for place, (qid, vector) in enumerate(asked):
        slices, offset = index.scores(vector)
        allowed = index.live
        if qid in where:
            allowed = allowed.copy()
            for row in where[qid]:
                allowed[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        sure, tied = index.select(slices, k, allowed)
        tied = tied[np.argsort(ids[tied], kind="stable")][: k - len(sure)]
        for row in [*sure.tolist(), *tied.tolist()]:
            yield place, int(ids[row]), max(-_MOST - 1, min(_MOST, _value(slices, row) - offset))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), -1)


def sliced(rows: DataFrame, block_rows: int) -> DataFrame:
    """The index: a row per block of vectors of one length (dims), with its ids and its bit slices."""

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.combine_chunks()
        q = Slices(_matrix(tab.column("q").combine_chunks()))
        ids = tab.column("vec_id").to_numpy()
        return pa.table({"dims": pa.array([q.dims], pa.int32()), "bits": pa.array([q.bits], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "maps": pa.array([q.maps.tobytes()], pa.binary())})

    sizes = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.col("blocks")).cast("int"))
    return dealt.select("dims", "block", "vec_id", "q").groupBy("dims", "block").applyInArrow(run, "dims int, bits int, ids binary, maps binary")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = 16_384, query_chunk: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every row whose id is divisible by ``every``."""
    rows = stored(quantised(vectors, scale, id_col, vector_col).withColumn("dims", F.size("q")), "quantised")
    index = stored(sliced(rows, block_rows), "index")
    asked = stored(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "q"]).withColumn("query", F.monotonically_increasing_id()), "asked")
    # Chunks of queries, as many for each length as its queries need; packed, so that each is one row.
    sizes = asked.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / query_chunk).cast("int"))
    sizes = stored(sizes, "chunks")
    packed = asked.join(sizes, "dims").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
    packed = packed.groupBy("dims", "chunk").agg(F.collect_list(F.struct("query", "vec_id", "q")).alias("asked"))
    blocks = index.join(sizes, "dims").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = index.count() * max(1, sizes.agg(F.max("chunks")).first()[0] or 1)
    met = blocks.join(packed, ["dims", "chunk"]).select("dims", "bits", "ids", "maps", "asked").repartition(parts_for(pairs, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims, bits, ids, maps = (batch.column(c)[i].as_py() for c in range(4))
                ids, cell = np.frombuffer(ids, np.int64), batch.column(4)[i].values
                names, queries, q = (cell.field(c) for c in ("query", "vec_id", "q"))
                found = list(block_top(ids, Slices.of(maps, len(ids), dims, bits), zip(queries.to_pylist(), _matrix(q), strict=True), k))
                a = np.array(found, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a[:, 0])), queries.take(pa.array(a[:, 0])), pa.array(a[:, 1]), pa.array(a[:, 2])], names=["query", "query_id", "vec_id", "score"])

    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = met.mapInArrow(run, RESULT).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
