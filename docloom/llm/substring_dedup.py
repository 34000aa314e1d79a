"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

A word is removed if some window covers it whose word sequence also starts earlier (smaller doc_id,
or the same document and an earlier start). Repeated windows merge into maximal removal intervals.

How it is spread. Documents are dealt into blocks by ranges of doc_id of about equal bytes, so block order is
document order; a doc_id of very many rows is cut further, by a hash of the text. Each block sends every distinct
window hash once, as sorted, packed runs, one per hash range. A range task counts in how many blocks each hash
occurs: the earliest start of a hash that occurs in several blocks lies in the first of them, so it answers each
later block with a bitmap over the block's run: which of these hashes are repeats there. A block then marks, in
its own texts, the windows in that answer and those that start earlier within the block. So no location ever
travels, a passage shared by a third of all documents is one hash per block, and what a task holds is bounded by
the sizes of a block and a range.

Windows are equal when their hashes are, modulo 2**61 - 1 and modulo 2**31 - 1: of n windows, some n**2 / 2**93
pairs of different ones may be taken for equal (0.03 pairs among the 2e13 windows of 100 TB).

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined results: null or empty text has no words, nothing
is removed and the kept text is empty; a null doc_id comes before all others; repeated rows of one
doc_id are ordered by a hash of the text, then by text, and of equal ones all but one count as later; an empty
table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, null_safe_text, sorted_pairs, window_hashes, word_tokens

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept_text string"
_TOP = 61  # bits of a hash's first lane


def pack(one: np.ndarray, two: np.ndarray) -> bytes:
    """Sorted distinct hashes: the first lane as differences, all of the width that the largest needs, and the second."""
    gaps = np.diff(one, prepend=np.uint64(0))
    first, rest = int(gaps[0]), gaps[1:]
    width = max(1, (int(rest.max(initial=0)).bit_length() + 7) // 8)
    body = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + first.to_bytes(8, "little") + body.tobytes() + two.astype("<u4").tobytes()


def unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, first = run[0], int.from_bytes(run[1:9], "little")
    n = (len(run) - 9 + width) // (width + 4)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :width] = np.frombuffer(run, np.uint8, (n - 1) * width, 9).reshape(-1, width)
    out = gaps.view("<u8")[:, 0].copy()
    out[0] = first
    return np.cumsum(out, dtype=np.uint64), np.frombuffer(run, "<u4", n, 9 + (n - 1) * width)


class Block:
    """The texts of one block in document order, their words and window hashes."""

    def __init__(self, tab: pa.Table, width: int):
        order = pc.sort_indices(tab, sort_keys=[("doc_id", "ascending"), ("mark", "ascending"), ("text", "ascending")], null_placement="at_start")
        tab = tab.select(["doc_id", "text"]).take(order).combine_chunks()
        self.ids = tab.column("doc_id").combine_chunks()
        text = tab.column("text").combine_chunks()
        self.parts, low, high, rows = [], [], [], []
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
        for at, _, data, offs in chunks(text):
            a, b, s, e, row = word_tokens(data, offs)
            low.append(a), high.append(b), rows.append(row + at)
            self.parts.append((at, data, offs, s, e, row))
        gathered = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.row = gathered(rows, np.int64)
        self.count = n = len(self.row)
        one, two = window_hashes(gathered(low, np.uint64), gathered(high, np.uint64), width)
        n = len(one)
        inside = np.flatnonzero(self.row[:n] == self.row[width - 1 : width - 1 + n])  # windows within one document
        one, two = one[inside], two[inside]
        order, same = sorted_pairs(one, two)  # of equal windows, the earlier first
        self.starts, new = inside[order], np.r_[True, ~same] if len(order) else np.zeros(0, bool)
        #: Of every start in the order of hashes: whether its window came before in the block, and the number of its hash.
        self.again, self.number = ~new, np.cumsum(new) - 1
        self.one, self.two = one[order[new]], two[order[new]]

    def ranges(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(range, first hash) of the ranges that the block's hashes fall into."""
        top = (self.one >> np.uint64(_TOP - bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(top) else np.zeros(0, np.int64)
        return top[first], first


def _runs(width: int, range_bits: int):
    def run(tab: pa.Table) -> pa.Table:
        number, block = tab.column("block")[0].as_py(), Block(tab, width)
        part, first = block.ranges(range_bits)
        ends = [*first[1:].tolist(), len(block.one)]
        pieces = [pack(block.one[a:b], block.two[a:b]) for a, b in zip(first.tolist(), ends, strict=False)]
        return pa.table({"block": pa.array([number] * len(pieces), pa.int32()), "part": pa.array(part, pa.int64()), "run": pa.array(pieces, pa.binary())})

    return run


def _answers(tab: pa.Table) -> pa.Table:
    """For each block, which hashes of its run of this range an earlier block has too; no row for none."""
    blocks = tab.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    cells = tab.column("run").to_pylist()
    runs = [unpack(cells[i]) for i in order]
    ends = np.cumsum([len(r[0]) for r in runs])
    by, same = sorted_pairs(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))  # of equal hashes, the earlier block first
    known = np.zeros(len(by), bool)
    known[by[1:][same]] = True
    told = [(int(blocks[i]), np.packbits(known[end - len(r[0]) : end]).tobytes()) for i, r, end in zip(order, runs, ends, strict=True) if known[end - len(r[0]) : end].any()]
    return pa.table({"block": pa.array([b for b, _ in told], pa.int32()), "part": pa.array([tab.column("part")[0].as_py()] * len(told), pa.int64()), "known": pa.array([x for _, x in told], pa.binary())})


def _marked(width: int, range_bits: int, texts: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs, width)
        known = np.zeros(len(block.one), bool)
        part, first = block.ranges(range_bits)
        ends = np.r_[first[1:], len(block.one)]
        for p, cell in zip(answers.column("part").to_pylist(), answers.column("known").to_pylist(), strict=True):
            i = int(np.searchsorted(part, p))
            known[first[i] : ends[i]] = np.unpackbits(np.frombuffer(cell, np.uint8), count=int(ends[i] - first[i]))
        repeat = block.again | known[block.number]
        s = block.starts[repeat]
        cover = np.zeros(block.count + 1, np.int32)  # windows end inside their document, so intervals do too
        cover[s] += 1  # starts are distinct
        cover[s + width] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        rows = len(block.ids)
        first = np.searchsorted(block.row, np.arange(rows + 1))
        upto = np.concatenate([[0], np.cumsum(gone)])
        n_words, n_removed = np.diff(first), upto[first[1:]] - upto[first[:-1]]
        # Maximal intervals of removed words; a new document starts a new one.
        edge = gone.copy()
        edge[1:] &= ~gone[:-1] | (block.row[1:] != block.row[:-1])
        tail = gone.copy()
        tail[:-1] &= ~gone[1:] | (block.row[1:] != block.row[:-1])
        begin, end = np.flatnonzero(edge), np.flatnonzero(tail) + 1
        lists = np.searchsorted(begin, first)
        base = first[block.row[begin]] if len(begin) else begin
        spans = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"]))
        sums, kept = [], []
        done = 0
        for at, data, offs, ws, we, row in block.parts:
            raw = data.tobytes()
            stay = ~gone[done : done + len(ws)]
            done += len(ws)
            bounds = np.searchsorted(row, np.arange(len(offs)))
            a, b, ok = ws.tolist(), we.tolist(), stay.tolist()
            for i in range(len(offs) - 1):
                x, y = int(bounds[i]), int(bounds[i + 1])
                if n_removed[at + i]:
                    joined = b" ".join([raw[a[j] : b[j]] for j in range(x, y) if ok[j]])
                else:
                    joined = b" ".join(raw[int(offs[i]) : int(offs[i + 1])].split())
                sums.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    kept.append(joined.decode())
        return pa.table({"doc_id": block.ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sums, pa.string()), "removed": spans, "kept_text": pa.array(kept if texts else [None] * rows, pa.string())})

    return run


def cuts_by_bytes(rows: DataFrame, blocks: int, unit: int = 4096) -> np.ndarray:
    """Sorted ids that cut the rows (id, n_bytes) into blocks of about equal bytes; an id of many blocks stands there often."""
    if blocks < 2:
        return np.zeros(0, np.int64)
    weighed = rows.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_bytes") / unit).cast("int"))))
    cuts = weighed.approxQuantile("id", [i / blocks for i in range(1, blocks)], 1 / (8 * blocks))
    return np.array(sorted(int(c) for c in cuts), np.int64)


def block_of(cuts: np.ndarray):
    """The block of (id, hash of the text): by the cuts, and by the hash where several cuts are one id."""

    def run(ids: pa.Array, marks: pa.Array) -> pa.Array:
        x, m = (c.to_numpy(zero_copy_only=False) for c in (ids, marks))
        low, high = np.searchsorted(cuts, x, "left"), np.searchsorted(cuts, x, "right")
        share = ((m.astype(np.float64) + 2.0**63) / 2.0**64).clip(0, 1 - 1e-12)
        return pa.array((low + np.floor(share * (high - low + 1))).astype(np.int32))

    run.__annotations__ = {"ids": pa.Array, "marks": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")


def remove_repeats(docs: DataFrame, width: int = 20, texts: bool = True, block_bytes: int | None = None, range_windows: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word intervals), kept_text of every row.

    block_bytes: text of a block; by default 8 MB, growing with the root of the input to 128 MB, so that runs, of
    which there are as many as blocks times ranges, stay long. range_windows: windows of a hash range, about.
    """
    bound_batches(docs.sparkSession)
    text = null_safe_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    sized = rows.select(id_.alias("id"), F.octet_length("text").alias("n_bytes"))
    total = sized.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    size = block_bytes or min(max(8 << 20, 16 * math.isqrt(total)), 128 << 20)
    cuts = cuts_by_bytes(sized, -(-total // size))
    # A hash deals blocks to partitions: with twice as many of these, few have more than three.
    dealt = rows.withColumn("block", block_of(cuts)(id_, F.col("mark"))).repartition(min(2 * (len(cuts) + 1), 50_000), "block")
    # About six bytes a word.
    bits = max(0, math.ceil(math.log2(max(1, total / 6 / range_windows))))
    runs = dealt.groupBy("block").applyInArrow(_runs(width, bits), "block int, part long, run binary")
    answers = runs.repartition(min(2 << bits, 50_000), "part").groupBy("part").applyInArrow(_answers, "block int, part long, known binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_marked(width, bits, texts), RESULT)
