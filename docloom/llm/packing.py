"""Best-fit packing of documents into training sequences, with vector capacities.

A document's tokens, closed by the end-of-text id, are cut only if they exceed a sequence: into
full pieces, the first taking the remainder. Pieces are vectors (tokens, documents, attention cost =
tokens squared) and go, largest first, each into the open sequence that fits it under every capacity
and is best by the weighted residual norm that is left, or by the weighted dot product of the piece
with what the sequence has left.

The registered query and the pipeline pack sequences of 1024 tokens, 256 documents and an attention cost of
1024 squared. The documents bind where texts are tiny (under four tokens on average), and nowhere else, as the
query is to use as few sequences as it can. The attention cost is that of one full piece, which has to fit;
below it, as the sum of squares never exceeds the square of the sum, the tokens always bind first.

Packing is local to a task, then global: sequences that come out full, or nearly, are final; the pieces of all
others go on, with far fewer tasks, and are packed again, until one small task is left. So nearly all
pieces never move, no task holds more than its share, and in the whole only the last round leaves
sequences part-empty. Sequence ids are derived from round, task and order, so recomputed tasks agree.

Ids are those of the ``byte_bpe_50k`` tokenizer file, none added: where a text spells out one of its added
tokens, that token's id stands there. They are computed from the vocabulary's rank file, with a possessive form
of its split pattern, which gives the same ids several times faster (tests hold the two against each other).

Defined results: null text is empty, and is a piece that holds only the end-of-text id; repeated rows
are packed as documents of their own; an empty table gives an empty result. Columns besides doc_id
and text are not read.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, null_safe_text, stored

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
PACKED = PIECE + ", sequence_id long, offset long"
#: The vocabulary's split pattern, without backtracking.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END_OF_TEXT = 2


@functools.lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """The ids of a text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    own = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
    plain = own._core_bpe.encode_ordinary

    def encode(text: str) -> list[int]:
        return own.encode(text, allowed_special="all") if any(t in text for t in added) else plain(text)

    return encode


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but, perhaps, the first."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "residual") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. capacity: tokens, documents, attention cost of a sequence.

    Largest first; of bins that are equally good, the first one opened.
    """
    order = np.argsort(-lengths, kind="stable")
    full = np.array(capacity, np.float64)
    w = np.array(weights) / full**2
    left = np.empty((16, 3))
    number = np.empty(16, np.int64)
    n_open = n_bins = 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    smallest = float(lengths.min(initial=1))
    floor = np.array([smallest, 1.0, smallest * smallest])
    for i in order.tolist():
        size = float(lengths[i])
        item = np.array([size, 1.0, size * size])
        open_ = left[:n_open]
        fits = np.flatnonzero((open_ >= item).all(1))
        if len(fits):
            if rule == "residual":
                score = ((open_[fits] - item) ** 2) @ w
            else:
                score = -(open_[fits] @ (w * item))
            best = fits[score == score.min()]
            at = int(best[np.argmin(number[best])])
        else:
            if n_open == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            at, n_open = n_open, n_open + 1
            left[at], number[at], n_bins = full, n_bins, n_bins + 1
        bins[i], offsets[i] = number[at], full[0] - left[at, 0]
        left[at] -= item
        if (left[at] < floor).any():  # nothing fits any more
            n_open -= 1
            left[at], number[at] = left[n_open], number[n_open]
    return bins, offsets


def pieces(docs: DataFrame, most: int = 1024, end: int = END_OF_TEXT, with_ids: bool = True) -> DataFrame:
    """The pieces of every document: start, length, CRC-32 of the ids, and the ids (little-endian 32 bit)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text), end], "<u4")
                for p, (s, n) in enumerate(cut(len(ids), most)):
                    raw = ids[s : s + n].tobytes()
                    rows.append((doc, p, s, n, zlib.crc32(raw), raw if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text")).mapInArrow(run, PIECE)


def _pack(capacity: tuple[int, int, int], turn: int, last: bool, rule: str, gather: int, full: float):
    """Pack what a task has, ``gather`` pieces at a time; sequences with room go on (null id) unless last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        base = (turn << 58) | (task << 30)
        held, count, made = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, made
            tab = pa.Table.from_batches(held).combine_chunks()
            held, count = [], 0
            lengths = tab.column("length").to_numpy()
            bins, offsets = best_fit(lengths, capacity, rule=rule)
            used = np.bincount(bins, lengths)
            open_ = (used < capacity[0] * full)[bins] & (not last)
            tab = tab.append_column("sequence_id", pa.array(base + made + bins, mask=open_)).append_column("offset", pa.array(offsets, mask=open_))
            made += len(used)
            yield from tab.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
                if count >= gather:
                    yield from flush()
        if held:
            yield from flush()

    return run


def pack(found: DataFrame, capacity: tuple[int, int, int] = (1024, 256, 1 << 20), rule: str = "residual", gather: int = 20_000, full: float = 0.99) -> DataFrame:
    """:func:`pieces` with sequence_id and offset.

    capacity: tokens, documents and attention cost (sum of squared piece lengths) of a sequence.
    full: a sequence with this share of its tokens is final; the pieces of others go on to the next round.
    Each round's result is stored, so a lost executor costs a re-read.
    """
    turn, parts = 0, found
    done: list[DataFrame] = []
    while True:
        rest = None if turn == 0 else parts.count()
        last = rest is not None and rest <= gather
        if last:
            parts = parts.coalesce(1) if rest else parts
        packed = stored(parts.mapInArrow(_pack(capacity, turn, last, rule, gather, full), PACKED), f"packed{turn}")
        done.append(packed.where("sequence_id is not null"))
        if last:
            break
        left = packed.where("sequence_id is null").select(*[c.split()[0] for c in PIECE.split(", ")])
        n = left.count()
        # Pieces that go on meet others of all sizes, in fewer tasks.
        parts = left.repartition(max(1, -(-n // (gather * 4))), F.xxhash64("doc_id", "piece", F.lit(turn)))
        turn += 1
        if turn > 12:  # what no round can fill any more: final as it is
            done.append(stored(parts.mapInArrow(_pack(capacity, turn, True, rule, gather, full), PACKED), "packed"))
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, most: int = 1024, with_ids: bool = True, capacity: tuple[int, int, int] | None = None, rule: str = "residual") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, most, with_ids=with_ids), capacity or (most, max(1, most // 4), most * most), rule)
