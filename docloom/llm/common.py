"""Shared pieces: table access, scratch tables, Arrow text access, vectorised word hashes."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one kernel call works on; a longer single text is a call of its own.
CHUNK_BYTES = (1 << 19) - 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared folder named by ``spark.checkpoint.dir``; it is deleted when the driver ends.

    Where the setting is missing, a single-machine session (as in tests) gets a local folder, and a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/docloom-checkpoints"
    path = f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete scratch tables made by :func:`stored` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_docloom_path", None)
        if path:
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """How many parts hold ``rows`` rows at ``per_part`` each."""
    return max(least, math.ceil((rows or 0) / per_part))


def spread_join(rows: DataFrame, facts: DataFrame, key: list[str], size: str, by: str, total: int, how: str = "inner", least: int = 256, most: int = 20_000) -> DataFrame:
    """``rows`` joined to ``facts``, which has one row for each key and, in column ``size``, how many rows have it.

    A key of more than max(least, total / most) of the ``total`` rows is dealt, by a hash of column ``by``,
    into parts of about so many rows, and its fact goes to each; so no key fills a task. There are at most
    total / limit such keys, 20,000 or fewer, and only their list is broadcast.
    """
    limit = max(least, total // most)
    many = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit)).otherwise(1).cast("int")
    hot = facts.where(F.col(size) > limit).select(*key, many.alias("__parts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(F.lit(3), F.col(by)), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    right = facts.withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1)))
    return left.join(right, [*key, "__part"], how).drop("__part")


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], range_rows: int = 100_000) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over all rows before this one in the given order.

    Rows are dealt into ranges of that order, which no task exceeds; only the ranges' totals, a row for each, meet.
    """
    named = {f"__v{i}": c for i, c in enumerate(sums.values())}
    parts = parts_for(rows.count(), range_rows)
    dealt = rows.withColumns(named).repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    totals = dealt.groupBy("__range").agg(*[F.sum(v).alias(v) for v in named])
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"__s{v}") for v in named])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"__l{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in named})
    out = local.join(starts, "__range").withColumns({n: F.col(f"__s{v}") + F.col(f"__l{v}") for n, v in zip(sums, named, strict=True)})
    return out.select(*rows.columns, *sums)


# ---------------------------------------------------------------------------------------------
# Arrow access


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``most`` bytes together, or of one row."""
    data, offs = text_bytes(col)
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


# ---------------------------------------------------------------------------------------------
# Words and Rabin-Karp hashes of word windows

#: The moduli (Mersenne primes) and the bases of the two lanes.
P1, P2 = (1 << 61) - 1, (1 << 31) - 1
BASES = (0x1B873593CC9E2D51 % P1, 0x5BD1E995 % P2)
_SHORT = 15  # a word of at most so many bytes is hashed one to one


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every ``[^\\x20\\x09-\\x0D]+`` word; a word never crosses rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, bool)  # a row starts here
    cut[offs[:-1]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def word_tokens(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two 64-bit halves, start, end, row) of every word, optionally with A-Z folded.

    The 128 bits of a word of up to 15 bytes are its bytes and its length, permuted one to one, so different
    short words always differ; those of a longer word are its BLAKE2b digest.
    """
    if lower:
        data = _LOWER[data]
    s, e, row = word_spans(data, offs)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), s, e, row
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = e - s
    short = np.minimum(size, _SHORT)
    mask = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    low = at[s] & mask[np.minimum(short, 8)]
    high = at[s + 8] & mask[np.maximum(short - 8, 0)] | (short.astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        raw = data.tobytes()
        told = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)]), "<u8").reshape(-1, 2)
        low[long], high[long] = told[:, 0], told[:, 1]
    for key in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):  # each round is one to one
        high = high ^ mix64(low ^ np.uint64(key))
        low = low ^ mix64(high + np.uint64(key))
    return low, high, s, e, row


def _times1(a: np.ndarray, b: int) -> np.ndarray:
    """A number below 2**63.5 that is a * b modulo 2**61 - 1, for a up to a little over 2**61."""
    low, shift = np.uint64((1 << 31) - 1), np.uint64(31)
    b1, b0 = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    a1, a0 = a >> shift, a & low
    mid = a1 * b0
    mid += a0 * b1
    a1 *= b1 << np.uint64(1)
    a0 *= b0
    a0 += a1
    a0 += mid >> np.uint64(30)
    mid &= np.uint64((1 << 30) - 1)
    mid <<= shift
    a0 += mid
    return a0


def _times2(a: np.ndarray, b: int) -> np.ndarray:
    """A number that is a * b modulo 2**31 - 1, for a up to a little over 2**31."""
    return a * np.uint64(b)


def _fold(x: np.ndarray, bits: int) -> np.ndarray:
    """A smaller number that is the same modulo 2**bits - 1."""
    high = x >> np.uint64(bits)
    high += x & np.uint64((1 << bits) - 1)
    return high


def _reduced(x: np.ndarray, bits: int) -> np.ndarray:
    """x modulo 2**bits - 1."""
    x = _fold(_fold(x, bits), bits)
    x[x == np.uint64((1 << bits) - 1)] = 0
    return x


def _windows(t: np.ndarray, width: int, base: int, p: int) -> np.ndarray:
    """Polynomial hash of all windows of ``width`` values, by doubling."""
    times, bits = (_times1, 61) if p == P1 else (_times2, 31)

    def then(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        x = times(a, pow(base, size, p))
        x += b
        return _fold(x, bits) if bits == 61 else _fold(_fold(x, bits), bits)  # back below 2**bits + 8

    out, have, power, size = None, 0, _fold(_fold(t, bits), bits), 1
    while True:
        if width & size:  # what is there, then ``size`` values more
            n = len(t) - have - size + 1
            out = power if out is None else then(out[:n], power[have : have + n], size)
            have += size
        if have == width:
            return _reduced(out, bits)
        power = then(power[:-size], power[size:], size)
        size *= 2


def window_hashes(low: np.ndarray, high: np.ndarray, width: int, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of ``width`` words, modulo 2**61 - 1 and modulo 2**31 - 1.

    Different windows agree in both with a probability of about 2**-92. A window may cross rows: callers take theirs.
    """
    n = len(low) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    one, two = np.empty(n, np.uint64), np.empty(n, np.uint32)
    for at in range(0, n, step):
        end = min(n, at + step)
        one[at:end] = _windows(low[at : end + width - 1], width, BASES[0], P1)
        two[at:end] = _windows(high[at : end + width - 1], width, BASES[1], P2)
    return one, two


def sorted_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by both values, whether each but the first equals the one before it in that order)."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same, also = a[1:] == a[:-1], b[1:] == b[:-1]
    if (same & ~also).any():  # equal in the first only: order by both
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same, also = a[1:] == a[:-1], b[1:] == b[:-1]
    return order, same & also


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end, row) of every word, optionally with A-Z folded."""
    low, _, s, e, row = word_tokens(data, offs, lower)
    return low, s, e, row


def null_safe_text(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches to Python are bounded by bytes too, so long texts cannot fill a worker's memory.

    A setting of the session; one that its user has made stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "67108864b"):  # what it is by default
        spark.conf.set(name, most)
