"""Near-duplicate detection with HyperMinHash.

A document's set is its distinct k-word shingles. One hash deals the set into buckets; a bucket's register
keeps its smallest hash in 16 bits: the leading-zero count and the next ten bits (the mantissa). A bucket
that a short text leaves empty takes the register of the first filled one in an order of its own. Bands of
compressed registers give candidate pairs; the Jaccard estimate of a candidate is the share of equal
registers, corrected for registers that are equal by chance; candidates that may reach the threshold are
verified on their full sets, and only verified links count.

With ``bands`` = 32 and ``rows`` = 4, a pair at exactly 0.8 shares no band with a probability of about
(1 - 0.8**4)**32 = 5e-8, and somewhat more for texts of few shingles, whose registers repeat (the README
has measured figures). Groups are never expanded into all their pairs:

1. Documents with one and the same set are one class (by a 128-bit BLAKE2b digest of the sorted set); a
   class has one row from here on, so a group of thousands of copies costs nothing.
2. In each band bucket, every class is compared with the bucket's hub only, at first its smallest class. The
   texts of a hub's partners stream past the hub's set, in parts of bounded size. Verified links give
   components.
3. A bucket whose classes are all in one component is settled. While many pairs are open and links are still
   found, the smallest class of another component becomes the hub of each bucket that is not.
4. In what is left, classes of different components are compared block against block, blocks bounded by
   rows and by bytes, each pair in the first band it shares. Verification is part of that step, and it returns
   only links that join components, so at most one for each member of two blocks, however many pairs pass.

No partner is capped or dropped. Shingles are compared by 92 bits of Rabin-Karp hashes (modulo 2**61 - 1 and
2**31 - 1): among n and m shingles of a pair, some n * m / 2**92 different ones may be taken for equal.

Documents without words link with nothing. Fewer words than k: the whole sequence is the one shingle.

Defined results: null text is empty; a row with a null doc_id has its set size, links with nothing, as
no id can name its component (null), and is kept; rows with one and the same id are one document, which
is linked by any of their texts, and share its verdict (n_shingles is each row's own); an empty table
gives an empty result.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, drop_stored, null_safe_text, sorted_pairs, spread_join, stored, window_hashes, word_tokens

MANTISSA = 10
#: Expected share of equal registers of disjoint sets of equal size, times 2**MANTISSA.
COLLISION = 0.169919487159739
SKETCH = "doc_id long, text_hash long, n_shingles long, set_key binary, sketch binary"
#: A set: its distinct shingles' hashes in two lanes, sorted.
Set = tuple[np.ndarray, np.ndarray]


def _distinct(one: np.ndarray, two: np.ndarray) -> Set:
    order, same = sorted_pairs(one, two)
    if len(order):
        order = order[np.r_[True, ~same]]
    return one[order], two[order]


def shingle_sets(col: pa.Array, k: int) -> Iterator[Set]:
    """The sorted distinct shingle hashes of every row; A-Z is folded."""
    for _, _, data, offs in chunks(col):
        low, high, _, _, row = word_tokens(data, offs, lower=True)
        first = np.searchsorted(row, np.arange(len(offs)))
        one, two = window_hashes(low, high, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a < k:
                yield window_hashes(low[a:b], high[a:b], max(1, b - a))
            else:
                yield _distinct(one[a : b - k + 1], two[a : b - k + 1])


def common(x: Set, y: Set) -> int:
    """The size of the intersection of two sets."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if (y[0][1:] == y[0][:-1]).any():  # equal in the first lane only: count by both
        return int(sorted_pairs(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]))[1].sum())
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    return int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())


def probes(registers: int) -> np.ndarray:
    """For each bucket, itself and then all others in an order of its own."""
    out = np.empty((registers, registers), np.int64)
    for i in range(registers):
        rest = np.delete(np.arange(registers), i)
        out[i] = np.r_[i, np.random.default_rng([11, i]).permutation(rest)]
    return out


def sketch(one: np.ndarray, order: np.ndarray) -> np.ndarray:
    """16-bit registers of a sorted set: leading zeros of a bucket's smallest hash, then its mantissa bits.

    order: :func:`probes` of a number of registers that is a power of two.
    """
    bits = len(order).bit_length() - 1
    edge = np.arange(len(order), dtype=np.uint64) << np.uint64(61 - bits)
    at = np.searchsorted(one, edge)
    low = one[np.minimum(at, len(one) - 1)]
    filled = (at < len(one)) & ((low >> np.uint64(61 - bits)) == np.arange(len(order), dtype=np.uint64))
    x = low << np.uint64(3 + bits)  # what follows the bucket's number, from the top bit on
    zeros = np.zeros(len(x), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        none = x < np.uint64(1 << (64 - step))
        zeros[none] += np.uint64(step)
        x[none] <<= np.uint64(step)
    zeros = np.minimum(zeros, np.uint64(63))
    value = (zeros << np.uint64(MANTISSA)) | ((x << np.uint64(1)) >> np.uint64(64 - MANTISSA))
    source = order[np.arange(len(order)), filled[order].argmax(1)]
    return value[source].astype("<u2")


def estimated(equal: np.ndarray, registers: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate."""
    chance = COLLISION * 2.0**-MANTISSA * 4 * n * m / np.maximum(1, n + m) ** 2 * registers
    return np.maximum(0.0, (equal - chance) / (registers - chance))


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text); the first two tell the texts of rows with one and the same id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def sketches(docs: DataFrame, k: int, registers: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = probes(registers)
        for batch in batches:
            n, keys, out = [], [], []
            for one, two in shingle_sets(batch.column(2), k):
                n.append(len(one))
                keys.append(blake2b(one.tobytes() + two.tobytes(), digest_size=16).digest())
                out.append(sketch(one, order).tobytes() if len(one) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_key", "sketch"])

    return _hashed(docs).mapInArrow(run, SKETCH)


# ---------------------------------------------------------------------------------------------
# Components


def _reduced(links: DataFrame) -> DataFrame:
    """(id, comp) of every node of the links (a, b) but the smallest of its component, which is comp.

    Alternating large-star and small-star steps; each step is two shuffles of the remaining links,
    and a hub's neighbours are only ever reduced to their minimum.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        both = e.join(low, "u")
        if large:
            out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        large = stored(star(edges, True), "large")
        new = stored(star(large, False), "small")
        after = mark(new)
        drop_stored(edges, large)
        edges = new
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) of every node, comp the smallest id reachable. links: a, b."""
    return nodes.select("id").join(_reduced(links), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after links (a, b) between components."""
    new = _reduced(links).select(F.col("id").alias("comp"), F.col("comp").alias("__to"))
    return stored(comp.join(new, "comp", "left").select("id", F.coalesce("__to", "comp").alias("comp")), "components")


# ---------------------------------------------------------------------------------------------
# Verification


def _close(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _registers(cells: list[bytes], registers: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<u2").reshape(len(cells), registers)


def with_hubs(pairs: DataFrame, payload: DataFrame, k: int, percent: int, least: float, part: int = 128) -> DataFrame:
    """The pairs (a, b) that are linked. pairs: a, hub b, members of the bucket; payload: id, n_shingles, sketch, text.

    A hub's set is made once for some ``part`` partners, whose texts stream past it.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64(F.lit(5), "a"), F.ceil(F.col("members") / part)).cast("int").alias("part"))
    facts = ("id", "n_shingles", "sketch", "text")
    left = dealt.withColumnRenamed("a", "id").join(payload, "id").select("b", "part", F.lit(1).alias("partner"), *facts)
    hubs = dealt.select(F.col("b").alias("id"), "part").distinct().join(payload, "id").select(F.col("id").alias("b"), "part", F.lit(0).alias("partner"), *facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: dict = {}
        for batch in batches:
            b, part_no, partner, ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cells, text = batch.column(5).to_pylist(), batch.column(6)
            found = []
            starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (part_no[1:] != part_no[:-1])]) if len(b) else []
            for at, end in zip(starts, [*starts[1:], len(b)], strict=True):
                at, end = int(at), int(end)
                if partner[at] == 0:
                    hub = {"id": ids[at], "n": float(n[at]), "sketch": np.frombuffer(cells[at], "<u2"), "text": text.slice(at, 1), "set": None}
                    at += 1
                if at == end:
                    continue
                width = len(hub["sketch"])
                equal = (_registers(cells[at:end], width) == hub["sketch"]).sum(1)
                likely = np.flatnonzero(estimated(equal, width, n[at:end].astype(float), hub["n"]) >= least) + at
                if not len(likely):
                    continue
                if hub["set"] is None:
                    hub["set"] = next(iter(shingle_sets(hub["text"], k)))
                for i, s in zip(likely, shingle_sets(text.take(pa.array(likely)), k), strict=True):
                    both = common(s, hub["set"])
                    if 100 * both >= percent * (len(s[0]) + len(hub["set"][0]) - both):
                        found.append((ids[i], hub["id"]))
            links = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    both = left.unionByName(hubs).repartition("b", "part").sortWithinPartitions("b", "part", "partner")
    return both.mapInArrow(run, "a long, b long")


def intersections(x: list[Set], y: list[Set], step: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, as products of their incidence matrices."""
    sets = [*x, *y]
    size = [len(s[0]) for s in sets]
    one, two = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order, same = sorted_pairs(one, two)
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    owner = owner[order]
    # Only shingles that stand on both sides count.
    width = int(group[-1]) + 1 if len(group) else 0
    on = [np.bincount(group[owner < len(x)], minlength=width) > 0, np.bincount(group[owner >= len(x)], minlength=width) > 0]
    shared = on[0] & on[1]
    place = np.cumsum(shared) - 1
    stay = shared[group]
    group, owner = place[group[stay]], owner[stay]
    out = np.zeros((len(x), len(y)))
    for at in range(0, int(shared.sum()), step):
        here = slice(*np.searchsorted(group, [at, at + step]))
        cells = np.zeros((len(sets), step), np.float32)
        cells[owner[here], group[here] - at] = 1
        out += cells[: len(x)] @ cells[len(x) :].T
    return out.astype(np.int64)


def joining(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a matrix of truth) between things of components a and b, pairs of components enough to join what they join."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root, out = flat[: len(a)], flat[len(a) :], np.arange(len(names)), []
    for i in np.flatnonzero(links.any(1)):
        own = root[u[i]]
        for j in np.flatnonzero(links[i]):
            other = root[v[j]]
            if other != own:
                out.append((int(names[u[i]]), int(names[v[j]])))
                root[root == other] = own
    return out


def _across(entries: DataFrame, bands: int, width: int, k: int, percent: int, least: float, block: int, block_bytes: int = 4 << 20) -> DataFrame:
    """Pairs (a, b) of components that verified links join, from comparing buckets' members block against block.

    entries: bucket, band, id, comp, n_shingles, sketch, text. Links that join what others of the two blocks join
    already are not returned, so the result grows with the members, not with their pairs.
    """
    registers = bands * width
    sizes = entries.groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.octet_length("text")) / block_bytes)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"))
    total = entries.count()
    dealt = spread_join(entries, stored(sizes, "sizes"), ["bucket"], "members", "id", total)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("blocks")).cast("int")).repartition("bucket", "block")
    # A bucket is of one band.
    packed = dealt.groupBy("bucket", "block", "blocks").agg(F.first("band").alias("band"), F.sort_array(F.collect_list(F.struct("id", "comp", "n_shingles", "sketch", "text"))).alias("rows"))
    left = packed.select("bucket", "band", F.col("block").alias("i"), F.col("rows").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = packed.select("bucket", F.col("block").alias("j"), F.col("rows").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(cell) -> tuple:
            s = cell.values
            return (*(s.field(c).to_numpy(zero_copy_only=False) for c in ("comp", "n_shingles")), _registers(s.field("sketch").to_pylist(), registers), s.field("text"))

        for batch in batches:
            found: list[tuple[int, int]] = []
            for band, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                (ca, na, sa, ta), (cb, nb, sb, tb) = unpack(x), unpack(y)
                maybe = (ca[:, None] != cb[None, :]) & (np.minimum.outer(na, nb) * 100 >= np.maximum.outer(na, nb) * percent)
                p, q = np.nonzero(maybe)
                for at in range(0, len(p), 4096):
                    u, v = p[at : at + 4096], q[at : at + 4096]
                    equal = sa[u] == sb[v]
                    first = equal.reshape(len(u), bands, width).all(2).argmax(1) == band  # the pair is compared in the first band that it shares
                    good = estimated(equal.sum(1), registers, na[u].astype(float), nb[v].astype(float)) >= least
                    maybe[u, v] = first & good
                rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
                if not len(rows):
                    continue
                xs, ys = (list(shingle_sets(t.take(pa.array(at)), k)) for t, at in ((ta, rows), (tb, cols)))
                both, n, m = intersections(xs, ys), na[rows][:, None], nb[cols][None, :]
                linked = maybe[np.ix_(rows, cols)] & (both > 0) & (100 * both >= percent * (n + m - both))
                found += joining(linked, ca[rows], cb[cols])
            got = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return left.join(right, ["bucket", "j"]).select("band", "x", "y").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, slack: float = 0.2, block: int = 256, rounds: int = 8, open_share: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    bands * rows, the registers, must be a power of two. slack: a candidate is verified unless its estimate is
    below the threshold by more than this; with 128 registers that is over five standard deviations.
    rounds, open_share: hubs are tried again, at most so often, while there are more open pairs than so many for
    each band entry and the last hubs found links. This decides how fast the result is found, not what it is.
    """
    bound_batches(docs.sparkSession)
    registers, least = bands * rows, percent / 100 - slack
    every = stored(sketches(docs, k, registers), "sketches")
    seen = every.where("doc_id is not null")
    # 1. One row per distinct set, with an id of its own: several sets may have the same smallest doc_id.
    sets = seen.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    classes = stored(sets.select(F.monotonically_increasing_id().alias("id"), "set_key", "n_shingles", "copies", "of.doc_id", "of.text_hash", "sketch"), "classes")
    # 2. Band buckets; each class with the smallest of its bucket.
    values = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * rows * i + 1, 2 * rows)) for i in range(bands)])
    entries = classes.select("id", "n_shingles", F.posexplode(values).alias("band", "bucket"))
    n_entries = classes.count() * bands
    hub = F.min(F.struct("id", "n_shingles")).alias("hub")
    shared = stored(entries.groupBy("bucket").agg(hub, F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    members = stored(spread_join(entries, shared, ["bucket"], "members", "id", n_entries).select("bucket", "band", "id", "n_shingles", "hub", "members"), "members")
    close = _close(F.col("n_shingles"), F.col("hub.n_shingles"), percent)
    apart = F.col("id") != F.col("hub.id")
    # Texts that any verification can need: those of classes in a shared bucket.
    wanted = classes.select("id", "doc_id", "text_hash", "n_shingles", "sketch").join(members.select("id").distinct(), "id", "left_semi")
    payload = stored(_hashed(docs).join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "n_shingles", "sketch", "text"), "payload")

    def star(of: DataFrame) -> DataFrame:
        """Verified links of the members with their bucket's hub."""
        tried = stored(of.where(apart & close).groupBy(F.col("id").alias("a"), F.col("hub.id").alias("b")).agg(F.max("members").alias("members")), "tried")
        return stored(with_hubs(tried, payload, k, percent, least), "links")

    links = star(members)
    # Rows of one doc_id with different sets are one document, so their classes are linked.
    many = stored(seen.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id"), "many")
    several = many.limit(1).count() > 0
    if several:
        own = stored(seen.select("doc_id", "set_key").join(many, "doc_id").join(classes.select("id", "set_key"), "set_key").select("doc_id", "id").distinct(), "own")
        first = stored(own.groupBy("doc_id").agg(F.min("id").alias("b")), "first")
        links = stored(links.unionByName(own.join(first, "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")), "links")
    comp = stored(components(classes, links), "components")
    # 3. What the hubs left open: buckets whose other members are not in one component.
    rest = members.where("members > 2").where(apart)
    for _ in range(rounds):
        marked = stored(rest.select("bucket", "band", "id", "n_shingles").join(comp, "id"), "marked")
        # The next hub is of another component than the lowest; its pairs are those across.
        hubs = marked.groupBy("bucket").agg(F.min("comp").alias("low"), F.max(F.struct("comp", "id", "n_shingles")).alias("next"), F.approx_count_distinct("comp").alias("comps"), F.count(F.lit(1)).alias("size"))
        hubs = stored(hubs.where("low <> next.comp"), "hubs")
        rest = stored(spread_join(marked, hubs, ["bucket"], "size", "id", n_entries), "rest")
        pairs = hubs.agg(F.sum(F.col("comps").cast("double") * F.col("size"))).first()[0] or 0.0
        if pairs <= open_share * n_entries:
            break
        found = star(rest.where(F.col("comp") != F.col("next.comp")).withColumn("hub", F.struct("next.id", "next.n_shingles")).withColumn("members", F.col("size")))
        if not found.limit(1).count():
            break
        named = found.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
        comp = _joined(comp, named.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        rest = rest.where(F.col("id") != F.col("next.id")).withColumn("hub", F.struct("next.id", "next.n_shingles")).select("bucket", "band", "id", "n_shingles", "hub", F.col("size").alias("members"))
    else:
        rest = rest.join(comp, "id")
    # 4. All against all, across components.
    cells = rest.select("bucket", "band", "id", "comp").join(payload, "id")
    more = stored(_across(stored(cells, "cells"), bands, rows, k, percent, least, block), "across")
    if more.limit(1).count():
        comp = _joined(comp, more)
    drop_stored(payload, members)
    # A component is named by its smallest doc_id; stored, so that a large one can be split.
    class_of = stored(classes.join(comp, "id").select("set_key", "copies", "doc_id", "comp"), "class_of")
    names = stored(class_of.groupBy("comp").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("classes")), "names")
    named = stored(spread_join(class_of, names, ["comp"], "classes", "doc_id", n_entries).select("set_key", "copies", F.col("name").alias("comp")), "named")
    rows_ = seen.select("doc_id", "n_shingles", "set_key")
    bare = rows_.where("n_shingles = 0")
    if several:
        bare = bare.join(own.join(comp, "id").join(names, "comp").groupBy("doc_id").agg(F.min("name").alias("comp")), "doc_id", "left")
    else:
        bare = bare.withColumn("comp", F.lit(None).cast("long"))
    full = spread_join(rows_.where("n_shingles > 0"), named, ["set_key"], "copies", "doc_id", n_entries)
    out = full.select("doc_id", "n_shingles", "comp").unionByName(bare.select("doc_id", "n_shingles", "comp"))
    nameless = every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")).unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component, the document with the smallest id."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
