"""Mixing sources to target weights by a time-varying curriculum.

A source has a weight schedule over training time t in [0, 1], given by knots of a piecewise linear
curve. Its integral is the source's cumulative token demand; scaled to the source's target, the
demand is inverted to say at which position of training each document (and each repeat of it) comes.
Documents of a source are consumed in a fixed pseudo-random order (by MD5 of the id), pass after
pass; the result is range-sorted by position.

Targets: source i wants ``weight_i / sum(weights)`` of all words; no target exceeds ``max_repeat``
times the source's own size, and the excess is shared out again by weight until none is above. The
fixed point is min(max_repeat * size, level * weight) with one common level, found by sorting.

Running sums, over sources and over the documents of all sources, are taken in two steps: rows are dealt into
ranges of about equal size, summed inside each, and the ranges' totals are added up; so no task holds a whole
source, however hot, nor all sources.

Defined results: null text has size 0; documents of size 0 take nothing, and nor does a source
without words; a null source is a source of its own, sorted last; repeated rows are documents of
their own; an empty table gives an empty result. Columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe_text, parts_for, running_sums, stored

#: (time, relative weight) knots, by turns over the sources: rising, flat, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    """Number of words: pieces between separators, but for the empty ones at either end."""
    outer = lambda at: F.when(F.instr(F.lit(" \t\n\x0b\x0c\r"), F.substring(text, at, 1)) > 0, 1).otherwise(0)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+", -1)) - outer(1) - outer(-1)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(null_safe_text()).alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per source: source, rank (by code point, null last), source_size, n_docs, weight, target."""
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "per_source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = running_sums(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("weight", turn).withColumn("cap", (F.col("source_size") * max_repeat).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    # Sources reach their cap in the order of cap / weight. With the first j of them at their cap,
    # the level of the rest is (total - caps of j) / (weights of the rest).
    summed = stored(running_sums(ranked, [F.col("ratio"), F.col("rank")], {"caps": F.col("cap"), "weights": F.col("weight")}), "summed")
    whole = summed.agg(F.sum(F.col("source_size").cast("double")).alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("caps")) / (F.lit(whole["weight"]) - F.col("weights"))
    free = summed.withColumn("level", level).where(F.col("ratio") > F.col("level"))
    final = free.agg(F.min_by("level", F.struct("ratio", "rank"))).first()[0]  # one number
    target = F.col("cap") if final is None else F.least(F.col("cap"), F.lit(final) * F.col("weight"))
    return summed.select("source", "rank", "source_size", "n_docs", "weight", target.alias("target"))


def invert_schedule(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral is ``share`` (0 to 1) of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, out, done = sum(areas), None, 0.0
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        need, slope = share * whole - done, (w1 - w0) / (t1 - t0)
        step = need / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + need * (2 * slope))) - w0) / slope
        at = F.lit(t0) + step
        out = F.when(share * whole <= done + area, at) if out is None else out.when(share * whole <= done + area, at)
        done += area
    return F.least(F.lit(knots[-1][0]), out.otherwise(F.lit(knots[-1][0])))


def placed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, range_rows: int = 20_000) -> DataFrame:
    """Each document with what the mix takes of it.

    doc_id, source, size, source_size, target, start (words of its source before it), taken (words,
    repeats counted), copies (array of (pass, words, position in training)).
    """
    sizes = stored(sized(docs), "sizes")
    targets = source_targets(sizes, weights, max_repeat)
    # Rows that are alike in all this are interchangeable; their number tells them apart where very many are.
    rows = sizes.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("source").asc_nulls_last(), *[F.col(c).asc() for c in ("key", "doc_id", "size", "n")]]
    ahead = stored(running_sums(rows, order, {"before": F.col("size")}, range_rows), "ahead")
    firsts = ahead.groupBy("source").agg(F.min("before").alias("first"))
    facts = stored(targets.alias("t").join(firsts.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source"))).select("t.*", "f.first"), "targets")
    both = ahead.alias("r").join(facts.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    out = both.select("r.doc_id", "r.source", "r.size", "t.source_size", "t.target", "t.rank", (F.col("r.before") - F.col("t.first")).cast("long").alias("start"))
    goal = F.floor("target").cast("long")
    passes = [(i, F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("start") - F.lit(i) * F.col("source_size"))).cast("long")) for i in range(max_repeat)]
    share = [F.when(F.col("target") > 0, (F.col("start") + F.lit(i) * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0)) for i, _ in passes]

    def position(x: Column) -> Column:
        out = F.lit(None).cast("double")
        for j, knots in enumerate(SCHEDULES):
            out = F.when(F.col("rank") % len(SCHEDULES) == j, invert_schedule(x, knots)).otherwise(out)
        return out

    copies = F.filter(F.array(*[F.struct(F.lit(i).alias("pass"), w.alias("words"), position(x).alias("position")) for (i, w), x in zip(passes, share, strict=True)]), lambda c: c["words"] > 0)
    taken = sum((w for _, w in passes), F.lit(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "start", taken.cast("long").alias("taken"), copies.alias("copies"))


def schedule(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per copy that the mix takes (doc_id, source, pass, words, position), range-sorted by position."""
    flat = placed(docs, weights, max_repeat).select("doc_id", "source", F.explode("copies").alias("c")).select("doc_id", "source", "c.pass", "c.words", "c.position")
    return flat.orderBy("position", "doc_id", "pass")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, in the order of training, with all its columns.

    A document of which the mix takes a part counts as taken. Rows that share an id have its copies in common: one
    for each pass, at the first of their positions.
    """
    plan = schedule(docs, weights, max_repeat).groupBy("doc_id", "pass").agg(F.min("position").alias("__position"))
    joined = docs.join(plan.select(F.col("doc_id").alias("__id"), F.col("pass").alias("__pass"), "__position"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    return joined.orderBy("__position", "__id", "__pass").select(*[F.col(f"`{c}`") for c in docs.columns])
