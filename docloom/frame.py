"""A table of documents: (key, doc)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import functions as J
from .codec import dumps, loads
from .operators.edits import Editor, targets, write
from .operators.nodes import COLUMNS, nodes
from .operators.reads import ABSENT, CommandError
from .plans.lower import NotLowered, Typed, declared

LOG = "key string, seq bigint, op string, args array<string>"
FEED = "key string, seq bigint, ts timestamp, event string, reply string, error string"


class DocumentFrame:
    """Documents by key, with the read and write commands as table operations.

    schema: what every document keeps, as DDL of its root (members are of their type or missing, and not null); then
    :meth:`values` reads in code generation what has a native form. A document that breaks the schema gives null there,
    but for two things that go unseen: text after its end, and another value where a string is declared, which gives its text.
    """

    def __init__(self, df: DataFrame, key: str = "key", doc: str = "doc", schema: str | None = None):
        self.df, self.key, self.doc, self.schema = df, key, doc, schema

    def _with(self, df: DataFrame) -> DocumentFrame:
        """Another table of documents; edits need not keep the declared schema, so it goes."""
        return DocumentFrame(df, self.key, self.doc)

    # -- reads

    def lookup(self, key: Any) -> DocumentFrame:
        """One key's document; a filter that reaches the scan."""
        return DocumentFrame(self.df.where(F.col(self.key) == F.lit(key)), self.key, self.doc, self.schema)

    def copy(self, source: Any, target: Any) -> DocumentFrame:
        """The source's document under another key, replacing what was there."""
        there = self.df.where(F.col(self.key) == F.lit(source)).withColumn(self.key, F.lit(target))
        return self._with(self.df.where(F.col(self.key) != F.lit(target)).unionByName(there))

    def select(self, **columns: Column) -> DataFrame:
        return self.df.select(self.key, *[c.alias(n) for n, c in columns.items()])

    def get(self, *paths: str, **options: Any) -> DataFrame:
        return self.df.select(self.key, J.jp_get(self.doc, *paths, **options).alias("value"))

    def values(self, **wanted: tuple[str, str]) -> DataFrame:
        """Columns name = (path, kind), all by one parse; with a schema, by a native one for those that have a native form."""
        native: dict[str, Column] = {}
        if self.schema is not None:
            typed = Typed.parsed(F.col("__t"), self.schema, exact=True)
            for name, (path, kind) in wanted.items():
                try:
                    native[name] = typed.value(path, kind)
                except NotLowered:
                    continue
        rest = {n: w for n, w in wanted.items() if n not in native}
        parsed = [declared(self.doc, self.schema).alias("__t")] if native else []
        found = [J.jp_values(self.doc, **rest).alias("__v")] if rest else []
        return self.df.select(self.key, *parsed, *found).select(self.key, *[(native[n] if n in native else F.col("__v").getField(n)).alias(n) for n in wanted])

    def mget(self, keys: DataFrame, path: str, ordinal: str = "ordinal") -> DataFrame:
        """(ordinal, key, value) for a table of keys; null for a missing key, or one whose read fails."""
        asked = keys.select(F.col(ordinal), F.col(self.key))
        found = self.df.select(F.col(self.key), F.col(self.doc).alias("__doc"))
        return asked.join(found, self.key, "left").select(ordinal, self.key, J.jp_get("__doc", path).alias("value"))

    def nodes(self, path: str = "$..*", root: bool = True, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
        return nodes(self.df, self.key, self.doc, path, root, columns)

    # -- writes

    def edit(self, name: str, *args: Any) -> DataFrame:
        """All columns plus reply, changed, error; the document is the edited one (null: deleted)."""
        out = self.df.withColumn("__r", J.jp_edit(name, self.doc, *args))
        return out.withColumn(self.doc, F.col("__r.doc")).withColumns({c: F.col(f"__r.{c}") for c in ("reply", "changed", "error")}).drop("__r")

    def mutate(self, name: str, *args: Any) -> DocumentFrame:
        """The table after an edit of every document; deleted ones are gone."""
        out = self.edit(name, *args).where(F.col(self.doc).isNotNull())
        return self._with(out.drop("reply", "changed", "error"))

    def apply_log(self, log: DataFrame, feed: bool = False) -> DataFrame:
        """Apply a log of (key, seq, op, args) in order of seq within each key.

        Result: (key, doc) after it; with ``feed``, the change events (key, seq, ts, event, reply, error)
        instead, ts being the log's, if it has that column. Documents and log meet sorted by key and sequence, and
        are folded as they stream by, so a key with very many edits needs memory for its document only.

        Lines without a seq come first; lines of one key and seq are applied in the order of op and arguments. Two
        documents under one key are an error.
        """
        ts = F.col("ts") if "ts" in log.columns else F.lit(None)
        docs = self.df.select(F.col(self.key).cast("string").alias("key"), F.lit(0).alias("line"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit("").alias("op"), F.array().cast("array<string>").alias("args"), F.col(self.doc).alias("doc"))
        edits = log.select(F.col("key").cast("string"), F.lit(1).alias("line"), F.col("seq").cast("bigint"), ts.cast("timestamp").alias("ts"), F.lower("op").alias("op"), F.col("args").cast("array<string>"), F.lit(None).cast("string").alias("doc"))
        both = docs.unionByName(edits).repartition("key").sortWithinPartitions("key", "line", F.col("seq").asc_nulls_first(), "op", "args")
        return both.mapInArrow(_fold(feed), FEED if feed else "key string, doc string")

    def sets(self, triplets: DataFrame) -> DataFrame:
        """(key, path, value) triplets with a sequence number ``seq``, each a set of its own, in order: (key, doc) after them."""
        return self.apply_log(triplets.select("key", "seq", F.lit("set").alias("op"), F.array("path", "value").alias("args")))

    def _joint(self, triplets: DataFrame) -> DataFrame:
        """(key, old, doc, seq, error, done, events) of every key, and in every row the first error of all."""
        docs = self.df.select(F.col(self.key).cast("string").alias("key"), F.lit(0).alias("line"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("path"), F.col(self.doc).alias("value"))
        sets = triplets.select(F.col("key").cast("string"), F.lit(1).alias("line"), F.col("seq").cast("bigint"), F.col("path").cast("string"), F.col("value").cast("string"))
        both = docs.unionByName(sets).repartition("key").sortWithinPartitions("key", "line", F.col("seq").asc_nulls_first(), "path", "value")
        return both.mapInArrow(_set_together, "key string, old string, doc string, seq bigint, error string, done boolean, events bigint")

    def mset(self, triplets: DataFrame, feed: bool = False) -> DataFrame:
        """(key, path, value) triplets with a sequence number ``seq``, as one command: (key, doc) after it.

        Every triplet is checked, and its places found, before any is written; one that is wrong (a path that does
        not compile, a value that is no JSON, a missing key anywhere but at the root) refuses all. One whose places
        are not there, or gone by then, leaves the others be. With ``feed``: (key, event, n), a row for each
        changed key, n being how many triplets changed it.
        """
        done = self._joint(triplets)
        refused = done.agg(F.count("error").alias("errors"))  # one row
        both = done.join(F.broadcast(refused), F.lit(True))
        if feed:
            return both.where("errors = 0 and events > 0").select("key", F.lit("json.mset").alias("event"), F.col("events").alias("n"))
        return both.select("key", F.when(F.col("errors") > 0, F.col("old")).otherwise(F.col("doc")).alias("doc")).where("doc is not null")

    def mset_reply(self, triplets: DataFrame) -> DataFrame:
        """(reply, error) of :meth:`mset`, one row: OK if every triplet was written, null if one was not; the first error."""
        done = self._joint(triplets)
        one = done.agg(F.min(F.when(F.col("error").isNotNull(), F.struct("seq", "error"))).alias("e"), F.coalesce(F.bool_and("done"), F.lit(True)).alias("done"))
        return one.select(F.when(F.col("e").isNull() & F.col("done"), F.lit("OK")).alias("reply"), F.col("e.error").alias("error"))


_INTEGERS = {"arrinsert": (1,), "arrpop": (1,), "arrtrim": (1, 2)}


def _arguments(op: str, args: list[str]) -> list[Any]:
    """Arguments of a log line: all text there, some of them integers."""
    return [int(a) if i in _INTEGERS.get(op, ()) else a for i, a in enumerate(args)]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _fold(feed: bool):
    docs = [("key", pa.string()), ("doc", pa.string())]
    events = [("key", pa.string()), ("seq", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("event", pa.string()), ("reply", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, editor, started, whole = None, Editor(None), False, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if not started or row["key"] != key:
                    if started and not feed and editor.result() is not None:
                        out.append((key, editor.result()))
                    key, editor, started, whole = row["key"], Editor(None), True, False
                if row["line"] == 0:
                    if whole:
                        raise ValueError(f"two documents under the key {key!r}")
                    editor, whole = Editor(row["doc"]), True
                    continue
                try:
                    args = _arguments(row["op"], row["args"] or [])
                except ValueError as e:
                    reply, changed, error = None, False, f"bad log line: {e}"
                else:
                    reply, changed, error = editor.apply(row["op"] or "", *args)
                if feed and (changed or error):
                    out.append((key, row["seq"], row["ts"], f"json.{row['op']}" if changed else None, reply, error))
            if out:
                yield _batch(out, events if feed else docs)
        if started and not feed and editor.result() is not None:
            yield _batch([(key, editor.result())], docs)

    return run


def _set_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key: the document before and after, the first error, whether every triplet was written, how many changed it."""
    fields = [("key", pa.string()), ("old", pa.string()), ("doc", pa.string()), ("seq", pa.int64()), ("error", pa.string()), ("done", pa.bool_()), ("events", pa.int64())]
    key, state = None, None

    def result() -> tuple:
        new = state["old"] if state["events"] == 0 else dumps(state["doc"])
        return key, state["old"], new, state["seq"], state["error"], state["done"], state["events"]

    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if state is None or row["key"] != key:
                if state is not None:
                    out.append(result())
                key, state = row["key"], {"old": None, "first": ABSENT, "doc": ABSENT, "seq": None, "error": None, "done": True, "events": 0}
            if row["line"] == 0:
                if state["old"] is not None:
                    raise ValueError(f"two documents under the key {key!r}")
                state["old"] = row["value"]
                continue
            try:
                if state["first"] is ABSENT and state["old"] is not None:  # a copy stays as it was, and places are found in it
                    state["first"], state["doc"] = loads(state["old"]), loads(state["old"])
                if row["path"] is None or row["value"] is None:
                    raise CommandError("a triplet needs a path and a value")
                where, value = targets(state["first"], row["path"]), loads(row["value"])
                done = write(state["doc"], where, value)
            except (ValueError, TypeError) as e:
                if state["error"] is None:
                    state["seq"], state["error"] = row["seq"], str(e)[:200] or type(e).__name__
                continue
            state["doc"] = done.doc
            state["done"] &= done.reply == "OK"
            state["events"] += done.changed
        if out:
            yield _batch(out, fields)
    if state is not None:
        yield _batch([result()], fields)
