"""Column functions, lowering, node table, frames, sources and streams on Spark."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import functions as J
from docloom.frame import DocumentFrame
from docloom.operators.nodes import nodes
from docloom.operators.reads import CommandError
from docloom.path import PathError
from docloom.plans import Typed, json_value
from docloom.plans.lower import NotLowered, lowerable
from docloom.sources import read_bson, read_table, read_text, split_valid, write_snapshot
from docloom.streaming import apply_stream, current, versions

DOCS = [("a", '{"n":1,"s":"x","l":[1,2.5,3],"o":{"k":true}}'), ("b", '{"n":1.0,"s":5,"l":[],"o":{}}'), ("c", '{"n":"1","n":7,"l":"no"}'), ("d", None), ("e", "{bad"), ("f", "[1,2]"), ("g", '{"n":9223372036854775808,"o":null}')]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "key string, doc string")


def by_key(df):
    return {r[0]: r[1] for r in df.collect()}


def test_query_and_values(docs):
    assert by_key(docs.select("key", J.jp_query("doc", "$.l[*]"))) == {"a": ["1", "2.5", "3"], "b": [], "c": [], "d": None, "e": None, "f": [], "g": []}
    got = {r.key: r for r in DocumentFrame(docs).values(n=("$.n", "bigint"), s=("$.s", "string"), l=("$.l[*]", "array<double>"), k=("$.o.k", "boolean"), c=("$.*", "count"), j=("$.o", "json")).collect()}
    assert (got["a"].n, got["a"].s, got["a"].l, got["a"].k, got["a"].c, got["a"].j) == (1, "x", [1.0, 2.5, 3.0], True, 4, '{"k":true}')
    assert got["b"].n is None and got["b"].s is None and got["c"].n == 7 and got["d"].c is None and got["g"].n is None


def test_strict_raises(docs):
    with pytest.raises(Exception, match="JsonError|CommandError"):
        docs.select(J.jp_query("doc", "$.a", strict=True)).collect()
    with pytest.raises(PathError):
        J.jp_query("doc", "$[")
    with pytest.raises(CommandError):
        J.jp_type("doc", "$.a + 1")


@pytest.mark.parametrize(("path", "kind"), [("$.n", "bigint"), ("$.n", "double"), ("$.n", "boolean"), ("$.o.k", "boolean"), ("$.o.k", "bigint"), ("$.l", "bigint"), ("$.nope.deep", "double"), ('$["s"]', "bigint")])
def test_native_equals_evaluator(docs, path, kind):
    assert lowerable(path, kind)
    assert by_key(docs.select("key", json_value("doc", path, kind, True))) == by_key(docs.select("key", json_value("doc", path, kind, False)))


def test_not_lowered():
    assert not lowerable("$.a[0]", "bigint") and not lowerable("$..a", "bigint") and not lowerable("$.a", "string") and not lowerable("$", "bigint")


SCHEMA = "a BIGINT, t DOUBLE, items ARRAY<STRUCT<q: DOUBLE, f: STRING>>, xs ARRAY<DOUBLE>, one STRUCT<k: STRING>"


@pytest.mark.parametrize(
    "path",
    ["$.a", "$.one.k", "$.xs", "$.xs[0]", "$.xs[-1]", "$.xs[-9]", "$.xs[9]", "$.xs[*]", "$.xs[1:3]", "$.xs[-2:]", "$.xs[::2]", "$.xs[3:1]", "$.items[*].q", "$.items[0].f", "$.items[?@.q > 2].f", '$.items[?(@.q > 1 && @.f == "R")].q', "$.items[?!@.q > 2].q", "$.items[?@.q != 2].q", "$.items[?@.f].q", "$.items[?@.q >= $.xs[0]].q", "$.items[?@.q < 2 || @.q == 3].q", "$.xs.sum()", "$.xs.min()", "$.xs.max()", "$.xs.avg()", "stddev($.xs)", "$.xs.length()", "$.xs.first()", "$.xs.last()", "$.t * 2", "$.t + 1", "$.t / 0", "-$.t"],
)
def test_typed_equals_evaluator(spark, path):
    rows = [
        ("1", '{"a":1,"t":2.5,"items":[{"q":1.0,"f":"R"},{"q":2.0,"f":"A"},{"q":3.0,"f":"R"}],"xs":[1.5,2.0,0.5,4.0],"one":{"k":"z"}}'),
        ("2", '{"a":2,"t":1.0,"items":[],"xs":[],"one":{}}'),
        ("3", '{"a":3,"t":-1.0,"items":[{"q":9.0},{"f":"R"}],"xs":[7.0]}'),
    ]
    df = spark.createDataFrame(rows, "key string, doc string")
    native = by_key(df.select("key", F.to_json(F.struct(Typed("doc", SCHEMA).path(path).alias("v"))).alias("v")))
    kind = by_key(df.select("key", J.jp_query("doc", path)))
    for k, text in native.items():
        v = json.loads(text).get("v")
        want = [json.loads(x) for x in kind[k]]
        if isinstance(v, list) and path != "$.xs":
            assert v == want, k
        else:
            assert v == (want[0] if want else None), k


@pytest.mark.parametrize("path", ["$..q", "$.nope", "$.items.keys()", "$.items[0,1]", "$.items[*].q + 1", "$.a % 2", "$.items[?@.f > 1]", '$.items[?@.f =~ "R"]', "$.xs[*].sum()"])
def test_typed_refuses(path):
    with pytest.raises(NotLowered):
        Typed("doc", SCHEMA).path(path)


KEPT = [
    ("1", '{"a":1,"t":2.5,"items":[{"q":1.0,"f":"R"},{"q":2,"f":"A"},{"q":3.0}],"xs":[1.5,2,0.5,4.0],"one":{"k":"z"}}'),
    ("2", '{"a":-2,"items":[],"xs":[],"one":{},"more":[{"q":1}]}'),
    ("3", '{"a":9007199254740993,"t":-1,"items":[{"f":"R"},{"q":9}],"xs":[7.0]}'),
    ("4", "{}"),
    ("5", None),
]
BROKEN = ["{bad", "[1,2]", '{"a":"1"}', '{"a":1.5}', '{"xs":[1,"2"]}', '{"items":[{"q":"NaN"}]}', '{"one":5}', "{'a':1}", ""]


@pytest.mark.parametrize(
    ("path", "kind", "native"),
    [
        ("$.a", "bigint", True), ("$.a", "double", True), ("$.t", "double", True), ("$.one.k", "string", True), ("$.xs[-1]", "double", True), ("$.xs[9]", "double", True), ("$.items[0].f", "string", True),
        ("$.xs[*]", "array<double>", True), ("$.xs[1:3]", "array<double>", True), ("$.xs[*]", "count", True), ("$.items[*].q", "count", True), ("$.items[*].q", "double", True), ('$.items[?(@.q > 1 && @.f == "A")].q', "array<double>", True),
        ("$.items[?@.q >= $.xs[0]].f", "array<string>", True), ("$.items[?!@.f]", "count", True), ("$.xs.sum()", "double", True), ("stddev($.xs)", "double", True), ("$.xs.length()", "bigint", True), ("$.items.length()", "bigint", True),
        # No native form, or one that differs.
        ("$.t", "bigint", False), ("$.a", "count", False), ("$.a", "array<bigint>", False), ("$.one", "json", False), ("$..q", "array<double>", False), ("$.a + 1", "double", False), ("$.more", "count", False), ("3", "bigint", False),
    ],
)
def test_values_of_a_declared_schema(spark, path, kind, native):
    """Equal to the evaluator's on documents that keep the schema, null on those that break it; without Python where there is a native form."""
    broken = [(f"b{i}", text) for i, text in enumerate(BROKEN)]
    df = spark.createDataFrame(KEPT + broken, "key string, doc string")
    declared = DocumentFrame(df, schema=SCHEMA).values(v=(path, kind))
    assert ("Python" not in declared._jdf.queryExecution().executedPlan().toString()) == native
    got, want = by_key(declared), by_key(DocumentFrame(df).values(v=(path, kind)))
    assert {k: got[k] for k, _ in KEPT} == {k: want[k] for k, _ in KEPT}
    if native:
        assert {got[k] for k, _ in broken} == {None}


def test_declared_values_parse_once(spark):
    df = spark.createDataFrame(KEPT, "key string, doc string")
    frame = DocumentFrame(df, schema=SCHEMA).lookup("1")
    both = frame.values(n=("$.xs[*]", "count"), j=("$.one", "json"), s=("$.xs.sum()", "double"), a=("$.a", "bigint"))
    assert tuple(both.first()) == ("1", 4, '{"k":"z"}', 8.0, 1)
    plan = frame.values(n=("$.xs[*]", "count"), s=("$.xs.sum()", "double"), a=("$.a", "bigint"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_edit_columns(docs):
    got = {r.key: r for r in DocumentFrame(docs).edit("numincrby", "$.n", "2").collect()}
    assert json.loads(got["a"].doc)["n"] == 3 and got["a"].reply == "[3]" and got["a"].changed
    assert got["d"].doc is None and got["d"].error and got["e"].doc == "{bad" and got["e"].error and got["f"].reply == "[]" and not got["f"].changed
    out = docs.where("key = 'a'").select(J.jp_set("doc", "$.k", F.concat(F.lit('"'), F.col("key"), F.lit('"')))["doc"]).first()[0]
    assert json.loads(out)["k"] == "a"
    left = DocumentFrame(docs).mutate("del", "$")
    assert {r.key for r in left.df.collect()} == {"e"}


def test_mget_keeps_order_and_missing(spark, docs):
    keys = spark.createDataFrame([(0, "c"), (1, "zz"), (2, "a"), (3, "a"), (4, "e")], "ordinal int, key string")
    assert [(r.key, r.value) for r in DocumentFrame(docs).mget(keys, "$.n").orderBy("ordinal").collect()] == [("c", "[7]"), ("zz", None), ("a", "[1]"), ("a", "[1]"), ("e", None)]


def test_copy_and_lookup(docs):
    frame = DocumentFrame(docs).copy("a", "b")
    assert frame.lookup("b").df.first().doc == DOCS[0][1] and frame.df.count() == len(DOCS)


def test_nodes(docs):
    rows = nodes(docs.where("key in ('a','d','e')")).collect()
    assert [(r.path, r.type) for r in rows][:4] == [([], "object"), (["n"], "integer"), (["s"], "string"), (["l"], "array")]
    inner = next(r for r in rows if r.path == ["l", "1"])
    assert (inner.idx, inner.name, inner.dbl, inner.long, inner.parent, inner.depth) == (1, None, 2.5, None, ["l"], 2)


def test_paths(docs):
    got = docs.where("key = 'a'").select(J.jp_paths("doc", "$.l[1:]").alias("m")).first().m
    assert [(m.path, m.is_index, m.value) for m in got] == [(["l", "1"], [False, True], "2.5"), (["l", "2"], [False, True], "3")]


def test_log_in_order(spark):
    docs = spark.createDataFrame([("x", '{"n":1}'), ("y", '{"n":0}')], "key string, doc string")
    log = spark.createDataFrame(
        [("x", 3, "NUMINCRBY", ["$.n", "1"]), ("x", 1, "nummultby", ["$.n", "5"]), ("z", 1, "set", ["$", '{"l":[1,2,3]}']), ("z", 2, "arrpop", ["$.l", "0"]), ("y", 1, "del", ["$"]), ("y", 2, "numincrby", ["$.n", "1"]), ("x", 4, "nope", [])],
        "key string, seq bigint, op string, args array<string>",
    )
    frame = DocumentFrame(docs)
    assert by_key(frame.apply_log(log)) == {"x": '{"n":6}', "z": '{"l":[2,3]}'}
    events = {(r.key, r.seq): (r.event, r.error) for r in frame.apply_log(log, feed=True).collect()}
    assert events[("x", 1)] == ("json.nummultby", None) and events[("y", 2)][1] and events[("x", 4)][1] and len(events) == 7


def test_log_ties_and_doubles(spark):
    """Lines without a seq first, ties by op and arguments, whatever the order of rows; two documents under a key are refused."""
    docs = spark.createDataFrame([("x", '{"n":2}')], "key string, doc string")
    lines = [("x", 1, "numincrby", ["$.n", "1"]), ("x", None, "nummultby", ["$.n", "10"]), ("x", 1, "nummultby", ["$.n", "3"]), ("x", 1, "numincrby", ["$.n", "4"])]
    for rows in (lines, lines[::-1]):
        log = spark.createDataFrame(rows, "key string, seq bigint, op string, args array<string>").repartition(2)
        assert by_key(DocumentFrame(docs).apply_log(log)) == {"x": '{"n":75}'}
    with pytest.raises(Exception, match="two documents under the key"):
        DocumentFrame(docs.unionByName(docs)).apply_log(log).collect()


SETS = "key string, seq bigint, path string, value string"


@pytest.mark.parametrize(
    ("sets", "reply", "after", "events"),
    [
        ([("a", 1, "$.name", '"new"'), ("c", 2, "$", "[1]"), ("b", 3, "$.more", "{}")], ("OK", None), {"a": {"name": "new", "part": {"size": [1, 2]}}, "b": {"name": "b", "more": {}}, "c": [1]}, {"a": 1, "b": 1, "c": 1}),
        # A place that is gone by then, or never was: the others are written, the reply is null.
        ([("a", 1, "$.part", "0"), ("a", 2, "$.part.size[0]", "5"), ("b", 3, "$.name", "1")], (None, None), {"a": {"name": "a", "part": 0}, "b": {"name": 1}}, {"a": 1, "b": 1}),
        ([("a", 1, "$.no.place", "0"), ("b", 2, "$.name", "1")], (None, None), {"a": {"name": "a", "part": {"size": [1, 2]}}, "b": {"name": 1}}, {"b": 1}),
        # Places are found before anything is written.
        ([("b", 1, "$.fresh", "{}"), ("b", 2, "$.fresh.leaf", "1")], (None, None), {"b": {"name": "b", "fresh": {}}}, {"b": 1}),
        # One wrong triplet refuses all.
        ([("a", 1, "$.name", "1"), ("b", 2, "$.name", "{bad")], "error", {}, {}),
        ([("a", 1, "$.name", "1"), ("b", 2, "$.name[", "1")], "error", {}, {}),
        ([("a", 1, "$.name", "1"), ("new", 2, "$.name", "1")], "error", {}, {}),
        ([("a", 1, "$.name", "1"), ("b", 2, None, None)], "error", {}, {}),
        ([], ("OK", None), {}, {}),
    ],
)
def test_joint_sets(spark, sets, reply, after, events):
    before = {"a": {"name": "a", "part": {"size": [1, 2]}}, "b": {"name": "b"}}
    frame = DocumentFrame(spark.createDataFrame([(k, json.dumps(v)) for k, v in before.items()], "key string, doc string"))
    sets = spark.createDataFrame(sets, SETS).repartition(2)
    got = tuple(frame.mset_reply(sets).first())
    assert (got[0] is None and got[1]) if reply == "error" else got == reply
    assert {k: json.loads(v) for k, v in by_key(frame.mset(sets)).items()} == {**before, **after}
    assert {r.key: r.n for r in frame.mset(sets, feed=True).collect()} == events


def test_feed_has_the_time_of_the_log(spark):
    docs = spark.createDataFrame([("x", '{"n":2}')], "key string, doc string")
    log = spark.sql("SELECT 'x' AS key, 1L AS seq, TIMESTAMP '2024-05-01 10:20:30' AS ts, 'numincrby' AS op, array('$.n', '1') AS args")
    assert str(DocumentFrame(docs).apply_log(log, feed=True).first().ts) == "2024-05-01 10:20:30"
    assert DocumentFrame(docs).apply_log(log.drop("ts"), feed=True).first().ts is None


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text('{"a":1}\n[1]]\n')
    good, bad = split_valid(read_text(spark, str(tmp_path / "t")))
    assert [r.doc for r in good.collect()] == ['{"a":1}'] and [r.doc for r in bad.collect()] == ["[1]]"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.bson").write_bytes(b"\x0c\x00\x00\x00\x10n\x00\x07\x00\x00\x00\x00")
    assert read_bson(spark, str(tmp_path / "b")).first().doc == "7"
    write_snapshot(good, str(tmp_path / "s"))
    assert read_table(spark, str(tmp_path / "s"), "key", "doc").count() == 1


def test_stream(spark, tmp_path):
    schema = "key string, seq bigint, op string, args array<string>"
    source, table, feed = (str(tmp_path / x) for x in ("log", "table", "feed"))
    for lines in ([("k", 1, "set", ["$", '{"n":1}'])], [("k", 2, "numincrby", ["$.n", "4"]), ("m", 3, "set", ["$", "[]"])]):
        spark.createDataFrame(lines, schema).write.mode("append").parquet(source)
        apply_stream(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "ck"), feed).awaitTermination(120)
    assert by_key(current(spark, table)) == {"k": '{"n":5}', "m": "[]"}
    assert len(versions(spark, table)) >= 2
    assert spark.read.parquet(f"{feed}/batch=*").count() == 3


def test_stream_of_deltas_is_compacted(spark, tmp_path):
    """Seven batches, two deltas to a whole version: the table is right after each, and old versions go."""
    schema = "key string, seq bigint, op string, args array<string>"
    source, table = str(tmp_path / "log"), str(tmp_path / "table")
    want = {}
    for i in range(7):
        lines = [(f"k{i % 3}", 2 * i, "set", ["$", f'{{"n":{i}}}']), (None, 0, "set", ["$", "0"])] + ([("k1", 2 * i + 1, "del", ["$"])] if i == 5 else [])
        spark.createDataFrame(lines, schema).coalesce(1).write.mode("append").parquet(source)
        apply_stream(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "ck"), compact=2).awaitTermination(120)
        want[f"k{i % 3}"] = f'{{"n":{i}}}'
        if i == 5:
            del want["k1"]
        assert by_key(current(spark, table)) == want, i
    assert min(versions(spark, table)) >= 2 and len(list((tmp_path / "table").glob("v=*"))) <= 2
    again = by_key(current(spark, table, 4))
    assert again == {"k0": '{"n":3}', "k1": '{"n":1}', "k2": '{"n":2}'}


def test_plans_push_down_and_prune(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = df.where("event_type = 'view'").select(json_value("props", "$.k", "bigint"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan and "Python" not in plan and "user_id" not in plan
