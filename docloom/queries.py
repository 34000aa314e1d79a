"""Queries over the driver's tables, one per operator, and the same in SQL.

Documents are built from relational rows, so that SQL on the rows is an independent account of what
a path over the documents must give.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as J
from .frame import DocumentFrame
from .operators.nodes import nodes
from .plans import Typed, json_value
from .sources import read_table, write_snapshot
from .streaming import event_counts

ITEM = "l_linenumber INT, l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_returnflag STRING"
ORDER = f"o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, items ARRAY<STRUCT<{ITEM.replace(' INT', ': INT').replace(' BIGINT', ': BIGINT').replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING')}>>, quantities ARRAY<DOUBLE>, flags ARRAY<STRING>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Folder of tables: where :func:`keep_order_docs` put its order documents.
_KEPT: dict[str, str] = {}


def keep_order_docs(spark: SparkSession, d: str, path: str) -> None:
    """Write the order documents once; queries of this process on the same tables then read them there."""
    order_docs(spark, d).write.parquet(path)
    _KEPT[d] = path


def order_docs(spark: SparkSession, d: str) -> DataFrame:
    """(key, doc): an order with its line items, sorted by all their columns."""
    if d in _KEPT:
        return spark.read.parquet(_KEPT[d])
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    doc = F.struct("o_orderkey", "o_orderstatus", "o_totalprice", "items", F.col("items.l_quantity").alias("quantities"), F.col("items.l_returnflag").alias("flags"))
    return joined.select(F.col("o_orderkey").alias("key"), F.to_json(doc).alias("doc"))


def customer_docs(spark: SparkSession, d: str) -> DataFrame:
    """(key, doc): a customer with nation and region nested."""
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    doc = F.struct("c_custkey", "c_name", "c_acctbal", F.struct("n_name", F.struct("r_name").alias("region")).alias("nation"))
    return joined.select(F.col("c_custkey").alias("key"), F.to_json(doc).alias("doc"))


def event_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("key"), "event_type", "user_id", F.col("props").alias("doc"))


def _values(docs: Callable, **wanted: tuple[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: DocumentFrame(docs(spark, d)).values(**wanted)


def _counts(**paths: str) -> Callable[[SparkSession, str], DataFrame]:
    return _values(order_docs, **{n: (p, "count") for n, p in paths.items()})


#: The line items in document order, numbered.
LINES = """
WITH it AS (
  SELECT l.*, o.*, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag))
"""


def _sql(columns: str, source: str = "it") -> str:
    return f"{LINES} SELECT l_orderkey AS key, {columns} FROM {source} GROUP BY l_orderkey"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# -- paths


def static_get(spark: SparkSession, d: str, native: bool | None = None) -> DataFrame:
    k = json_value("doc", "$.k", "bigint", native)
    return event_docs(spark, d).select("event_type", k.alias("k")).where("k >= 50").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


_STATIC = "SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE k >= 50 GROUP BY event_type"
query("path_static", static_get, _STATIC)
query("path_static_evaluator", lambda s, d: static_get(s, d, native=False), _STATIC)
query(
    "path_indexes",
    _values(order_docs, first=("$.items[0].l_quantity", "double"), last=("$.items[-1].l_quantity", "double"), clamped=("$.items[-100].l_partkey", "bigint"), some=("$.items[0,2]", "count"), beyond=("$.items[50]", "count")),
    _sql("max(l_quantity) FILTER (i = 1) AS first, max(l_quantity) FILTER (i = n) AS last, max(l_partkey) FILTER (i = 1) AS clamped, count(*) FILTER (i IN (1, 3)) AS some, CAST(0 AS BIGINT) AS beyond"),
)
query(
    "path_slices",
    _counts(middle="$.items[1:3]", tail="$.items[-2:]", head="$.items[:2]", stepped="$.items[0::2]", whole="$.items[:]", empty="$.items[3:1]"),
    _sql("count(*) FILTER (i IN (2, 3)) AS middle, count(*) FILTER (i > n - 2) AS tail, count(*) FILTER (i <= 2) AS head, count(*) FILTER (i % 2 = 1) AS stepped, count(*) AS whole, CAST(0 AS BIGINT) AS empty"),
)
query("path_names_union", _values(order_docs, both=("$[\"o_orderkey\",'nope',\"o_totalprice\"]", "count"), price=('$["o_totalprice"]', "double")), _sql("CAST(2 AS BIGINT) AS both, any_value(o_totalprice) AS price"))
query("path_wildcard", _counts(items="$.items[*]", members="$.*", all_fields="$.items[*].*"), _sql("count(*) AS items, CAST(6 AS BIGINT) AS members, 5 * count(*) AS all_fields"))


def recursive(spark: SparkSession, d: str) -> DataFrame:
    got = DocumentFrame(order_docs(spark, d)).values(q=("$..l_quantity", "array<double>"), flag=("$..l_returnflag", "count"))
    return got.select("key", F.aggregate("q", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("q").cast("bigint").alias("n"), "flag")


query("path_recursive", recursive, _sql("sum(l_quantity) AS total, count(*) AS n, count(*) AS flag"))
query(
    "path_recursive_nested",
    _values(customer_docs, region=("$..r_name", "string"), nation=("$.nation.n_name", "string"), objects=("$..[?@.r_name]", "count")),
    "SELECT c_custkey AS key, r_name AS region, n_name AS nation, CAST(1 AS BIGINT) AS objects FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)


def located(spark: SparkSession, d: str) -> DataFrame:
    at = order_docs(spark, d).select("key", F.explode(J.jp_paths("doc", "$.items[?@.l_quantity > 45].l_partkey")).alias("m"))
    return at.select("key", F.concat_ws("/", "m.path").alias("at"), F.col("m.value").cast("bigint").alias("part"))


query("path_locations", located, LINES + " SELECT l_orderkey AS key, 'items/' || CAST(i - 1 AS VARCHAR) || '/l_partkey' AS at, l_partkey AS part FROM it WHERE l_quantity > 45")


def legacy(spark: SparkSession, d: str) -> DataFrame:
    got = order_docs(spark, d).select("key", J.jp_get("doc", ".items[0].l_partkey").alias("a"), J.jp_get("doc", "o_orderkey").alias("b"), J.jp_get("doc", "nope").alias("none"))
    return got.select("key", F.col("a").cast("bigint").alias("part"), F.col("b").cast("bigint").alias("number"), "none")


query("path_legacy", legacy, _sql("max(l_partkey) FILTER (i = 1) AS part, l_orderkey AS number, CAST(NULL AS VARCHAR) AS none"))

# -- filters

query(
    "filter_compare",
    _counts(eq="$.items[?@.l_quantity == 25]", ne="$.items[?@.l_quantity != 25]", lt="$.items[?@.l_quantity < 25]", le="$.items[?(@.l_quantity <= 25)]", gt="$.items[?@.l_quantity > 25]", ge="$.items[?@.l_quantity >= 25.0]", mixed='$.items[?@.l_quantity == "25"]', missing="$.items[?@.nope != 1]"),
    _sql("count(*) FILTER (l_quantity = 25) AS eq, count(*) FILTER (l_quantity <> 25) AS ne, count(*) FILTER (l_quantity < 25) AS lt, count(*) FILTER (l_quantity <= 25) AS le, count(*) FILTER (l_quantity > 25) AS gt, count(*) FILTER (l_quantity >= 25) AS ge, CAST(0 AS BIGINT) AS mixed, count(*) AS missing"),
)
query(
    "filter_logic",
    _counts(both='$.items[?(@.l_quantity > 25 && @.l_returnflag == "R")]', either='$.items[?@.l_quantity > 40 || @.l_returnflag == "A"]', neither='$.items[?!(@.l_quantity > 40 || @.l_returnflag == "A")]', bound='$.items[?@.l_quantity > 40 || @.l_quantity < 5 && @.l_returnflag == "N"]', no="$.items[?!@.l_quantity > 40]", here="$.items[?@.l_partkey]", absent="$.items[?!@.nope]"),
    _sql("count(*) FILTER (l_quantity > 25 AND l_returnflag = 'R') AS both, count(*) FILTER (l_quantity > 40 OR l_returnflag = 'A') AS either, count(*) FILTER (NOT (l_quantity > 40 OR l_returnflag = 'A')) AS neither, count(*) FILTER (l_quantity > 40 OR (l_quantity < 5 AND l_returnflag = 'N')) AS bound, count(*) FILTER (NOT l_quantity > 40) AS no, count(*) AS here, count(*) AS absent"),
)
query(
    "filter_regex",
    _counts(part='$.items[?@.l_returnflag =~ "[AR]"]', whole='$.flags[?match(@, "A|R")]', search='$.flags[?search(@, "^N$")]', number='$.items[?@.l_quantity =~ "2"]', bad='$.flags[?@ =~ "("]'),
    _sql("count(*) FILTER (regexp_matches(l_returnflag, '[AR]')) AS part, count(*) FILTER (regexp_full_match(l_returnflag, 'A|R')) AS whole, count(*) FILTER (l_returnflag = 'N') AS search, CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS bad"),
)
query(
    "filter_sets",
    _counts(among='$.items[?@.l_returnflag in ["A","N"]]', outside='$.items[?@.l_returnflag nin ["A","N"]]', within='$[?@ subsetof ["A","N"]]', shares='$[?@ anyof ["R"]]', shares_none='$[?@ noneof ["R", 25]]', three="$[?@ sizeof 3]", filled="$[?@ empty false]"),
    _sql("count(*) FILTER (l_returnflag IN ('A', 'N')) AS among, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS outside, CAST(count(*) FILTER (l_returnflag = 'R') = 0 AS BIGINT) AS within, CAST(count(*) FILTER (l_returnflag = 'R') > 0 AS BIGINT) AS shares, 6 - CAST(count(*) FILTER (l_returnflag = 'R') > 0 AS BIGINT) - CAST(count(*) FILTER (l_quantity = 25) > 0 AS BIGINT) AS shares_none, 3 * CAST(count(*) = 3 AS BIGINT) AS three, CAST(4 AS BIGINT) AS filled"),
)
query(
    "filter_root",
    _counts(above="$.items[?@.l_quantity > $.quantities[0]]", top="$.items[?@.l_quantity == $.quantities.max()]", flagged="$.items[?@.l_returnflag in $.flags]"),
    f"{LINES}, f AS (SELECT l_orderkey AS k, max(l_quantity) FILTER (i = 1) AS q, max(l_quantity) AS m FROM it GROUP BY l_orderkey) SELECT k AS key, count(*) FILTER (l_quantity > q) AS above, count(*) FILTER (l_quantity = m) AS top, count(*) AS flagged FROM it JOIN f ON k = l_orderkey GROUP BY k",
)
query("filter_nested", _counts(found="$[?@[?@.l_quantity > 45]]", deep="$..[?@.l_quantity > 45]"), _sql("CAST(count(*) FILTER (l_quantity > 45) > 0 AS BIGINT) AS found, count(*) FILTER (l_quantity > 45) AS deep"))

# -- arithmetic and functions

query(
    "arithmetic",
    _values(order_docs, double=("$.o_orderkey * 2", "bigint"), mixed=("$.o_orderkey + 0.5", "double"), minus=("$.o_orderkey - 10", "bigint"), rest=("$.o_orderkey % 7", "bigint"), half=("$.o_orderkey / 2", "double"), negative=("-$.o_orderkey", "bigint"), order=("($.o_orderkey + 1) * 2 + 3 * 4", "bigint"), zero=("$.o_orderkey / 0", "double"), text=("$.o_orderstatus * 2", "double")),
    _sql("l_orderkey * 2 AS double, l_orderkey + CAST(0.5 AS DOUBLE) AS mixed, l_orderkey - 10 AS minus, l_orderkey % 7 AS rest, CAST(l_orderkey AS DOUBLE) / 2 AS half, -l_orderkey AS negative, (l_orderkey + 1) * 2 + 12 AS order, CAST(NULL AS DOUBLE) AS zero, CAST(NULL AS DOUBLE) AS text"),
)


def aggregates(spark: SparkSession, d: str) -> DataFrame:
    got = DocumentFrame(order_docs(spark, d)).values(total=("$.quantities.sum()", "double"), low=("min($.quantities)", "double"), high=("$.quantities.max()", "double"), mean=("$.quantities.avg()", "double"), spread=("stddev($.quantities)", "double"), n=("$.quantities.length()", "bigint"), strings=("$.flags.sum()", "double"))
    return got.withColumns({"mean": F.round("mean", 6), "spread": F.round("spread", 6)})


query("functions_aggregate", aggregates, _sql("sum(l_quantity) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS spread, count(*) AS n, CAST(NULL AS DOUBLE) AS strings"))
query(
    "functions_scalar",
    _values(
        order_docs, up=("ceiling($.o_totalprice)", "bigint"), down=("floor($.o_totalprice)", "bigint"), size=("abs($.o_totalprice)", "double"), joined=('concat($.o_orderstatus, "-", $.flags[0])', "string"), letters=("$.o_orderstatus.length()", "bigint"), first=("$.quantities.first()", "double"), last=("$.quantities.last()", "double"),
        second=("$.quantities.index(1)", "double"), nodes=("count($.items[*])", "bigint"), one=("value($.o_orderkey)", "bigint"), unknown=("$.o_orderkey.bogus()", "bigint"), arity=("abs($.o_orderkey, 1)", "bigint"),
    ),
    _sql("CAST(ceil(any_value(o_totalprice)) AS BIGINT) AS up, CAST(floor(any_value(o_totalprice)) AS BIGINT) AS down, any_value(o_totalprice) AS size, any_value(o_orderstatus) || '-' || max(l_returnflag) FILTER (i = 1) AS joined, CAST(length(any_value(o_orderstatus)) AS BIGINT) AS letters, max(l_quantity) FILTER (i = 1) AS first, max(l_quantity) FILTER (i = n) AS last, max(l_quantity) FILTER (i = 2) AS second, count(*) AS nodes, l_orderkey AS one, CAST(NULL AS BIGINT) AS unknown, CAST(NULL AS BIGINT) AS arity"),
)
query(
    "functions_keys_append",
    _values(order_docs, names=("$~", "count"), fields=("$.items[*].keys()", "count"), longer=("$.items.append(1).length()", "bigint"), wrapped=("$.quantities.append($.flags).count()", "bigint"), nothing=("$.items.append($.nope)", "count")),
    _sql("CAST(6 AS BIGINT) AS names, 5 * count(*) AS fields, count(*) + 1 AS longer, count(*) + 1 AS wrapped, CAST(0 AS BIGINT) AS nothing"),
)

# -- reads

_one = lambda **c: lambda s, d: order_docs(s, d).select("key", *[x().alias(n) for n, x in c.items()])
query("read_type", _one(root=lambda: J.jp_type("doc", "."), number=lambda: J.jp_type("doc", "$.o_orderkey")[0], price=lambda: J.jp_type("doc", "$.quantities[0]")[0], many=lambda: F.size(J.jp_type("doc", "$.items[*]")).cast("bigint"), none=lambda: J.jp_type("doc", "nope")), _sql("'object' AS root, 'integer' AS number, 'number' AS price, count(*) AS many, CAST(NULL AS VARCHAR) AS none"))


def strlen(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("text", "turn")).alias("doc"))
    return docs.select("conv_id", "turn", J.jp_strlen("doc", "$.text")[0].alias("bytes"), json_value("doc", "$.text.length()", "bigint").alias("letters"), J.jp_strlen("doc", "$.turn")[0].alias("wrong"))


query("read_strlen", strlen, "SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS letters, CAST(NULL AS BIGINT) AS wrong FROM conversations")
query("read_arrlen", _one(n=lambda: J.jp_arrlen("doc", "$.items")[0], legacy=lambda: J.jp_arrlen("doc", "items"), wrong=lambda: J.jp_arrlen("doc", "$.o_orderkey")[0]), _sql("count(*) AS n, count(*) AS legacy, CAST(NULL AS BIGINT) AS wrong"))
query("read_objlen", _one(n=lambda: J.jp_objlen("doc", "$")[0], inner=lambda: F.size(J.jp_objlen("doc", "$.items[*]")).cast("bigint"), missing=lambda: J.jp_objlen("doc", "nope")), _sql("CAST(6 AS BIGINT) AS n, count(*) AS inner, CAST(NULL AS BIGINT) AS missing"))
query("read_objkeys", _one(names=lambda: F.array_join(J.jp_objkeys("doc", "$")[0], ","), inner=lambda: F.array_join(J.jp_objkeys("doc", "items[0]"), ",")), _sql("'o_orderkey,o_orderstatus,o_totalprice,items,quantities,flags' AS names, 'l_linenumber,l_partkey,l_suppkey,l_quantity,l_returnflag' AS inner"))
query("read_arrindex", _one(at=lambda: J.jp_arrindex("doc", "$.flags", '"R"')[0], later=lambda: J.jp_arrindex("doc", "$.flags", '"R"', 1)[0], typed=lambda: J.jp_arrindex("doc", "$.quantities", "25")[0]), _sql("coalesce(min(i) FILTER (l_returnflag = 'R'), 0) - 1 AS at, CASE WHEN count(*) = 1 THEN CASE WHEN max(l_returnflag) = 'R' THEN 0 ELSE -1 END ELSE coalesce(min(i) FILTER (l_returnflag = 'R' AND i > 1), 0) - 1 END AS later, CAST(-1 AS BIGINT) AS typed"))
query("read_get_many", _one(price=lambda: F.get_json_object(J.jp_get("doc", "$.o_totalprice", "$.o_orderkey"), "$['$.o_totalprice'][0]").cast("double"), number=lambda: F.get_json_object(J.jp_get("doc", "o_orderkey", ".o_totalprice"), "$.o_orderkey").cast("bigint")), _sql("any_value(o_totalprice) AS price, l_orderkey AS number"))


def mget(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("key"), F.col("o_orderkey").alias("ordinal"))
    got = DocumentFrame(order_docs(spark, d)).mget(keys, "$.o_orderkey")
    return got.select("ordinal", "key", F.get_json_object("value", "$[0]").cast("bigint").alias("found"))


query("read_mget", mget, "SELECT o.o_orderkey AS ordinal, o.o_orderkey * 3 AS key, f.o_orderkey AS found FROM orders o LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) f ON f.o_orderkey = o.o_orderkey * 3")


# -- texts and protocol trees, over small documents whose text SQL can build


def small_docs(spark: SparkSession, d: str) -> DataFrame:
    """(key, doc): a customer's key, name, a nested object and an array."""
    doc = F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("n"), F.lit(True).alias("t")).alias("in"), F.array("c_custkey", "c_nationkey").alias("xs"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.to_json(doc).alias("doc"))


_K, _N = "CAST(c_custkey AS VARCHAR)", "CAST(c_nationkey AS VARCHAR)"


def _small(*parts: str) -> str:
    """SQL that puts a text together: pieces of text by turns with column names k, n, name."""
    names = {"k": _K, "n": _N, "name": "c_name", "nl": "chr(10)"}
    return " || ".join(names[p[1:]] if p.startswith(":") else "'" + p.replace("'", "''") + "'" for p in parts)


def _text(name: str, column: Callable, *parts: str) -> None:
    query(name, lambda s, d: small_docs(s, d).select("key", column().alias("text")), f"SELECT c_custkey AS key, {_small(*parts)} AS text FROM customer")


_text("read_resp", lambda: J.jp_resp("doc", "$"), '[["{","k",', ":k", ',"name","', ":name", '","in",["{","n",', ":n", ',"t","true"],"xs",["[",', ":k", ",", ":n", "]]]")
_text("read_resp_legacy", lambda: J.jp_resp("doc", ".in"), '["{","n",', ":n", ',"t","true"]')
_text("read_pretty", lambda: J.jp_get("doc", "$", indent="  ", newline="\n", space=" "), "[", ":nl", "  {", ":nl", '    "k": ', ":k", ",", ":nl", '    "name": "', ":name", '",', ":nl", '    "in": {', ":nl", '      "n": ', ":n", ",", ":nl", '      "t": true', ":nl", "    },", ":nl", '    "xs": [', ":nl", "      ", ":k", ",", ":nl", "      ", ":n", ":nl", "    ]", ":nl", "  }", ":nl", "]")
_text("read_expand", lambda: J.jp_expand("doc", "$.in", "$.xs[*]"), '[[{"n":', ":n", ',"t":true}],[', ":k", ",", ":n", "]]")
_text("read_expand_flat", lambda: J.jp_expand("doc", "$.in", "$.k", mode="EXPAND1"), '[["{\\"n\\":', ":n", ',\\"t\\":true}"],[', ":k", "]]")
_text("read_expand_strings", lambda: J.jp_expand("doc", "$.k", mode="STRINGS"), '[["', ":k", '"]]')
_text("edit_set_narrow_floats", lambda: J.jp_set("doc", "$.xs", "[0.1,3.14159,2]", "", "FP16")["doc"], '{"k":', ":k", ',"name":"', ":name", '","in":{"n":', ":n", ',"t":true},"xs":[0.1,3.14,2.0]}')
_text("edit_set_narrow_floats_refused", lambda: J.jp_set("doc", "$.xs", "[70000.5]", "", "FP16")["doc"], '{"k":', ":k", ',"name":"', ":name", '","in":{"n":', ":n", ',"t":true},"xs":[', ":k", ",", ":n", "]}")
query("read_debug_memory", lambda s, d: small_docs(s, d).select("key", F.get_json_object(J.jp_debug_memory("doc", "$.name").cast("string"), "$[0]").cast("bigint").alias("bytes")), "SELECT c_custkey AS key, CAST(strlen(c_name) + 2 AS BIGINT) AS bytes FROM customer")


def from_bson(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose BSON is put together from the columns: {"v": {"n": int32, "s": string, "when": date}}."""
    inner = "concat('106E00', hex(char(c_nationkey % 100)), '000000', '027300', hex(char(length(c_name) + 1)), '000000', hex(c_name), '00', '097700', '00E40B5402000000', '00')"
    body = f"concat(hex(char(length({inner}) div 2 + 4)), '000000', {inner})"
    raw = f"unhex(concat(hex(char(length({body}) div 2 + 8)), '000000', '037600', {body}, '00'))"
    return table(spark, d, "customer").where("c_nationkey > 0").select(F.col("c_custkey").alias("key"), J.jp_from_bson(F.expr(raw)).alias("text"))


query("source_bson", from_bson, f"""SELECT c_custkey AS key, {_small('{"n":', ":n", ',"s":"', ":name", '","w":{"$date":"1970-04-26T17:46:40Z"}}')} AS text FROM customer WHERE c_nationkey > 0""")


def copied(spark: SparkSession, d: str) -> DataFrame:
    return DocumentFrame(small_docs(spark, d)).copy(1, 2).df.select("key", json_value("doc", "$.k", "bigint").alias("k"))


query("write_copy", copied, "SELECT c_custkey AS key, CASE WHEN c_custkey = 2 THEN 1 ELSE c_custkey END AS k FROM customer")
query("read_lookup", lambda s, d: DocumentFrame(small_docs(s, d)).lookup(7).df, f"""SELECT c_custkey AS key, {_small('{"k":', ":k", ',"name":"', ":name", '","in":{"n":', ":n", ',"t":true},"xs":[', ":k", ",", ":n", "]}")} AS doc FROM customer WHERE c_custkey = 7""")


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as a snapshot and read again, in the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(small_docs(spark, d), path)
    return read_table(spark, path, "key", "doc")


query("write_snapshot", snapshot, f"""SELECT c_custkey AS key, {_small('{"k":', ":k", ',"name":"', ":name", '","in":{"n":', ":n", ',"t":true},"xs":[', ":k", ",", ":n", "]}")} AS doc FROM customer""")

# -- edits


def edited(steps: list[tuple], **wanted: tuple[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """Values read from order documents after edits."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = order_docs(spark, d).select("key", J.jp_apply("doc", *steps)["doc"].alias("doc"))
        return DocumentFrame(docs).values(**wanted)

    return run


query("edit_set", edited([("set", "$.items[*].l_quantity", "7"), ("set", "$.note", '{"a":[1]}'), ("set", "$.nope.deep", "1")], total=("$.items[*].l_quantity", "count"), seven=("$.items[?@.l_quantity == 7]", "count"), note=("$.note.a[0]", "bigint"), deep=("$..deep", "count")), _sql("count(*) AS total, count(*) AS seven, CAST(1 AS BIGINT) AS note, CAST(0 AS BIGINT) AS deep"))
query("edit_set_when", edited([("set", "$.o_orderkey", "1", "NX"), ("set", "$.fresh", "2", "NX"), ("set", "$.other", "3", "XX"), ("set", "$.o_totalprice", "4", "XX")], number=("$.o_orderkey", "bigint"), fresh=("$.fresh", "bigint"), other=("$.other", "bigint"), price=("$.o_totalprice", "bigint")), _sql("l_orderkey AS number, CAST(2 AS BIGINT) AS fresh, CAST(NULL AS BIGINT) AS other, CAST(4 AS BIGINT) AS price"))
query("edit_merge", edited([("merge", "$", '{"o_orderstatus":null,"extra":{"a":1},"flags":[]}')], status=("$.o_orderstatus", "string"), extra=("$.extra.a", "bigint"), flags=("$.flags[*]", "count"), items=("$.items[*]", "count")), _sql("CAST(NULL AS VARCHAR) AS status, CAST(1 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS flags, count(*) AS items"))


def deleted(spark: SparkSession, d: str) -> DataFrame:
    docs = order_docs(spark, d).select("key", J.jp_del("doc", "$.items[?@.l_quantity > 25]").alias("r"))
    return DocumentFrame(docs.select("key", "r.reply", F.col("r.doc").alias("doc"))).df.select("key", F.col("reply").cast("bigint").alias("gone"), json_value("doc", "$.items[*]", "count").alias("left"))


query("edit_del", deleted, _sql("count(*) FILTER (l_quantity > 25) AS gone, count(*) FILTER (l_quantity <= 25) AS left"))
query("edit_clear", edited([("clear", "$.items"), ("clear", "$.quantities[*]"), ("clear", "$.o_orderstatus")], items=("$.items[*]", "count"), zeros=("$.quantities[?@ == 0]", "count"), status=("$.o_orderstatus", "string")), _sql("CAST(0 AS BIGINT) AS items, count(*) AS zeros, any_value(o_orderstatus) AS status"))


def toggled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.to_json(F.struct((F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderkey").alias("n"))).alias("doc"))
    return docs.select("key", J.jp_toggle("doc", "$.*").alias("r")).select("key", F.get_json_object("r.reply", "$[0]").cast("bigint").alias("reply"), json_value(F.col("r.doc"), "$.done", "boolean").alias("done"))


query("edit_toggle", toggled, "SELECT o_orderkey AS key, CAST(o_orderstatus <> 'F' AS BIGINT) AS reply, o_orderstatus <> 'F' AS done FROM orders")
query("edit_numbers", edited([("numincrby", "$.o_orderkey", "5"), ("nummultby", "$.o_orderkey", "2"), ("numincrby", "$.items[*].l_quantity", "0.5"), ("set", "$.base", "3"), ("numpowby", "$.base", "4")], number=("$.o_orderkey", "bigint"), first=("$.items[0].l_quantity", "double"), power=("$.base", "bigint")), _sql("(l_orderkey + 5) * 2 AS number, max(l_quantity) FILTER (i = 1) + 0.5 AS first, CAST(81 AS BIGINT) AS power"))
query("edit_strappend", edited([("strappend", "$.o_orderstatus", '"-é"')], status=("$.o_orderstatus", "string")), _sql("any_value(o_orderstatus) || '-é' AS status"))
query("edit_arrappend", edited([("arrappend", "$.flags", '"X"', '"Y"')], last=("$.flags[-1]", "string"), n=("$.flags[*]", "count")), _sql("'Y' AS last, count(*) + 2 AS n"))
query("edit_arrinsert", edited([("arrinsert", "$.quantities", -1, "100", "200")], n=("$.quantities[*]", "count"), last=("$.quantities[-1]", "double"), before=("$.quantities[-2]", "double")), _sql("count(*) + 2 AS n, max(l_quantity) FILTER (i = n) AS last, CAST(200 AS DOUBLE) AS before"))


def popped(spark: SparkSession, d: str) -> DataFrame:
    docs = order_docs(spark, d).select("key", J.jp_arrpop("doc", "$.quantities", 0).alias("r"))
    return docs.select("key", F.get_json_object("r.reply", "$[0]").cast("double").alias("popped"), json_value(F.col("r.doc"), "$.quantities[*]", "count").alias("left"))


query("edit_arrpop", popped, _sql("max(l_quantity) FILTER (i = 1) AS popped, count(*) - 1 AS left"))


def popped_whole(spark: SparkSession, d: str) -> DataFrame:
    docs = order_docs(spark, d).select("key", J.jp_arrpop("doc", "$.items", 0, "EXPAND").alias("r"))
    return docs.select("key", F.get_json_object("r.reply", "$[0].l_quantity").cast("double").alias("popped"), json_value(F.col("r.doc"), "$.items[*]", "count").alias("left"))


query("edit_arrpop_format", popped_whole, _sql("max(l_quantity) FILTER (i = 1) AS popped, count(*) - 1 AS left"))
query("edit_arrtrim", edited([("arrtrim", "$.quantities", 1, 2), ("arrtrim", "$.flags", -2, -1)], middle=("$.quantities[*]", "count"), tail=("$.flags[*]", "count")), _sql("count(*) FILTER (i IN (2, 3)) AS middle, count(*) FILTER (i > n - 2) AS tail"))
query("edit_column_argument", lambda s, d: order_docs(s, d).select("key", J.jp_numincrby("doc", "$.o_orderkey", F.col("key").cast("string")).alias("r")).select("key", json_value(F.col("r.doc"), "$.o_orderkey", "bigint").alias("twice")), _sql("2 * l_orderkey AS twice"))


def user_docs(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key")).distinct()
    return users.withColumn("doc", F.lit('{"n":0,"kinds":{}}'))


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.lit("numincrby").alias("op"), F.array(F.lit("$.n"), F.get_json_object("props", "$.k")).alias("args"))


def folded(spark: SparkSession, d: str) -> DataFrame:
    after = DocumentFrame(user_docs(spark, d)).apply_log(event_log(spark, d))
    return after.select("key", json_value("doc", "$.n", "bigint").alias("n"))


query("edit_log", folded, "SELECT CAST(user_id AS VARCHAR) AS key, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS n FROM events GROUP BY user_id")


def event_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.lit("$.last").alias("path"), F.get_json_object("props", "$.k").alias("value"))


def mset(spark: SparkSession, d: str) -> DataFrame:
    return DocumentFrame(user_docs(spark, d)).sets(event_sets(spark, d)).select("key", json_value("doc", "$.last", "bigint").alias("last"))


query("edit_mset", mset, "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS last FROM events GROUP BY user_id")
# As one command, places are found first: the first to add a member does, the others find it there.
query("edit_mset_joint", lambda s, d: DocumentFrame(user_docs(s, d)).mset(event_sets(s, d)).select("key", json_value("doc", "$.last", "bigint").alias("first")), "SELECT CAST(user_id AS VARCHAR) AS key, arg_min(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS first FROM events GROUP BY user_id")
query("change_feed", lambda s, d: DocumentFrame(user_docs(s, d)).apply_log(event_log(s, d), feed=True).groupBy("event").agg(F.count(F.lit(1)).alias("n")), "SELECT 'json.numincrby' AS event, count(*) AS n FROM events")



def mset_reply(spark: SparkSession, d: str) -> DataFrame:
    """One joint set: every customer's name, and for those of nation 3 a member that cannot be made."""
    docs = small_docs(spark, d)
    sets = docs.select(F.col("key").cast("string"), F.lit(1).alias("seq"), F.lit("$.name").alias("path"), F.lit('"x"').alias("value"))
    more = docs.where(json_value("doc", "$.in.n", "bigint") == 3).select(F.col("key").cast("string"), F.lit(2).alias("seq"), F.lit("$.no.such").alias("path"), F.lit("1").alias("value"))
    return DocumentFrame(docs).mset_reply(sets.unionByName(more))


query("edit_mset_reply", mset_reply, "SELECT CAST(CASE WHEN count_if(c_nationkey = 3) > 0 THEN NULL ELSE 'OK' END AS VARCHAR) AS reply, CAST(NULL AS VARCHAR) AS error FROM customer")


def timed_feed(spark: SparkSession, d: str) -> DataFrame:
    """Changes by hour of their event time."""
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", F.lit("numincrby").alias("op"), F.array(F.lit("$.n"), F.lit("1")).alias("args"))
    feed = DocumentFrame(user_docs(spark, d)).apply_log(log, feed=True)
    return event_counts(feed, "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event", "n")


query("change_feed_windows", timed_feed, "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, 'json.numincrby' AS event, count(*) AS n FROM events GROUP BY 1")

# -- the node table


def node_types(spark: SparkSession, d: str) -> DataFrame:
    return nodes(order_docs(spark, d), columns=("type", "depth")).groupBy("type", "depth").agg(F.count(F.lit(1)).alias("n"))


query(
    "nodes_histogram",
    node_types,
    """
WITH it AS (SELECT l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey), o AS (SELECT count(DISTINCT l_orderkey) AS k, count(*) AS n FROM it)
SELECT t.type, CAST(t.depth AS INTEGER) AS depth, CAST(t.a * k + t.b * n AS BIGINT) AS n
FROM o, (VALUES ('object', 0, 1, 0), ('integer', 1, 1, 0), ('string', 1, 1, 0), ('number', 1, 1, 0), ('array', 1, 3, 0), ('object', 2, 0, 1), ('number', 2, 0, 1), ('string', 2, 0, 1), ('integer', 3, 0, 3), ('number', 3, 0, 1), ('string', 3, 0, 1)) t(type, depth, a, b)""",
)


def node_sums(spark: SparkSession, d: str) -> DataFrame:
    found = nodes(order_docs(spark, d), path="$.items[*].l_quantity", root=False, columns=("dbl", "ordinal"))
    return found.groupBy("key").agg(F.sum("dbl").alias("total"), F.max("ordinal").cast("bigint").alias("last"))


query("nodes_aggregate", node_sums, _sql("sum(l_quantity) AS total, count(*) - 1 AS last"))


def node_join(spark: SparkSession, d: str) -> DataFrame:
    parts = nodes(order_docs(spark, d), path="$.items[*].l_partkey", root=False, columns=("long",)).select("key", F.col("long").alias("p_partkey"))
    return parts.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


query("nodes_join", node_join, "SELECT p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand")

# -- declared schemas


def typed(spark: SparkSession, d: str) -> DataFrame:
    parsed = order_docs(spark, d).select("key", F.from_json("doc", ORDER).alias("o"))
    t = Typed.parsed(F.col("o"), ORDER)
    return parsed.select(
        "key", F.size(t.path('$.items[?(@.l_quantity > 25 && @.l_returnflag == "R")]')).cast("bigint").alias("both"), F.size(t.path("$.items[1:3]")).cast("bigint").alias("middle"), t.path("$.quantities.sum()").alias("total"), t.path("$.items[-1].l_partkey").alias("last"),
        F.size(t.path("$.items[?@.l_quantity > $.quantities[0]]")).cast("bigint").alias("above"), t.path("$.quantities.length()").alias("n"), (t.path("$.o_totalprice * 2")).alias("twice"),
    )


query(
    "typed_paths",
    typed,
    f"{LINES}, f AS (SELECT l_orderkey AS k, max(l_quantity) FILTER (i = 1) AS q FROM it GROUP BY l_orderkey) SELECT k AS key, count(*) FILTER (l_quantity > 25 AND l_returnflag = 'R') AS both, count(*) FILTER (i IN (2, 3)) AS middle, sum(l_quantity) AS total, max(l_partkey) FILTER (i = n) AS last, count(*) FILTER (l_quantity > q) AS above, count(*) AS n, any_value(o_totalprice) * 2 AS twice FROM it JOIN f ON k = l_orderkey GROUP BY k",
)
query(
    "values_declared",
    lambda s, d: DocumentFrame(order_docs(s, d), schema=ORDER).values(
        total=("$.quantities.sum()", "double"), n=("$.items[*]", "count"), parts=("$.items[?(@.l_quantity > 25)].l_partkey", "count"), first=("$.items[0].l_partkey", "bigint"), status=("$.o_orderstatus", "string"), price=("$.o_totalprice", "double"), returned=('$.items[?@.l_returnflag == "R"].l_quantity', "double")
    ),
    _sql("sum(l_quantity) AS total, count(*) AS n, count(*) FILTER (l_quantity > 25) AS parts, max(l_partkey) FILTER (i = 1) AS first, any_value(o_orderstatus) AS status, any_value(o_totalprice) AS price, min_by(l_quantity, i) FILTER (l_returnflag = 'R') AS returned"),
)
query("source_valid", lambda s, d: event_docs(s, d).select("event_type", J.jp_valid("doc").alias("ok")).groupBy("event_type").agg(F.count_if("ok").alias("valid")), "SELECT event_type, count(*) AS valid FROM events GROUP BY event_type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static_get(spark, sf_dir)
