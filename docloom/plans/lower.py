"""Native lowering.

``json_value``: one scalar at a path of plain names. ``from_json`` with just that path's schema reads
a bigint, double or boolean exactly as the evaluator does (another type gives null, the last of
repeated keys wins), so those are lowered; everything else goes through the Arrow evaluator.

``Typed``: documents whose schema is declared and true. The document is parsed once by ``from_json``
and paths become struct fields and higher-order functions inside code generation. Only what has a test
of equivalence with the evaluator is accepted; anything else raises :class:`NotLowered`.

``declared``: the parse that ``DocumentFrame.values`` shares among the paths of documents with a declared
schema. A text that is no JSON, or breaks the schema, is told apart there, and gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..path import ast as A
from ..path.rewrite import compile_path


class NotLowered(ValueError):
    """A path that has no native form."""


def lowerable(path: str, kind: str) -> bool:
    compiled = compile_path(path)
    return kind in ("bigint", "double", "boolean") and bool(compiled.steps) and compiled.static and all(isinstance(s, A.Names) for s in compiled.steps)


def json_value(doc: Column | str, path: str, kind: str, native: bool | None = None) -> Column:
    """The scalar at a path if it is of the kind (bigint, double, string, boolean, json, count, array<...>), else null."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    if native is None:
        native = lowerable(path, kind)
    if not native:
        from ..functions import jp_values

        return jp_values(doc, v=(path, kind))["v"]
    names = [s.names[0] for s in compile_path(path).steps]
    schema: T.DataType = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[kind]
    for n in reversed(names):
        schema = T.StructType([T.StructField(n, schema)])
    out = F.from_json(doc, schema, {"allowNonNumericNumbers": "false"})
    for n in names:
        out = out.getField(n)
    return out


#: The field of :func:`declared` that holds the text of a document that breaks its schema.
BROKEN = "__broken"


def declared(doc: Column | str, schema: str | T.DataType) -> Column:
    """The document as a struct of its declared schema, and, in field ``__broken``, its text where it does not keep it."""
    kind = _struct(schema)
    whole = T.StructType([*kind.fields, T.StructField(BROKEN, T.StringType())])
    options = {"columnNameOfCorruptRecord": BROKEN, "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}
    return F.from_json(F.col(doc) if isinstance(doc, str) else doc, whole, options)


def _struct(schema: str | T.DataType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


_ORDER = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _field(name: str):
    return lambda x: x.getField(name)


class Typed:
    """Paths over a column of documents with a declared schema (DDL of the root)."""

    def __init__(self, doc: Column | str, schema: str | T.DataType):
        self.schema = _struct(schema)
        self.root = F.from_json(F.col(doc) if isinstance(doc, str) else doc, self.schema)

    #: Refuse arithmetic, which overflows in another way than the evaluator's.
    exact = False

    @classmethod
    def parsed(cls, column: Column, schema: str | T.DataType, exact: bool = False) -> Typed:
        """Over a column that holds the parsed struct, so that several paths share one parse."""
        out = cls.__new__(cls)
        out.exact = exact
        out.schema = _struct(schema)
        out.root = column
        return out

    def path(self, path: str) -> Column:
        """A scalar for a static path, an array of the matches otherwise; or a projection's value."""
        tree = compile_path(path).tree
        return self._value(tree, self.root, self.schema)[0]

    def value(self, path: str, kind: str) -> Column:
        """What the evaluator gives for a path and a kind (see ``functions.jp_values``); the root is :func:`declared`.

        Null for a null document and for one that breaks the schema. Whole and other numbers compare as doubles.
        """
        col, inner, many = self._value(compile_path(path).tree, self.root, self.schema)
        if kind == "count" or kind.startswith("array<"):
            if not many:
                raise NotLowered("a missing member and null are told apart")
            out = F.size(col).cast("bigint") if kind == "count" else F.transform(col, lambda x: self._cast(x, inner, kind[6:-1]))
        else:
            out = self._cast(F.try_element_at(col, F.lit(1)) if many else col, inner, kind)
        return F.when(self.root.isNotNull() & self.root[BROKEN].isNull(), out)

    @staticmethod
    def _cast(col: Column, inner: T.DataType | None, kind: str) -> Column:
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        fits = {"bigint": whole, "double": (*whole, T.FloatType, T.DoubleType), "string": (T.StringType,), "boolean": (T.BooleanType,)}
        if not isinstance(inner, fits.get(kind, ())):
            raise NotLowered(f"{kind} of another type")
        return col.cast(kind)

    # Each rule gives (column, type, whether it is an array of matches).

    def _value(self, tree, cur: Column, kind: T.DataType) -> tuple[Column, T.DataType | None, bool]:
        if isinstance(tree, A.Literal):
            if tree.json is not None:
                raise NotLowered("container constant")
            return F.lit(tree.value), None, False
        if isinstance(tree, A.Path):
            start = (self.root, self.schema) if tree.root == "$" else (cur, kind)
            return self._steps(tree.steps, *start)
        if self.exact and isinstance(tree, (A.Binary, A.Unary)):
            raise NotLowered("arithmetic")
        if isinstance(tree, A.Binary):
            a, b = (self._number(x, cur, kind) for x in (tree.left, tree.right))
            if tree.op == "/":
                return F.try_divide(a, b), T.DoubleType(), False
            if tree.op == "%":
                raise NotLowered("remainder")
            a, b = a.cast("double"), b.cast("double")
            return (a + b if tree.op == "+" else a - b if tree.op == "-" else a * b), T.DoubleType(), False
        if isinstance(tree, A.Unary):
            n = self._number(tree.value, cur, kind).cast("double")
            return (-n if tree.op == "-" else n), T.DoubleType(), False
        return self._call(tree, cur, kind)

    def _number(self, tree, cur: Column, kind: T.DataType) -> Column:
        col, _, many = self._value(tree, cur, kind)
        if many:
            raise NotLowered("several nodes as a number")
        return col

    def _call(self, tree: A.Call, cur: Column, kind: T.DataType) -> tuple[Column, T.DataType | None, bool]:
        if len(tree.args) != 1:
            raise NotLowered(tree.name)
        col, inner, many = self._value(tree.args[0], cur, kind)
        if many or not isinstance(inner, T.ArrayType):
            raise NotLowered(f"{tree.name} of what is not one array")
        if tree.name == "length":
            return F.when(col.isNotNull(), F.size(col)).cast("bigint"), T.LongType(), False
        if tree.name in ("first", "last"):
            return F.try_element_at(col, F.lit(1 if tree.name == "first" else -1)), inner.elementType, False
        if tree.name not in ("sum", "min", "max", "avg", "stddev") or not isinstance(inner.elementType, T.NumericType):
            raise NotLowered(tree.name)
        ok = (F.size(col) > 0) & F.forall(col, lambda x: x.isNotNull())
        total = F.aggregate(col, F.lit(0.0), lambda a, x: a + x)
        mean = total / F.size(col)
        spread = F.sqrt(F.aggregate(col, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(col))
        got = {"sum": total, "min": F.array_min(col), "max": F.array_max(col), "avg": mean, "stddev": spread}[tree.name]
        return F.when(ok, got.cast("double")), T.DoubleType(), False

    def _steps(self, steps: tuple, cur: Column, kind: T.DataType) -> tuple[Column, T.DataType, bool]:
        many = False  # cur: an array of matches
        for step in steps:
            if isinstance(step, A.Names) and len(step.names) == 1:
                name = step.names[0]
                if not isinstance(kind, T.StructType) or name not in kind.names:
                    raise NotLowered(f"{name} is not declared")
                inner = kind[name].dataType
                # A member that is missing is not a match.
                cur = F.filter(F.transform(cur, _field(name)), lambda x: x.isNotNull()) if many else cur.getField(name)
                kind = inner
                continue
            if not isinstance(kind, T.ArrayType):
                raise NotLowered("a selector of elements on what is not an array")
            if many:
                cur = F.flatten(F.transform(cur, self._each(step, kind)))
            elif isinstance(step, A.Indexes) and len(step.indexes) == 1:
                i = step.indexes[0]
                cur, kind = F.get(cur, F.lit(i) if i >= 0 else F.greatest(F.size(cur) + i, F.lit(0))), kind.elementType
                continue
            else:
                cur = F.coalesce(self._elements(step, cur, kind), F.array().cast(T.ArrayType(kind.elementType)))
            kind, many = kind.elementType, True
        return cur, kind, many

    def _each(self, step, kind: T.ArrayType):
        return lambda x: self._elements(step, x, kind)

    def _elements(self, step, arr: Column, kind: T.ArrayType) -> Column:
        if isinstance(step, A.Wildcard):
            return arr
        if isinstance(step, A.Slice):
            n = F.size(arr)
            at = lambda i: F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))
            low = F.lit(0) if step.start is None else at(step.start)
            high = n if step.stop is None else at(step.stop)
            return F.filter(arr, lambda x, i: (i >= low) & (i < high) & ((i - low) % step.step == 0))
        if isinstance(step, A.Filter):
            return F.filter(arr, lambda x: self._test(step.test, x, kind.elementType))
        raise NotLowered(type(step).__name__)

    def _test(self, tree, cur: Column, kind: T.DataType) -> Column:
        if isinstance(tree, A.Not):
            return ~self._test(tree.test, cur, kind)
        if isinstance(tree, (A.And, A.Or)):
            out = self._test(tree.tests[0], cur, kind)
            for t in tree.tests[1:]:
                out = out & self._test(t, cur, kind) if isinstance(tree, A.And) else out | self._test(t, cur, kind)
            return out
        if isinstance(tree, A.Exists):
            col, _, many = self._value(tree.value, cur, kind)
            if many or not isinstance(tree.value, A.Path):
                raise NotLowered("existence")
            return col.isNotNull()
        (a, ka, ma), (b, kb, mb) = (self._value(x, cur, kind) for x in (tree.left, tree.right))
        if ma or mb or not self._comparable(ka, kb, tree):
            raise NotLowered("comparison")
        if tree.op == "==":
            return F.coalesce(a == b, F.lit(False))
        if tree.op == "!=":
            return ~F.coalesce(a == b, F.lit(False))
        if tree.op in _ORDER:
            return F.coalesce(getattr(a, _ORDER[tree.op])(b), F.lit(False))
        raise NotLowered(tree.op)

    @staticmethod
    def _comparable(ka: T.DataType | None, kb: T.DataType | None, tree: A.Compare) -> bool:
        def family(k: T.DataType | None, x) -> str:
            if k is None:
                v = x.value if isinstance(x, A.Literal) else None
                return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "null"
            return "bool" if isinstance(k, T.BooleanType) else "number" if isinstance(k, T.NumericType) else "text" if isinstance(k, T.StringType) else "other"

        a, b = family(ka, tree.left), family(kb, tree.right)
        return a == b and a in ("bool", "number", "text")
