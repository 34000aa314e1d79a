"""Column functions over a column of JSON text.

Each is one Arrow function: the document is parsed once, however many paths are asked for. A null
document is the document of a key that has none. Paths are compiled on the driver first, so one that
does not parse raises before anything runs. ``strict`` raises on a command's error; otherwise the
result is null there (edits carry the message).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codec import JsonError, dumps, from_bson, loads
from ..operators import edits, reads
from ..operators.reads import ABSENT, CommandError
from ..path.evaluate import I64_MAX, I64_MIN, located, values
from ..path.rewrite import compile_path

_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "json": pa.string(), "count": pa.int64()}


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else _ARROW[kind]


def _ddl(kind: str) -> str:
    return f"array<{_ddl(kind[6:-1])}>" if kind.startswith("array<") else {"json": "string", "count": "bigint"}.get(kind, kind)


def _run(ddl: str, arrow: pa.DataType, function: Callable, *inputs: Any) -> Column:
    """function over values: Columns among ``inputs`` by row, the rest as constants."""
    cols = [x for x in inputs if isinstance(x, Column)]
    spots = [i for i, x in enumerate(inputs) if isinstance(x, Column)]
    fixed = [None if isinstance(x, Column) else x for x in inputs]

    def run(*arrays: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(a.to_pylist() for a in arrays), strict=True):
            args = list(fixed)
            for i, x in zip(spots, row, strict=True):
                args[i] = x
            out.append(function(*args))
        return pa.array(out, arrow)

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl)(*cols)


def _column(doc: Column | str) -> Column:
    return F.col(doc) if isinstance(doc, str) else doc


def _document(text: str | None) -> Any:
    return ABSENT if text is None else loads(text)


def _guard(function: Callable, strict: bool) -> Callable:
    def run(text: str | None, *args: Any) -> Any:
        try:
            return function(_document(text), *args)
        except (CommandError, JsonError):
            if strict:
                raise
            return None

    return run


# -- reading values


def typed(found: list, kind: str) -> Any:
    """What a list of matches is as a value of a kind; null where it is not of that kind."""
    if kind == "count":
        return len(found)
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return [typed([v], inner) for v in found]
    if not found:
        return None
    v = found[0]
    if kind == "json":
        return dumps(v)
    if kind == "boolean":
        return v if isinstance(v, bool) else None
    if isinstance(v, bool):
        return None
    if kind == "bigint":
        return v if isinstance(v, int) and I64_MIN <= v <= I64_MAX else None
    if kind == "double":
        return float(v) if isinstance(v, (int, float)) else None
    return v if isinstance(v, str) else None


def jp_values(doc: Column | str, strict: bool = False, **wanted: tuple[str, str]) -> Column:
    """STRUCT of name = (path, kind): all paths of one document by one parse.

    Kinds: bigint, double, string, boolean (the first match, if it is of that kind), json (its text),
    count (how many matches), and array<...> of these (all matches).
    """
    compiled = [(name, compile_path(path), kind) for name, (path, kind) in wanted.items()]

    def run(text: str | None) -> dict | None:
        if text is None:
            return None
        try:
            value = loads(text)
        except JsonError:
            if strict:
                raise
            return None
        return {name: typed(values(path, value), kind) for name, path, kind in compiled}

    ddl = "struct<" + ",".join(f"`{n}`:{_ddl(k)}" for n, _, k in compiled) + ">"
    return _run(ddl, pa.struct([(n, _arrow(k)) for n, _, k in compiled]), run, _column(doc))


def jp_query(doc: Column | str, path: str, strict: bool = False) -> Column:
    """ARRAY<STRING>: the text of every match, in order; null for a null or bad document."""
    compiled = compile_path(path)

    def run(value: Any) -> list | None:
        return None if value is ABSENT else [dumps(v) for v in values(compiled, value)]

    return _run("array<string>", pa.list_(pa.string()), _guard(run, strict), _column(doc))


def jp_paths(doc: Column | str, path: str, strict: bool = False) -> Column:
    """ARRAY<STRUCT<path: ARRAY<STRING>, is_index: ARRAY<BOOLEAN>, value: STRING>>: matches and where they are."""
    compiled = reads.plain(path)

    def run(value: Any) -> list | None:
        return None if value is ABSENT else [{"path": [str(x) for x in p], "is_index": [isinstance(x, int) for x in p], "value": dumps(v)} for v, p in located(compiled, value)]

    kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("is_index", pa.list_(pa.bool_())), ("value", pa.string())]))
    return _run("array<struct<path:array<string>,is_index:array<boolean>,value:string>>", kind, _guard(run, strict), _column(doc))


def jp_get(doc: Column | str, *paths: str, indent: str = "", newline: str = "", space: str = "", strict: bool = False) -> Column:
    """STRING: JSON text of a path's matches, or of an object of several paths' matches."""
    for p in paths:
        compile_path(p)
    return _run("string", pa.string(), _guard(lambda v: reads.get(v, *paths, indent=indent, newline=newline, space=space), strict), _column(doc))


def jp_expand(doc: Column | str, *paths: str, mode: str = "EXPAND", strict: bool = False) -> Column:
    for p in paths:
        compile_path(p)
    return _run("string", pa.string(), _guard(lambda v: reads.expand(v, *paths, mode=mode), strict), _column(doc))


def _read(name: str, one: str) -> Callable:
    function = reads.READS[name]

    def build(doc: Column | str, path: str = ".", *args: Any, strict: bool = False) -> Column:
        legacy = reads.compile_path(path).legacy
        if name not in ("resp",):
            reads.plain(path)
        kind = one if legacy else f"array<{one}>"
        if name == "arrindex":
            run = _guard(lambda v, value, *bounds: function(v, path, loads(value), *bounds), strict)
        elif name == "resp":
            run, kind = _guard(lambda v: None if v is ABSENT else dumps(function(v, path)), strict), "string"
        else:
            run = _guard(lambda v: function(v, path), strict)
        return _run(_ddl(kind), _arrow(kind), run, _column(doc), *args)

    build.__name__ = f"jp_{name}"
    build.__doc__ = f"{name.upper()}: one {one} per match, or of the first match for a legacy path."
    return build


jp_type, jp_strlen, jp_arrlen, jp_objlen = _read("type", "string"), _read("strlen", "bigint"), _read("arrlen", "bigint"), _read("objlen", "bigint")
jp_objkeys, jp_arrindex, jp_resp, jp_debug_memory = _read("objkeys", "array<string>"), _read("arrindex", "bigint"), _read("resp", "string"), _read("debug_memory", "bigint")


def jp_valid(doc: Column | str) -> Column:
    """Whether the text is one JSON value within the depth limit; null for null."""

    def run(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            loads(text)
        except JsonError:
            return False
        return True

    return _run("boolean", pa.bool_(), run, _column(doc))


def jp_from_bson(data: Column | str, strict: bool = False) -> Column:
    """JSON text of the first field of a BSON document."""

    def run(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return dumps(from_bson(raw))
        except JsonError:
            if strict:
                raise
            return None

    return _run("string", pa.string(), run, _column(data))


# -- edits

EDIT_DDL = "struct<doc:string,reply:string,changed:boolean,error:string>"
EDIT_ARROW = pa.struct([("doc", pa.string()), ("reply", pa.string()), ("changed", pa.bool_()), ("error", pa.string())])


def jp_edit(name: str, doc: Column | str, *args: Any, strict: bool = False) -> Column:
    """STRUCT<doc, reply, changed, error> of one edit; arguments may be columns. A null doc: the key is gone."""
    if name not in edits.EDITS:
        raise CommandError(f"no edit {name}")
    if args and isinstance(args[0], str):
        reads.plain(args[0])

    def run(text: str | None, *given: Any) -> dict:
        new, reply, changed, error = edits.edit_text(name, text, *given)
        if error and strict:
            raise CommandError(error)
        return {"doc": new, "reply": reply, "changed": changed, "error": error}

    return _run(EDIT_DDL, EDIT_ARROW, run, _column(doc), *args)


def jp_apply(doc: Column | str, *steps: tuple) -> Column:
    """The document after several edits, each (name, *args), parsed and written once; the last reply, the first error."""

    def run(text: str | None) -> dict:
        editor, reply, changed, error = edits.Editor(text), None, False, None
        for name, *args in steps:
            reply, c, e = editor.apply(name, *args)
            changed, error = changed or c, error or e
        return {"doc": editor.result(), "reply": reply, "changed": changed, "error": error}

    for name, *args in steps:
        if args:
            reads.plain(args[0])
    return _run(EDIT_DDL, EDIT_ARROW, run, _column(doc))


def _edit(name: str) -> Callable:
    def build(doc: Column | str, *args: Any, strict: bool = False) -> Column:
        return jp_edit(name, doc, *args, strict=strict)

    build.__name__ = f"jp_{name}"
    build.__doc__ = f"{name.upper()} as an edit; see :func:`jp_edit`."
    return build


jp_set, jp_merge, jp_del, jp_clear, jp_toggle = map(_edit, ("set", "merge", "del", "clear", "toggle"))
jp_forget = jp_del
jp_numincrby, jp_nummultby, jp_numpowby, jp_strappend = map(_edit, ("numincrby", "nummultby", "numpowby", "strappend"))
jp_arrappend, jp_arrinsert, jp_arrpop, jp_arrtrim = map(_edit, ("arrappend", "arrinsert", "arrpop", "arrtrim"))
