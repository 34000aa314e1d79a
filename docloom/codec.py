"""JSON text to values and back, keeping apart what JSON keeps apart.

Integers stay integers (up to 64 bits unsigned, beyond that floats), floats always print a fraction or
an exponent, non-ASCII is written raw, key order is kept and the last of repeated keys wins.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
import re
from json.encoder import encode_basestring
from typing import Any

MAX_DEPTH = 128


class JsonError(ValueError):
    """Text that is not one JSON value, or is nested too deeply."""


def _int(s: str) -> int | float:
    if len(s) < 19:
        return -0.0 if s == "-0" else int(s)
    n = int(s) if len(s) < 400 else None
    if n is not None and -(2**63) <= n < 2**64:
        return n
    return _float(s)


def _float(s: str) -> float:
    f = float(s)
    if math.isinf(f):
        raise JsonError("number out of range")
    return f


def _constant(s: str):
    raise JsonError(f"{s} is not JSON")


_decode = json.JSONDecoder(parse_int=_int, parse_float=_float, parse_constant=_constant).decode
_EXPONENT = re.compile(r"\de[+-]?\d")
_REPR = re.compile(r"e([+-]?)0*(\d+)$")


def depth(value: Any) -> int:
    """Nesting of containers; a scalar has 0."""
    level, deepest = [value], 0
    while True:
        level = [c for v in level if isinstance(v, (dict, list)) for c in (v.values() if isinstance(v, dict) else v)] if any(isinstance(v, (dict, list)) for v in level) else None
        if level is None:
            return deepest
        deepest += 1


def loads(text: str) -> Any:
    """The value of a JSON text; raises :class:`JsonError`."""
    try:
        value = _decode(text)
    except (ValueError, RecursionError) as e:
        raise JsonError(str(e)[:200]) from None
    if text.count("[") + text.count("{") > MAX_DEPTH and depth(value) > MAX_DEPTH:
        raise JsonError("nested too deeply")
    if "\\u" in text and re.search(r"\\u[dD][89a-fA-F]", text):
        try:
            json.dumps(value, ensure_ascii=False).encode()
        except UnicodeEncodeError:
            raise JsonError("lone surrogate") from None
    return value


def format_float(f: float) -> str:
    return _REPR.sub(lambda m: "e" + ("-" if m[1] == "-" else "") + m[2], repr(f))


def _write(v: Any, out: list[str]) -> None:
    if isinstance(v, str):
        out.append(encode_basestring(v))
    elif v is None:
        out.append("null")
    elif v is True or v is False:
        out.append("true" if v else "false")
    elif isinstance(v, float):
        out.append(format_float(v) if math.isfinite(v) else "null")
    elif isinstance(v, int):
        out.append(str(v))
    elif isinstance(v, dict):
        out.append("{")
        for i, (k, x) in enumerate(v.items()):
            out.append("," if i else "")
            out.append(encode_basestring(k))
            out.append(":")
            _write(x, out)
        out.append("}")
    else:
        out.append("[")
        for i, x in enumerate(v):
            if i:
                out.append(",")
            _write(x, out)
        out.append("]")


_fast = json.JSONEncoder(ensure_ascii=False, allow_nan=False, separators=(",", ":")).encode


def dumps(value: Any) -> str:
    """Compact text. Only a value with exponents takes the slow way."""
    if type(value) is str:
        return encode_basestring(value)
    if type(value) is int:
        return str(value)
    try:
        text = _fast(value)
        if not _EXPONENT.search(text):
            return text
    except ValueError:
        pass
    out: list[str] = []
    _write(value, out)
    return "".join(out)


def pretty(value: Any, indent: str = "", newline: str = "", space: str = "") -> str:
    """Formatted text: ``indent`` per level, ``newline`` before each element, ``space`` after a colon."""
    if not (indent or newline or space):
        return dumps(value)

    def write(v: Any, level: int) -> str:
        if not isinstance(v, (dict, list)) or not v:
            return dumps(v)
        pad = newline + indent * (level + 1)
        if isinstance(v, dict):
            body = ("," + pad).join(f"{encode_basestring(k)}:{space}{write(x, level + 1)}" for k, x in v.items())
            return "{" + pad + body + newline + indent * level + "}"
        return "[" + pad + ("," + pad).join(write(x, level + 1) for x in v) + newline + indent * level + "]"

    return write(value, 0)


def type_name(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    return {float: "number", str: "string", list: "array", dict: "object"}[type(value)]


def reply_tree(value: Any) -> Any:
    """The protocol form of a value: containers are lists that open with ``[`` or ``{``, booleans are words."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return ["[", *map(reply_tree, value)]
    if isinstance(value, dict):
        return ["{", *(y for k, v in value.items() for y in (k, reply_tree(v)))]
    return value


# -- BSON, read only


def _date(ms: int) -> Any:
    """Milliseconds since 1970 as extended JSON shows them: ISO 8601 in the years 1970 to 9999, else the number."""
    if not 0 <= ms < 253_402_300_800_000:
        return {"$numberLong": str(ms)}
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{ms % 1000:03d}".rstrip("0") if ms % 1000 else "") + "Z"


def _decimal(raw: bytes) -> str:
    """A 128-bit decimal (binary integer form) as text."""
    bits = int.from_bytes(raw, "little")
    sign, top = "-" if bits >> 127 else "", bits >> 122 & 31
    if top == 31:
        return "NaN"
    if top == 30:
        return sign + "Infinity"
    if top >= 24:  # a coefficient beyond 34 digits counts as zero
        return str(decimal.Decimal((int(bool(sign)), (0,), (bits >> 111 & 0x3FFF) - 6176)))
    value = bits & (1 << 113) - 1
    return str(decimal.Decimal((int(bool(sign)), tuple(map(int, str(value if value < 10**34 else 0))), (bits >> 113 & 0x3FFF) - 6176)))


def from_bson(data: bytes) -> Any:
    """The first field's value of a BSON document; null for an empty document or no bytes."""
    import struct

    def document(at: int, as_list: bool) -> tuple[Any, int]:
        size = struct.unpack_from("<i", data, at)[0]
        end, at, out = at + size, at + 4, {}
        if size < 5 or end > len(data):
            raise JsonError("bad BSON length")
        while data[at]:
            kind, stop = data[at], data.index(0, at + 1)
            name = data[at + 1 : stop].decode()
            out[name], at = field(kind, stop + 1)
        return (list(out.values()) if as_list else out), end

    def field(kind: int, at: int) -> tuple[Any, int]:
        if kind == 0x01:
            f = struct.unpack_from("<d", data, at)[0]
            return f, at + 8
        if kind == 0x02:
            n = struct.unpack_from("<i", data, at)[0]
            return data[at + 4 : at + 3 + n].decode(), at + 4 + n
        if kind in (0x03, 0x04):
            return document(at, kind == 0x04)
        if kind == 0x08:
            return bool(data[at]), at + 1
        if kind == 0x0A:
            return None, at
        if kind == 0x10:
            return struct.unpack_from("<i", data, at)[0], at + 4
        if kind == 0x12:
            return struct.unpack_from("<q", data, at)[0], at + 8
        if kind == 0x09:
            return {"$date": _date(struct.unpack_from("<q", data, at)[0])}, at + 8
        if kind == 0x11:
            i, t = struct.unpack_from("<II", data, at)
            return {"$timestamp": {"t": t, "i": i}}, at + 8
        if kind == 0x05:
            n, sub = struct.unpack_from("<iB", data, at)
            if n < 0 or at + 5 + n > len(data):
                raise JsonError("bad BSON length")
            return {"$binary": {"base64": base64.b64encode(data[at + 5 : at + 5 + n]).decode(), "subType": f"{sub:02x}"}}, at + 5 + n
        if kind == 0x0B:
            mid = data.index(0, at)
            end = data.index(0, mid + 1)
            return {"$regularExpression": {"pattern": data[at:mid].decode(), "options": data[mid + 1 : end].decode()}}, end + 1
        if kind == 0x13:
            return {"$numberDecimal": _decimal(data[at : at + 16])}, at + 16
        if kind == 0x07:
            return {"$oid": data[at : at + 12].hex()}, at + 12
        raise JsonError(f"BSON type {kind:#x} has no JSON value")

    if not data:
        return None
    try:
        whole, _ = document(0, False)
    except (struct.error, ValueError, IndexError) as e:
        raise JsonError(f"bad BSON: {e}"[:200]) from None
    return next(iter(whole.values()), None)
