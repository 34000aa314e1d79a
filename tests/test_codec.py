import json
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from docloom.codec import JsonError, depth, dumps, from_bson, loads, pretty, reply_tree, type_name


@pytest.mark.parametrize("text", ["1", "1.0", "-5", '"é\\u0000"', "[1,2.5,null]", '{"b":1,"a":2}', "1e16", "1.6350000000001313e308", "5.960464477539062e16", "1e-7", "18446744073709551615", "0.1", "[]", "{}"])
def test_round_trip_text(text):
    assert dumps(loads(text)) == text


def test_numbers():
    assert type(loads("1")) is int and type(loads("1.0")) is float
    assert isinstance(loads("18446744073709551616"), float)
    assert dumps(3.0) == "3.0" and dumps(1e15) == "1000000000000000.0" and dumps([1e-5]) == "[1e-5]"
    assert type_name(loads("9223372036854775808")) == "integer"


@pytest.mark.parametrize("text", ["", "[1,]", "{a:1}", "NaN", "Infinity", "1e400", "[1]]", "01", "+1", ".12", '"\t"', '"\\ud800"', "[" * 129 + "]" * 129, "'a'", "tru", "nulL", "[1 2]", '{"a" 1}', '{"a":1,}', "[,1]", '{"a":}', '"a', '"\\x41"', '"\\u12"', "0x10", "1.", "1e", "-", "--1", "[", "}", '{"a":1}}', "/**/1", "1 1", '"a\nb"', "{1:2}", "\ufeff1"])
def test_rejected(text):
    with pytest.raises(JsonError):
        loads(text)


def test_depth():
    assert depth(1) == 0 and depth([]) == 1 and depth({"a": [1]}) == 2
    assert loads("[" * 128 + "]" * 128) is not None


def test_last_of_repeated_keys_wins():
    assert loads('{"a":1,"a":2}') == {"a": 2}


def test_pretty():
    assert pretty({"a": [1, {}]}, "  ", "\n", " ") == '{\n  "a": [\n    1,\n    {}\n  ]\n}'
    assert pretty([], "  ", "\n") == "[]"


def test_reply_tree():
    assert reply_tree({"a": [True, None]}) == ["{", "a", ["[", "true", None]]


_json = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=("Cs",))), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=("Cs",))), x, max_size=4), max_leaves=20)


@given(_json)
def test_values_survive(value):
    again = loads(dumps(value))
    assert again == value and dumps(again) == dumps(value)
    assert json.loads(dumps(value)) == value


def test_bson():
    body = b"\x10n\x00" + struct.pack("<i", 7) + b"\x02s\x00" + struct.pack("<i", 3) + b"hi\x00"
    inner = struct.pack("<i", len(body) + 5) + body + b"\x00"
    outer = b"\x03d\x00" + inner
    data = struct.pack("<i", len(outer) + 5) + outer + b"\x00"
    assert from_bson(data) == {"n": 7, "s": "hi"}
    assert from_bson(b"") is None and from_bson(struct.pack("<i", 5) + b"\x00") is None
    with pytest.raises(JsonError):
        from_bson(b"\x01")


def bson(kind, body):
    inner = bytes([kind]) + b"v\0" + body + b"\0"
    return (len(inner) + 4).to_bytes(4, "little") + inner


@pytest.mark.parametrize(
    ("kind", "body", "want"),
    [
        (0x09, (1_700_000_000_123).to_bytes(8, "little"), {"$date": "2023-11-14T22:13:20.123Z"}), (0x09, (5000).to_bytes(8, "little"), {"$date": "1970-01-01T00:00:05Z"}), (0x09, (-1).to_bytes(8, "little", signed=True), {"$date": {"$numberLong": "-1"}}),
        (0x11, (7).to_bytes(4, "little") + (9).to_bytes(4, "little"), {"$timestamp": {"t": 9, "i": 7}}), (0x12, (-3).to_bytes(8, "little", signed=True), -3), (0x05, b"\x03\0\0\0\x80abc", {"$binary": {"base64": "YWJj", "subType": "80"}}),
        (0x0B, b"a.*\0i\0", {"$regularExpression": {"pattern": "a.*", "options": "i"}}), (0x13, ((6174 << 113) | 1234).to_bytes(16, "little"), {"$numberDecimal": "12.34"}), (0x13, ((1 << 127) | (30 << 122)).to_bytes(16, "little"), {"$numberDecimal": "-Infinity"}),
    ],
)
def test_bson_values_beyond_json(kind, body, want):
    assert from_bson(bson(kind, body)) == want


@pytest.mark.parametrize("data", [bson(0x05, b"\xff\0\0\0\0ab"), bson(0x0B, b"ab"), bson(0x06, b""), b"\x05\0"])
def test_bad_bson(data):
    with pytest.raises(JsonError):
        from_bson(data)
