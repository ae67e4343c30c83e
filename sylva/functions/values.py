"""The JSON value model: order, equality, printing, reading and sort keys.

Values are None, bool, int, float, str, list and dict. Integers beyond 2**53 and decimals whose text differs from the
shortest form of their double are ``Literal`` numbers: they print as written until arithmetic makes plain numbers of them.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from functools import cmp_to_key

BIG = 1 << 53
MAX = 1.7976931348623157e308


class JqError(Exception):
    """An error value on its way to a handler."""

    def __init__(self, value):
        super().__init__(value)
        self.value = value

    def message(self) -> str:
        return self.value if isinstance(self.value, str) else encode(self.value) + " (not a string)"


class Literal(float):
    """A number that remembers its text."""

    text: str

    def __new__(cls, value: float, text: str):
        out = super().__new__(cls, value)
        out.text = text
        return out

    def __reduce__(self):
        return Literal, (float(self), self.text)


def number(x):
    """Plain form of an arithmetic result: an int where it is one of 2**53 or less, else a double."""
    if isinstance(x, float):
        return int(x) if x.is_integer() and abs(x) <= BIG and not (x == 0 and math.copysign(1, x) < 0) else float(x)
    return x if abs(x) <= BIG else float(x) if abs(x) < 1 << 1000 else math.copysign(math.inf, x)


def type_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def truthy(v) -> bool:
    return v is not None and v is not False


def rank(v) -> int:
    if v is None:
        return 0
    if isinstance(v, bool):
        return 2 if v else 1
    if isinstance(v, (int, float)):
        return 3
    if isinstance(v, str):
        return 4
    return 5 if isinstance(v, list) else 6


def compare(a, b) -> int:
    """Total order; strings by bytes; NaN lies below every number, itself included."""
    ra, rb = rank(a), rank(b)
    if ra != rb:
        return -1 if ra < rb else 1
    if ra < 3:
        return 0
    if ra == 3:
        if a != a:
            return -1
        if isinstance(a, Literal) and isinstance(b, Literal):
            a, b = Decimal(a.text), Decimal(b.text)
        return (a > b) - (a < b) if b == b else 1
    if ra == 4:
        if a == b:
            return 0
        x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
        return -1 if x < y else 1
    if ra == 5:
        for x, y in zip(a, b, strict=False):
            if c := compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    ka, kb = sorted_keys(a), sorted_keys(b)
    if c := compare(ka, kb):
        return c
    for k in ka:
        if c := compare(a[k], b[k]):
            return c
    return 0


order = cmp_to_key(compare)


def equal(a, b) -> bool:
    return compare(a, b) == 0


def sorted_keys(o: dict) -> list[str]:
    return sorted(o, key=lambda k: k.encode("utf-8", "surrogatepass"))


def sort_key(v) -> bytes:
    """Bytes whose order is the values' order: what shuffles, sorts and joins of dynamic values go by.

    A NaN takes a key below all numbers; strings escape 0 so that a shorter string precedes its extensions; containers end
    in a byte below every rank.
    """
    r = rank(v)
    head = bytes([r + 1])
    if r < 3:
        return head
    if r == 3:
        if v != v:
            return head + b"\0" * 8
        (bits,) = struct.unpack(">Q", struct.pack(">d", float(v) + 0.0 if v else 0.0))
        return head + struct.pack(">Q", bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63)
    if r == 4:
        return head + v.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0"
    if r == 5:
        return head + b"".join(map(sort_key, v)) + b"\0"
    keys = sorted_keys(v)
    return head + b"".join(map(sort_key, keys)) + b"\0" + b"".join(sort_key(v[k]) for k in keys) + b"\0"


# ---- printing


def format_number(x) -> str:
    if isinstance(x, Literal):
        return x.text
    if isinstance(x, int):
        return str(x)
    if x != x:
        return "null"
    if math.isinf(x):
        x = math.copysign(MAX, x)
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent
    if point <= -4 or point > len(text) + 15:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'-' if point < 1 else '+'}{abs(point - 1):02d}"
    elif point <= 0:
        body = "0." + "0" * -point + text
    elif point >= len(text):
        body = text + "0" * (point - len(text))
    else:
        body = text[:point] + "." + text[point:]
    return "-" + body if sign else body


_ESCAPES = {i: f"\\u{i:04x}" for i in range(32)} | {34: '\\"', 92: "\\\\", 8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 127: "\\u007f"} | {i: "�" for i in range(0xD800, 0xE000)}


def quote(s: str, ascii_only: bool = False) -> str:
    body = s.translate(_ESCAPES)
    if ascii_only and not body.isascii():
        units = body.encode("utf-16-be")
        wide = [int.from_bytes(units[k : k + 2], "big") for k in range(0, len(units), 2)]
        body = "".join(chr(u) if u < 128 else f"\\u{u:04x}" for u in wide)
    return f'"{body}"'


def encode(v, indent: int | str | None = None, sort: bool = False, ascii_only: bool = False, _pad: str = "\n") -> str:
    """JSON text; ``indent``: spaces, or a string such as a tab; none for one line."""
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    if isinstance(v, (int, float)):
        return format_number(v)
    if isinstance(v, str):
        return quote(v, ascii_only)
    if not v:
        return "[]" if isinstance(v, list) else "{}"
    step = None if not indent else " " * indent if isinstance(indent, int) else indent
    inner = _pad + step if step else ""
    if isinstance(v, list):
        parts = [encode(x, indent, sort, ascii_only, inner) for x in v]
        return "[" + inner + ("," + inner).join(parts) + (_pad if step else "") + "]"
    colon = ": " if step else ":"
    keys = sorted_keys(v) if sort else v
    parts = [quote(k, ascii_only) + colon + encode(v[k], indent, sort, ascii_only, inner) for k in keys]
    return "{" + inner + ("," + inner).join(parts) + (_pad if step else "") + "}"


# ---- reading


def read_number(text: str):
    try:
        if not any(c in text for c in ".eE"):
            n = int(text)
            if abs(n) <= BIG and not (n == 0 and text[0] == "-"):
                return n
        f = float(text)
        if math.isinf(f):
            return math.copysign(MAX, f)
        exact = str(Decimal(text))
    except (ValueError, InvalidOperation) as e:
        raise JqError(f"Cannot parse '{text}' as JSON") from e
    plain = number(f)
    return plain if format_number(plain) == exact else Literal(f, exact)


_DECODER = json.JSONDecoder(parse_int=read_number, parse_float=read_number, parse_constant=lambda c: math.nan if c == "NaN" else math.copysign(math.inf, -1 if c[0] == "-" else 1), strict=False)
_SPACE = " \t\r\n﻿\x1e"


def decode_all(text: str) -> Iterator:
    """Each of the concatenated values of a text."""
    at = 0
    while True:
        while at < len(text) and text[at] in _SPACE:
            at += 1
        if at >= len(text):
            return
        if text.startswith("nan", at):
            yield math.nan
            at += 3
            continue
        try:
            value, at = _DECODER.raw_decode(text, at)
        except (json.JSONDecodeError, RecursionError) as e:
            raise JqError(f"{e} (while parsing '{text[:60]}')") from e
        yield value


def decode(text: str):
    values = list(decode_all(text))
    if len(values) != 1:
        raise JqError(f"Expected one JSON value (while parsing '{text[:60]}')")
    return values[0]


def shown(v) -> str:
    """A value for an error message, shortened."""
    text = encode(v)
    raw = text.encode()
    return text if len(raw) <= 29 else raw[:26].decode("utf-8", "ignore") + "..."
