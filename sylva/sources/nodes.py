"""The node tree of YAML-like documents: kinds, tags, styles, comments, anchors."""

from __future__ import annotations

import re
from contextvars import ContextVar
from dataclasses import dataclass, field

MAP, SEQ, SCALAR, ALIAS = "map", "seq", "scalar", "alias"


class YqError(Exception):
    """What ends an expression or a reading."""


@dataclass(eq=False)
class Node:
    kind: str
    value: str = ""
    tag: str = ""
    style: str = ""  # "", flow, single, double, literal, folded
    content: list[Node] = field(default_factory=list)  # a map holds keys and values by turns
    anchor: str = ""
    target: Node | None = None
    head: str = ""
    line_comment: str = ""
    foot: str = ""
    line: int = 0
    column: int = 0
    parent: Node | None = None
    key: Node | None = None
    doc: int = 0
    file: int = 0
    filename: str = ""
    is_key: bool = False

    def pairs(self) -> list[tuple[Node, Node]]:
        return list(zip(self.content[::2], self.content[1::2], strict=True))

    def get(self, name: str) -> Node | None:
        found = None
        for k, v in self.pairs():
            if k.value == name:
                found = v
        return found

    def real(self) -> Node:
        node, seen = self, 0
        while node.kind == ALIAS and node.target is not None:
            node, seen = node.target, seen + 1
            if seen > 100:
                raise YqError("an alias refers to itself")
        return node

    def copy(self, memo: dict | None = None) -> Node:
        memo = {} if memo is None else memo
        out = Node(self.kind, self.value, self.tag, self.style, [], self.anchor, None, self.head, self.line_comment, self.foot, self.line, self.column, None, self.key, self.doc, self.file, self.filename, self.is_key)
        memo[id(self)] = out
        out.content = [c.copy(memo) for c in self.content]
        if self.target is not None:
            out.target = memo.get(id(self.target), self.target)
        out.adopt()
        return out

    def adopt(self) -> Node:
        """Set parent and key of the children."""
        if self.kind == MAP:
            for k, v in self.pairs():
                k.parent = v.parent = self
                v.key, k.key, k.is_key = k, k, True
        elif self.kind == SEQ:
            for n, v in enumerate(self.content):
                v.parent, v.key = self, scalar(n)
        return self

    def become(self, other: Node, keep_style: bool = False) -> None:
        """Take over the other's value, keeping place and comments."""
        other = other.copy()
        style = self.style if keep_style and self.kind == other.kind == SCALAR and not other.style else other.style
        self.kind, self.value, self.tag, self.content, self.target = other.kind, other.value, other.tag, other.content, other.target
        self.style = style
        if other.anchor:
            self.anchor = other.anchor
        for name in ("head", "line_comment", "foot"):
            if getattr(other, name):
                setattr(self, name, getattr(other, name))
        self.adopt()


def scalar(v, style: str = "") -> Node:
    if v is None:
        return Node(SCALAR, "null", "!!null")
    if isinstance(v, bool):
        return Node(SCALAR, "true" if v else "false", "!!bool")
    if isinstance(v, int):
        return Node(SCALAR, str(v), "!!int")
    if isinstance(v, float):
        return Node(SCALAR, float_text(v), "!!float")
    return Node(SCALAR, v, "!!str", style)


def float_text(v: float) -> str:
    if v != v:
        return ".nan"
    if v in (float("inf"), float("-inf")):
        return ".inf" if v > 0 else "-.inf"
    if v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return repr(v).replace("e+", "e+").replace("e-0", "e-0")


def seq(items: list[Node], style: str = "") -> Node:
    return Node(SEQ, tag="!!seq", style=style, content=items).adopt()


def mapping(pairs: list[tuple[Node, Node]], style: str = "") -> Node:
    return Node(MAP, tag="!!map", style=style, content=[x for p in pairs for x in p]).adopt()


_INT = re.compile(r"[-+]?(0|[1-9][0-9_]*|0[0-7_]+)")
_BASED = re.compile(r"[-+]?0(x[0-9a-fA-F_]+|o[0-7_]+|b[01_]+)")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9][0-9_]*(\.[0-9_]*)?)([eE][-+]?[0-9]+)?")
_TIME = re.compile(r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([Tt ]+[0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]*)?( *(Z|[-+][0-9]{1,2}(:?[0-9]{2})?))?)?")


def resolve(text: str) -> str:
    """Tag of a plain scalar."""
    if text in ("", "~", "null", "Null", "NULL"):
        return "!!null"
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return "!!bool"
    if text == "<<":
        return "!!merge"
    if text[0] in "-+.0123456789":
        if _INT.fullmatch(text) or _BASED.fullmatch(text):
            n = integer(text)
            return "!!int" if -(1 << 63) <= n < 1 << 64 else "!!float"
        if text.lstrip("+-") in (".inf", ".Inf", ".INF") or text in (".nan", ".NaN", ".NAN"):
            return "!!float"
        if _FLOAT.fullmatch(text):
            return "!!float"
        if _TIME.fullmatch(text):
            return "!!timestamp"
    return "!!str"


def integer(text: str) -> int:
    t = text.replace("_", "")
    sign = -1 if t[0] == "-" else 1
    body = t.lstrip("+-")
    for mark, base in (("0x", 16), ("0o", 8), ("0b", 2)):
        if body.startswith(mark):
            return sign * int(body[2:], base)
    return sign * (int(body, 8) if len(body) > 1 and body[0] == "0" and not set(body) & set("89") else int(body))


def python_number(n: Node):
    if n.tag == "!!int":
        return integer(n.value)
    t = n.value.replace("_", "")
    low = t.lower()
    if low.lstrip("+-") == ".inf":
        return float("-inf") if t[0] == "-" else float("inf")
    if low == ".nan":
        return float("nan")
    return float(t)


#: Whether merge keys follow the YAML specification: a map's own keys win, then the earlier merge. Otherwise later ones win.
MERGE_TO_SPEC: ContextVar[bool] = ContextVar("MERGE_TO_SPEC", default=False)


def merged(node: Node, printed: bool = False, within: tuple = ()) -> list[tuple[Node, Node]]:
    """A map's pairs with merge keys followed; a key keeps its first place and takes its last value.

    Of several maps under one merge key the later one wins where a path is followed, the earlier one where a map is written
    out (``printed``) or merges follow the specification. A map that merges itself is passed over.
    """
    pairs = node.pairs()
    if not any(k.tag == "!!merge" for k, _ in pairs):
        return pairs
    to_spec = MERGE_TO_SPEC.get()
    own, taken, in_place = [], [], []
    for k, v in pairs:
        if k.tag != "!!merge":
            own.append((k, v))
            in_place.append((k, v))
            continue
        source = v.real()
        parts = [p.real() for p in (source.content if source.kind == SEQ else [source])]
        found = [merged(p, printed, (*within, node)) for p in parts if p.kind == MAP and not any(p is x for x in (*within, node))]
        ordered = [pair for some in (found[::-1] if to_spec or printed else found) for pair in some]
        taken.insert(0, ordered)
        in_place += ordered
    out: dict[str, tuple[Node, Node]] = {}
    for k, v in [pair for some in taken for pair in some] + own if to_spec else in_place:
        out[k.value] = (k, v)
    return list(out.values())


def to_value(n: Node):
    """A node as a JSON value (numbers as their own text where that differs)."""
    from sylva.functions.values import read_number

    n = n.real()
    if n.kind == MAP:
        return {k.real().value: to_value(v) for k, v in merged(n, True)}
    if n.kind == SEQ:
        return [to_value(c) for c in n.content]
    if n.tag == "!!null":
        return None
    if n.tag == "!!bool":
        return n.value.lower() == "true"
    if n.tag == "!!int":
        return integer(n.value)
    if n.tag == "!!float":
        try:
            return read_number(n.value.replace("_", ""))
        except Exception:  # noqa: BLE001  .inf and the like
            return python_number(n)
    return n.value


def from_value(v) -> Node:
    from sylva.functions.values import Literal

    if isinstance(v, dict):
        return mapping([(scalar(k), from_value(x)) for k, x in v.items()])
    if isinstance(v, list):
        return seq([from_value(x) for x in v])
    if isinstance(v, Literal):
        return Node(SCALAR, v.text, resolve(v.text))
    return scalar(v)


def null() -> Node:
    return scalar(None)
