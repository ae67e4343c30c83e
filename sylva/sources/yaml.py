"""YAML text to node trees and back, with styles, anchors and comments."""

from __future__ import annotations

import re

from sylva.sources.nodes import ALIAS, MAP, SCALAR, SEQ, Node, YqError, resolve

_ESC = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_SHORT = {"!!str", "!!int", "!!float", "!!bool", "!!null", "!!seq", "!!map", "!!timestamp", "!!merge", "!!binary"}


class Reader:
    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").removeprefix("\ufeff")
        self.at = 0
        self.anchors: dict[str, Node] = {}
        self.pending: list[str] = []
        self.last: Node | None = None

    # ---- places

    def fault(self, why: str):
        raise YqError(f"yaml: line {self.text.count(chr(10), 0, self.at) + 1}: {why}")

    def peek(self, n: int = 0) -> str:
        k = self.at + n
        return self.text[k] if k < len(self.text) else ""

    def column(self) -> int:
        return self.at - (self.text.rfind("\n", 0, self.at) + 1)

    def mark(self, node: Node, at: int | None = None) -> Node:
        at = self.at if at is None else at
        node.line = self.text.count("\n", 0, at) + 1
        node.column = at - self.text.rfind("\n", 0, at)
        return node

    def blank(self, n: int = 0) -> bool:
        return self.peek(n) in ("", " ", "\t", "\n")

    def spaces(self) -> None:
        while self.peek() in (" ", "\t"):
            self.at += 1

    def end_of_line(self) -> str:
        """Skip to the line's end; the comment found there."""
        self.spaces()
        comment = ""
        if self.peek() == "#":
            end = self.text.find("\n", self.at)
            end = len(self.text) if end < 0 else end
            comment = self.text[self.at : end].rstrip()
            self.at = end
        return comment

    def next_token(self) -> bool:
        """Skip blank lines and comment lines, which are remembered; False at the end."""
        gap = False
        while self.at < len(self.text):
            start = self.at
            self.spaces()
            c = self.peek()
            if c == "\n":
                gap = gap or self.text[self.text.rfind("\n", 0, start) + 1 : self.at].strip() == ""
                if gap and self.pending and self.last is not None and not getattr(self, "gapped", False):
                    # comments right below a value and above a gap belong to the value
                    self.last.foot = "\n".join(filter(None, [self.last.foot, *self.pending]))
                    self.pending = []
                self.gapped = gap
                self.at += 1
            elif c == "#":
                if gap and not self.pending:
                    self.gapped = True
                self.pending.append(self.end_of_line())
                gap = False
                if self.peek() == "\n":
                    self.at += 1
            elif c == "":
                return False
            else:
                return True
        return False

    def comments(self) -> str:
        out, self.pending = "\n".join(self.pending), []
        self.gapped = False
        return out

    # ---- documents

    def documents(self) -> list[Node]:
        out: list[Node] = []
        while True:
            explicit = False
            more = self.next_token()
            while more and self.peek() == "%" and self.column() == 0:
                self.at = (self.text + "\n").index("\n", self.at)
                more = self.next_token()
            if more and self.text.startswith("---", self.at) and self.column() == 0 and self.blank(3):
                explicit = True
                self.at += 3
                more = self.next_token()
            if not more and not explicit and (out or not self.pending):
                if out and self.pending:
                    out[-1].foot = "\n".join(filter(None, [out[-1].foot, self.comments()]))
                break
            self.anchors, self.last = {}, None
            head = self.comments()
            empty = not more or self.document_mark()
            node = self.mark(Node(SCALAR, "", "!!null")) if empty else self.block(-1)
            if head:
                node.head = "\n".join(filter(None, [head, node.head]))
            node.doc = len(out)
            out.append(node)
            more = self.next_token()
            if self.pending and (not more or self.document_mark()):
                node.foot = "\n".join(filter(None, [node.foot, self.comments()]))
            if more and self.text.startswith("...", self.at) and self.column() == 0:
                self.at += 3
                more = self.next_token()
                if not more:
                    break
                continue
            if more and not self.document_mark():
                self.fault("did not find expected <document start>")
            if not more:
                break
        return out

    def document_mark(self) -> bool:
        return self.column() == 0 and self.text[self.at : self.at + 3] in ("---", "...") and self.blank(3)

    # ---- blocks

    def block(self, indent: int, in_seq: bool = False) -> Node:
        """The node at this place, whose lines are indented more than ``indent``."""
        start, line = self.at, self.text.count("\n", 0, self.at)
        anchor, tag = self.properties()
        if (anchor or tag) and (self.peek() in ("\n", "#", "")):
            comment = self.end_of_line()
            if not self.next_token() or self.document_mark() or self.column() <= indent and not (self.peek() == "-" and self.blank(1) and self.column() == indent and not in_seq):
                node = self.mark(Node(SCALAR, "", "!!null", line_comment=comment), start)
                return self.dress(node, anchor, tag)
            node = self.block(indent if self.column() > indent else indent - 1)
            if comment and not node.line_comment:
                node.line_comment = comment
            return self.dress(node, anchor, tag)
        column = self.column()
        c = self.peek()
        if c == "-" and self.blank(1):
            return self.dress(self.sequence(column), anchor, tag)
        if c == "?" and self.blank(1) or self.simple_key():
            if (anchor or tag) and self.text.count("\n", 0, self.at) == line:
                self.at = start  # the properties are the first key's
                column = self.column()
                return self.map_(column)
            return self.dress(self.map_(column), anchor, tag)
        if c in "|>" and c:
            node = self.block_scalar(indent)
        else:
            node = self.inline(indent)
            node.line_comment = self.end_of_line()
        return self.dress(node, anchor, tag)

    def properties(self) -> tuple[str, str]:
        anchor = tag = ""
        while self.peek() in ("&", "!"):
            m = re.compile(r"[&!][^\s,\[\]{}]*" if self.peek() == "&" else r"!<[^>]*>|!\S*").match(self.text, self.at)
            if m[0][0] == "&":
                anchor = m[0][1:]
            else:
                tag = m[0]
            self.at = m.end()
            self.spaces()
        return anchor, tag

    def dress(self, node: Node, anchor: str, tag: str) -> Node:
        if anchor:
            node.anchor = anchor
            self.anchors[anchor] = node
        if tag:
            node.tag = tag.replace("!<tag:yaml.org,2002:", "!!").rstrip(">") if tag.startswith("!<") else tag
        return node

    def simple_key(self) -> bool:
        """Whether a key and its colon start here, on this line."""
        at = self.at
        try:
            self.properties()
            c = self.peek()
            if c in ('"', "'"):
                self.quoted()
            elif c in "[{" and c:
                self.flow()
            elif c == "*":
                self.at = re.compile(r"\*[^\s,\[\]{}]*").match(self.text, self.at).end()
                if self.text[self.at - 1] == ":":
                    self.at -= 1
            elif c in ("", "\n", "#", "|", ">", "@", "`", "%"):
                return False
            else:
                end = (self.text + "\n").index("\n", self.at)
                m = re.compile(r":(?=[ \t\n]|$)|[ \t]#").search(self.text, self.at, end + 1)
                return bool(m) and m[0] == ":" and m.start() < end
            if self.text.count("\n", at, self.at):
                return False
            self.spaces()
            return self.peek() == ":" and self.blank(1)
        except YqError:
            return False
        finally:
            self.at = at

    def sequence(self, column: int) -> Node:
        out = self.mark(Node(SEQ, tag="!!seq"))
        while True:
            head = self.comments()
            self.at += 1
            comment = self.end_of_line()
            if self.peek() == "\n" or not self.peek():
                found = self.next_token() and not self.document_mark() and self.column() > column
                item = self.block(column, True) if found else Node(SCALAR, "", "!!null")
                if not found:
                    self.last = item
            else:
                item = self.block(column, True)
            item.head = "\n".join(filter(None, [head, item.head]))
            if comment:
                item.line_comment = comment
            out.content.append(item)
            self.last = item
            if not (self.next_token() and self.column() == column and self.peek() == "-" and self.blank(1)) or self.document_mark():
                if self.at < len(self.text) and self.column() > column:
                    self.fault("did not find expected '-' indicator")
                return out.adopt()

    def map_(self, column: int) -> Node:
        out = self.mark(Node(MAP, tag="!!map"))
        while True:
            head = self.comments()
            if self.peek() == "?" and self.blank(1):
                self.at += 1
                self.spaces()
                key = self.block(column)
                more = self.next_token()
                if more and self.column() == column and self.peek() == ":" and self.blank(1):
                    self.at += 1
                    value = self.map_value(column, key)
                else:
                    value = Node(SCALAR, "", "!!null")
            else:
                if not self.simple_key():
                    self.fault("could not find expected ':'")
                anchor, tag = self.properties()
                key = self.dress(self.inline(column, True), anchor, tag)
                self.spaces()
                self.at += 1
                value = self.map_value(column, key)
            key.head = head
            out.content += [key, value]
            self.last = key
            if not (self.next_token() and self.column() == column) or self.document_mark():
                if self.at < len(self.text) and self.column() > column:
                    self.fault("did not find expected key")
                return out.adopt()
            if self.peek() == "-" and self.blank(1):
                return out.adopt()

    def map_value(self, column: int, key: Node) -> Node:
        comment = self.end_of_line()
        if self.peek() not in ("\n", ""):
            return self.block(column)
        more = self.next_token() and not self.document_mark()
        if more and (self.column() > column or self.column() == column and self.peek() == "-" and self.blank(1)):
            head = self.comments()
            value = self.sequence(column) if self.column() == column else self.block(column)
            value.head = "\n".join(filter(None, [head, value.head]))
            key.line_comment = comment
            return value
        return Node(SCALAR, "", "!!null", line_comment=comment)

    def block_scalar(self, indent: int) -> Node:
        node = self.mark(Node(SCALAR, tag="!!str", style="literal" if self.peek() == "|" else "folded"))
        m = re.compile(r"[|>]([-+]?)([1-9]?)([-+]?)").match(self.text, self.at)
        self.at = m.end()
        chomp, given = m[1] or m[3], int(m[2] or 0)
        node.line_comment = self.end_of_line()
        lines, width = [], max(indent, 0) + given if given else 0
        self.at += 1
        while self.at < len(self.text):
            end = (self.text + "\n").index("\n", self.at)
            line = self.text[self.at : end]
            bare = line.lstrip(" ")
            depth = len(line) - len(bare)
            if bare:
                if not width:
                    if depth <= indent:
                        break
                    width = depth
                elif depth < width:
                    break
                if indent < 0 and line[:3] in ("---", "...") and not line[3:].strip():
                    break
            lines.append(line[width:] if bare else line[width:] if len(line) > width else "")
            self.at = end + 1
        self.at = min(self.at, len(self.text))
        if self.at and self.text[self.at - 1] == "\n":
            self.at -= 1  # the caller looks for the line's end
        trailing = 0
        while lines and not lines[-1]:
            lines.pop()
            trailing += 1
        if node.style == "literal":
            body = "\n".join(lines)
        else:
            body = ""
            for k, line in enumerate(lines):
                body += line
                if k + 1 < len(lines):
                    after = lines[k + 1]
                    if not line or line[:1] in " \t" or after[:1] in (" ", "\t"):
                        body += "\n" if line or not body.endswith("\n") or line[:1] in (" ", "\t") or not after else "\n" if not line and not after else ""
                    elif after:
                        body += " "
                    else:
                        body += "\n"
        node.value = body + ("" if chomp == "-" or not lines and chomp != "+" else "\n" * (1 + trailing) if chomp == "+" else "\n")
        return node

    # ---- inline nodes

    def inline(self, indent: int, key: bool = False) -> Node:
        c = self.peek()
        at = self.at
        if c in ('"', "'"):
            style = "double" if c == '"' else "single"
            return self.mark(Node(SCALAR, self.quoted(), "!!str", style), at)
        if c in "[{" and c:
            return self.flow()
        if c == "*":
            return self.alias()
        if c in ("@", "`", "%") and c:
            self.fault("found character that cannot start any token")
        return self.plain(indent, key)

    def alias(self) -> Node:
        m = re.compile(r"\*([^\s,\[\]{}]+)").match(self.text, self.at)
        name = m[1]
        if name.endswith(":") and name not in self.anchors:
            name = name[:-1]
        if name not in self.anchors:
            self.fault(f"unknown anchor '{name}' referenced")
        node = self.mark(Node(ALIAS, name, target=self.anchors[name]))
        self.at += 1 + len(name)
        return node

    def plain(self, indent: int, key: bool) -> Node:
        node = self.mark(Node(SCALAR))
        lines = [self.plain_line(False)]
        while not key:
            at, pending = self.at, list(self.pending)
            self.spaces()
            if self.peek() != "\n":
                break
            gap = 0
            while self.peek() == "\n":
                self.at += 1
                gap += 1
                self.spaces()
            if not self.peek() or self.column() <= indent or self.peek() == "#" or self.document_mark() or self.simple_key():
                self.at, self.pending = at, pending
                break
            lines.append("\n" * (gap - 1) if gap > 1 else " ")
            lines.append(self.plain_line(False))
        node.value = "".join(lines)
        node.tag = resolve(node.value)
        return node

    def plain_line(self, flow: bool) -> str:
        pattern = r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#:,\[\]{}]|:[^\s,\[\]{}]))*" if flow else r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]|:\S))*"
        m = re.compile(pattern).match(self.text, self.at)
        self.at = m.end()
        return m[0]

    def quoted(self) -> str:
        q = self.peek()
        self.at += 1
        out: list[str] = []
        while True:
            c = self.peek()
            if not c:
                self.fault("found unexpected end of stream")
            if c == q:
                if q == "'" and self.peek(1) == "'":
                    out.append("'")
                    self.at += 2
                    continue
                self.at += 1
                return "".join(out)
            if c == "\n":
                while out and out[-1] in (" ", "\t"):
                    out.pop()
                breaks = 0
                while self.peek() in ("\n", " ", "\t") and self.peek():
                    breaks += self.peek() == "\n"
                    self.at += 1
                out.append(" " if breaks == 1 else "\n" * (breaks - 1))
            elif c == "\\" and q == '"':
                e = self.peek(1)
                if e == "\n":
                    self.at += 2
                    self.spaces()
                elif e in "xuU" and e:
                    n = {"x": 2, "u": 4, "U": 8}[e]
                    code = int(self.text[self.at + 2 : self.at + 2 + n], 16)
                    if 0xD800 <= code < 0xDC00 and self.text[self.at + 6 : self.at + 8] == "\\u":
                        code = 0x10000 + ((code - 0xD800) << 10) + int(self.text[self.at + 8 : self.at + 12], 16) - 0xDC00
                        self.at += 6
                    out.append(chr(code))
                    self.at += 2 + n
                elif e in _ESC:
                    out.append(_ESC[e])
                    self.at += 2
                else:
                    self.fault("found unknown escape character")
            else:
                out.append(c)
                self.at += 1

    def flow_space(self) -> str:
        comment = ""
        while self.peek() in (" ", "\t", "\n", "#") and self.peek():
            if self.peek() == "#":
                comment = self.end_of_line()
            else:
                self.at += 1
        return comment

    def flow(self) -> Node:
        open_ = self.peek()
        node = self.mark(Node(SEQ if open_ == "[" else MAP, tag="!!seq" if open_ == "[" else "!!map", style="flow"))
        close = "]" if open_ == "[" else "}"
        self.at += 1
        while True:
            self.flow_space()
            c = self.peek()
            if not c:
                self.fault(f"did not find expected ',' or '{close}'")
            if c == close:
                self.at += 1
                return node.adopt()
            if c == "?" and self.blank(1):
                self.at += 1
                self.flow_space()
            key = self.flow_node()
            self.flow_space()
            value = None
            if self.peek() == ":" and (self.blank(1) or self.peek(1) in ",]}" or key.style in ("double", "single", "flow")):
                self.at += 1
                self.flow_space()
                value = Node(SCALAR, "", "!!null") if self.peek() in (",", close) else self.flow_node()
            if node.kind == MAP:
                node.content += [key, value or Node(SCALAR, "", "!!null")]
            else:
                node.content.append(key if value is None else Node(MAP, tag="!!map", style="flow", content=[key, value]).adopt())
            self.flow_space()
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != close:
                self.fault(f"did not find expected ',' or '{close}'")

    def flow_node(self) -> Node:
        anchor, tag = self.properties()
        c, at = self.peek(), self.at
        if c in ('"', "'"):
            node = self.mark(Node(SCALAR, self.quoted(), "!!str", "double" if c == '"' else "single"), at)
        elif c in "[{" and c:
            node = self.flow()
        elif c == "*":
            node = self.alias()
        else:
            node = self.mark(Node(SCALAR))
            parts = [self.plain_line(True)]
            while True:
                save = self.at
                self.spaces()
                if self.peek() != "\n":
                    self.at = save
                    break
                self.flow_space()
                more = self.plain_line(True)
                if not more:
                    break
                parts += [" ", more]
            node.value = "".join(parts)
            node.tag = resolve(node.value)
        return self.dress(node, anchor, tag)


def load_all(text: str) -> list[Node]:
    return Reader(text).documents()


# ---- writing

_PLAIN_FIRST = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}])")


def plain_ok(text: str, flow: bool = False) -> bool:
    if not text or text != text.strip() or "\n" in text or not _PLAIN_FIRST.match(text):
        return False
    if ": " in text or " #" in text or text.endswith(":") or re.search(r"[\x00-\x08\x0b-\x1f\x7f\ufeff]|\t", text):
        return False
    return not (flow and re.search(r"[,\[\]{}]", text)) and not text.startswith(("---", "..."))


def quoted_double(text: str) -> str:
    out = []
    back = {"\n": "\\n", "\t": "\\t", "\r": "\\r", '"': '\\"', "\\": "\\\\", "\0": "\\0", "\a": "\\a", "\b": "\\b", "\x1b": "\\e", "\v": "\\v", "\f": "\\f"}
    for c in text:
        out.append(back.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else f"\\u{ord(c):04X}" if c in "\x85\u2028\u2029\ufeff" else c))
    return '"' + "".join(out) + '"'


class Writer:
    def __init__(self, indent: int = 2, unwrap: bool = True):
        self.step, self.unwrap = indent, unwrap

    def document(self, n: Node) -> str:
        out = self.comment(n.head, 0) if n.kind != SCALAR and n.kind != ALIAS or n.head else ""
        if n.kind in (SCALAR, ALIAS):
            if self.unwrap and n.kind == SCALAR and n.tag in _SHORT:
                body = n.value + (f" {n.line_comment}" if n.line_comment else "")
            else:
                body = self.properties(n) + self.scalar(n, 0) + (f" {n.line_comment}" if n.line_comment else "")
            out += body if body.endswith("\n") and n.style in ("literal", "folded") and not self.unwrap else body + "\n"
        elif n.style == "flow" or not n.content:
            out += self.properties(n) + self.flow(n) + (f" {n.line_comment}" if n.line_comment else "") + "\n"
        else:
            props = self.properties(n).strip()
            out += (props + "\n" if props else "") + self.block(n, 0)
        return out + (("\n" if n.kind != SCALAR else "") + self.comment(n.foot, 0) if n.foot else "")

    def comment(self, text: str, depth: int) -> str:
        return "".join((" " * depth + line if line else "") + "\n" for line in text.split("\n")) if text else ""

    def properties(self, n: Node) -> str:
        out = f"&{n.anchor} " if n.anchor else ""
        standard = {MAP: "!!map", SEQ: "!!seq"}.get(n.kind)
        if n.kind == SCALAR:
            if n.tag and n.tag not in _SHORT:
                out += n.tag + " "
            elif n.tag in _SHORT and n.style in ("single", "double") and n.tag != "!!str":
                out += n.tag + " "
        elif n.kind != ALIAS and n.tag not in ("", standard):
            out += n.tag + " "
        return out

    def scalar(self, n: Node, depth: int, flow: bool = False) -> str:
        v = n.value
        if n.kind == ALIAS:
            return "*" + v
        if n.style == "double":
            return quoted_double(v)
        if n.style == "single" and "\n" not in v:
            return "'" + v.replace("'", "''") + "'"
        if not flow and (n.style in ("literal", "folded") or "\n" in v and n.tag == "!!str" and not re.search(r"[\x00-\x08\x0b-\x1f]", v) and v.strip()):
            head = ">" if n.style == "folded" else "|"
            body = v.rstrip("\n")
            tail = len(v) - len(body)
            hint = str(self.step) if body[:1] in (" ", "\n") else ""
            mark = "-" if not tail else "+" if tail > 1 else ""
            pad = " " * (depth or self.step)
            lines = body.split("\n") + [""] * (tail - 1 if tail > 1 else 0)
            if head == ">":
                folded: list[str] = []
                for k, line in enumerate(lines):
                    folded.append(line)
                    if k + 1 < len(lines) and line and lines[k + 1] and line[0] != " " and lines[k + 1][0] != " ":
                        folded.append("")
                lines = folded
            return head + hint + mark + "\n" + "\n".join(pad + x if x else "" for x in lines)
        if n.tag == "!!str" or n.tag.startswith("!") and n.tag not in _SHORT:
            needs = n.tag == "!!str" and resolve(v) != "!!str"
            if needs or not plain_ok(v, flow):
                return quoted_double(v) if "\n" in v or re.search(r"[\x00-\x1f\x7f]", v) or needs or "'" in v or not v else "'" + v + "'"
        return v

    def flow(self, n: Node) -> str:
        if n.kind == MAP:
            return "{" + ", ".join(f"{self.properties(k)}{self.scalar(k, 0, True) if k.kind in (SCALAR, ALIAS) else self.flow(k)}: {self.flow_item(v)}" for k, v in n.pairs()) + "}"
        return "[" + ", ".join(map(self.flow_item, n.content)) + "]"

    def flow_item(self, n: Node) -> str:
        return self.properties(n) + (self.scalar(n, 0, True) if n.kind in (SCALAR, ALIAS) else self.flow(n))

    def block(self, n: Node, depth: int) -> str:
        pad, out = " " * depth, []
        if n.kind == MAP:
            for k, v in n.pairs():
                out.append(self.comment(k.head, depth))
                name = self.properties(k) + (self.scalar(k, depth + self.step) if k.kind in (SCALAR, ALIAS) else self.flow(k))
                colon = " :" if k.kind == ALIAS else ":"
                out.append(pad + name + colon)
                out.append(self.value(v, depth, k.line_comment, False))
                if k.foot:
                    out.append(self.comment(k.foot, depth) + "\n")
        else:
            for v in n.content:
                out.append(self.comment(v.head, depth))
                out.append(pad + "-")
                out.append(self.value(v, depth, "", True))
                if v.foot and v.kind in (SCALAR, ALIAS):
                    out.append(self.comment(v.foot, depth) + "\n")
        return "".join(out)

    def value(self, v: Node, depth: int, key_comment: str, in_seq: bool) -> str:
        props = self.properties(v)
        line = f" {v.line_comment}" if v.line_comment else ""
        if v.kind in (SCALAR, ALIAS):
            text = self.scalar(v, depth + self.step)
            if text[:1] in ("|", ">") and v.style in ("literal", "folded", "") and "\n" in text and v.kind == SCALAR:
                first, rest = text.split("\n", 1)
                return f" {props}{first}{line}\n{rest}\n"
            text = f" {props}{text}".rstrip() if not text else f" {props}{text}"
            return f"{text}{line or (f' {key_comment}' if key_comment else '')}\n"
        if v.style == "flow" or not v.content:
            return f" {props}{self.flow(v)}{line or (f' {key_comment}' if key_comment else '')}\n"
        head = f" {props.rstrip()}" if props else ""
        if in_seq and not props:
            body = self.block(v, depth + self.step)
            if not v.content[0].head:
                return " " * (self.step - 1) + body[depth + self.step :]
            return "\n" + body
        inner = depth + self.step
        note = f" {key_comment}" if key_comment else line
        above = self.comment(v.head, inner) if not in_seq and v.head else ""
        return f"{head}{note}\n{above}{self.block(v, inner)}"


def dump(n: Node, indent: int = 2, unwrap: bool = True) -> str:
    return Writer(indent, unwrap).document(n)
