"""Formats around the node tree: read and write."""

from __future__ import annotations

import base64
import csv as csv_text
import io
import re
import tomllib
import urllib.parse
from collections.abc import Callable
from xml.parsers import expat

from sylva.functions.values import decode_all, encode
from sylva.sources import yaml
from sylva.sources.nodes import MAP, SCALAR, SEQ, Node, YqError, from_value, mapping, null, resolve, scalar, seq, to_value

# ---- JSON


def read_json(text: str) -> list[Node]:
    return [from_value(v) for v in decode_all(text)]


def write_json(n: Node, indent: int = 2) -> str:
    return encode(to_value(n), indent or None) + "\n"


# ---- CSV and TSV


def _csv_reader(separator: str, auto: bool = True):
    def read(text: str) -> list[Node]:
        rows = [r for r in csv_text.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=separator) if r]
        if not rows:
            return []

        def cell(x: str) -> Node:
            if not auto:
                return scalar(x)
            try:
                docs = yaml.load_all(x) if x.strip() else []
            except YqError:
                docs = []
            if docs and docs[0].kind != SCALAR:
                return docs[0]
            return Node(SCALAR, x, resolve(x))

        head = rows[0]
        for k, r in enumerate(rows[1:], 2):
            if len(r) > len(head):
                raise YqError(f"record on line {k}: wrong number of fields")
        return [seq([mapping([(scalar(h), cell(x)) for h, x in zip(head, r, strict=False)]) for r in rows[1:]])]

    return read


def _csv_writer(separator: str):
    def write(n: Node) -> str:
        n = n.real()
        if n.kind != SEQ:
            raise YqError(f"csv encoding only works for arrays, got: {n.tag}")
        out = io.StringIO()
        w = csv_text.writer(out, delimiter=separator, lineterminator="\n", quoting=csv_text.QUOTE_MINIMAL)
        items = [c.real() for c in n.content]
        text = lambda c: "" if c is None else c.value if c.kind == SCALAR else _fault_row(c)
        if all(c.kind == SCALAR for c in items):
            w.writerow([text(c) for c in items])
        elif items and items[0].kind == MAP:
            head = [k.value for k, _ in items[0].pairs()]
            w.writerow(head)
            for c in items:
                if c.kind != MAP:
                    raise YqError(f"csv object encoding only works for arrays of flat objects, child is a {c.tag}")
                w.writerow([text(v.real() if (v := c.get(h)) is not None else None) for h in head])
        else:
            for c in items:
                w.writerow([text(x.real()) for x in c.content])
        return out.getvalue()

    return write


def _fault_row(c: Node):
    raise YqError(f"csv encoding only works for arrays of scalars, child is a {c.tag}")


# ---- XML


def read_xml(text: str, prefix: str = "+@", content: str = "+content", directive: str = "+directive", instruction: str = "+p_", directives: bool = True, instructions: bool = True, namespaces: bool = True, raw: bool = True) -> list[Node]:
    """``namespaces`` off: names without their prefix; ``raw`` off: the prefix's address instead of the prefix."""
    if not text.strip():
        return []
    parser = expat.ParserCreate(namespace_separator=None)
    root = mapping([])
    stack: list[tuple[Node, list[str]]] = [(root, [])]
    waiting: list[str] = []

    def put(parent: Node, name: str, value: Node) -> None:
        old = parent.get(name)
        if old is None:
            parent.content += [scalar(name), value]
        elif old.kind == SEQ and getattr(old, "repeated", False):
            old.content.append(value)
        else:
            many = seq([old, value])
            many.repeated = True
            at = next(k for k in range(0, len(parent.content), 2) if parent.content[k].value == name)
            parent.content[at + 1] = many

    known: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace"}]

    def named(name: str, of_attribute: bool = False) -> str:
        space, colon, local = name.rpartition(":")
        if not namespaces:
            return local
        if raw or of_attribute and space in ("", "xmlns"):
            return name
        space = known[-1].get(space, space)
        return f"{space}:{local}" if space else local

    def start(name, attributes):
        pairs = list(zip(attributes[::2], attributes[1::2], strict=True))
        known.append({**known[-1], **{k.partition(":")[2]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}})
        node = mapping([(scalar(prefix + named(k, True)), scalar(v)) for k, v in pairs])
        if waiting:
            node.head = "\n".join(f"# {w}" for w in waiting)
            waiting.clear()
        stack.append((node, []))

    def end(name):
        node, parts = stack.pop()
        text_ = "".join(parts).strip()
        if not node.content:
            value = Node(SCALAR, text_, "!!str") if text_ else null()
            if not text_:
                value.value = ""
            value.head = node.head
        else:
            if text_:
                node.content = [scalar(content), scalar(text_), *node.content]
            value = node
        put(stack[-1][0], named(name), value.adopt())
        known.pop()

    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda d: stack[-1][1].append(d)
    parser.CommentHandler = lambda d: waiting.append(d.strip())
    if instructions:
        parser.ProcessingInstructionHandler = lambda t, d: put(stack[-1][0], instruction + t, scalar(d))
        parser.XmlDeclHandler = lambda version, encoding, alone: put(root, instruction + "xml", scalar(f'version="{version}"' + (f' encoding="{encoding}"' if encoding else "")))
    if directives:
        parser.StartDoctypeDeclHandler = lambda name, sysid, pubid, internal: put(root, directive, scalar("DOCTYPE " + name + (f' SYSTEM "{sysid}"' if sysid else "")))
    try:
        parser.Parse(text.strip(), True)
    except expat.ExpatError as e:
        raise YqError(f"bad file: XML syntax error: {e}") from e
    return [root.adopt()] if root.content else []


_XML = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_ATTRIBUTE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "\n": "&#xA;", "\t": "&#x9;"})


def write_xml(n: Node, indent: int = 2, prefix: str = "+@", content: str = "+content", directive: str = "+directive", instruction: str = "+p_") -> str:
    out: list[str] = []

    def element(name: str, v: Node, depth: int) -> None:
        v = v.real()
        pad = " " * indent * depth
        for c in filter(None, [v.head]):
            out.append(f"{pad}<!-- {c.lstrip('# ')} -->\n")
        if v.kind == SEQ:
            for x in v.content:
                element(name, x, depth)
        elif v.kind == SCALAR:
            out.append(f"{pad}<{name}>{'' if v.tag == '!!null' else v.value.translate(_XML)}</{name}>\n")
        else:
            attributes = "".join(f' {k.value[len(prefix):]}="{x.real().value.translate(_ATTRIBUTE)}"' for k, x in v.pairs() if k.value.startswith(prefix))
            rest = [(k.value, x) for k, x in v.pairs() if not k.value.startswith(prefix)]
            if not [1 for k, _ in rest if k != content]:
                body = "".join(x.real().value.translate(_XML) for _, x in rest)
                out.append(f"{pad}<{name}{attributes}>{body}</{name}>\n")
                return
            out.append(f"{pad}<{name}{attributes}>")
            first = True
            for k, x in rest:
                if k == content:
                    out.append(x.real().value.translate(_XML))
                else:
                    if first:
                        out.append("\n")
                    first = False
                    element(k, x, depth + 1)
            out.append(f"{pad}</{name}>\n")

    n = n.real()
    if n.kind == SCALAR:
        return n.value.translate(_XML) + "\n"
    if n.kind == SEQ:
        raise YqError("xml encoding needs a map at the top")
    for k, v in n.pairs():
        if k.value.startswith(instruction):
            out.append(f"<?{k.value[len(instruction):]} {v.value}?>\n")
        elif k.value == directive:
            out.append(f"<!{v.value}>\n")
        else:
            element(k.value, v, 0)
    return "".join(out)


# ---- properties


def read_props(text: str) -> list[Node]:
    root, comments = mapping([]), []
    lines = iter(re.sub(r"(?<!\\)((?:\\\\)*)\\\n[ \t\f]*", r"\1", text.replace("\r\n", "\n")).split("\n"))
    found = False
    for raw in lines:
        line = raw.strip(" \t\f")
        if not line:
            continue
        if line[0] in "#!":
            comments.append("# " + line[1:].strip())
            continue
        m = re.match(r"((?:\\.|[^=:\s\\])*)[ \t\f]*[=:]?[ \t\f]*(.*)", line, re.S)
        key, value = (re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if len(e[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r", "f": "\f"}.get(e[1], e[1]), x) for x in m.groups())
        found = True
        node = root
        parts = key.split(".")
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            following_list = not last and re.fullmatch("[0-9]{1,9}", parts[k + 1])
            made = scalar(value) if last else seq([]) if following_list else mapping([])
            if node.kind == SEQ and re.fullmatch("[0-9]{1,9}", part):
                at = int(part)
                while len(node.content) <= at:
                    node.content.append(null())
                if last or node.content[at].kind == SCALAR:
                    node.content[at] = made
                child = node.content[at]
            else:
                old = node.get(part) if node.kind == MAP else None
                if old is None or last or old.kind == SCALAR:
                    if old is not None:
                        at = next(j for j in range(0, len(node.content), 2) if node.content[j].value == part)
                        node.content[at + 1] = made
                    else:
                        name = scalar(part)
                        if last and comments:
                            name.head = "\n".join(comments)
                        node.content += [name, made]
                    old = made
                child = old
            node.adopt()
            node = child
        comments = []
    return [root.adopt()] if found else []


def write_props(n: Node, separator: str = " = ", brackets: bool = False) -> str:
    """``brackets``: places in arrays as [0] instead of .0."""
    out: list[str] = []

    def walk(v: Node, path: list[str], comment: str) -> None:
        v = v.real()
        if v.kind == MAP:
            for k, x in v.pairs():
                walk(x, [*path, k.value], k.head)
        elif v.kind == SEQ:
            for k, x in enumerate(v.content):
                walk(x, [*path[:-1], f"{path[-1]}[{k}]"] if brackets and path else [*path, str(k)], x.head)
        else:
            for c in [*comment.split("\n"), *v.head.split("\n"), v.line_comment]:
                if c:
                    out.append(c + "\n")
            value = "" if v.tag == "!!null" else v.value
            out.append(f"{'.'.join(p.replace(' ', chr(92) + ' ') for p in path)}{separator}{value.replace(chr(10), chr(92) + 'n')}\n" if path else value + "\n")

    walk(n, [], "")
    return "".join(out)


# ---- TOML


def read_toml(text: str) -> list[Node]:
    import datetime

    def node(v) -> Node:
        if isinstance(v, dict):
            return mapping([(scalar(k), node(x)) for k, x in v.items()])
        if isinstance(v, list):
            return seq([node(x) for x in v])
        if isinstance(v, (datetime.datetime, datetime.date, datetime.time)):
            return Node(SCALAR, v.isoformat().replace("+00:00", "Z"), "!!timestamp")
        return scalar(v)

    try:
        return [node(tomllib.loads(text))] if text.strip() else []
    except tomllib.TOMLDecodeError as e:
        raise YqError(f"bad file: {e}") from e


def _toml_key(k: str) -> str:
    return k if re.fullmatch("[A-Za-z0-9_-]+", k) else yaml.quoted_double(k)


def _toml_value(v: Node) -> str:
    v = v.real()
    if v.kind == SEQ:
        return "[" + ", ".join(map(_toml_value, v.content)) + "]"
    if v.kind == MAP:
        return "{ " + ", ".join(f"{_toml_key(k.value)} = {_toml_value(x)}" for k, x in v.pairs()) + " }"
    if v.tag == "!!null":
        raise YqError("toml has no null")
    if v.tag in ("!!int", "!!float", "!!bool", "!!timestamp"):
        return v.value.lstrip(".") if v.value in (".inf", ".nan") else v.value
    return yaml.quoted_double(v.value)


def write_toml(n: Node) -> str:
    out: list[str] = []

    def table(v: Node, path: list[str]) -> None:
        later = []
        for k, x in v.pairs():
            x = x.real()
            if x.kind == MAP and x.style != "flow" or x.kind == SEQ and x.content and all(c.real().kind == MAP for c in x.content) and x.style != "flow":
                later.append((k.value, x))
            else:
                out.append("".join(f"{c}\n" for c in k.head.split("\n") if c) + f"{_toml_key(k.value)} = {_toml_value(x)}\n")
        for k, x in later:
            name = ".".join(map(_toml_key, [*path, k]))
            if x.kind == MAP:
                scalars = [y for _, y in x.pairs() if y.real().kind != MAP]
                if scalars or not x.content:
                    out.append(("\n" if out else "") + f"[{name}]\n")
                table(x, [*path, k])
            else:
                for c in x.content:
                    out.append(("\n" if out else "") + f"[[{name}]]\n")
                    table(c.real(), [*path, k])

    n = n.real()
    if n.kind != MAP:
        return _toml_value(n) + "\n"
    table(n, [])
    return "".join(out)


# ---- HCL


class _Hcl:
    """Attributes, blocks nested by label, literals; other expressions stay as text in ${}."""

    def __init__(self, text: str):
        self.t, self.at, self.notes = text, 0, []

    def skip(self, newlines: bool = True) -> None:
        while self.at < len(self.t):
            c = self.t[self.at]
            if c in " \t\r" or newlines and c in "\n,":
                self.at += 1
            elif c == "#" or self.t.startswith("//", self.at):
                end = (self.t + "\n").index("\n", self.at)
                self.notes.append("# " + self.t[self.at : end].lstrip("#/").strip())
                self.at = end
            elif self.t.startswith("/*", self.at):
                self.at = self.t.index("*/", self.at) + 2
            else:
                return

    def name(self) -> str | None:
        m = re.compile(r"[A-Za-z_][\w-]*").match(self.t, self.at)
        if m:
            self.at = m.end()
        return m[0] if m else None

    def body(self, close: str = "") -> Node:
        out = mapping([])
        while True:
            self.skip()
            if self.at >= len(self.t) or self.t[self.at] == "}":
                if close and self.at >= len(self.t):
                    raise YqError("bad file: a block isn't closed")
                self.at += bool(close)
                return out.adopt()
            head = "\n".join(self.notes)
            self.notes = []
            name = self.string() if self.t[self.at] == '"' else self.name()
            if name is None:
                raise YqError(f"bad file: unexpected {self.t[self.at:self.at + 10]!r}")
            self.skip(False)
            if self.t[self.at : self.at + 1] in ("=", ":"):
                self.at += 1
                self.skip(False)
                key = scalar(name)
                key.head = head
                out.content += [key, self.value()]
                continue
            labels = [name]
            while self.at < len(self.t) and self.t[self.at] != "{":
                label = self.string() if self.t[self.at] == '"' else self.name()
                if label is None:
                    raise YqError(f"bad file: unexpected {self.t[self.at:self.at + 10]!r}")
                labels.append(label)
                self.skip(False)
            self.at += 1
            block = self.body("}")
            node = out
            for label in labels[:-1]:
                if node.get(label) is None:
                    node.content += [scalar(label), mapping([])]
                node = node.get(label)
            old = node.get(labels[-1])
            if old is None:
                key = scalar(labels[-1])
                key.head = head
                node.content += [key, block]
            elif old.kind == SEQ:
                old.content.append(block)
            else:
                node.content[node.content.index(old)] = seq([old, block])

    def string(self) -> str:
        self.at += 1
        out, depth = [], 0
        while self.at < len(self.t):
            c = self.t[self.at]
            if c == "\\" and not depth:
                e = self.t[self.at + 1]
                out.append({"n": "\n", "t": "\t", "r": "\r"}.get(e, e))
                self.at += 2
                continue
            if self.t.startswith("${", self.at):
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            elif c == '"' and not depth:
                self.at += 1
                return "".join(out)
            out.append(c)
            self.at += 1
        raise YqError("bad file: a string isn't closed")

    def value(self) -> Node:
        c = self.t[self.at : self.at + 1]
        if c == '"':
            at = self.at
            s = self.string()
            if self.ended():
                return scalar(s, "double")
            self.at = at
            return self.expression()
        if c == "[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if self.t[self.at : self.at + 1] == "]":
                    self.at += 1
                    return seq(items, "flow")
                if self.at >= len(self.t):
                    raise YqError("bad file: a list isn't closed")
                items.append(self.value())
        if c == "{":
            self.at += 1
            out = self.body("}")
            out.style = "flow"
            return out
        if m := re.compile(r"<<-?(\w+)\n(.*?)\n[ \t]*\1(?=\n|$)", re.S).match(self.t, self.at):
            self.at = m.end()
            return scalar(m[2] + "\n", "literal")
        m = re.compile(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true\b|false\b|null\b").match(self.t, self.at)
        if m:
            at, self.at = self.at, m.end()
            if self.ended():
                return Node(SCALAR, m[0], resolve(m[0]))
            self.at = at
        return self.expression()

    def ended(self) -> bool:
        return bool(re.compile(r"[ \t\r]*(?:[\n,\]}#]|//|$)").match(self.t, self.at))

    def expression(self) -> Node:
        depth, start = 0, self.at
        while self.at < len(self.t):
            c = self.t[self.at]
            if c == '"':
                self.string()
                continue
            if c in "([{":
                depth += 1
            elif c in ")]}":
                if not depth:
                    break
                depth -= 1
            elif c in "\n,#" and not depth:
                break
            self.at += 1
        return scalar("${" + self.t[start : self.at].strip() + "}")


def read_hcl(text: str) -> list[Node]:
    return [_Hcl(text).body()] if text.strip() else []


def write_hcl(n: Node) -> str:
    out: list[str] = []

    def value(v: Node, depth: int) -> str:
        v = v.real()
        if v.kind == SEQ:
            return "[" + ", ".join(value(c, depth) for c in v.content) + "]"
        if v.kind == MAP:
            pad = "  " * (depth + 1)
            return "{\n" + "".join(f"{pad}{k.value} = {value(x, depth + 1)}\n" for k, x in v.pairs()) + "  " * depth + "}"
        if v.tag in ("!!int", "!!float", "!!bool", "!!null"):
            return "null" if v.tag == "!!null" else v.value
        m = re.fullmatch(r"\$\{([^{}]*)\}", v.value)
        return m[1] if m and not v.style else '"' + v.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

    def body(v: Node, depth: int) -> None:
        pad = "  " * depth
        for k, x in v.pairs():
            for c in filter(None, k.head.split("\n")):
                out.append(f"{pad}{c}\n")
            block(k.value, x.real(), depth, [])

    def block(name: str, v: Node, depth: int, labels: list[str]) -> None:
        pad = "  " * depth
        if v.kind == SEQ and v.content and v.style != "flow" and all(c.real().kind == MAP for c in v.content):
            for c in v.content:
                block(name, c.real(), depth, labels)
        elif v.kind == MAP and v.style != "flow":
            inner = [x.real() for _, x in v.pairs()]
            if inner and all(x.kind == MAP and x.style != "flow" for x in inner) and len(labels) < 3:
                for k, x in v.pairs():
                    block(name, x.real(), depth, [*labels, k.value])
                return
            out.append(f"{pad}{name}{''.join(f' {chr(34)}{x}{chr(34)}' for x in labels)} {{\n")
            body(v, depth + 1)
            out.append(f"{pad}}}\n")
        else:
            out.append(f"{pad}{name} = {value(v, depth)}\n")

    body(n.real(), 0)
    return "".join(out)


# ---- Lua


def read_lua(text: str) -> list[Node]:
    token = re.compile(r"\s+|--\[\[.*?\]\]|--[^\n]*|(\[\[.*?\]\]|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|-?0x[0-9a-fA-F]+|-?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|-?math\.huge|\(0/0\)|[A-Za-z_]\w*|[{}\[\]=,;])", re.S)
    words, at = [], 0
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise YqError(f"bad file: unexpected {text[at:at + 10]!r}")
        at = m.end()
        if m[1]:
            words.append(m[1])
    words.append("")
    k = 0

    def value() -> Node:
        nonlocal k
        w = words[k]
        k += 1
        if w == "{":
            items, named, n = [], [], 0
            while words[k] != "}":
                if words[k] == "[":
                    k += 1
                    key = value()
                    k += 2
                    named.append((key, value()))
                elif words[k + 1] == "=":
                    key = scalar(words[k])
                    k += 2
                    named.append((key, value()))
                else:
                    n += 1
                    items.append(value())
                if words[k] in (",", ";"):
                    k += 1
                elif words[k] != "}":
                    raise YqError("bad file: a table isn't closed")
            k += 1
            if not named:
                return seq(items) if items else mapping([])
            return mapping([*((scalar(j), x) for j, x in enumerate(items, 1)), *named])
        if w[:2] == "[[":
            return scalar(w[2:-2].removeprefix("\n"), "literal")
        if w[:1] in ("'", '"'):
            return scalar(re.sub(r"\\(\d{1,3}|x[0-9a-fA-F]{2}|.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1]) or (chr(int(e[1])) if e[1].isdigit() else chr(int(e[1][1:], 16)) if len(e[1]) == 3 else e[1]), w[1:-1], flags=re.S), "double")
        if w in ("true", "false"):
            return scalar(w == "true")
        if w == "nil":
            return null()
        if "math.huge" in w:
            return Node(SCALAR, "-.inf" if w[0] == "-" else ".inf", "!!float")
        if w == "(0/0)":
            return Node(SCALAR, ".nan", "!!float")
        if re.match("-?[0-9]", w):
            return Node(SCALAR, w, resolve(w))
        raise YqError(f"bad file: unexpected {w!r}")

    if not words[0]:
        return []
    if words[0] == "return":
        k = 1
        return [value()]
    pairs = []
    while words[k]:
        key = scalar(words[k])
        k += 2
        pairs.append((key, value()))
        k += words[k] == ";"
    return [mapping(pairs)]


_LUA_WORDS = set("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())


def write_lua(n: Node, prefix: str = "return ", suffix: str = ";\n", unquoted: bool = False, as_globals: bool = False) -> str:
    """``unquoted``: keys that are names stand bare; ``as_globals``: the top map's entries are assignments."""

    def key(k: Node, bare: bool) -> str:
        if bare and re.fullmatch(r"[A-Za-z_]\w*", k.value, re.ASCII) and k.value not in _LUA_WORDS:
            return k.value
        if bare and as_globals and n.real().kind == MAP and any(k is x for x, _ in n.real().pairs()):
            raise YqError(f"{k.value!r} can't be the name of a global variable")
        return f"[{k.value}]" if k.tag in ("!!int", "!!float", "!!bool") else f'["{k.value}"]'

    def value(v: Node, depth: int) -> str:
        v = v.real()
        pad = "\t" * (depth + 1)
        if v.kind == SEQ:
            return "{\n" + "".join(f"{pad}{value(c, depth + 1)},\n" for c in v.content) + "\t" * depth + "}" if v.content else "{}"
        if v.kind == MAP:
            return "{\n" + "".join(f"{pad}{key(k, unquoted)} = {value(x, depth + 1)};\n" for k, x in v.pairs()) + "\t" * depth + "}" if v.content else "{}"
        if v.tag == "!!null":
            return "nil"
        if v.tag in ("!!int", "!!float", "!!bool"):
            return {".inf": "(1/0)", "-.inf": "(-1/0)", ".nan": "(0/0)"}.get(v.value, v.value.lower())
        return '"' + v.value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'

    if as_globals and n.real().kind == MAP:
        return "".join(f"{key(k, True)} = {value(x, 0)};\n" for k, x in n.real().pairs())
    return prefix + value(n, 0) + suffix


# ---- shell, base64, uri, kyaml


def write_shell(n: Node, separator: str = "_") -> str:
    out: list[str] = []

    def walk(v: Node, path: list[str]) -> None:
        v = v.real()
        if v.kind == MAP:
            for k, x in v.pairs():
                walk(x, [*path, re.sub(r"[^A-Za-z0-9_]", "_", k.value)])
        elif v.kind == SEQ:
            for k, x in enumerate(v.content):
                walk(x, [*path, str(k)])
        else:
            name = separator.join(path) or "value"
            name = "_" + name if name[0].isdigit() else name
            text = "" if v.tag == "!!null" else v.value
            out.append(f"{name}={text if re.fullmatch(r'[A-Za-z0-9_.+,/@%:=-]*', text) and text or not text else chr(39) + text.replace(chr(39), chr(39) + chr(34) + chr(39) + chr(34) + chr(39)) + chr(39)}\n")

    walk(n, [])
    return "".join(out)


def one_text(n: Node) -> str:
    n = n.real()
    if n.kind != SCALAR:
        raise YqError(f"cannot encode {n.tag} as text, only scalars")
    return n.value


def write_kyaml(n: Node, depth: int = 0) -> str:
    def value(v: Node, depth: int) -> str:
        v = v.real()
        pad = "  " * (depth + 1)
        if v.kind == MAP:
            key = lambda k: k.value if re.fullmatch(r"[A-Za-z_][\w./-]*", k.value) and resolve(k.value) == "!!str" and k.value.lower() not in ("y", "n", "yes", "no", "on", "off") else yaml.quoted_double(k.value)
            return "{\n" + "".join("".join(f"{pad}{c}\n" for c in k.head.split("\n") if c) + f"{pad}{key(k)}: {value(x, depth + 1)},\n" for k, x in v.pairs()) + "  " * depth + "}" if v.content else "{}"
        if v.kind == SEQ:
            if v.content and all(c.real().kind != SCALAR for c in v.content):
                return "[" + ", ".join(value(c, depth) for c in v.content) + "]"
            return "[\n" + "".join(f"{pad}{value(c, depth + 1)},\n" for c in v.content) + "  " * depth + "]" if v.content else "[]"
        if v.tag in ("!!int", "!!float", "!!bool"):
            return v.value
        return "null" if v.tag == "!!null" else yaml.quoted_double(v.value)

    return "---\n" + value(n, depth) + "\n"


READERS: dict[str, Callable[[str], list[Node]]] = {
    "yaml": yaml.load_all, "kyaml": yaml.load_all, "json": read_json, "csv": _csv_reader(","), "tsv": _csv_reader("\t"), "xml": read_xml, "props": read_props,
    "toml": read_toml, "hcl": read_hcl, "lua": read_lua,
    "base64": lambda t: [scalar(base64.b64decode(t.strip() + "=" * (-len(t.strip()) % 4)).decode("utf-8", "replace"))] if t.strip() else [],
    "base64url": lambda t: [scalar(base64.urlsafe_b64decode(t.strip() + "=" * (-len(t.strip()) % 4)).decode("utf-8", "replace"))] if t.strip() else [],
    "uri": lambda t: [scalar(urllib.parse.unquote_plus(t.rstrip("\n")))] if t else [],
}
WRITERS: dict[str, Callable[..., str]] = {
    "yaml": yaml.dump, "json": write_json, "csv": _csv_writer(","), "tsv": _csv_writer("\t"), "xml": write_xml, "props": write_props, "toml": write_toml,
    "hcl": write_hcl, "lua": write_lua, "shell": write_shell, "kyaml": write_kyaml,
    "base64": lambda n: base64.b64encode(one_text(n).encode()).decode(), "base64url": lambda n: base64.urlsafe_b64encode(one_text(n).encode()).decode(),
    "uri": lambda n: urllib.parse.quote_plus(one_text(n)),
}
#: File extensions and short names of formats.
NAMES = {"yml": "yaml", "y": "yaml", "j": "json", "c": "csv", "t": "tsv", "x": "xml", "p": "props", "properties": "props", "tf": "hcl", "hc": "hcl", "l": "lua", "b64": "base64", "ky": "kyaml", "sh": "shell"}


#: Options of formats by name, with the argument they set ("not" before it: turned round).
_XML_NAMES = {"xml-attribute-prefix": "prefix", "xml-content-name": "content", "xml-directive-name": "directive", "xml-proc-inst-prefix": "instruction"}
_XML_READ = {**_XML_NAMES, "xml-skip-directives": "not directives", "xml-skip-proc-inst": "not instructions", "xml-keep-namespace": "namespaces", "xml-raw-token": "raw"}
_PROPS = {"properties-separator": "separator", "properties-array-brackets": "brackets"}
_LUA = {"lua-prefix": "prefix", "lua-suffix": "suffix", "lua-unquoted": "unquoted", "lua-globals": "as_globals"}


def _arguments(names: dict[str, str], options: dict) -> dict:
    return {names[k].removeprefix("not "): not v if names[k].startswith("not ") else v for k, v in options.items() if k in names}


def reader(name: str, options: dict) -> Callable[[str], list[Node]]:
    """The reader of a format under the options of the command line."""
    if name in ("csv", "tsv"):
        separator = options.get("csv-separator", ",") if name == "csv" else "\t"
        if len(separator) != 1:
            raise YqError("csv-separator must be one character")
        return _csv_reader(separator, options.get(f"{name}-auto-parse", True))
    if name == "xml":
        return lambda text: read_xml(text, **_arguments(_XML_READ, options))
    if name not in READERS:
        raise YqError(f"{name} can't be read")
    return READERS[name]


def writer(name: str, options: dict) -> Callable[[Node], str]:
    """The writer of a format under the options of the command line."""
    if name == "csv":
        return _csv_writer(options.get("csv-separator", ","))
    if name == "shell":
        return lambda n: write_shell(n, options.get("shell-key-separator", "_"))
    for of, write, names in (("xml", write_xml, _XML_NAMES), ("props", write_props, _PROPS), ("lua", write_lua, _LUA)):
        if name == of:
            return lambda n: write(n, **_arguments(names, options))  # noqa: B023
    return WRITERS[name]


def format_of(name: str) -> str:
    """The format of a short name, extension or file name."""
    ext = name.rsplit(".", 1)[-1].lower()
    found = NAMES.get(ext, ext)
    return found if found in READERS or found in WRITERS else "yaml"


def split_front_matter(text: str) -> tuple[str, str]:
    """Leading YAML between --- lines, and the rest with its opening ---."""
    m = re.match(r"---[ \t]*\n(.*?)(^---[ \t]*(?:\n|\Z).*)", text, re.S | re.M)
    return (m[1], m[2]) if m else (text, "")
