"""JSON filter programs over tables, planned as DataFrames.

The table is the program's input: an array of row objects (slurp), or each row in turn (stream). A pipeline is lowered step
by step. The state is a stream or an array of typed values, or groups of an array; each step extends a lazy DataFrame, so
Catalyst sees filters, projections, aggregates, joins and sorts. What has no typed form raises ``NotPlanned``; the caller
then evaluates row by row inside Arrow batches, where that is possible.

Order is part of the language. It is kept as explicit columns: the table's own order (columns the caller names, or the scan
order) extended by positions of exploded arrays; sorts and groups replace it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.plans.jq_parser import parse


class NotPlanned(Exception):
    """No typed plan for this (part of a) program."""


@dataclass
class Value:
    """A typed expression; ``fields`` are set where it is an object with known keys."""

    col: Column | None
    type: T.DataType | None = None
    fields: dict[str, Value] | None = None
    literal: object = None
    is_literal: bool = False

    def column(self) -> Column:
        if self.fields is not None:
            return F.struct(*[v.column().alias(k) for k, v in self.fields.items()]) if self.fields else F.struct()
        return self.col


def literal(x) -> Value:
    if isinstance(x, list):
        items = [literal(y) for y in x]
        return Value(F.array(*[i.col for i in items]), T.ArrayType(items[0].type if items else T.NullType()), literal=x, is_literal=True)
    kind = T.NullType() if x is None else T.BooleanType() if isinstance(x, bool) else T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()
    if isinstance(x, dict):
        return Value(None, None, {k: literal(v) for k, v in x.items()}, x, True)
    return Value(F.lit(float(x) if isinstance(x, float) else x), kind, literal=x, is_literal=True)


def typed(col: Column, kind: T.DataType) -> Value:
    if isinstance(kind, T.StructType):
        return Value(col, kind, {f.name: typed(col.getField(f.name), f.dataType) for f in kind.fields})
    return Value(col, kind)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_num(v: Value) -> bool:
    return isinstance(v.type, NUMERIC)


def is_null(v: Value) -> bool:
    return isinstance(v.type, T.NullType)


def kind(v: Value) -> str:
    if v.fields is not None:
        return "object"
    t = v.type
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, NUMERIC):
        return "number"
    if isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.MapType):
        return "object"
    raise NotPlanned(f"values of type {t}")


def text(v: Value) -> Value:
    """tostring of a scalar that is no double (whose shortest form has no function) and no container."""
    k = kind(v)
    if k == "string":
        return as_text(v)
    if k == "boolean" or (k == "number" and isinstance(v.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))):
        return Value(F.coalesce(v.col.cast("string"), F.lit("null")), T.StringType())
    if k == "null":
        return literal("null")
    raise NotPlanned("text of a double or container")


def as_text(v: Value) -> Value:
    """Timestamps are ISO-8601 text to the language."""
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        return Value(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss'Z'"), T.StringType())
    if isinstance(v.type, T.DateType):
        return Value(v.col.cast("string"), T.StringType())
    return v


def truthy(v: Value) -> Column:
    if v.fields is not None:
        return F.lit(True)
    if isinstance(v.type, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    return v.col.isNotNull()


def boolean(c: Column) -> Value:
    return Value(c, T.BooleanType())


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    floating = (T.FloatType, T.DoubleType, T.DecimalType)
    return T.DoubleType() if isinstance(a, floating) or isinstance(b, floating) else T.LongType()


def order_key(v: Value) -> list[Column]:
    """Sort columns with the language's order: null first, NaN below the numbers, text by bytes."""
    if v.fields is not None:
        return [c for k in sorted(v.fields) for c in order_key(v.fields[k])]
    c = v.col
    if isinstance(v.type, (T.FloatType, T.DoubleType)):
        return [c.isNotNull(), ~F.isnan(c), c]
    return [c]  # ascending order puts null first


def comparison(op: str, a: Value, b: Value) -> Value:
    if a.fields is not None or b.fields is not None:
        raise NotPlanned("comparison of objects")
    ka, kb = kind(a), kind(b)
    if ka != kb and "null" not in (ka, kb):
        ranks = ["null", "boolean", "number", "string", "array", "object"]
        # a null of either column still ranks lowest
        low = ranks.index(ka) < ranks.index(kb)
        less = F.when(a.col.isNull(), b.col.isNotNull()).when(b.col.isNull(), F.lit(False)).otherwise(F.lit(low))
        same = a.col.isNull() & b.col.isNull()
    else:
        if ka == "string":
            a, b = as_text(a), as_text(b)
        x, y = a.col, b.col
        same = x.eqNullSafe(y)
        if ka == "number" and (isinstance(a.type, (T.FloatType, T.DoubleType)) or isinstance(b.type, (T.FloatType, T.DoubleType))):
            nan_x, nan_y = F.isnan(x.cast("double")), F.isnan(y.cast("double"))
            same = same & ~F.coalesce(nan_x, F.lit(False))
            strict = F.when(nan_x, F.lit(True)).when(nan_y, F.lit(False)).otherwise(x < y)
        else:
            strict = x < y
        less = F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(strict)
    return boolean({"==": same, "!=": ~same, "<": less, "<=": less | same, ">": ~(less | same), ">=": ~less}[op])


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if a.fields is not None and b.fields is not None and op == "+":
        return Value(None, None, {**a.fields, **b.fields})
    if a.fields is not None or b.fields is not None:
        raise NotPlanned("arithmetic on objects")
    if op == "+" and is_null(a):
        return b
    if op == "+" and is_null(b):
        return a
    if is_num(a) and is_num(b):
        x, y = a.col, b.col
        if op == "/":
            return Value(x.cast("double") / y.cast("double"), T.DoubleType())
        if op == "%":
            return Value(x.cast("long") % F.abs(y.cast("long")), T.LongType())
        t = wider(a.type, b.type)
        x, y = x.cast(t), y.cast(t)
        if op == "+":
            return Value(F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y), t)
        return Value(x - y if op == "-" else x * y, t)
    ka, kb = kind(a), kind(b)
    if ka == kb == "string":
        x, y = as_text(a).col, as_text(b).col
        if op == "+":
            return Value(F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))), T.StringType())
        if op == "/":
            return split(a, b)
    if ka == kb == "array":
        if op == "+":
            return Value(F.concat(F.coalesce(a.col, F.array().cast(a.type)), F.coalesce(b.col.cast(a.type), F.array().cast(a.type))), a.type)
        if op == "-":
            return Value(F.filter(a.col, lambda x: ~F.exists(b.col, lambda y: x.eqNullSafe(y))), a.type)
    if ka == "string" and kb == "number" and op == "*":
        return Value(F.when(b.col > 0, F.repeat(a.col, F.greatest(b.col.cast("int"), F.lit(1)))), T.StringType())
    raise NotPlanned(f"{ka} {op} {kb}")


def split(a: Value, sep: Value) -> Value:
    if not sep.is_literal:
        raise NotPlanned("a separator that varies")
    s = as_text(a).col
    pattern = "" if sep.literal == "" else "\\Q" + sep.literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    made = F.split(s, pattern, -1)
    if sep.literal == "":
        made = F.filter(made, lambda c: c != "")
    return Value(F.when(s == "", F.array().cast("array<string>")).otherwise(made), T.ArrayType(T.StringType()))


def index(v: Value, key: Value) -> Value:
    if key.is_literal and isinstance(key.literal, str):
        if v.fields is not None:
            return v.fields.get(key.literal, literal(None))
        if isinstance(v.type, T.MapType):
            return typed(F.try_element_at(v.col, F.lit(key.literal)), v.type.valueType)
    if isinstance(v.type, T.ArrayType) and is_num(key):
        at = F.floor(key.col).cast("int") if not key.is_literal else F.lit(int(key.literal // 1))
        at = F.when(at < 0, F.size(v.col) + at).otherwise(at)
        return typed(F.when(at >= 0, F.get(v.col, at)), v.type.elementType)
    raise NotPlanned("index")


_SIMPLE_TEXT = {
    "ascii_downcase": lambda s: F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    "ascii_upcase": lambda s: F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "trim": lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), "ltrim": lambda s: F.regexp_replace(s, r"(?U)^\s+", ""), "rtrim": lambda s: F.regexp_replace(s, r"(?U)\s+$", ""),
}
_MATH = {
    **{n: getattr(F, n) for n in "acos acosh asin asinh atan cos cosh exp expm1 sin sinh tan tanh sqrt cbrt log1p log2 log10 rint".split()},
    "log": F.ln, "exp10": lambda x: F.pow(F.lit(10.0), x), "exp2": lambda x: F.pow(F.lit(2.0), x), "pow10": lambda x: F.pow(F.lit(10.0), x), "nearbyint": F.rint,
    "fabs": F.abs, "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)), "round": lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5), "floor": F.floor, "ceil": F.ceil,
}
_MATH2 = {"pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "fmin": F.least, "fmax": F.greatest, "fmod": lambda a, b: a % b}


class Scalars:
    """Lowers single-valued expressions over one current value."""

    def __init__(self, variables: dict[str, Value], functions: dict):
        self.vars, self.functions = variables, functions

    def with_var(self, name: str, v: Value) -> Scalars:
        return Scalars({**self.vars, name: v}, self.functions)

    def lower(self, node, cur: Value) -> Value:
        method = getattr(self, "on_" + node[0], None)
        if method is None:
            raise NotPlanned(node[0])
        return method(cur, *node[1:])

    def on_identity(self, cur):
        return cur

    def on_literal(self, cur, x):
        return literal(x)

    def on_string(self, cur, form, parts):
        if all(isinstance(p, str) for p in parts) and not form:
            return literal("".join(parts))
        if not parts:
            return literal("")
        pieces = [F.lit(p) if isinstance(p, str) else (self.shaped(form, self.lower(p, cur)) if form else text(self.lower(p, cur))).col for p in parts]
        return Value(F.concat(*pieces), T.StringType())

    def on_format(self, cur, name):
        return self.shaped(name, cur)

    def shaped(self, name, v: Value) -> Value:
        if name == "@text":
            return text(v)
        if name == "@json":
            return self.call_tojson_0(v)
        if name == "@sh" and kind(v) == "string":
            return Value(F.concat(F.lit("'"), F.replace(as_text(v).col, F.lit("'"), F.lit("'\\''")), F.lit("'")), T.StringType())
        if name == "@base64":
            return Value(F.regexp_replace(F.base64(F.encode(text(v).col, "utf-8")), "[\\r\\n]", ""), T.StringType())
        if name == "@base64d":
            return Value(F.decode(F.unbase64(text(v).col), "utf-8"), T.StringType())
        if name == "@uri":
            c = F.url_encode(text(v).col)
            for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
                c = F.regexp_replace(c, a, b)
            return Value(c, T.StringType())
        if name == "@html":
            c = text(v).col
            for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
                c = F.replace(c, F.lit(a), F.lit(b))
            return Value(c, T.StringType())
        if name in ("@csv", "@tsv") and v.fields is None and getattr(v, "items", None):
            parts = []
            for x in v.items:
                if kind(x) == "string":
                    s = as_text(x).col
                    if name == "@csv":
                        s = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
                    else:
                        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                            s = F.replace(s, F.lit(a), F.lit(b))
                else:
                    s = F.when(x.col.isNotNull(), text(x).col)
                parts.append(F.coalesce(s, F.lit("")))
            return Value(F.concat_ws("," if name == "@csv" else "\t", *parts), T.StringType())
        raise NotPlanned(name)

    def on_index(self, cur, base, key):
        return index(self.lower(base, cur), self.lower(key, cur))

    def on_slice(self, cur, base, lo, hi):
        v = self.lower(base, cur)
        at = [None if x is None else self.lower(x, cur) for x in (lo, hi)]
        if any(x is not None and not x.is_literal for x in at):
            raise NotPlanned("slice bounds that vary")
        a, b = (None if x is None or x.literal is None else x.literal for x in at)
        array = isinstance(v.type, T.ArrayType)
        size = F.size(v.col) if array else F.char_length(v.col)
        lo_ = F.lit(0) if a is None else F.least(F.greatest(F.lit(int(a // 1)) + (size if a < 0 else 0), F.lit(0)), size)
        hi_ = size if b is None else F.least(F.greatest(F.lit(int(-(-b // 1))) + (size if b < 0 else 0), F.lit(0)), size)
        n = F.greatest(hi_ - lo_, F.lit(0))
        return Value(F.slice(v.col, lo_ + 1, n) if array else F.substring(v.col, lo_ + 1, n), v.type)

    def on_pipe(self, cur, a, b):
        return self.lower(b, self.lower(a, cur))

    def on_variable(self, cur, name):
        if name not in self.vars:
            raise NotPlanned(f"variable {name}")
        return self.vars[name]

    def on_as(self, cur, source, patterns, body):
        if len(patterns) > 1:
            raise NotPlanned("destructuring alternatives")
        out = self.bound(patterns[0], self.lower(source, cur))
        return out.lower(body, cur)

    def bound(self, pattern, v: Value) -> Scalars:
        if pattern[0] == "var":
            return self.with_var(pattern[1], v)
        out = self
        if pattern[0] == "list":
            for k, p in enumerate(pattern[1]):
                out = out.bound(p, index(v, literal(k)))
            return out
        for key, var, p in pattern[1]:
            k = out.lower(key, v)
            x = index(v, k)
            if var:
                out = out.with_var(var[1], x)
            if p:
                out = out.bound(p, x)
        return out

    def on_object(self, cur, items):
        out: dict[str, Value] = {}
        for k, v in items:
            key = self.lower(k, cur)
            if not key.is_literal:
                raise NotPlanned("keys that vary")
            out[key.literal] = self.lower(v, cur)
        return Value(None, None, out)

    def on_collect(self, cur, body):
        items = self.listed(body, cur)
        if items is not None:
            kinds = {str(i.type) for i in items}
            same = len(kinds) == 1 or all(is_num(i) for i in items)
            col = F.array(*[i.column() for i in items]) if same else None
            t = items[0].type if len(kinds) == 1 else T.DoubleType()
            out = Value(col, T.ArrayType(t) if same else T.NullType())
            out.items = items
            return out
        return self.array_map(body, cur)

    def listed(self, node, cur) -> list[Value] | None:
        if node[0] == "comma":
            a, b = self.listed(node[1], cur), self.listed(node[2], cur)
            return None if a is None or b is None else a + b
        try:
            return [self.lower(node, cur)]
        except NotPlanned:
            return None

    def array_map(self, node, cur) -> Value:
        """[source[] | f]: transform and filter of an array."""
        if node[0] == "iterate":
            v = self.lower(node[1], cur)
            if not isinstance(v.type, T.ArrayType):
                raise NotPlanned("iteration over an object")
            return v
        if node[0] == "pipe":
            return self.mapped(self.array_map(node[1], cur), node[2])
        if node[0] == "call" and node[1] == "limit" and len(node[2]) == 2:
            n, arr = self.lower(node[2][0], cur), self.array_map(node[2][1], cur)
            if not isinstance(n.literal, int) or n.literal < 0:
                raise NotPlanned("a limit that varies")
            return Value(F.slice(arr.col, 1, n.literal), arr.type)
        if node[0] == "call" and node[1] == "range" and len(node[2]) in (1, 2):
            lo, hi = [literal(0), *(self.lower(x, cur) for x in node[2])][-2:]
            if not all(isinstance(x.type, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) for x in (lo, hi)):
                raise NotPlanned("a range of fractions")
            a, b = lo.col.cast("long"), hi.col.cast("long")
            return Value(F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(T.LongType()))
        raise NotPlanned("a generator")

    def mapped(self, arr: Value, f) -> Value:
        element = arr.type.elementType
        if f[0] == "call" and f[1] == "select":
            return Value(F.filter(arr.col, lambda x: truthy(self.lower(f[2][0], typed(x, element)))), arr.type)
        if f[0] == "pipe":
            return self.mapped(self.mapped(arr, f[1]), f[2])
        seen: list[Value] = []

        def one(x):
            v = self.lower(f, typed(x, element))
            seen.append(v)
            return v.column()

        col = F.transform(arr.col, one)
        return Value(col, T.ArrayType(_type_of(seen[-1])))

    def on_arith(self, cur, a, b, op):
        return arithmetic(op, self.lower(a, cur), self.lower(b, cur))

    def on_compare(self, cur, a, b, op):
        return comparison(op, self.lower(a, cur), self.lower(b, cur))

    def on_and(self, cur, a, b):
        return boolean(truthy(self.lower(a, cur)) & truthy(self.lower(b, cur)))

    def on_or(self, cur, a, b):
        return boolean(truthy(self.lower(a, cur)) | truthy(self.lower(b, cur)))

    def on_alt(self, cur, a, b):
        x, y = self.lower(a, cur), self.lower(b, cur)
        if x.fields is not None:
            return x
        if is_null(x):
            return y
        return Value(F.when(truthy(x), x.col).otherwise(y.col), x.type if str(x.type) == str(y.type) or not is_num(x) else wider(x.type, y.type))

    def on_negate(self, cur, a):
        v = self.lower(a, cur)
        return literal(-v.literal) if v.is_literal and is_num(v) else Value(-v.col, v.type)

    def on_if(self, cur, c, t, e):
        test, x, y = truthy(self.lower(c, cur)), self.lower(t, cur), self.lower(e, cur)
        if x.fields is not None or y.fields is not None:
            if x.fields is None or y.fields is None or list(x.fields) != list(y.fields):
                raise NotPlanned("branches of different shapes")
            return Value(None, None, {k: Value(F.when(test, x.fields[k].col).otherwise(y.fields[k].col), x.fields[k].type) for k in x.fields})
        if kind(x) != kind(y) and "null" not in (kind(x), kind(y)):
            raise NotPlanned("branches of different types")
        t_ = y.type if is_null(x) else x.type if is_null(y) or str(x.type) == str(y.type) else wider(x.type, y.type)
        return Value(F.when(test, x.col).otherwise(y.col), t_)

    def on_try(self, cur, body, handler):
        v = self.lower(body, cur)
        if body[0] in ("index", "identity") or handler is not None and handler[0] == "call" and handler[1] == "empty" and body[0] == "index":
            return v
        raise NotPlanned("try")

    def on_reduce(self, cur, source, patterns, start, update):
        arr = self.array_map(source, cur)
        if patterns[0][0] != "var" or len(patterns) > 1:
            raise NotPlanned("destructuring in reduce")
        first = self.lower(start, cur)
        name, element = patterns[0][1], arr.type.elementType
        t = wider(first.type, element) if is_num(first) and isinstance(element, NUMERIC) else first.type
        if is_num(first):
            t = T.DoubleType()
        return Value(F.aggregate(arr.col, first.col.cast(t), lambda acc, x: self.with_var(name, typed(x, element)).lower(update, Value(acc, t)).col.cast(t)), t)

    def on_def(self, cur, definition, body):
        name, params, code = definition
        return Scalars(self.vars, {**self.functions, f"{name}/{len(params)}": (params, code, self)}).lower(body, cur)

    def on_call(self, cur, name, args):
        key = f"{name}/{len(args)}"
        if key in self.functions:
            return self.expanded(key, args, cur)
        if name in _SIMPLE_TEXT and not args:
            return Value(_SIMPLE_TEXT[name](as_text(cur).col), T.StringType())
        if name in _MATH and not args and is_num(cur):
            return Value(_MATH[name](cur.col.cast("double")).cast("double"), T.DoubleType())
        if name in _MATH2 and len(args) == 2:
            a, b = (self.lower(x, cur).col.cast("double") for x in args)
            return Value(_MATH2[name](a, b), T.DoubleType())
        method = getattr(self, f"call_{name}_{len(args)}", None)
        if method is None:
            raise NotPlanned(key)
        return method(cur, *args)

    def expanded(self, key, args, cur, depth=[0]):  # noqa: B006
        params, code, home = self.functions[key]
        if depth[0] > 40:
            raise NotPlanned("a recursive function")
        scope = Scalars(home.vars, {**home.functions, key: self.functions[key]})
        for p, a in zip(params, args, strict=True):
            if p[0] == "$":
                scope = scope.with_var(p, self.lower(a, cur))
            scope.functions[f"{p.lstrip('$')}/0"] = ([], a, self)
        depth[0] += 1
        try:
            return scope.lower(code, cur)
        finally:
            depth[0] -= 1

    # ---- builtins

    def call_not_0(self, cur):
        return boolean(~truthy(cur))

    def call_length_0(self, cur):
        k = kind(cur)
        if cur.fields is not None:
            return literal(len(cur.fields))
        if k == "string":
            return Value(F.coalesce(F.char_length(as_text(cur).col), F.lit(0)).cast("long"), T.LongType())
        if k == "number":
            return Value(F.coalesce(F.abs(cur.col), F.lit(0)), cur.type)
        if k == "array":
            return Value(F.coalesce(F.size(cur.col), F.lit(0)).cast("long"), T.LongType())
        raise NotPlanned("length")

    def call_utf8bytelength_0(self, cur):
        return Value(F.octet_length(as_text(cur).col).cast("long"), T.LongType())

    def call_type_0(self, cur):
        k = kind(cur)
        return Value(F.when(cur.column().isNull(), F.lit("null")).otherwise(F.lit(k)), T.StringType())

    def call_abs_0(self, cur):
        return Value(F.abs(cur.col), cur.type)

    def call_tostring_0(self, cur):
        return text(cur)

    def call_tonumber_0(self, cur):
        return cur if is_num(cur) else Value(as_text(cur).col.cast("double"), T.DoubleType())

    def call_ascii_0(self, cur):
        return Value(F.char(cur.col), T.StringType())

    def _texts(self, cur, arg):
        return as_text(cur).col, as_text(self.lower(arg, cur)).col

    def call_startswith_1(self, cur, a):
        return boolean(F.startswith(*self._texts(cur, a)))

    def call_endswith_1(self, cur, a):
        return boolean(F.endswith(*self._texts(cur, a)))

    def call_ltrimstr_1(self, cur, a):
        s, x = self._texts(cur, a)
        return Value(F.when(F.startswith(s, x), F.substring(s, F.char_length(x) + 1, F.char_length(s))).otherwise(s), T.StringType())

    def call_rtrimstr_1(self, cur, a):
        s, x = self._texts(cur, a)
        return Value(F.when(F.endswith(s, x) & (x != ""), F.substring(s, F.lit(1), F.char_length(s) - F.char_length(x))).otherwise(s), T.StringType())

    def call_split_1(self, cur, a):
        return split(cur, self.lower(a, cur))

    def call_join_1(self, cur, a):
        sep = self.lower(a, cur)
        if kind(cur) != "array" or not sep.is_literal:
            raise NotPlanned("join")
        parts = F.transform(cur.col, lambda x: F.coalesce(text(Value(x, cur.type.elementType)).col if not isinstance(cur.type.elementType, T.StringType) else x, F.lit("")))
        if not isinstance(cur.type.elementType, T.StringType):
            parts = F.transform(cur.col, lambda x: F.when(x.isNull(), "").otherwise(text(Value(x, cur.type.elementType)).col))
        return Value(F.array_join(parts, sep.literal), T.StringType())

    def _pattern(self, cur, args) -> str:
        re_ = self.lower(args[0], cur)
        flags = self.lower(args[1], cur).literal if len(args) > 1 else ""
        if not re_.is_literal or set(flags or "") - set("gixs"):
            raise NotPlanned("a pattern that varies")
        p = re_.literal.replace("\\h", "[0-9a-fA-F]")
        return "(?m" + "".join(f for f in (flags or "") if f in "ix") + ")" + p

    def call_test_1(self, cur, a):
        return boolean(F.rlike(as_text(cur).col, F.lit(self._pattern(cur, [a]))))

    def call_test_2(self, cur, a, f):
        return boolean(F.rlike(as_text(cur).col, F.lit(self._pattern(cur, [a, f]))))

    def call_gsub_2(self, cur, a, w):
        x = self.lower(w, cur)
        if not x.is_literal:
            raise NotPlanned("a replacement that varies")
        return Value(F.regexp_replace(as_text(cur).col, self._pattern(cur, [a]), x.literal.replace("\\", "\\\\").replace("$", "\\$")), T.StringType())

    def call_sub_2(self, cur, a, w):
        x = self.lower(w, cur)
        if not x.is_literal:
            raise NotPlanned("a replacement that varies")
        # the first match alone: everything before it is taken along, unwillingly
        p = self._pattern(cur, [a])
        end = p.index(")") + 1
        return Value(F.regexp_replace(as_text(cur).col, f"{p[:end]}(?s:\\A(.*?))(?:{p[end:]})", "$1" + x.literal.replace("\\", "\\\\").replace("$", "\\$")), T.StringType()) if "(" not in p[end:].replace("(?:", "") else self._no("groups in sub")

    def _no(self, why):
        raise NotPlanned(why)

    def call_scan_1(self, cur, a):
        raise NotPlanned("scan yields a stream")

    def call_capture_1(self, cur, a):
        import re as python_re

        p = self._pattern(cur, [a])
        names = python_re.findall(r"\(\?<([A-Za-z_]\w*)>", p)
        groups = python_re.findall(r"(?<!\\)\((?!\?)|\(\?<[A-Za-z_]\w*>", p)
        if not names or len(groups) != len(names):
            raise NotPlanned("unnamed groups")
        s = as_text(cur).col
        return Value(None, None, {n: Value(F.when(F.rlike(s, F.lit(p)), F.regexp_extract(s, p, k + 1)), T.StringType()) for k, n in enumerate(names)})

    def call_explode_0(self, cur):
        # the code points of UTF-32
        raw = F.hex(F.encode(as_text(cur).col, "UTF-32"))
        return Value(F.transform(F.sequence(F.lit(0), F.char_length(as_text(cur).col) - 1), lambda k: F.conv(F.substring(raw, k * 8 + 1, F.lit(8)), 16, 10).cast("long")), T.ArrayType(T.LongType()))

    def call_ascii_1(self, cur, a):
        raise NotPlanned("ascii/1")

    def call_contains_1(self, cur, a):
        x = self.lower(a, cur)
        if kind(cur) == kind(x) == "string":
            return boolean(F.contains(as_text(cur).col, x.col))
        if kind(cur) == kind(x) == "array":
            text_ = isinstance(cur.type.elementType, T.StringType)
            return boolean(F.forall(x.col, lambda y: F.exists(cur.col, lambda z: F.contains(z, y) if text_ else z.eqNullSafe(y))))
        raise NotPlanned("contains")

    def call_inside_1(self, cur, a):
        return Scalars(self.vars | {"$__in": cur}, self.functions).lower(("call", "contains", [("variable", "$__in")]), self.lower(a, cur))

    def call_has_1(self, cur, a):
        k = self.lower(a, cur)
        if cur.fields is not None and k.is_literal:
            return literal(k.literal in cur.fields)
        if kind(cur) == "array" and is_num(k):
            return boolean((k.col >= 0) & (k.col < F.size(cur.col)))
        raise NotPlanned("has")

    def call_keys_0(self, cur):
        if cur.fields is None:
            raise NotPlanned("keys")
        return literal(sorted(cur.fields, key=lambda k: k.encode()))

    def call_keys_unsorted_0(self, cur):
        if cur.fields is None:
            raise NotPlanned("keys")
        return literal(list(cur.fields))

    def call_del_1(self, cur, path):
        if cur.fields is None:
            raise NotPlanned("del")
        gone = []

        def collect(p):
            if p[0] == "comma":
                collect(p[1])
                collect(p[2])
            elif p[0] == "index" and p[1] == ("identity",) and p[2][0] == "string":
                gone.append("".join(p[2][2]))
            else:
                raise NotPlanned("a nested path")

        collect(path)
        return Value(None, None, {k: v for k, v in cur.fields.items() if k not in gone})

    def call_pick_1(self, cur, path):
        if cur.fields is None:
            raise NotPlanned("pick")
        kept = []

        def collect(p):
            if p[0] == "comma":
                collect(p[1])
                collect(p[2])
            elif p[0] == "index" and p[1] == ("identity",) and p[2][0] == "string":
                kept.append("".join(p[2][2]))
            else:
                raise NotPlanned("a nested path")

        collect(path)
        return Value(None, None, {k: cur.fields.get(k, literal(None)) for k in kept})

    def on_assign(self, cur, left, right, op):
        if left[0] != "index" or left[1] != ("identity",) or left[2][0] != "string" or cur.fields is None:
            raise NotPlanned("assignment to a nested path")
        name = "".join(left[2][2])
        now = cur.fields.get(name, literal(None))
        if op == "|=":
            new = self.lower(right, now)
        else:
            x = self.lower(right, cur)
            new = x if op == "=" else self.on_alt(cur, left, right) if op == "//=" else arithmetic(op[0], now, x)
        return Value(None, None, {**cur.fields, name: new})

    def call_with_entries_1(self, cur, f):
        if cur.fields is None:
            raise NotPlanned("with_entries")
        out = {}
        for k, v in cur.fields.items():
            e = self.lower(f, Value(None, None, {"key": literal(k), "value": v}))
            name = e.fields["key"]
            if not name.is_literal:
                name = self.constant(name, k, f)
            out[name.literal] = e.fields["value"]
        return Value(None, None, out)

    def constant(self, name: Value, key: str, f) -> Value:
        """A key made by an expression of the key alone is made here and now."""
        from sylva.operators.jq_eval import Env, Host, build

        made = next(build(f).run(Env({}, {}, Host()), {"key": key, "value": None}), None)
        if made is None or not isinstance(made.get("key"), str):
            raise NotPlanned("keys that vary")
        return literal(made["key"])

    def call_tojson_0(self, cur):
        if kind(cur) == "string":
            inside = F.regexp_extract(F.to_json(F.array(as_text(cur).col)), r"(?s)^\[(.*)\]$", 1)
            return Value(F.coalesce(F.replace(inside, F.lit("\x7f"), F.lit("\\u007f")), F.lit("null")), T.StringType())
        return text(cur)

    def call_fromjson_0(self, cur):
        s = as_text(cur).col
        return _Json(s)

    def call_add_0(self, cur):
        if isinstance(cur.type, T.ArrayType):
            return self.folded(cur)
        if cur.fields:
            out = None
            for v in cur.fields.values():
                out = v if out is None else arithmetic("+", out, v)
            return out
        raise NotPlanned("add")

    def folded(self, cur):
        e = cur.type.elementType
        if isinstance(e, NUMERIC):
            t = T.DoubleType() if isinstance(e, (T.FloatType, T.DoubleType)) else T.LongType()
            total = F.aggregate(cur.col, F.lit(0).cast(t), lambda a, x: a + F.coalesce(x.cast(t), F.lit(0).cast(t)))
            return Value(F.when(F.exists(cur.col, lambda x: x.isNotNull()), total), t)
        if isinstance(e, T.StringType):
            return Value(F.when(F.size(cur.col) > 0, F.array_join(cur.col, "")), e)
        if isinstance(e, T.ArrayType):
            return Value(F.when(F.size(cur.col) > 0, F.flatten(cur.col)), e)
        raise NotPlanned("add")

    def call_add_1(self, cur, f):
        return self.folded(self.array_map(f, cur))

    def call_map_1(self, cur, f):
        if not isinstance(cur.type, T.ArrayType):
            raise NotPlanned("map")
        return self.mapped(cur, f)

    def call_first_0(self, cur):
        return index(cur, literal(0))

    def call_last_0(self, cur):
        return index(cur, literal(-1))

    def call_reverse_0(self, cur):
        return Value(F.coalesce(F.reverse(cur.col), F.array().cast(cur.type)) if kind(cur) == "array" else F.reverse(cur.col), cur.type)

    def call_sort_0(self, cur):
        return Value(F.array_sort(cur.col), cur.type) if not isinstance(cur.type.elementType, (T.FloatType, T.DoubleType)) else Value(F.sort_array(cur.col), cur.type)

    def call_unique_0(self, cur):
        return Value(F.array_sort(F.array_distinct(cur.col)), cur.type)

    def call_min_0(self, cur):
        return typed(F.when(F.exists(cur.col, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_min(cur.col)), cur.type.elementType)

    def call_max_0(self, cur):
        return typed(F.array_max(cur.col), cur.type.elementType)

    def call_flatten_0(self, cur):
        v = cur
        while isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, T.ArrayType):
            v = Value(F.flatten(v.col), v.type.elementType)
        return v

    def call_any_1(self, cur, f):
        return boolean(F.exists(cur.col, lambda x: truthy(self.lower(f, typed(x, cur.type.elementType)))))

    def call_all_1(self, cur, f):
        return boolean(F.forall(cur.col, lambda x: truthy(self.lower(f, typed(x, cur.type.elementType)))))

    def call_any_0(self, cur):
        return self.call_any_1(cur, ("identity",))

    def call_all_0(self, cur):
        return self.call_all_1(cur, ("identity",))

    def call_any_2(self, cur, source, f):
        return self.call_any_1(self.array_map(source, cur), f)

    def call_all_2(self, cur, source, f):
        return self.call_all_1(self.array_map(source, cur), f)

    def call_map_values_1(self, cur, f):
        if cur.fields is None:
            return self.call_map_1(cur, f)
        if _generates(f):
            raise NotPlanned("map_values of a stream")
        return Value(None, None, {k: self.lower(f, v) for k, v in cur.fields.items()})

    def call_getpath_1(self, cur, path):
        at = self.lower(path, cur)
        steps = at.literal if at.is_literal else [i.literal if i.is_literal else None for i in getattr(at, "items", None) or [literal(None)]]
        if any(not isinstance(x, (str, int)) for x in steps):
            raise NotPlanned("a path that varies")
        for x in steps:
            cur = index(cur, literal(x))
        return cur

    def call_toarray_0(self, cur):
        return cur if kind(cur) == "array" else Value(F.array(cur.column()), T.ArrayType(_type_of(cur)))

    def call_flatten_1(self, cur, depth):
        n, v = self.lower(depth, cur), cur
        if not isinstance(n.literal, int) or n.literal < 0:
            raise NotPlanned("a depth that varies")
        for _ in range(n.literal):
            if isinstance(v.type, T.ArrayType) and isinstance(v.type.elementType, T.ArrayType):
                v = Value(F.flatten(v.col), v.type.elementType)
        return v

    def call_trimstr_1(self, cur, a):
        return self.call_rtrimstr_1(self.call_ltrimstr_1(cur, a), a)

    def call_split_2(self, cur, a, flags):
        return Value(F.split(as_text(cur).col, self._pattern(cur, [a, flags]), -1), T.ArrayType(T.StringType()))

    def call_indices_1(self, cur, a):
        s, x = as_text(cur).col, self.lower(a, cur)
        if kind(cur) != "string" or not isinstance(x.literal, str) or not x.literal:
            raise NotPlanned("indices")
        size = len(x.literal)
        places = F.when(F.char_length(s) >= size, F.sequence(F.lit(0).cast("long"), (F.char_length(s) - size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return Value(F.when(s.isNotNull(), F.filter(places, lambda k: F.substring(s, (k + 1).cast("int"), F.lit(size)) == x.literal)), T.ArrayType(T.LongType()))

    def call_rindex_1(self, cur, a):
        return index(self.call_indices_1(cur, a), literal(-1))

    def call_index_1(self, cur, a):
        s, x = cur.col, self.lower(a, cur)
        if kind(cur) != "string" or not isinstance(x.literal, str):
            raise NotPlanned("index")
        at = F.locate(x.literal, s)
        return Value(F.when(at > 0, at - 1).cast("long"), T.LongType())

    def call_IN_1(self, cur, a):
        items = self.listed(a, cur)
        if items is None:
            arr = self.array_map(a, cur)
            return boolean(F.exists(arr.col, lambda x: comparison("==", cur, typed(x, arr.type.elementType)).col))
        out = F.lit(False)
        for i in items:
            out = out | comparison("==", cur, i).col
        return boolean(out)

    def call_in_1(self, cur, a):
        return Scalars(self.vars | {"$__k": cur}, self.functions).lower(("call", "has", [("variable", "$__k")]), self.lower(a, cur))

    def call_range_1(self, cur, a):
        raise NotPlanned("range yields a stream")

    def call_empty_0(self, cur):
        raise NotPlanned("empty")

    def call_isnan_0(self, cur):
        return boolean(F.isnan(cur.col.cast("double")))

    def call_isinfinite_0(self, cur):
        return boolean(F.abs(cur.col.cast("double")) == float("inf"))

    def call_infinite_0(self, cur):
        return Value(F.lit(float("inf")), T.DoubleType())

    def call_nan_0(self, cur):
        return Value(F.lit(float("nan")), T.DoubleType())

    def call_todate_0(self, cur):
        return Value(F.date_format(F.timestamp_seconds(F.floor(cur.col)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), T.StringType()) if is_num(cur) else self._no("todate")

    call_todateiso8601_0 = call_date_0 = call_todate_0

    def call_fromdate_0(self, cur):
        if isinstance(cur.type, (T.TimestampType, T.TimestampNTZType)):
            return Value(F.unix_seconds(F.date_trunc("second", cur.col).cast("timestamp")), T.LongType())
        return Value(F.unix_timestamp(as_text(cur).col, "yyyy-MM-dd'T'HH:mm:ssX"), T.LongType())

    call_fromdateiso8601_0 = call_fromdate_0

    def call_strftime_1(self, cur, a):
        layout = self.lower(a, cur).literal
        mapped = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "a": "EEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}
        out, k = "", 0
        while k < len(layout):
            if layout[k] == "%":
                if layout[k + 1] not in mapped:
                    raise NotPlanned("a date conversion")
                out, k = out + mapped[layout[k + 1]], k + 2
            else:
                out, k = out + f"'{layout[k]}'" if layout[k].isalpha() else out + layout[k], k + 1
        return Value(F.date_format(F.timestamp_seconds(F.floor(cur.col)), out), T.StringType())

    def call_gmtime_0(self, cur):
        t = F.timestamp_seconds(F.floor(cur.col))
        parts = [F.year(t), F.month(t) - 1, F.dayofmonth(t), F.hour(t), F.minute(t), F.second(t), F.dayofweek(t) - 1, F.dayofyear(t) - 1]
        return Value(F.array(*[p.cast("long") for p in parts]), T.ArrayType(T.LongType()))


class _Json(Value):
    """Parsed JSON text: a field of it is read as a number."""

    def __init__(self, s: Column):
        super().__init__(s, T.VariantType())
        self.source = s


def _index_json(v: _Json, name: str) -> Value:
    return Value(F.get_json_object(v.source, "$." + name).cast("double"), T.DoubleType())


_plain_index = index


def index(v: Value, key: Value) -> Value:  # noqa: F811
    if isinstance(v, _Json) and key.is_literal and isinstance(key.literal, str):
        return _index_json(v, key.literal)
    return _plain_index(v, key)


def _type_of(v: Value) -> T.DataType:
    return T.StructType([T.StructField(k, _type_of(x)) for k, x in v.fields.items()]) if v.fields is not None else v.type


# ---- the relational part

#: Buckets of a running sum at most (else spark.sql.shuffle.partitions of them), and sampled places to each.
MOST_BUCKETS, SAMPLED = 2_000, 20


@dataclass
class State:
    """``form``: "array" or "stream" of values, "groups" or "each" (an array or stream of arrays by ``keys``), "lookup", or "single"."""

    df: DataFrame
    value: Value
    order: list[str]
    form: str
    keys: list[Value] = field(default_factory=list)
    key_texts: list[str] = field(default_factory=list)


class Planner:
    def __init__(self, df: DataFrame, variables: dict | None = None, order: list[str] | None = None):
        self.tables = {"$" + k: v for k, v in (variables or {}).items() if isinstance(v, DataFrame)}
        self.scalars = Scalars({"$" + k: literal(v) for k, v in (variables or {}).items() if not isinstance(v, DataFrame)}, {})
        self.input, self.order = df, order
        self.scan_order: str | None = None  # the column of scan order, which two readings of a table may number differently
        self.n = 0

    def fresh(self, name: str) -> str:
        self.n += 1
        return f"__{name}{self.n}"

    def plan(self, program: str, mode: str) -> DataFrame:
        imports, defs, body, _ = parse(program)
        if imports:
            raise NotPlanned("imports")
        for d in defs:
            body_name = f"{d[0]}/{len(d[1])}"
            self.scalars = Scalars(self.scalars.vars, {**self.scalars.functions, body_name: (d[1], d[2], self.scalars)})
        df = self.input
        if self.order:
            order = self.order
        else:
            order = [self.fresh("ord")]
            self.scan_order = order[0]
            df = df.withColumn(order[0], F.monotonically_increasing_id())
        row = Value(None, None, {f.name: typed(F.col(f"`{f.name}`"), f.dataType) for f in self.input.schema.fields})
        state = State(df, row, order, "array" if mode == "slurp" else "stream")
        return self.finish(self.steps(body, state))

    def finish(self, s: State) -> DataFrame:
        if s.form in ("groups", "each"):
            s = self.collected(s)
        cols = [v.column().alias(k) for k, v in s.value.fields.items()] if s.value.fields is not None else [s.value.column().alias("value")]
        if not cols:
            raise NotPlanned("an empty object")
        df = s.df
        if s.order and s.form != "single" and getattr(s, "sorted", False):
            df = df.orderBy(*[F.col(c) if isinstance(c, str) else c for c in s.order])
        return df.select(*cols)

    def steps(self, node, s: State) -> State:
        if node[0] == "pipe":
            return self.steps(node[2], self.steps(node[1], s))
        if node[0] == "as":
            return self.cross(node, s)
        if node[0] == "def":
            name, params, code = node[1]
            self.scalars = Scalars(self.scalars.vars, {**self.scalars.functions, f"{name}/{len(params)}": (params, code, self.scalars)})
            return self.steps(node[2], s)
        return getattr(self, "over_" + s.form)(node, s)

    # ---- rows that meet a row of another table, or none

    def met(self, test, s: State) -> State | None:
        """`select(IN($t[].k))`, `select(any($t[]; p))` and their negations: semi and anti joins with the table."""
        wanted, steps = True, _piped(test)
        while len(steps) > 1 and steps[-1] == ("call", "not", []):
            steps, wanted = steps[:-1], not wanted
        test, value = steps[-1], s.value
        if len(steps) > 1:
            if test[0] != "call" or test[1] != "IN" or len(test[2]) != 1 or self.rows_of(test[2][0]) is None:
                return None
            for step in steps[:-1]:
                value = self.scalars.lower(step, value)
        if test[0] != "call" or (test[1], len(test[2])) not in (("IN", 1), ("IN", 2), ("any", 2), ("all", 2)):
            return None
        name, args = test[1], test[2]
        if name == "IN" and len(args) == 2:
            value, args = self.scalars.lower(args[0], s.value), args[1:]
        found = self.rows_of(args[0])
        if found is None:
            return None
        right, row = found
        if name == "IN":
            on = comparison("==", value, row).col
        else:
            on = truthy(self.scalars.lower(args[1], row))
            if name == "all":
                on, wanted = ~on, not wanted
        return replace_state(s, df=s.df.join(right, on, "left_semi" if wanted else "left_anti"))

    def rows_of(self, source) -> tuple[DataFrame, Value] | None:
        """(renamed table, value) of `$t[]`, `$t[].k`, `$t[] | f` and `$t | .[] | f`, or None."""
        if source[0] == "iterate" and source[1][0] == "variable" and source[1][1] in self.tables:
            table = self.tables[source[1][1]]
            held = {c: self.fresh("m") for c in table.columns}
            renamed = table.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()])
            return renamed, Value(None, None, {c: typed(F.col(n), renamed.schema[n].dataType) for c, n in held.items()})
        if source[0] == "pipe" and source[2] == ("iterate", ("identity",)) and source[1][0] == "variable":
            return self.rows_of(("iterate", source[1]))
        if source[0] in ("index", "pipe") and (inner := self.rows_of(source[1])) is not None:
            rest = ("index", ("identity",), source[2]) if source[0] == "index" else source[2]
            if rest[0] == "call" and rest[1] == "select":
                return inner[0].filter(truthy(self.scalars.lower(rest[2][0], inner[1]))), inner[1]
            return inner[0], self.scalars.lower(rest, inner[1])
        return None

    # ---- streams: a row a value

    def over_stream(self, node, s: State) -> State:
        if node[0] == "call" and node[1] == "select":
            if (met := self.met(node[2][0], s)) is not None:
                return met
            return replace_state(s, df=s.df.filter(truthy(self.scalars.lower(node[2][0], s.value))))
        if node[0] == "call" and node[1] == "empty":
            return replace_state(s, df=s.df.limit(0))
        if node[0] == "call" and node[1] in ("values", "nulls"):
            null = s.value.column().isNull()
            return replace_state(s, df=s.df.filter(null if node[1] == "nulls" else ~null))
        if node[0] == "iterate":
            inner = self.steps(node[1], s) if node[1][0] != "identity" else s
            return self.exploded(inner, inner.value)
        if node[0] == "comma":
            items = self.scalars.listed(node, s.value)
            if items is None or any(str(_type_of(i)) != str(_type_of(items[0])) for i in items):
                raise NotPlanned("outputs of different types")
            arr = Value(F.array(*[i.column() for i in items]), T.ArrayType(_type_of(items[0])))
            return self.exploded(s, arr)
        if node[0] == "index" and node[1][0] in ("iterate", "index") and _generates(node[1]):
            return self.over_stream(("index", ("identity",), node[2]), self.over_stream(node[1], s))
        if node[0] == "call" and node[1] == "to_entries" and s.value.fields is not None:
            return self.entries_of(s)
        if node[0] == "call" and node[1] in ("range", "splits", "scan"):
            return self.generated(node, s)
        if node[0] == "object":
            gens = [k for k, (_, v) in enumerate(node[1]) if _generates(v)]
            for k in gens:
                key, v = node[1][k]
                name = f"$__gen{self.n}"
                self.n += 1
                held = s.value
                s = self.steps(v, s)
                col = self.fresh("gen")
                s = replace_state(s, df=s.df.withColumn(col, s.value.column()), value=held)
                self.scalars = self.scalars.with_var(name, typed(F.col(col), _type_of_col(s.df, col)))
                node = ("object", [*node[1][:k], (key, ("variable", name)), *node[1][k + 1 :]])
        return replace_state(s, value=self.scalars.lower(node, s.value))

    def generated(self, node, s: State) -> State:
        name, args = node[1], node[2]
        if name == "range":
            at = [self.scalars.lower(a, s.value) for a in args]
            lo, hi, step = (literal(0), at[0], literal(1)) if len(at) == 1 else (*at, literal(1))[:3]
            if not step.is_literal or not isinstance(step.literal, int) or step.literal == 0:
                raise NotPlanned("range steps")
            lo_, hi_ = lo.col.cast("long"), F.ceil(hi.col).cast("long")
            last = hi_ - (1 if step.literal > 0 else -1)
            some = F.when(lo_ < hi_ if step.literal > 0 else lo_ > hi_, F.sequence(lo_, last, F.lit(step.literal).cast("long"))).otherwise(F.array().cast("array<bigint>"))
            return self.exploded(s, Value(some, T.ArrayType(T.LongType())))
        pattern = self.scalars._pattern(s.value, args)
        t = as_text(s.value).col
        if name == "scan":
            if "(" in pattern.replace("(?", "", 1).replace("(?:", ""):
                raise NotPlanned("groups in scan")
            return self.exploded(s, Value(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), T.ArrayType(T.StringType())))
        return self.exploded(s, Value(F.split(t, pattern, -1), T.ArrayType(T.StringType())))

    def exploded(self, s: State, arr: Value) -> State:
        if arr.fields is not None:
            items = list(arr.fields.values())
            if not items or any(str(_type_of(i)) != str(_type_of(items[0])) for i in items):
                raise NotPlanned("iteration over fields of different types")
            arr = Value(F.array(*[i.column() for i in items]), T.ArrayType(_type_of(items[0])))
        if not isinstance(arr.type, T.ArrayType):
            raise NotPlanned("iteration")
        pos, item = self.fresh("pos"), self.fresh("item")
        df = s.df.select("*", F.posexplode(arr.col).alias(pos, item))
        return replace_state(s, df=df, value=typed(F.col(item), arr.type.elementType), order=[*s.order, pos])

    def entries_of(self, s: State) -> State:
        """to_entries of a row, where its values share a type (numbers are widened): an unpivot."""
        items = s.value.fields
        kinds = {kind(v) for v in items.values()}
        if len(kinds) != 1 or "object" in kinds or "array" in kinds:
            raise NotPlanned("entries of different types")
        t = "double" if kinds == {"number"} else "boolean" if kinds == {"boolean"} else "string"
        made = F.array(*[F.struct(F.lit(k).alias("key"), as_text(v).col.cast(t).alias("value")) for k, v in items.items()])
        dt = {"double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[t]
        return replace_state(s, value=Value(made, T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", dt)]))))

    # ---- arrays: a row an element

    def over_array(self, node, s: State) -> State:
        k = node[0]
        if k == "identity":
            return s
        if k == "iterate":
            return replace_state(self.inner(node[1], s), form="stream")
        if k == "collect":
            return replace_state(self.steps(node[1], s), form="array") if not self.single_collect(node) else self.aggregate(node, s)
        if k in ("index", "slice") and _generates(node[1]) and (inner := self.steps(node[1], s)).form == "stream":
            return self.over_stream((k, ("identity",), *node[2:]), inner)
        if k == "index" and (node[1][0] == "call" or node[1] == ("identity",)):
            got = self.inner(node[1], s)
            if got.form == "single":
                return replace_state(got, value=index(got.value, self.scalars.lower(node[2], got.value)))
            if got.form == "stream":
                return self.over_stream(("index", ("identity",), node[2]), got)
            return self.element(got, node[2])
        if k == "slice":
            return self.sliced(self.inner(node[1], s), node[2], node[3])
        if k == "reduce" or k == "foreach":
            return self.fold(node, s)
        if k == "call":
            name, args = node[1], node[2]
            if name in ("any", "all") and len(args) == 2 and args[0] == ("iterate", ("identity",)):
                node, args = ("call", name, args[1:]), args[1:]
            method = getattr(self, f"array_{name}_{len(args)}", None)
            if method:
                return method(s, *args)
        return self.aggregate(node, s)

    def inner(self, node, s: State) -> State:
        return s if node[0] == "identity" else self.steps(node, s)

    def single_collect(self, node) -> bool:
        return not _generates(node[1])

    def array_map_1(self, s, f):
        out = self.steps(f, replace_state(s, form="stream"))
        return replace_state(out, form="array")

    def _sortable(self, s: State, f) -> tuple[State, list[str]]:
        items = self.scalars.listed(f, s.value)
        if items is None:
            raise NotPlanned("a key that is a stream")
        names, df = [], s.df
        for v in items:
            for c in order_key(v):
                name = self.fresh("key")
                nulls_first = c
                df = df.withColumn(name, _bare(nulls_first))
                names.append(name)
        return replace_state(s, df=df), names

    def array_sort_by_1(self, s, f):
        s, names = self._sortable(s, f)
        out = replace_state(s, order=[*[F.col(n).asc_nulls_first() for n in names], *s.order])
        out.sorted = True
        return out

    def array_sort_0(self, s):
        return self.array_sort_by_1(s, ("identity",))

    def array_reverse_0(self, s):
        order = [_descending(c) for c in s.order]
        out = replace_state(s, order=order)
        out.sorted = True
        return out

    def _limited(self, s: State, n: int, skip: int = 0) -> State:
        df = s.df.orderBy(*s.order)
        if skip:
            df = df.offset(skip)
        return replace_state(s, df=df.limit(n) if n is not None else df)

    def running(self, s: State, term: Column, name: str) -> State:
        """Add ``name``: the sum of ``term`` over the array up to each row, without one task that sees every row.

        Boundaries from a sample of the order (the rows of smallest hash, the same ones whenever it is taken) deal the rows
        to buckets, rows of equal place to one; sums run within each bucket, and the totals of the buckets before it, a row a bucket, are broadcast.
        Rows in scan order alone are one window, as only a single reading numbers them alike.
        """
        down = ["DESC" in str(c._jc.toString()) if not isinstance(c, str) else False for c in s.order]
        named = [str(_bare(c)._jc.toString()).strip("`") for c in s.order]
        same = next((k for k, d in enumerate(down) if d != down[0] or named[k] == self.scan_order), len(down))
        if not same:
            w = Window.orderBy(*s.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return replace_state(s, df=s.df.withColumn(name, F.coalesce(F.sum(term).over(w), F.lit(0))))
        key, bucket, rest = self.fresh("place"), self.fresh("bucket"), self.fresh("before")
        df = s.df.withColumn(key, F.struct(*[_bare(c).alias(f"c{k}") for k, c in enumerate(s.order[:same])]))
        n = min(MOST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        width = math.isqrt(2 * n) + 1
        sample = df.select(key).orderBy(F.xxhash64(key)).limit(n * SAMPLED).agg(F.sort_array(F.collect_set(key), not down[0]).alias("a"))
        bounds = sample.select(F.expr(f"filter(a, (x, i) -> i % greatest(size(a) DIV {n}, 1) = 0)").alias("b"))
        levels = bounds.select(F.expr(f"transform(sequence(0, greatest(size(b) - 1, 0), {width}), i -> slice(b, i + 1, {width}))").alias("l"))
        sign = ">=" if down[0] else "<="
        upto = lambda among: f"size(filter({among}, x -> x {sign} `{key}`))"
        held = self.fresh("levels")
        dealt = df.withColumn(held, levels.scalar()).withColumn(rest, F.expr(upto(f"transform(`{held}`, y -> get(y, 0))")))
        at = F.when(F.col(rest) == 0, F.lit(0)).otherwise((F.col(rest) - 1) * width + F.expr(upto(f"get(`{held}`, `{rest}` - 1)")))
        dealt = dealt.withColumn(bucket, at).drop(held, rest, key).withColumn(name, F.coalesce(term, F.lit(0)))
        before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        totals = dealt.groupBy(bucket).agg(F.sum(name).alias(rest)).select(bucket, F.coalesce(F.sum(rest).over(before), F.lit(0)).alias(rest))
        within = Window.partitionBy(bucket).orderBy(*s.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = dealt.join(F.broadcast(totals), bucket).withColumn(name, F.sum(name).over(within) + F.col(rest))
        return replace_state(s, df=out.drop(bucket, rest))

    def numbered(self, s: State, name: str) -> State:
        return self.running(s, F.lit(1).cast("long"), name)

    def _without_first(self, s: State, n: int) -> State:
        """All but the first ``n`` rows."""
        at = self.fresh("at")
        out = self.numbered(s, at)
        out = replace_state(out, df=out.df.filter(F.col(at) > n).drop(at))
        out.sorted = True
        return out

    def array_to_entries_0(self, s):
        """Rows numbered from 0 in the array's order."""
        at = self.fresh("at")
        out = self.numbered(s, at)
        return replace_state(out, value=Value(None, None, {"key": Value(F.col(at) - 1, T.LongType()), "value": s.value}))

    def sliced(self, s: State, lo, hi) -> State:
        a, b = (None if x is None else self.scalars.lower(x, literal(None)).literal for x in (lo, hi))
        if (a or 0) < 0 and b is None:
            back = replace_state(s, order=[_descending(c) for c in s.order])
            out = self._limited(back, -a)
            kept = replace_state(out, order=s.order)
            kept.sorted = True
            return kept
        if (a or 0) >= 0 and b is None:
            return self._without_first(s, a or 0) if a else s
        if b < 0:
            back = replace_state(s, order=[_descending(c) for c in s.order])
            out = self._limited(back, max(0, b - a), -b) if (a or 0) < 0 else self._without_first(back, -b)
            out = replace_state(out, order=s.order)
            out.sorted = True
            return self._without_first(out, a) if (a or 0) > 0 else out
        if (a or 0) < 0:
            raise NotPlanned("slices from the end to a place from the start")
        return self._limited(s, None if b is None else max(0, b - (a or 0)), a or 0)

    def element(self, s: State, key) -> State:
        at = self.scalars.lower(key, s.value)
        if not at.is_literal or not isinstance(at.literal, int):
            raise NotPlanned("an index that varies")
        if at.literal < 0:
            s = replace_state(s, order=[_descending(c) for c in s.order])
            out = self._limited(s, 1, -at.literal - 1)
        else:
            out = self._limited(s, 1, at.literal)
        return replace_state(out, form="stream")

    def array_first_0(self, s):
        return self.element(s, ("literal", 0))

    def array_last_0(self, s):
        return self.element(s, ("literal", -1))

    def array_nth_1(self, s, n):
        return self.element(s, n)

    def _stream_limit(self, f, s):
        return self.steps(f, s)

    def array_limit_2(self, s, n, f):
        return replace_state(self._limited(self.steps(f, s), self.scalars.lower(n, literal(None)).literal), form="stream")

    def array_skip_2(self, s, n, f):
        return replace_state(self._without_first(self.steps(f, s), self.scalars.lower(n, literal(None)).literal), form="stream")

    def array_first_1(self, s, f):
        return replace_state(self._limited(self.steps(f, s), 1), form="stream")

    def array_last_1(self, s, f):
        return replace_state(self.element(self.steps(f, s), ("literal", -1)), form="stream")

    def array_flatten_0(self, s):
        out = s
        while isinstance(out.value.type, T.ArrayType):
            out = self.flattened(out)
        return out

    def flattened(self, s: State) -> State:
        """One level: elements that are null instead of arrays stay."""
        v = s.value
        return self.exploded(s, Value(F.coalesce(v.col, F.array(F.lit(None).cast(v.type.elementType))), v.type))

    def array_flatten_1(self, s, n):
        out = s
        for _ in range(self.scalars.lower(n, literal(None)).literal):
            if isinstance(out.value.type, T.ArrayType):
                out = self.flattened(out)
        return out

    def array_group_by_1(self, s, f):
        items = self.scalars.listed(f, s.value)
        if items is None:
            raise NotPlanned("a key that is a stream")
        names, df = [], s.df
        for v in items:
            name = self.fresh("group")
            df = df.withColumn(name, v.column())
            names.append(typed(F.col(name), _type_of(v)))
        return State(df, s.value, s.order, "groups", names, [_text_of(v) for v in items])

    def array_unique_by_1(self, s, f):
        g = self.array_group_by_1(s, f)
        aggs = Aggregates(self, g)
        value = aggs.edge(_Group(g.value, None), F.min_by)
        return replace_state(self.grouped(g, aggs.columns), value=value, form="array")

    def array_unique_0(self, s):
        return self.array_unique_by_1(s, ("identity",))

    def array_min_by_1(self, s, f):
        return self.extreme(s, f, F.min_by)

    def array_max_by_1(self, s, f):
        return self.extreme(s, f, F.max_by)

    def array_min_0(self, s):
        return self.extreme(s, ("identity",), F.min_by)

    def array_max_0(self, s):
        return self.extreme(s, ("identity",), F.max_by)

    def extreme(self, s, f, pick):
        aggs = Aggregates(self, replace_state(s, keys=[]))
        value = aggs.edge(_Group(s.value, None), pick, self.scalars.lower(f, s.value))
        return State(s.df.agg(*[c.alias(n) for n, c in aggs.columns.items()]), value, [], "single")

    def array_INDEX_1(self, s, f):
        """The object of rows by key, as rows of key and value: the last row of a key wins."""
        key = text(self.scalars.lower(f, s.value))
        df = s.df.groupBy(key.col.alias("key")).agg(F.max_by(s.value.column(), F.struct(*[F.col(c) if isinstance(c, str) else _bare(c) for c in s.order])).alias("value"))
        return State(df, Value(None, None, {"key": Value(F.col("key"), T.StringType()), "value": typed(F.col("value"), _type_of(s.value))}), ["key"], "lookup")

    def array_JOIN_2(self, s, index_, f):
        """[row, $table's last row of the key] as {row, match}: a left join on the key's text."""
        return self.looked_up(s, index_, f)

    def looked_up(self, s, index_, f):
        if index_[0] != "variable" or index_[1] not in self.tables:
            raise NotPlanned("a lookup in a value")
        table = self.tables[index_[1]]
        if "key" not in table.columns or "value" not in table.columns:
            raise NotPlanned("a lookup table has key and value")
        k, v = self.fresh("key"), self.fresh("match")
        right = table.select(F.col("key").alias(k), F.col("value").alias(v))
        key = self.scalars.lower(f, s.value)
        if kind(key) != "string":
            raise NotPlanned("an object is indexed by strings")
        df = s.df.join(right, key.col == F.col(k), "left")
        pair = Value(None, None, {"row": s.value, "match": typed(F.col(v), right.schema[v].dataType)})
        return replace_state(s, df=df, value=pair)

    def fold(self, node, s: State) -> State:
        """reduce and foreach of sums over the array: a total, or a running total in the array's order."""
        word, source, patterns, start, update, *rest = node
        if len(patterns) != 1 or patterns[0][0] != "var":
            raise NotPlanned("destructuring in a fold")
        inner = self.steps(source, s)
        name = patterns[0][1]
        if update[0] != "arith" or update[3] != "+" or update[1] != ("identity",):
            raise NotPlanned("a fold that is no sum")
        first = self.scalars.lower(start, literal(None))
        term = self.scalars.with_var(name, inner.value).lower(update[2], literal(None))
        if not is_num(term) or not is_num(first):
            raise NotPlanned("a fold that is no sum")
        t = wider(term.type, first.type)
        if word == "reduce":
            df = inner.df.agg((F.coalesce(F.sum(term.col), F.lit(0)) + first.col).cast(t).alias("__sum"))
            return State(df, Value(F.col("__sum"), t), [], "single")
        total = self.fresh("total")
        out = self.running(inner, term.col, total)
        out = replace_state(out, value=Value((F.col(total) + first.col).cast(t), t))
        if rest:
            out = replace_state(out, value=self.scalars.with_var(name, inner.value).lower(rest[0], out.value))
        return replace_state(out, form="stream")

    def cross(self, node, s: State) -> State:
        """`.[] as $x | body`, or `$table[] as $y | body`: bind, joining the tables where two are named."""
        _, source, patterns, body = node
        if len(patterns) > 1:
            raise NotPlanned("destructuring alternatives")
        if source[0] == "iterate" and source[1][0] == "variable" and source[1][1] in self.tables:
            right = self.tables[source[1][1]]
            held = {c: self.fresh("r") for c in right.columns}
            renamed = right.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()])
            value = Value(None, None, {c: typed(F.col(n), renamed.schema[n].dataType) for c, n in held.items()})
            # a predicate that follows becomes the join's condition
            out = replace_state(s, df=s.df.crossJoin(renamed))
            self.scalars = self.scalars.bound(patterns[0], value)
            return self.steps(body, out)
        if s.form == "array" and source == ("iterate", ("identity",)):
            self.scalars = self.scalars.bound(patterns[0], s.value)
            return self.steps(body, replace_state(s, form="stream"))
        if s.form == "stream":
            self.scalars = self.scalars.bound(patterns[0], self.scalars.lower(source, s.value))
            return self.steps(body, s)
        raise NotPlanned("a binding of the whole array")

    # ---- groups

    def over_groups(self, node, s: State) -> State:
        if node[0] == "call" and node[1] == "map":
            return replace_state(self.per_group(node[2][0], s), form="array")
        if node == ("iterate", ("identity",)):
            return replace_state(s, form="each")
        if node[0] == "call" and node[1] == "length":
            return self.aggregate(("call", "length", []), self.distinct_keys(s))
        return replace_state(self.per_group(node, s), form="stream")

    def over_each(self, node, s: State) -> State:
        """A stream of groups."""
        return replace_state(self.per_group(node, s), form="stream")

    def over_lookup(self, node, s: State) -> State:
        """An object of rows by key: its length, its values, or its entries."""
        if node[0] == "call" and node[1] == "length":
            return self.aggregate(node, s)
        if node == ("iterate", ("identity",)):
            return replace_state(s, form="stream", value=s.value.fields["value"])
        if node[0] == "call" and node[1] == "to_entries":
            return replace_state(s, form="array")
        raise NotPlanned("an object of rows")

    def distinct_keys(self, s: State) -> State:
        out = self.grouped(s, {})
        return replace_state(out, form="array")

    def collected(self, s: State) -> State:
        return self.per_group(("identity",), s)

    def per_group(self, node, s: State) -> State:
        aggs = Aggregates(self, s)
        value = aggs.lower(node)
        out = self.grouped(s, aggs.columns)
        return replace_state(out, value=value, form="stream")

    def grouped(self, s: State, columns: dict[str, Column]) -> State:
        keys = [self.fresh("key") for _ in s.keys]
        by = [k.column().alias(n) for k, n in zip(s.keys, keys, strict=True)]
        columns = columns or {"__n": F.count(F.lit(1))}
        df = s.df.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()])
        out = State(df, Value(None, None, {}), [F.col(k).asc_nulls_first() for k in keys], "stream")
        out.sorted = True
        out.key_names = keys
        return out

    # ---- whole-array results

    def aggregate(self, node, s: State) -> State:
        aggs = Aggregates(self, replace_state(s, keys=[]))
        value = aggs.lower(node)
        if not aggs.columns:
            raise NotPlanned("a constant of the whole array")
        return State(s.df.agg(*[c.alias(n) for n, c in aggs.columns.items()]), value, [], "single")

    def over_single(self, node, s: State) -> State:
        if node[0] == "iterate":
            return self.exploded(replace_state(s, form="stream"), self.scalars.lower(node[1], s.value))
        return replace_state(s, value=self.scalars.lower(node, s.value))


class Aggregates(Scalars):
    """Expressions over a group of rows; the aggregates they need become ``columns``."""

    def __init__(self, planner: Planner, s: State):
        super().__init__(planner.scalars.vars, planner.scalars.functions)
        self.planner, self.s, self.columns = planner, s, {}

    def with_var(self, name, v):
        out = Aggregates(self.planner, self.s)
        out.vars, out.functions, out.columns = {**self.vars, name: v}, self.functions, self.columns
        return out

    def add(self, col: Column, t: T.DataType) -> Value:
        name = f"__a{len(self.columns)}_{self.planner.fresh('x')}"
        self.columns[name] = col
        return typed(F.col(name), t)

    def lower(self, node, cur=None):
        if cur is not None:
            return Scalars(self.vars, self.functions).lower(node, cur) if not isinstance(cur, _Group) else self.of_group(node, cur)
        return self.of_group(node, _Group(self.s.value, None))

    def of_group(self, node, g: _Group) -> Value:
        k = node[0]
        plain = Scalars(self.vars, self.functions)
        if k == "identity":
            t = T.ArrayType(_type_of(g.value))
            return self.add(self.listed_rows(g), t)
        if k == "pipe":
            left = self.group_step(node[1], g)
            if left is not None:
                return self.of_group(node[2], left)
            return plain.lower(node[2], self.of_group(node[1], g))
        if k == "call":
            name, args = node[1], node[2]
            if name == "length" and not args:
                return self.add(F.count(F.lit(1)) if g.where is None else F.count_if(g.where), T.LongType()) if not g.distinct else self.add(F.count_distinct(g.only(g.value.column())) + F.max(g.only(g.value.column().isNull()).cast("long")), T.LongType())
            if name in ("add", "min", "max") and not args:
                return self.total(name, g)
            if name in ("first", "last") and not args:
                return self.edge(g, F.min_by if name == "first" else F.max_by)
            if name in ("min_by", "max_by"):
                key = plain.lower(args[0], g.value)
                return self.edge(g, F.min_by if name == "min_by" else F.max_by, key)
            if name in ("any", "all") and len(args) <= 1:
                c = truthy(plain.lower(args[0], g.value) if args else g.value)
                return self.add(F.coalesce((F.bool_or if name == "any" else F.bool_and)(g.only(c)), F.lit(name == "all")), T.BooleanType())
            if name == "join" and len(args) == 1:
                sep = plain.lower(args[0], g.value)
                rows = self.add(self.listed_rows(g), T.ArrayType(_type_of(g.value)))
                return plain.lower(("call", "join", [("literal", sep.literal)]), rows)
            if name == "add" and len(args) == 1:
                return self.of_group(("pipe", ("collect", args[0]), ("call", "add", [])), g)
            step = self.group_step(node, g)
            if step is not None:
                return self.of_group(("identity",), step)
        if k == "index" and node[1][0] == "index" and (path := _path_of_edge(node)) is not None:
            at, names = path
            v = g.value
            try:
                for name in names:
                    v = index(v, literal(name))
            except NotPlanned:
                v = None
            if v is not None:
                return self.edge(replace(g, value=v), F.min_by if at == 0 else F.max_by)
        if k in ("index", "slice") and node[1] != ("identity",) and k == "index":
            if node[1][0] == "call" and (step := self.group_step(node[1], g)) is not None:
                return self.of_group(("index", ("identity",), node[2]), step)
            return index(self.of_group(node[1], g), plain.lower(node[2], literal(None)))
        if k == "index":
            at = plain.lower(node[2], literal(None))
            if at.is_literal and at.literal in (0, -1) and not isinstance(at.literal, bool):
                return self.edge(g, F.min_by if at.literal == 0 else F.max_by)
            rows = self.add(self.listed_rows(g), T.ArrayType(_type_of(g.value)))
            return index(rows, at)
        if k == "collect":
            step = self.group_step(node, g)
            if step is not None:
                return self.of_group(("identity",), step)
        if k in ("literal", "variable"):
            return plain.lower(node, literal(None))
        if k == "object":
            out = {}
            for key, v in node[1]:
                name = plain.lower(key, literal(None))
                if not name.is_literal:
                    raise NotPlanned("keys that vary")
                out[name.literal] = self.of_group(v, g)
            return Value(None, None, out)
        if k == "arith":
            return arithmetic(node[3], self.of_group(node[1], g), self.of_group(node[2], g))
        if k == "compare":
            return comparison(node[3], self.of_group(node[1], g), self.of_group(node[2], g))
        if k in ("and", "or", "alt", "if"):
            parts = [self.of_group(x, g) for x in node[1:]]
            names = [f"$__p{n}" for n in range(len(parts))]
            scope = Scalars({**self.vars, **dict(zip(names, parts, strict=True))}, self.functions)
            return scope.lower((k, *[("variable", n) for n in names]), literal(None))
        if k == "reduce":
            _, source, patterns, start, update = node
            step = self.group_step(("collect", source), g)
            if step is None or patterns[0][0] != "var" or update[0] != "arith" or update[3] != "+" or update[1] != ("identity",):
                raise NotPlanned("a fold that is no sum")
            term = plain.with_var(patterns[0][1], step.value).lower(update[2], literal(None))
            first = plain.lower(start, literal(None))
            t = wider(term.type, first.type)
            return self.add((F.coalesce(F.sum(step.only(term.col)), F.lit(0)) + first.col).cast(t), t)
        raise NotPlanned(f"{k} of a group")

    def group_step(self, node, g: _Group) -> _Group | None:
        """Array-to-array steps that stay inside an aggregate: map, select, [.[] | f], unique, sort."""
        plain = Scalars(self.vars, self.functions)
        if node[0] == "identity":
            return g
        if node[0] == "collect":
            body = node[1]
            if body == ("iterate", ("identity",)):
                return g
            if body[0] == "pipe" and body[1] == ("iterate", ("identity",)):
                return self.map_step(body[2], g)
            if body[0] == "index" and body[1] == ("iterate", ("identity",)):
                return self.map_step(("index", ("identity",), body[2]), g)
            return None
        if node[0] == "iterate" and node[1] == ("identity",):
            return g
        if node[0] == "call":
            if node[1] == "map":
                return self.map_step(node[2][0], g)
            if node[1] == "unique" and not node[2]:
                return replace(g, distinct=True)
            if node[1] == "sort_by":
                return replace(g, by=plain.lower(node[2][0], g.value))
            if node[1] == "sort" and not node[2]:
                return replace(g, by=g.value)
        return None

    def map_step(self, f, g: _Group) -> _Group | None:
        plain = Scalars(self.vars, self.functions)
        if f[0] == "call" and f[1] == "select":
            c = truthy(plain.lower(f[2][0], g.value))
            return replace(g, where=c if g.where is None else g.where & c)
        if f[0] == "pipe":
            left = self.map_step(f[1], g)
            return None if left is None else self.map_step(f[2], left)
        try:
            return replace(g, value=plain.lower(f, g.value))
        except NotPlanned:
            return None

    def _order(self, g: _Group) -> list[Column]:
        own = [F.col(c) if isinstance(c, str) else _bare(c) for c in self.s.order]
        if g.by is None:
            return own
        return [g.by.col.isNotNull(), *[_bare(c) for c in order_key(g.by)], *own]

    def listed_rows(self, g: _Group) -> Column:
        v = g.value.column()
        if g.distinct:
            return F.array_sort(F.collect_set(g.only(v)))
        parts = self._order(g)
        rows = F.collect_list(g.only(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(parts)], v.alias("v"))))
        return F.transform(F.array_sort(rows), lambda x: x["v"])

    def edge(self, g: _Group, pick, key: Value | None = None) -> Value:
        """The value of the row with the smallest or largest (key, order): an aggregate a field, so unused ones are pruned.

        All fields come from one row, as every aggregate sees the same rows in the same order. What the group is made by
        needs no aggregate, and an order by one column that is never null no struct.
        """
        if g.value.fields is not None and g.value.fields:
            return Value(None, None, {k: self.edge(replace(g, value=v), pick, key) for k, v in g.value.fields.items()})
        if g.where is None and (of := _text_of(g.value)) in self.s.key_texts and len(self.s.keys) == len(self.s.key_texts):
            k = self.s.keys[self.s.key_texts.index(of)]
            return self.add(k.column(), _type_of(g.value))
        if key is None and g.by is None and len(self.s.order) == 1 and isinstance(self.s.order[0], str) and self.s.order[0].startswith("__ord"):
            return self.add(pick(g.value.column(), g.only(F.col(self.s.order[0]))), _type_of(g.value))
        parts = [*([key.col.isNotNull(), *[_bare(c) for c in order_key(key)]] if key else []), *self._order(g)]
        return self.add(pick(g.value.column(), g.only(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(parts)]))), _type_of(g.value))

    def total(self, name: str, g: _Group) -> Value:
        v = g.value
        if v.fields is not None:
            raise NotPlanned(f"{name} of objects")
        if name == "add":
            if is_num(v):
                t = T.DoubleType() if isinstance(v.type, (T.FloatType, T.DoubleType, T.DecimalType)) else T.LongType()
                return self.add((F.sum_distinct if g.distinct else F.sum)(g.only(v.col)).cast(t), t)
            rows = self.add(self.listed_rows(g), T.ArrayType(v.type))
            return Scalars(self.vars, self.functions).folded(rows)
        picked = self.edge(replace(g, by=None), F.min_by if name == "min" else F.max_by, v)
        return picked


@dataclass
class _Group:
    value: Value
    where: Column | None
    distinct: bool = False
    by: Value | None = None

    def only(self, c: Column) -> Column:
        return c if self.where is None else F.when(self.where, c)


def _path_of_edge(node) -> tuple[int, list[str]] | None:
    """(0 or -1, fields) of `.[0].a.b` and `.[-1].a.b`."""
    names: list[str] = []
    while node[0] == "index" and node[2][0] == "string" and node[2][1] is None and all(isinstance(p, str) for p in node[2][2]):
        names.insert(0, "".join(node[2][2]))
        node = node[1]
    if not names or node[0] != "index" or node[1] != ("identity",):
        return None
    at = node[2]
    if at == ("literal", 0):
        return 0, names
    return (-1, names) if at in (("literal", -1), ("negate", ("literal", 1))) else None


def _piped(node) -> list:
    """The steps of a pipeline."""
    return [*_piped(node[1]), *_piped(node[2])] if node[0] == "pipe" else [node]


def _text_of(v: Value) -> str:
    """An expression as text, to tell equal ones."""
    return str(v.column()._jc.toString()) if v.fields is None else "{" + ",".join(f"{k}:{_text_of(x)}" for k, x in v.fields.items()) + "}"


def replace_state(s: State, **changes) -> State:
    out = replace(s, **changes)
    if getattr(s, "sorted", False):
        out.sorted = True
    return out


def _bare(c) -> Column:
    """A sort column without its direction."""
    if isinstance(c, str):
        return F.col(c)
    text_ = str(c._jc.toString()) if hasattr(c, "_jc") else ""
    if " ASC" in text_ or " DESC" in text_:
        return F.col(text_.split(" ASC")[0].split(" DESC")[0].strip("`"))
    return c


def _descending(c):
    name = c if isinstance(c, str) else str(c._jc.toString()).split(" ASC")[0].split(" DESC")[0].strip("`")
    back = not isinstance(c, str) and " DESC" in str(c._jc.toString())
    return F.col(name).asc_nulls_first() if back else F.col(name).desc_nulls_last()


def _generates(node) -> bool:
    """Whether an expression may have another number of outputs than one."""
    if not isinstance(node, tuple):
        return False
    if node[0] in ("iterate", "comma"):
        return True
    if node[0] in ("collect", "reduce", "literal", "string"):
        return False
    if node[0] == "call":
        return node[1] in ("range", "select", "empty", "recurse", "scan", "splits", "match", "limit", "first", "inputs", "paths", "to_entries_stream", "values", "nulls") and not (node[1] == "first" and not node[2])
    return any(_generates(x) for x in node[1:])


def _type_of_col(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def plan(df: DataFrame, program: str, mode: str = "slurp", variables: dict | None = None, order: list[str] | None = None) -> DataFrame:
    """The DataFrame of a program's outputs: an object's fields as columns, another value as column ``value``."""
    return Planner(df, variables, order).plan(program, mode)
