"""Command lines of the two languages: python -m sylva.cli jq|yq ..."""

from __future__ import annotations

import json
import os
import random
import re
import sys
from collections.abc import Iterator

from sylva.functions.jq_builtins import Halt
from sylva.functions.values import JqError, decode_all, encode, truthy
from sylva.operators.jq_eval import Host, Program
from sylva.operators.yq_eval import Context, render, run
from sylva.plans.jq_parser import SyntaxFault
from sylva.sources import codecs
from sylva.sources.nodes import MERGE_TO_SPEC, YqError

_COLOURS = {"null": "0;90", "false": "0;39", "true": "0;39", "number": "0;39", "string": "0;32", "array": "1;39", "object": "1;39", "key": "34;1"}


def coloured(v, indent: int | str | None, sort: bool, depth: int = 0) -> str:
    """JSON text with terminal colours."""
    from sylva.functions.values import quote, sorted_keys, type_of

    kind = ("true" if v else "false") if isinstance(v, bool) else type_of(v)
    on = f"\x1b[{_COLOURS[kind]}m"
    if kind not in ("array", "object") or not v:
        return f"{on}{encode(v)}\x1b[0m"
    step = "" if not indent else " " * indent if isinstance(indent, int) else indent
    pad, end = ("\n" + step * (depth + 1), "\n" + step * depth) if step else ("", "")
    if kind == "array":
        body = f"{on},".join(pad + coloured(x, indent, sort, depth + 1) for x in v)
        return f"{on}[{body}{on}{end}]\x1b[0m"
    keys = sorted_keys(v) if sort else list(v)
    body = f"{on},".join(f"{pad}\x1b[0m\x1b[{_COLOURS['key']}m{quote(k)}\x1b[0m{on}:{' ' if step else ''}\x1b[0m" + coloured(v[k], indent, sort, depth + 1) for k in keys)
    return f"{on}{{{body}{on}{end}}}\x1b[0m"


def stream_events(v) -> Iterator:
    from sylva.operators.jq_eval import evaluate

    yield from evaluate("tostream", v)


class _Usage(Exception):
    pass


_MARKS = re.compile(r'["\\{}\[\]]')


def segments(lines: Iterator[str]) -> Iterator[str]:
    """A text's lines joined so that no value is cut: each segment is given on once its brackets and strings are closed."""
    held, depth, quoted = [], 0, False
    for line in lines:
        held.append(line)
        skip = -1
        for m in _MARKS.finditer(line):
            c, at = m[0], m.start()
            if at == skip:
                continue
            if c == "\\":
                skip = at + 1 if quoted else -1
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += 1 if c in "{[" else -1
        if depth <= 0 and not quoted:
            yield "".join(held)
            held, depth = [], 0
    if held:
        yield "".join(held)


def jq_main(args: list[str], stdin=None, stdout=None, stderr=None) -> int:
    """Exit status: 0, with -e 1 or 4 by the last output, 2 usage, 3 a program that cannot be read, 5 an error."""
    stdin, stdout, stderr = stdin or sys.stdin, stdout or sys.stdout, stderr or sys.stderr
    flags: set[str] = set()
    variables, data, positional, plain = {}, {}, [], []
    indent: int | str | None = 2
    program_file, taking = None, None
    libraries: dict[str, str] = {}
    rest = list(args)
    short = {"n": "null-input", "r": "raw-output", "j": "join-output", "a": "ascii-output", "s": "slurp", "R": "raw-input", "c": "compact-output", "S": "sort-keys", "C": "color-output", "M": "monochrome-output", "e": "exit-status", "f": "from-file", "h": "help", "L": "library-path"}
    try:
        while rest:
            a = rest.pop(0)
            if a == "--" or not a.startswith("-") or a == "-":
                if a == "--":
                    plain, rest = plain + rest, []
                elif taking and plain:
                    positional.append(a if taking == "args" else json.loads(a))
                else:
                    plain.append(a)
                continue
            names = [a[2:]] if a.startswith("--") else [short.get(c, c) for c in a[1:]]
            for name in names:
                if name in ("arg", "argjson", "slurpfile", "rawfile"):
                    k, v = rest.pop(0), rest.pop(0)
                    if name in ("slurpfile", "rawfile"):
                        with open(v, encoding="utf-8") as f:
                            v = f.read()
                    variables[k] = v if name in ("arg", "rawfile") else list(decode_all(v)) if name == "slurpfile" else next(decode_all(v))
                elif name in ("args", "jsonargs"):
                    taking = name
                elif name == "indent":
                    indent = int(rest.pop(0))
                    if not 0 <= indent <= 7:
                        raise _Usage("Cannot indent more than 7 characters")
                elif name == "tab":
                    indent = "\t"
                elif name == "from-file":
                    program_file = rest.pop(0)
                elif name == "library-path":
                    folder = rest.pop(0)
                    for d, _, files in os.walk(folder):
                        for x in files:
                            if x.endswith((".jq", ".json")):
                                with open(os.path.join(d, x), encoding="utf-8") as f:
                                    key = os.path.relpath(os.path.join(d, x), folder).rsplit(".", 1)[0]
                                    if x.endswith(".jq"):
                                        libraries[key] = f.read()
                                    else:
                                        data[key] = list(decode_all(f.read()))
                elif name in short.values() or name in ("seq", "stream", "stream-errors", "raw-output0", "unbuffered"):
                    flags.add(name)
                else:
                    raise _Usage(f"Unknown arguments: {a}")
        if program_file is None:
            if not plain:
                raise _Usage("a program is needed")
            program, files = plain[0], plain[1:]
        else:
            files = plain
            with open(program_file, encoding="utf-8") as f:
                program = f.read()
    except (_Usage, IndexError, ValueError, OSError) as e:
        print(f"jq: error: {e}", file=stderr)
        return 2
    if "compact-output" in flags:
        indent = None

    def counted(lines: Iterator[str]) -> Iterator[str]:
        for line in lines:
            host.line += line.endswith("\n")
            yield line

    def texts() -> Iterator[tuple[str | None, Iterator[str]]]:
        for name in files or [None]:
            host.line = 0
            if name is None:
                yield None, counted(iter(stdin))
            else:
                with open(name, encoding="utf-8", errors="replace") as f:
                    yield name, counted(f)

    host = Host(environment=dict(os.environ), libraries=libraries, data=data)

    def inputs() -> Iterator:
        everything: list = []
        for name, lines in texts():
            host.filename = name
            if "raw-input" in flags:
                found = lines if "slurp" in flags else (line.removesuffix("\n") for line in lines)
            else:
                found = (v for text in segments(lines) for v in decode_all(text))
                if "stream" in flags or "stream-errors" in flags:
                    found = (e for v in found for e in stream_events(v))
            if "slurp" in flags:
                everything += found
            else:
                yield from found
        if "slurp" in flags:
            yield "".join(everything) if "raw-input" in flags else everything

    host.inputs = inputs()
    status, last = 0, None
    try:
        compiled = Program(program, variables, host)
        compiled.env.vars["$ARGS"] = {"positional": positional, "named": variables}
        compiled.env.vars["$__prog_args"] = positional
    except (SyntaxFault, JqError) as e:
        print(f"jq: error: {e}\njq: 1 compile error", file=stderr)
        return 3

    def shown(v) -> str:
        if isinstance(v, str) and flags & {"raw-output", "join-output", "raw-output0"}:
            return encode(v, ascii_only=True)[1:-1] if "ascii-output" in flags else v
        if "color-output" in flags:
            return coloured(v, indent, "sort-keys" in flags)
        return encode(v, indent, "sort-keys" in flags, "ascii-output" in flags)

    end = "" if "join-output" in flags else "\0" if "raw-output0" in flags else "\n"
    feed = iter([None]) if "null-input" in flags else host.inputs
    while True:
        try:
            value = next(feed)
        except StopIteration:
            break
        except (JqError, OSError) as e:
            print(f"jq: error (at <stdin>:0): {e.message() if isinstance(e, JqError) else e}", file=stderr)
            status = 2
            break
        try:
            for out in compiled.run(value):
                if "raw-output0" in flags and isinstance(out, str) and "\0" in out:
                    raise JqError("Cannot dump a string containing NUL with --raw-output0 option")
                stdout.write(("\x1e" if "seq" in flags else "") + shown(out) + end)
                last = out, True
        except JqError as e:
            print(f"jq: error (at <unknown>): {e.message()}", file=stderr)
            status = 5
        except Halt as e:
            if e.shown:
                stderr.write(e.value if isinstance(e.value, str) else encode(e.value) + "\n")
            return e.status
        finally:
            for m in host.messages:
                stderr.write(encode(m) + ("\n" if isinstance(m, list) else ""))
            host.messages.clear()
    if status == 0 and "exit-status" in flags:
        return 4 if last is None else 0 if truthy(last[0]) else 1
    return status


#: Flags of the command line that take a text, those that are on or off, and short names.
_YQ_TEXTS = set("csv-separator expression from-file front-matter indent input-format lua-prefix lua-suffix output-format properties-separator shell-key-separator split-exp split-exp-file xml-attribute-prefix xml-content-name xml-directive-name xml-proc-inst-prefix".split())
_YQ_SWITCHES = set("colors csv-auto-parse exit-status header-preprocess help inplace lua-globals lua-unquoted no-colors no-doc nul-output null-input prettyPrint properties-array-brackets security-disable-env-ops security-disable-file-ops security-enable-system-operator string-interpolation toyaml tojson tsv-auto-parse unwrapScalar verbose version xml-keep-namespace xml-raw-token xml-skip-directives xml-skip-proc-inst xml-strict-mode yaml-fix-merge-anchor-to-spec".split())
_YQ_SHORT = {"C": "colors", "e": "exit-status", "f": "front-matter", "h": "help", "I": "indent", "i": "inplace", "p": "input-format", "M": "no-colors", "N": "no-doc", "0": "nul-output", "n": "null-input", "o": "output-format", "P": "prettyPrint", "s": "split-exp", "y": "toyaml", "j": "tojson", "r": "unwrapScalar", "v": "verbose", "V": "version"}


def _set(options: dict, name: str, value: str | None, rest: list[str], shown: str) -> None:
    """Put a flag of yq into ``options``; a text may be the next argument."""
    if name in _YQ_TEXTS:
        if value is None and not rest:
            raise _Usage(f"flag needs an argument: {shown}")
        options[name] = rest.pop(0) if value is None else value
    elif name in _YQ_SWITCHES:
        if value not in (None, "true", "false", "1", "0", "t", "f"):
            raise _Usage(f"invalid argument {value!r} for {shown!r}")
        options[name] = value in (None, "true", "1", "t")
    else:
        raise _Usage(f"unknown flag: {shown}")


def yq_main(args: list[str], stdin=None, stdout=None, stderr=None) -> int:
    stdin, stdout, stderr = stdin or sys.stdin, stdout or sys.stdout, stderr or sys.stderr
    options: dict = {"input-format": "auto", "output-format": "auto", "indent": "2"}
    plain: list[str] = []
    rest = list(args)
    all_ = bool(rest) and rest[0] in ("eval-all", "ea")
    if rest and rest[0] in ("eval", "e", "eval-all", "ea"):
        rest.pop(0)
    try:
        while rest:
            a = rest.pop(0)
            if a == "--":
                plain, rest = plain + rest, []
            elif not a.startswith("-") or a == "-":
                plain.append(a)
            elif a.startswith("--"):
                name, given, value = a[2:].partition("=")
                _set(options, name, value if given else None, rest, a)
            else:
                letters = a[1:]
                while letters:
                    name, letters = _YQ_SHORT.get(letters[0], letters[0]), letters[1:]
                    value = None
                    if letters and (name in _YQ_TEXTS or letters[0] == "="):
                        value, letters = letters.removeprefix("="), ""
                    _set(options, name, value, rest, a)
    except _Usage as e:
        print(f"Error: {e}", file=stderr)
        return 1
    if options.get("version") or options.get("help"):
        stdout.write("usage: python -m sylva.cli yq [eval|eval-all] [flags] [expression] [files]\n")
        return 0
    flags = {k for k, v in options.items() if v is True}
    if "tojson" in flags or "toyaml" in flags:
        options["output-format"] = "json" if "tojson" in flags else "yaml"
    try:
        for name, text_of in (("from-file", "expression"), ("split-exp-file", "split-exp")):
            if name in options:
                with open(options[name], encoding="utf-8") as f:
                    options[text_of] = f.read()
    except OSError as e:
        print(f"Error: {e}", file=stderr)
        return 1
    interpolate = options.get("string-interpolation", True)
    token = MERGE_TO_SPEC.set("yaml-fix-merge-anchor-to-spec" in flags)
    expression = options.get("expression") or (plain.pop(0) if plain and not os.path.isfile(plain[0]) else ".")
    try:
        names = [] if "null-input" in flags else plain or ["-"]
        texts = []
        for name in names:
            if name == "-":
                texts.append(stdin.read())
            else:
                with open(name, encoding="utf-8") as f:
                    texts.append(f.read())
        front = ""
        if options.get("front-matter") and texts:
            texts[0], front = codecs.split_front_matter(texts[0])
        from_ = codecs.format_of(options["input-format"]) if options["input-format"] != "auto" else codecs.format_of(names[0]) if names and names[0] != "-" else "yaml"
        to = codecs.format_of(options["output-format"]) if options["output-format"] != "auto" else from_
        if "prettyPrint" in flags:
            expression = f"({expression}) | ... style=\"\""
        context = Context(environment=None if "security-disable-env-ops" in flags else dict(os.environ), files=None if "security-disable-file-ops" in flags else _Files())
        if "null-input" in flags:
            from sylva.operators.yq_eval import evaluate, parsed
            from sylva.sources.nodes import null

            found = evaluate(parsed(expression, interpolate), [null()], context)
        else:
            found = run(expression, texts, from_, all_, names, context, options)
        indent = int(options["indent"])
        if "split-exp" in options:
            from sylva.operators.yq_eval import evaluate, parsed
            from sylva.sources.nodes import scalar

            for k, m in enumerate(found):
                stem = evaluate(parsed(options["split-exp"], interpolate), [m], context.bind("$index", [scalar(k)]))[0].value
                if os.path.dirname(stem):
                    os.makedirs(os.path.dirname(stem), exist_ok=True)
                with open(stem if "." in os.path.basename(stem) else f"{stem}.{'yml' if to == 'yaml' else to}", "w", encoding="utf-8") as f:
                    f.write(render([m], to, indent, options=options))
            return 0
        if "nul-output" in flags:
            text = "".join(render([m], to, indent, options=options).removesuffix("\n") + "\0" for m in found)
        else:
            text = render(found, to, indent, options.get("unwrapScalar", True), "no-doc" not in flags, options)
        text += front if options.get("front-matter") == "process" else ""
        if "inplace" in flags and names and names[0] != "-":
            part = f"{names[0]}.{random.randrange(1 << 30):x}.tmp"
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(part, names[0])
        else:
            stdout.write(text)
        if "exit-status" in flags and not any(m.real().tag != "!!null" and m.real().value != "false" for m in found):
            return 1
        return 0
    except (YqError, JqError, OSError, ValueError) as e:
        print(f"Error: {e.message() if isinstance(e, JqError) else e}", file=stderr)
        return 1
    finally:
        MERGE_TO_SPEC.reset(token)


class _Files(dict):
    """File contents by path, read when asked for."""

    def __contains__(self, path) -> bool:
        return os.path.isfile(path)

    def __getitem__(self, path) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()


if __name__ == "__main__":
    tool = {"jq": jq_main, "yq": yq_main}.get(sys.argv[1] if len(sys.argv) > 1 else "")
    if tool is None:
        sys.exit("usage: python -m sylva.cli jq|yq ...")
    sys.exit(tool(sys.argv[2:]))
