"""Regular expressions of the JSON filter language (Oniguruma's Ruby syntax) on the ``regex`` module."""

from __future__ import annotations

from functools import lru_cache

import regex

from sylva.functions.values import JqError, shown, type_of

_FLAGS = {"i": regex.IGNORECASE, "x": regex.VERBOSE, "p": regex.DOTALL, "s": 0, "g": 0, "n": 0, "l": 0}


@lru_cache(maxsize=512)
def compiled(pattern: str, flags: str):
    bits = regex.MULTILINE  # ^ and $ match at lines
    for f in flags:
        if f not in _FLAGS:
            raise JqError(f"{flags} is not a valid modifier string")
        bits |= _FLAGS[f]
    text = pattern.replace("\\h", "[0-9a-fA-F]").replace("\\H", "[^0-9a-fA-F]").replace("\\Z", "(?=\\n?\\z)").replace("\\z", "\\Z")
    try:
        return regex.compile(text, bits | (regex.POSIX if "l" in flags else 0))
    except regex.error as e:
        raise JqError(f"{pattern} (at offset 0) is not a valid regex: {e}") from e


def matches(text, pattern, flags, every: bool = False) -> list:
    if not isinstance(text, str):
        raise JqError(f"{type_of(text)} ({shown(text)}) cannot be matched, as it is not a string")
    if isinstance(pattern, list):
        pattern, flags = pattern[0], (pattern[1] if len(pattern) > 1 else None) or flags
    if not isinstance(pattern, str):
        raise JqError(f"{type_of(pattern)} ({shown(pattern)}) cannot be matched, as it is not a string")
    if flags is not None and not isinstance(flags, str):
        raise JqError(f"{type_of(flags)} ({shown(flags)}) is not a string")
    flags = flags or ""
    r = compiled(pattern, flags)
    if every or "g" in flags:
        found = list(r.finditer(text))
    else:
        m = r.search(text)
        found = [m] if m else []
    return [m for m in found if m[0]] if "n" in flags else found


def match_object(m) -> dict:
    names = {n: k for k, n in m.re.groupindex.items()}
    captures = []
    for k in range(1, m.re.groups + 1):
        s = m[k]
        captures.append({"offset": m.start(k), "length": len(s) if s is not None else 0, "string": s, "name": names.get(k)})
    return {"offset": m.start(), "length": len(m[0]), "string": m[0], "captures": captures}


def captured(m) -> dict:
    return {n: m[n] for n in sorted(m.re.groupindex, key=m.re.groupindex.get)}
