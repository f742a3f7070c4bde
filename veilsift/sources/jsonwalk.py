"""String values of a JSON document with their pointers and byte places.

A scanner over tokens with an explicit stack: no tree is built, and depth costs no recursion. ``offset_map`` has the
serialized offset of each decoded UTF-8 byte and of the end; it is None where a body has no escapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

LEAST_BYTES, DEEPEST = 6, 512
_SPACE = re.compile(rb"[ \t\r\n]*")
_BODY = re.compile(rb'[^"\\\x00-\x1f]*')
_ATOM = re.compile(rb"-?[0-9][0-9.eE+-]*|true|false|null")
_SHORT = {ord('"'): b'"', ord("\\"): b"\\", ord("/"): b"/", ord("b"): b"\b", ord("f"): b"\f", ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t"}


class JSONError(ValueError):
    """Not JSON, with the byte offset."""

    def __init__(self, what: str, at: int) -> None:
        super().__init__(f"{what} at {at}")
        self.at = at


class StringValue(NamedTuple):
    pointer: str
    text: str
    start: int
    end: int
    offset_map: list[int] | None


def _unicode(data: bytes, at: int) -> tuple[int, int]:
    """The code point of an escape ``\\uXXXX`` at ``at`` (of a pair if it begins one) and the offset after it."""

    def unit(i: int) -> int:
        digits = data[i + 2 : i + 6]
        if data[i : i + 2] != b"\\u" or not re.fullmatch(rb"[0-9a-fA-F]{4}", digits):
            raise JSONError("bad escape", i)
        return int(digits, 16)

    first = unit(at)
    if 0xD800 <= first < 0xDC00:
        second = unit(at + 6)
        if not 0xDC00 <= second < 0xE000:
            raise JSONError("lone surrogate", at)
        return 0x10000 + ((first - 0xD800) << 10) + second - 0xDC00, at + 12
    if 0xDC00 <= first < 0xE000:
        raise JSONError("lone surrogate", at)
    return first, at + 6


def _string(data: bytes, at: int) -> tuple[bytes, list[int] | None, int]:
    """Decoded bytes of the string whose body begins at ``at``, its map, and the offset of the closing quote."""
    end = _BODY.match(data, at).end()
    if data[end : end + 1] == b'"':
        return data[at:end], None, end
    parts, places, i = [data[at:end]], list(range(at, end)), end
    while True:
        c = data[i : i + 1]
        if c == b'"':
            places.append(i)
            return b"".join(parts), places, i
        if c == b"":
            raise JSONError("unexpected end", i)
        if c != b"\\":
            raise JSONError("control byte", i)
        mark = data[i + 1 : i + 2]
        if mark == b"u":
            point, after = _unicode(data, i)
            piece = chr(point).encode()
        elif mark and mark[0] in _SHORT:
            piece, after = _SHORT[mark[0]], i + 2
        else:
            raise JSONError("bad escape", i)
        parts.append(piece)
        places.extend([i] * len(piece))
        end = _BODY.match(data, after).end()
        parts.append(data[after:end])
        places.extend(range(after, end))
        i = end


def _text(raw: bytes, at: int) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        raise JSONError("not UTF-8", at + e.start) from None


def string_values(data: bytes, least: int = LEAST_BYTES) -> Iterator[StringValue]:
    """String values (not keys) of at least ``least`` decoded bytes; raises JSONError where the document is not JSON."""
    stack: list[list] = []  # [is object, pointer of the container, next index or key]
    at, done = _SPACE.match(data, 0).end(), False
    pointer = ""
    while True:
        # One value begins at ``at`` under ``pointer``.
        c = data[at : at + 1]
        if c == b'"':
            raw, places, end = _string(data, at + 1)
            text = _text(raw, at + 1)
            if len(raw) >= least:
                yield StringValue(pointer, text, at + 1, end, places)
            at = end + 1
        elif c in (b"{", b"["):
            if len(stack) >= DEEPEST:
                raise JSONError("nested too deeply", at)
            closing = b"}" if c == b"{" else b"]"
            inner = _SPACE.match(data, at + 1).end()
            if data[inner : inner + 1] == closing:
                at = inner + 1
            else:
                stack.append([c == b"{", pointer, 0])
                at, pointer = _entered(data, inner, stack[-1])
                continue
        else:
            m = _ATOM.match(data, at)
            if not m:
                raise JSONError("unexpected end" if at >= len(data) else "unexpected byte", at)
            at = m.end()
        # The value has ended: close containers, or go on to the next value.
        while not done:
            at = _SPACE.match(data, at).end()
            if not stack:
                if at != len(data):
                    raise JSONError("trailing bytes", at)
                done = True
                break
            c = data[at : at + 1]
            if c == b",":
                stack[-1][2] += 1
                at, pointer = _entered(data, _SPACE.match(data, at + 1).end(), stack[-1])
                break
            if c != (b"}" if stack[-1][0] else b"]"):
                raise JSONError("unexpected end" if at >= len(data) else "unexpected byte", at)
            stack.pop()
            at += 1
        if done:
            return


def _entered(data: bytes, at: int, container: list) -> tuple[int, str]:
    """Offset and pointer of the next value of a container, past its key if it is an object."""
    is_object, pointer, index = container
    if not is_object:
        return at, f"{pointer}/{index}"
    if data[at : at + 1] != b'"':
        raise JSONError("a key is missing", at)
    raw, _, end = _string(data, at + 1)
    key = _text(raw, at + 1).replace("~", "~0").replace("/", "~1")
    at = _SPACE.match(data, end + 1).end()
    if data[at : at + 1] != b":":
        raise JSONError("a colon is missing", at)
    return _SPACE.match(data, at + 1).end(), f"{pointer}/{key}"


def serialized(value_start: int, offset_map: list[int] | None, start: int, end: int) -> tuple[int, int]:
    """Serialized byte range of a decoded byte range."""
    if offset_map is None:
        return value_start + start, value_start + end
    last = len(offset_map) - 1
    return offset_map[min(start, last)], offset_map[min(end, last)]


def feasibility(reliable: bool, offset_map: list[int] | None, start: int, end: int) -> str:
    if not reliable:
        return "offsetsUnreliable"
    if offset_map is None or all(offset_map[i + 1] - offset_map[i] == 1 for i in range(start, min(end, len(offset_map) - 1))):
        return "byteLengthPreserving"
    return "semanticRewrite"
