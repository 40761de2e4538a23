"""EDN text: a reader and a printer.

Values come back as Python ones: None, bool, int, float, str, ``list`` (a vector),
``dict``, ``uuid.UUID``, ``datetime`` (naive, UTC), and the small types below for what
Python lacks.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta


class EdnError(ValueError):
    """The text is not EDN, or not the EDN that is asked for."""


class BigInt(int):
    """An integer written with N."""


@dataclass(frozen=True, order=True)
class Symbol:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, order=True)
class Keyword:
    """``:name`` or ``:namespace/name``; ``text`` is without the colon."""

    text: str

    @property
    def namespace(self) -> str | None:
        return self.text.rpartition("/")[0] or None

    @property
    def name(self) -> str:
        return self.text.rpartition("/")[2]

    @property
    def backward(self) -> bool:
        return self.name.startswith("_")

    def reversed(self) -> Keyword:
        name = self.name[1:] if self.backward else "_" + self.name
        return Keyword(f"{self.namespace}/{name}" if self.namespace else name)

    def __str__(self) -> str:
        return ":" + self.text


class List(tuple):
    """A form in parentheses."""


class Set(tuple):
    """A form in #{}, in the order of the text."""


#: Characters that begin and that continue a name.
HEAD, TAIL = r"a-zA-Z0-9*!_?$%&=<>", r"+a-zA-Z0-9*!_?$%&=<>\-"
NAME = rf"(?:[{HEAD}][{TAIL}]*(?:\.[{TAIL}]+)*/)?[{HEAD}][{TAIL}]*"
TOKENS = re.compile(
    rf"""
    (?P<blank>(?:[ \r\n\t,]|;[^\r\n]*)+)
  | (?P<open>\#\{{|[(\[{{])
  | (?P<close>[)\]}}])
  | (?P<text>"(?:[^"\\]|\\[\\"ntr])*")
  | (?P<inst>\#inst[ \r\n\t,]+"[^"]*")
  | (?P<micros>\#instmicros[ \r\n\t,]+\d+)
  | (?P<millis>\#instmillis[ \r\n\t,]+\d+)
  | (?P<uuid>\#uuid[ \r\n\t,]+"[^"]*")
  | (?P<special>\#f[ \r\n\t,]+(?:NaN|[+-]Infinity))
  | (?P<keyword>:{NAME})
  | (?P<big>[+-]?\d+N)
  | (?P<based>(?:3[0-6]|[12]\d|[2-9])r[0-9a-zA-Z]+)
  | (?P<hex>0x[0-9a-fA-F]+)
  | (?P<float>[+-]?\d+(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+))
  | (?P<octal>0[0-7]+(?![0-9.eE]))
  | (?P<int>[+-]?\d+)
  | (?P<symbol>{NAME}|\.\.\.|\.|[-+/])
    """,
    re.VERBOSE,
)
INSTANT = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)")
CLOSE = {"(": ")", "[": "]", "{": "}", "#{": "}"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"nil": None, "true": True, "false": False}


def instant(text: str) -> datetime:
    """A point in time, to the microsecond; its own zone is turned into UTC."""
    found = INSTANT.fullmatch(text)
    if not found:
        raise EdnError(f"invalid datetime {text!r}")
    *parts, fraction, zone = found.groups()
    try:
        at = datetime(*map(int, parts)) + timedelta(microseconds=int((fraction or "0")[:6].ljust(6, "0")))
    except ValueError as e:
        raise EdnError(f"invalid datetime {text!r}") from e
    if zone != "Z":
        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[4:]))
        at += shift if zone[0] == "-" else -shift
    return at


def _long(text: str, base: int = 10) -> int:
    number = int(text, base)
    if not -(1 << 63) <= number < 1 << 63:
        raise EdnError(f"integer {text} is out of range")
    return number


def _atom(kind: str, text: str):
    last = text.split()[-1].split(",")[-1] if kind in ("inst", "micros", "millis", "uuid", "special") else text
    match kind:
        case "text":
            return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1])
        case "inst":
            return instant(last[1:-1])
        case "micros":
            return datetime(1970, 1, 1) + timedelta(microseconds=int(last))
        case "millis":
            return datetime(1970, 1, 1) + timedelta(milliseconds=int(last))
        case "uuid":
            if not re.fullmatch(r'"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"', last):
                raise EdnError(f"invalid uuid {last}")
            return uuid.UUID(last[1:-1])
        case "special":
            return float(last.replace("Infinity", "inf").replace("NaN", "nan"))
        case "keyword":
            return Keyword(text[1:])
        case "big":
            return BigInt(text[:-1])
        case "based":
            base, _, digits = text.partition("r")
            return _long(digits, int(base))
        case "hex":
            return _long(text, 16)
        case "octal":
            return _long(text, 8)
        case "int":
            return _long(text)
        case "float":
            return float(text)
        case "symbol":
            return WORDS[text] if text in WORDS else Symbol(text)


def read_all(text: str) -> list:
    """Every form of a text."""
    stack: list[tuple[str, list]] = [("", [])]
    at = 0
    while at < len(text):
        found = TOKENS.match(text, at)
        if not found:
            raise EdnError(f"unexpected {text[at : at + 12]!r} at {at}")
        kind, token, at = found.lastgroup, found.group(), found.end()
        if kind == "blank":
            continue
        if kind == "open":
            stack.append((token, []))
        elif kind == "close":
            opened, items = stack.pop()
            if not stack or CLOSE[opened] != token:
                raise EdnError(f"unexpected {token!r} before {at}")
            stack[-1][1].append(_collected(opened, items))
        else:
            stack[-1][1].append(_atom(kind, token))
    if len(stack) > 1:
        raise EdnError(f"{stack[-1][0]!r} is not closed")
    return stack[0][1]


def _collected(opened: str, items: list):
    if opened == "[":
        return items
    if opened == "(":
        return List(items)
    if opened == "#{":
        return Set(items)
    if len(items) % 2:
        raise EdnError("a map needs pairs")
    try:
        return dict(zip(items[::2], items[1::2]))
    except TypeError:
        raise EdnError("a map's key must be a scalar") from None


def read(text: str):
    """The one form of a text."""
    forms = read_all(text)
    if len(forms) != 1:
        raise EdnError(f"expected one value, got {len(forms)}")
    return forms[0]


def write(value) -> str:
    """A value as EDN, so that ``read`` gives it back; maps in the order of their keys' text."""
    match value:
        case None:
            return "nil"
        case bool():
            return "true" if value else "false"
        case BigInt():
            return f"{int(value)}N"
        case int():
            return str(value)
        case float():
            if value != value:
                return "#f NaN"
            if value in (float("inf"), float("-inf")):
                return "#f +Infinity" if value > 0 else "#f -Infinity"
            return repr(value)
        case str():
            text = value.replace("\\", "\\\\").replace('"', '\\"')
            return f'"{text}"'
        case uuid.UUID():
            return f'#uuid "{value}"'
        case datetime():
            at = value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value
            return f'#inst "{at.isoformat(timespec="microseconds")}Z"'
        case bytes():
            return f'"{value.hex()}"'
        case Keyword() | Symbol():
            return str(value)
        case List():
            return "(" + " ".join(map(write, value)) + ")"
        case Set():
            return "#{" + " ".join(map(write, value)) + "}"
        case dict():
            pairs = sorted((write(k), write(v)) for k, v in value.items())
            return "{" + ", ".join(f"{k} {v}" for k, v in pairs) + "}"
        case list() | tuple():
            return "[" + " ".join(map(write, value)) + "]"
    raise TypeError(f"{type(value).__name__} has no EDN form")
