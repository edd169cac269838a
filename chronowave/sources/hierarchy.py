"""The design hierarchy on the driver: scopes, signals, ranges, and queries over paths.

A path is a list of parts joined by dots: ``name``, ``{a,b}`` or ``{0..3}`` inside a name, ``/regex/`` or ``@regex``, ``*``
(one level), ``**`` (one or more levels), ``$Module`` and ``$$Module`` (by definition; value-change dumps have none). The last
part may select bits, ``[7:4]`` or ``[3]``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Range:
    start: int
    end: int

    def __str__(self) -> str:
        return f"[{self.start}]" if self.start == self.end else f"[{self.start}:{self.end}]"

    @property
    def width(self) -> int:
        return abs(self.start - self.end) + 1

    def holds(self, other: Range) -> bool:
        low, high = sorted((self.start, self.end))
        inside = low <= min(other.start, other.end) and max(other.start, other.end) <= high
        same_way = other.start == other.end or (other.start > other.end) == (self.start > self.end)
        return inside and same_way

    def offset(self, other: Range) -> int:
        """How many letters before the selected bits, counted from the left index."""
        return abs(other.start - self.start)


@dataclass
class Node:
    base: str
    kind: str  # scope or signal
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    code: str = ""
    width: int | None = None
    native: Range | None = None
    range: Range | None = None

    @property
    def name(self) -> str:
        return self.base + (str(self.range) if self.kind == "signal" and self.range else "")

    @property
    def full_name(self) -> str:
        return f"{self.parent.full_name}.{self.name}" if self.parent else self.name

    def select(self, wanted: Range | None) -> Node:
        """This signal with some of its bits; None gives all of them."""
        if wanted is None:
            wanted = self.native
        elif self.native is None:
            if (wanted.start, wanted.end) != (0, 0):
                raise ValueError(f"{self.full_name} has one bit")
        elif not self.native.holds(wanted):
            raise ValueError(f"{wanted} isn't within {self.native} of {self.full_name}")
        return Node(self.base, self.kind, self.parent, self.children, self.code, self.width, self.native, wanted)

    @property
    def selected_width(self) -> int:
        return self.range.width if self.range and self.native else (self.width or 1)


@dataclass(frozen=True)
class Part:
    kind: str  # exact, brace, regex, any, deep, module, deep_module
    text: str
    choices: tuple[tuple[str, tuple[str, ...]], ...] = ()
    select: Range | None = None


_TAIL = re.compile(r"^(.*?)\[(\d+)(?::(\d+))?\]$", re.S)


def _tail(text: str) -> tuple[str, Range | None]:
    m = _TAIL.match(text)
    return (m[1], Range(int(m[2]), int(m[3] if m[3] is not None else m[2]))) if m else (text, None)


def split_path(path: str) -> list[str]:
    """Parts of a path; dots inside braces and regular expressions don't split."""
    out, now, depth, literal, i = [], "", 0, False, 0
    path = path.strip()
    while i < len(path):
        c = path[i]
        if c == "\\" and i + 1 < len(path) and not literal:
            now += path[i : i + 2]
            i += 2
            continue
        if literal and c == "\\" and i + 1 < len(path):
            now += path[i : i + 2]
            i += 2
            continue
        if c == "/" and (literal or not now):
            literal = not literal
        elif not literal:
            depth += (c == "{") - (c == "}")
        if c == "." and not literal and not depth and not now.startswith("@"):
            out.append(now)
            now = ""
        else:
            now += c
        i += 1
    if literal:
        raise ValueError(f"unclosed /regex/ in {path!r}")
    if depth:
        raise ValueError(f"unmatched brace in {path!r}")
    return [p for p in [*out, now] if p]


def _expand(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Every spelling of a name with braces, and what each brace chose."""
    pieces: list[list[str]] = []
    braces: list[bool] = []
    for chunk in re.split(r"(\{[^{}]*\})", text):
        if chunk.startswith("{"):
            inner = chunk[1:-1]
            if m := re.fullmatch(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?", inner):
                a, b, step = int(m[1]), int(m[2]), abs(int(m[3] or 1)) or 1
                pieces.append([str(x) for x in (range(a, b + 1, step) if a <= b else range(a, b - 1, -step))])
            else:
                pieces.append([x.strip() for x in inner.split(",")])
            braces.append(True)
        else:
            pieces.append([chunk])
            braces.append(False)
    found = {}
    for combo in itertools.product(*pieces):
        found.setdefault("".join(combo), tuple(x for x, is_brace in zip(combo, braces, strict=True) if is_brace))
    return tuple(found.items())


def parse_path(path: str) -> list[Part]:
    parts = []
    for text in split_path(path):
        if text == "*":
            parts.append(Part("any", text))
        elif text == "**":
            parts.append(Part("deep", text))
        elif text.startswith("$"):
            parts.append(Part("deep_module" if text.startswith("$$") else "module", text.lstrip("$")))
        elif text.startswith(("/", "@")):
            body, select = text, None
            if text.startswith("/"):
                end = text.rfind("/")
                select_text = text[end + 1 :]
                if select_text:
                    rest, select = _tail(select_text)
                    if rest or select is None:
                        raise ValueError(f"{select_text!r} after a /regex/")
                body = text[1:end]
            else:
                body = text[1:]
            try:
                re.compile(body)
            except re.error as error:
                raise ValueError(f"{body!r}: {error}") from error
            parts.append(Part("regex", body, select=select))
        elif "{" in text:
            body, select = _tail(text)
            parts.append(Part("brace", body, _expand(body), select))
        else:
            body, select = _tail(text)
            parts.append(Part("exact", text, ((body, ()),), select))
    return parts


Key = tuple


def _fits(node: Node, part: Part) -> tuple[object, Range | None] | None:
    """What a part captures from a node and the bits it selects, or None."""
    if part.kind == "any":
        return node.name, None
    if part.kind == "exact":
        if part.text.replace("\\", "") == node.base:
            return (), None
        body = part.choices[0][0].replace("\\", "")
        return ((), part.select) if body == node.base and node.kind == "signal" else None
    if part.kind == "brace":
        for spelling, chosen in part.choices:
            if spelling == node.base and (part.select is None or node.kind == "signal"):
                return chosen, part.select
        return None
    m = re.fullmatch(part.text, node.base) or (re.fullmatch(part.text, node.name) if part.select is None else None)
    return ((m.groups() or (node.base,)), part.select) if m else None


def find(roots: list[Node], path: str, kind: str | None = None) -> dict[Key, Node]:
    """Nodes by what the path's patterns captured; names written out capture nothing."""
    parts = parse_path(path)
    if any(p.kind in ("module", "deep_module") for p in parts):
        raise ValueError("value-change dumps have no module definitions")
    out: dict[Key, Node] = {}

    def walk(nodes: list[Node], at: int, key: Key) -> Iterator[tuple[Key, Node]]:
        part, last = parts[at], at == len(parts) - 1
        for node in nodes:
            if part.kind == "deep":
                for below, trail in _below([node], ""):
                    if last:
                        yield (*key, trail), below
                    else:
                        yield from walk(below.children, at + 1, (*key, trail))
                continue
            hit = _fits(node, part)
            if hit is None:
                continue
            captured, select = hit
            if select is not None and not last:
                raise ValueError(f"a bit range in {path!r} cannot be followed by more")
            here = node.select(select) if select is not None else node
            longer = key if part.kind == "exact" else (*key, captured)
            if last:
                yield longer, here
            else:
                yield from walk(node.children, at + 1, longer)

    for key, node in walk(roots, 0, ()) if parts else ():
        if kind is not None and node.kind != kind:
            continue
        if key in out:
            raise ValueError(f"{path!r} matches {out[key].full_name} and {node.full_name} under one key")
        out[key] = node
    return out


def _below(nodes: list[Node], lead: str) -> Iterator[tuple[Node, str]]:
    for n in nodes:
        trail = f"{lead}.{n.name}" if lead else n.name
        yield n, trail
        yield from _below(n.children, trail)


def pair_clocks(signals: list[Key], clocks: list[Key]) -> dict[Key, Key]:
    """For each signal's key the clock whose key is its longest prefix; a single clock serves all."""
    if len(clocks) == 1:
        return dict.fromkeys(signals, clocks[0])
    out = {}
    for s in signals:
        fitting = [c for c in clocks if s[: len(c)] == c]
        if not fitting:
            raise ValueError(f"no clock key is a prefix of {s}")
        out[s] = max(fitting, key=len)
    return out
