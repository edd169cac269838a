"""The pattern builder: a chain of steps, each a plain record."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

_channels = itertools.count()


@dataclass(frozen=True)
class Channel:
    """An identity under which events are consumed at most once."""

    name: str = ""
    token: int = field(default_factory=lambda: next(_channels))


@dataclass(frozen=True)
class Step:
    kind: str
    args: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None


MODES = ("last", "first", "list")


@dataclass(frozen=True)
class Pattern:
    """Immutable: every call returns a longer pattern."""

    steps: tuple[Step, ...] = ()

    def _with(self, kind: str, **args: Any) -> Pattern:
        return Pattern((*self.steps, Step(kind, args)))

    def wait(self, cond: Any, *, require: Any = None, require_message: Any = None) -> Pattern:
        return self._with("wait", cond=cond, require=require, message=require_message)

    def consume(self, cond: Any, channel: Any, *, require: Any = None, require_message: Any = None) -> Pattern:
        return self._with("consume", cond=cond, channel=channel, require=require, message=require_message)

    def delay(self, n: Any, *, require: Any = None, require_message: Any = None) -> Pattern:
        return self._with("delay", n=n, require=require, message=require_message)

    def capture(self, name: str, signal: Any, mode: str = "last") -> Pattern:
        if mode not in MODES:
            raise ValueError(f"capture mode is one of {MODES}")
        return self._with("capture", name=name, signal=signal, mode=mode)

    def require(self, cond: Any, *, message: Any = None) -> Pattern:
        return self._with("require", cond=cond, message=message)

    def loop(self, body: Pattern, *, until: Any = None, when: Any = None) -> Pattern:
        if (until is None) == (when is None):
            raise ValueError("a loop has either until or when")
        return self._with("loop", body=body, until=until, when=when)

    def repeat(self, body: Pattern, n: Any) -> Pattern:
        return self._with("repeat", body=body, n=n)

    def branch(self, cond: Any, true_body: Pattern | None = None, false_body: Pattern | None = None) -> Pattern:
        return self._with("branch", cond=cond, true_body=true_body, false_body=false_body)

    def captures(self) -> dict[str, str]:
        """Names and modes of all captures inside."""
        out: dict[str, str] = {}
        for s in self.steps:
            if s.kind == "capture":
                out[s.name] = "list" if s.mode == "list" else out.get(s.name, s.mode)
            for part in ("body", "true_body", "false_body"):
                if isinstance(s.args.get(part), Pattern):
                    out.update(s.args[part].captures())
        return out
