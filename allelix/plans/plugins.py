"""Operators by name with typed parameters, chained from a command line or a list."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from ..operators import filters, joins, models, pairs, quality, reads, summary, traits, windows


@dataclass
class Plugin:
    name: str
    run: Callable

    def parameters(self) -> dict[str, inspect.Parameter]:
        return dict(inspect.signature(self.run).parameters)

    def usage(self) -> str:
        return f"-{self.name} " + " ".join(f"[-{n} {p.default}]" for n, p in self.parameters().items() if p.default is not inspect.Parameter.empty)

    def parse(self, args: list[str]) -> dict:
        """Values from text, by the kind of each default; an unknown parameter is an error."""
        known, out = self.parameters(), {}
        for flag, text in zip(args[::2], args[1::2], strict=True):
            if flag.lstrip("-") not in known:
                raise ValueError(f"{self.name} has no parameter {flag}; usage: {self.usage()}")
            default = known[flag.lstrip("-")].default
            kind = type(default) if isinstance(default, (bool, int, float, str)) else str
            out[flag.lstrip("-")] = text.lower() in ("true", "1", "yes") if kind is bool else kind(text)
        return out


PLUGINS = {
    name: Plugin(name, fn)
    for module in (filters, joins, models, pairs, quality, reads, summary, traits, windows)
    for name, fn in vars(module).items()
    if inspect.isfunction(fn) and fn.__module__ == module.__name__ and name[0] != "_"
}


def chain(data, args: list[str]):
    """-name -param value ... -end, again and again; each one's result is the next one's first input."""
    at = 0
    while at < len(args):
        plugin = PLUGINS[args[at].lstrip("-")]
        end = args.index("-end", at)
        data = plugin.run(data, **plugin.parse(args[at + 1 : end]))
        at = end + 1
    return data
