"""A command line from a function's signature."""

from __future__ import annotations

import argparse
import inspect
import re
from collections.abc import Callable


def parser_of(fn: Callable, allow_abbrev: bool = False) -> argparse.ArgumentParser:
    """Help from ``name: text`` lines of the docstring; types from annotations and defaults."""
    doc = inspect.getdoc(fn) or ""
    said = dict(re.findall(r"^\s*(\w+)\s*:\s*(.+)$", doc, re.M))
    out = argparse.ArgumentParser(fn.__name__, description=doc.split("\n")[0] or None, allow_abbrev=allow_abbrev)
    for p in inspect.signature(fn).parameters.values():
        if p.kind in (p.VAR_KEYWORD, p.VAR_POSITIONAL):
            continue
        kind = p.annotation if p.annotation in (int, float, str) else type(p.default) if isinstance(p.default, (int, float, str)) and not isinstance(p.default, bool) else str
        if isinstance(p.default, bool):
            out.add_argument(f"--{p.name}", type=lambda x: x.lower() in ("1", "true", "yes"), default=p.default, help=said.get(p.name))
        elif p.default is p.empty:
            out.add_argument(f"--{p.name}", type=kind, required=True, help=said.get(p.name))
        else:
            out.add_argument(f"--{p.name}", type=kind, default=p.default, help=said.get(p.name))
    return out


def call(fn: Callable, argv: list[str]):
    """Arguments that aren't declared go to ``**kwargs`` if the function has it."""
    known, rest = parser_of(fn).parse_known_args(argv)
    more = dict(zip((x.lstrip("-") for x in rest[::2]), rest[1::2], strict=False))
    if more and not any(p.kind is p.VAR_KEYWORD for p in inspect.signature(fn).parameters.values()):
        raise SystemExit(f"unknown: {', '.join(more)}")
    return fn(**vars(known), **more)
