"""Chains of processes: each declares what it requires and provides; results are remembered by request."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field


def canonical(request: Mapping) -> str:
    """The same text for requests that differ only in order."""
    return json.dumps(request, sort_keys=True, default=str)


@dataclass
class Node:
    """``operator(node, inputs)`` gets the parents' results in the order of ``requires`` and returns what it provides."""

    name: str
    operator: Callable
    requires: list[dict] = field(default_factory=list)
    provides: dict | list[dict] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)

    def propagated(self) -> list[dict]:
        """Requires with values filled in from ``provides``: None copies the value of the same key, a number takes that member of
        a list, a function is called with the provided value; a key that isn't provided is left out."""
        if not isinstance(self.provides, dict):
            return [dict(r) for r in self.requires]
        out = []
        for require in self.requires:
            made = {}
            for k, v in require.items():
                given = self.provides.get(k)
                if v is None or isinstance(v, int) and not isinstance(v, bool) or callable(v):
                    if k not in self.provides:
                        continue
                    if callable(v):
                        v = v(given)
                    else:
                        v = given[v or 0] if isinstance(given, (list, tuple)) else given
                made[k] = v
            out.append(made)
        return out

    def filled(self, requires: list[dict]) -> list[dict]:
        """Provides that take what they lack from the require at their place (or the last), unless inherit is False."""
        some = self.provides if isinstance(self.provides, list) else [self.provides]
        out = []
        for i, p in enumerate(some):
            p = dict(p)
            parent = requires[min(i, len(requires) - 1)] if requires and p.pop("inherit", True) is not False else {}
            p.pop("inherit", None)
            out.append({**{k: v for k, v in parent.items() if k not in ("process", "root")}, **p})
        return out


def subset(requires: Iterable[Mapping], wanted: Iterable, key: str) -> list[dict]:
    """The first require for each wanted value of ``key``."""
    requires = list(requires)
    return [dict(next(r for r in requires if r.get(key) == v)) for v in wanted if any(r.get(key) == v for r in requires)]


def return_request(provided: list[dict]) -> list[dict]:
    """Keys common to all, without repeats."""
    common = set.intersection(*(set(p) for p in provided)) if provided else set()
    out = {canonical(x): x for x in ({k: v for k, v in p.items() if k in common} for p in provided)}
    return list(out.values())


class Memo:
    """Results by process and request, in memory or as files below a folder of the driver."""

    def __init__(self, root: str | None = None):
        self.root, self.kept = root, {}

    def _path(self, process: str, request: Mapping) -> str:
        return os.path.join(self.root, process, hashlib.sha256(canonical(request).encode()).hexdigest() + ".json")

    def get(self, process: str, request: Mapping):
        key = (process, canonical(request))
        if key not in self.kept and self.root and os.path.exists(path := self._path(process, request)):
            with open(path) as f:
                self.kept[key] = json.load(f)["result"]
        return self.kept.get(key)

    def put(self, process: str, request: Mapping, result) -> None:
        self.kept[(process, canonical(request))] = result
        if self.root:
            path = self._path(process, request)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path + ".new", "w") as f:
                json.dump({"request": json.loads(canonical(request)), "result": result}, f)
            os.replace(path + ".new", path)

    def forget(self, process: str) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k[0] != process}
        if self.root and os.path.isdir(folder := os.path.join(self.root, process)):
            for name in os.listdir(folder):
                os.remove(os.path.join(folder, name))


@contextmanager
def lock(path: str, wait: float = 60.0, poll: float = 0.2):
    """One holder at a time: the file is made by one atomic call, and removed at the end."""
    until = time.monotonic() + wait
    while True:
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            if time.monotonic() > until:
                raise TimeoutError(f"{path} is held") from None
            time.sleep(poll)
    try:
        yield
    finally:
        os.remove(path)


class Workflow:
    """Nodes by name. ``run`` makes a node's parents first, each request once; ``force`` counts the levels above the node that
    are made anew though remembered, ``reset`` the levels whose memory is dropped."""

    def __init__(self, nodes: Iterable[Node], memo: Memo | None = None, **settings):
        self.nodes, self.memo, self.settings = {n.name: n for n in nodes}, memo or Memo(), settings

    def order(self, name: str) -> list[str]:
        """Parents before children; a ring is an error."""
        done, open_, out = set(), [], []

        def visit(n):
            if n in open_:
                raise ValueError("a ring of processes: " + " -> ".join([*open_, n]))
            if n in done:
                return
            open_.append(n)
            for r in self.nodes[n].requires:
                if r.get("process"):
                    visit(r["process"])
            open_.pop()
            done.add(n)
            out.append(n)

        visit(name)
        return out

    def run(self, name: str, force: int = 0, reset: int = 0, **provides):
        self.order(name)
        return self._run(name, provides, force, reset)

    def _run(self, name: str, provides: Mapping, force: int, reset: int):
        from dataclasses import replace

        node = self.nodes[name]
        if provides and isinstance(node.provides, dict):
            node = replace(node, provides={**node.provides, **provides})
        request = {"provides": node.provides, "properties": {**self.settings, **node.properties}}
        if reset > 0:
            self.memo.forget(name)
        if force <= 0 and (known := self.memo.get(name, request)) is not None:
            return known
        inputs, requires = [], []
        for require in node.propagated():
            if not require.get("process"):
                requires.append(require)
                inputs.append(require)
                continue
            given = {k: v for k, v in require.items() if k not in ("process", "root")}
            got = self._run(require["process"], given, force - 1, reset - 1)
            if got is None:  # the parent opts out
                continue
            for x in got if isinstance(got, list) else [got]:
                requires.append({**require, **x} if isinstance(x, Mapping) else require)
                inputs.append(x)
        filled = node.filled(requires)
        ready = replace(node, requires=requires, provides=filled if isinstance(node.provides, list) else filled[0])
        result = ready.operator(ready, inputs)
        if result is not None:
            self.memo.put(name, request, result)
        return result
