"""Regular expressions over bytes -> one deterministic automaton in transition arrays that finds all matches of all rules.

The grammar is what secret rules need: literals, ``[...]`` with ranges and ``^``, ``.``, groups,
``|``, ``* + ? {m} {m,} {m,n}`` and ``\\xHH`` / ``\\d \\w \\s`` escapes.

Rules stand in groups. Within a group matches are leftmost and do not overlap: a match begins once a rule accepts, and
while it goes on no other rule of the group is begun. Each group becomes a minimal automaton by subset construction;
their product, over common byte classes, is the automaton that is run. A rule's matches must go on accepting until they
end (a head and a run behind it, or a fixed end), and none may begin within the head of another of its group.
"""

from __future__ import annotations

import numpy as np

ANY = frozenset(range(256))
CLASSES = {"d": frozenset(b"0123456789"), "w": frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"), "s": frozenset(b" \t\n\r\x0b\x0c")}


class _Parser:
    """Recursive descent to a tree: ('set', bytes), ('cat', ...), ('alt', ...), ('rep', node, least, most or None)."""

    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def parse(self):
        node = self.alt()
        if self.i != len(self.s):
            raise ValueError(f"unbalanced pattern at {self.i}: {self.s}")
        return node

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def alt(self):
        parts = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", *parts)

    def repeat(self):
        node = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            node = self.alt()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.s}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.folded(self.members()))
        if c == ".":
            return ("set", ANY - {10})
        return ("set", self.folded(self.escape() if c == "\\" else frozenset({self.byte(c)})))

    def byte(self, c: str) -> int:
        if ord(c) > 127:
            raise ValueError("patterns are over ASCII")
        return ord(c)

    def escape(self) -> frozenset:
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return frozenset({int(self.s[self.i - 2 : self.i], 16)})
        if c in CLASSES:
            return CLASSES[c]
        return frozenset({{"n": 10, "t": 9, "r": 13}.get(c, self.byte(c))})

    def members(self) -> frozenset:
        negate = self.peek() == "^"
        self.i += negate
        out: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.s[self.i]
            self.i += 1
            got = self.escape() if c == "\\" else frozenset({self.byte(c)})
            if len(got) == 1 and self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                d = self.s[self.i]
                self.i += 1
                end = self.escape() if d == "\\" else frozenset({self.byte(d)})
                got = frozenset(range(min(got), min(end) + 1))
            out |= got
        self.i += 1
        return ANY - out if negate else frozenset(out)

    def folded(self, got: frozenset) -> frozenset:
        if not self.fold:
            return got
        return got | {b ^ 32 for b in got if 65 <= b <= 90 or 97 <= b <= 122}


class _Nfa:
    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def build(self, node, at: int) -> int:
        """Adds ``node`` from state ``at``; the state after it."""
        kind = node[0]
        if kind == "set":
            to = self.state()
            self.steps[at].append((node[1], to))
            return to
        if kind == "cat":
            for part in node[1:]:
                at = self.build(part, at)
            return at
        if kind == "alt":
            to = self.state()
            for part in node[1:]:
                begin = self.state()
                self.free[at].append(begin)
                self.free[self.build(part, begin)].append(to)
            return to
        _, part, least, most = node
        for _ in range(least):
            at = self.build(part, at)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.build(part, loop)].append(loop)
            return loop
        ends = [at]
        for _ in range(most - least):
            ends.append(at := self.build(part, at))
        to = self.state()
        for x in ends:
            self.free[x].append(to)
        return to


class Automaton:
    """``table[state * n_classes + byte_class[byte]]`` is the next state; ``accept[state]`` has a bit for each rule that is in a
    match. A match ends where its rule's bit is lost."""

    def __init__(self, byte_class: np.ndarray, table: np.ndarray, accept: np.ndarray, back: list[tuple[np.ndarray, np.ndarray]]):
        self.byte_class, self.accept, self.back, self.lists = byte_class, accept, back, None
        self.n_classes = table.shape[1]
        self.table = table.reshape(-1)
        #: Bytes after which the automaton is in its start state, whatever came before.
        self.resets = ((table == 0).all(0))[byte_class]
        #: Transitions that end a match.
        self.ends = ((accept[:, None] & ~accept[table]) != 0).reshape(-1)

    def plain(self) -> tuple[list[int], bytes]:
        """The table with states as places of their rows, and the transitions that end a match, for a loop over bytes."""
        if self.lists is None:
            self.lists = (self.table.astype(np.int64) * self.n_classes).tolist(), self.ends.astype(np.uint8).tobytes()
        return self.lists

    def __getstate__(self):
        return self.__dict__ | {"lists": None}  # tasks make their own


def tree(pattern: str, fold: bool):
    return _Parser(pattern, fold).parse()


def reversed_(node):
    if node[0] == "cat":
        return ("cat", *(reversed_(x) for x in reversed(node[1:])))
    if node[0] == "alt":
        return ("alt", *(reversed_(x) for x in node[1:]))
    if node[0] == "rep":
        return ("rep", reversed_(node[1]), *node[2:])
    return node


def sets_of(node) -> set[frozenset]:
    if node[0] == "set":
        return {node[1]}
    return set().union(*(sets_of(x) for x in (node[1:2] if node[0] == "rep" else node[1:])))


class _Threads:
    """Closed moves of an automaton that may be in several states, by byte class."""

    def __init__(self, trees: list, members: dict[frozenset, np.ndarray], n_classes: int):
        nfa = _Nfa()
        start = nfa.state()
        self.ends = []
        for x in trees:
            begin = nfa.state()
            nfa.free[start].append(begin)
            self.ends.append(nfa.build(x, begin))
        closure = []
        for q in range(len(nfa.steps)):
            seen, todo = {q}, [q]
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            closure.append(frozenset(seen))
        # only states that consume or accept tell subsets apart
        matter = frozenset(q for q in range(len(nfa.steps)) if nfa.steps[q]) | frozenset(self.ends)
        self.moves: list[list[frozenset]] = []
        for q in range(len(nfa.steps)):
            row: list[set] = [set() for _ in range(n_classes)]
            for s, to in nfa.steps[q]:
                for c in members[s]:
                    row[c] |= closure[to] & matter
            self.moves.append([frozenset(x) for x in row])
        self.start = closure[start] & matter
        self.open = [bool(nfa.steps[e]) for e in self.ends]  # a run at the end
        self.owner = self._owners(nfa, [nfa.free[start][k] for k in range(len(trees))])

    def _owners(self, nfa: _Nfa, begins: list[int]) -> list[int]:
        """The rule of each state; rules are built one after the other."""
        return [max((k for k, b in enumerate(begins) if q >= b), default=-1) for q in range(len(nfa.steps))]

    def step(self, subset: frozenset, c: int) -> frozenset:
        return frozenset().union(*(self.moves[q][c] for q in subset))

    def going_on(self, subset: frozenset) -> frozenset:
        """Of a subset in which a rule accepts, what goes on with its match."""
        rule = self.accepts(subset)
        if self.open[rule]:
            return frozenset({self.ends[rule]})
        return frozenset(q for q in subset if self.owner[q] == rule)

    def accepts(self, subset: frozenset) -> int | None:
        return next((k for k, e in enumerate(self.ends) if e in subset), None)


def subsets(threads: _Threads, n_classes: int, search: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transition rows and the rule that accepts (or -1) of each subset. ``search``: matches may begin anywhere but within
    one that goes on; otherwise only at the start, and the last state is dead."""
    first = threads.start
    index, order, rows = {first: 0}, [first], []
    for subset in order:  # grows while it is read
        matched = search and threads.accepts(subset) is not None
        row = []
        for c in range(n_classes):
            to = threads.step(subset, c)
            if search and threads.accepts(to) is None:
                to = (threads.step(first, c) if matched else to) | first
            if search and threads.accepts(to) is not None:
                to = threads.going_on(to)
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        rows.append(row)
    accept = np.array([-1 if (k := threads.accepts(s)) is None else k for s in order])
    return np.array(rows, np.int64), accept


def minimised(rows: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement: blocks split until the successors of a block's states agree. State 0 stays 0."""
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        new = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    names: dict[int, int] = {}
    order = np.array([names.setdefault(b, len(names)) for b in block.tolist()])
    first = np.unique(order, return_index=True)[1]
    return order[rows[first]], accept[first]


def compile_rules(groups: list[list[tuple[str, bool]]], limit: int = 200_000) -> Automaton:
    """groups of (pattern, either case); rules are numbered through all groups."""
    trees = [[tree(*rule) for rule in group] for group in groups]
    sets = sorted(set().union(*(sets_of(x) for group in trees for x in group)), key=sorted)
    marks = np.zeros((256, len(sets)), bool)
    for k, s in enumerate(sets):
        marks[list(s), k] = True
    kinds, byte_class = np.unique(marks, axis=0, return_inverse=True)
    byte_class, n = byte_class.reshape(-1).astype(np.uint8), len(kinds)
    members = {s: np.flatnonzero(kinds[:, k]) for k, s in enumerate(sets)}
    parts, number = [], 0
    for group in trees:
        rows, accept = minimised(*subsets(_Threads(group, members, n), n, True))
        parts.append((rows.tolist(), [0 if k < 0 else 1 << (number + k) for k in accept.tolist()]))
        number += len(group)
    index, order, table = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    for state in order:  # the product, as far as it can be reached
        row = []
        for to in zip(*(rows[q] for (rows, _), q in zip(parts, state, strict=True)), strict=True):
            if to not in index:
                if len(order) >= limit:
                    raise ValueError(f"the rules need more than {limit} states")
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        table.append(row)
    accept = np.array([sum(a[q] for (_, a), q in zip(parts, state, strict=True)) for state in order], np.int64)
    back = []
    for x in (x for group in trees for x in group):
        rows, ok = minimised(*subsets(_Threads([reversed_(x)], members, n), n, False))
        back.append((rows, ok >= 0))
    return Automaton(byte_class, np.array(table, np.int32), accept, back)


def lanes_of(buffer: np.ndarray, offsets: np.ndarray, resets: np.ndarray, width: int = 1024) -> np.ndarray:
    """Starts of lanes, ascending: the documents' starts, and about every ``width`` bytes a place just after a
    reset byte. No match crosses a lane's start."""
    cuts = np.flatnonzero(resets[buffer]) + 1
    cuts = cuts[np.unique(cuts // width, return_index=True)[1]]
    starts = np.unique(np.concatenate([offsets[:-1], cuts]))
    return starts[starts < len(buffer)]


FEW = 100  # lanes that are read one after the other


def match_ends(auto: Automaton, buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lane, end (exclusive) and rules (bits) of all matches. Each byte is read once. All lanes advance together, one byte a step,
    until only few are left; these are longer than others by far and read in a plain loop, which costs less a byte then."""
    lengths = np.diff(np.append(starts, len(buffer)))
    order = np.argsort(-lengths, kind="stable")
    at, sizes = starts[order], lengths[order]
    classes = auto.byte_class[buffer]
    state = np.zeros(len(order), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live, t = len(order), 0
    for t in range(int(sizes[0]) + 1 if len(sizes) else 0):
        now = int(np.searchsorted(-sizes, -t, "left"))  # lanes longer than t
        if now < live:  # matches that go on to a lane's end
            some = np.flatnonzero(auto.accept[state[now:live]]) + now
            found.append((order[some], at[some] + sizes[some], auto.accept[state[some]]))
            live = now
        if live <= FEW:
            break
        s = state[:live]
        move = s * auto.n_classes + classes[at[:live] + t]
        new = auto.table[move]
        left = np.flatnonzero(auto.ends[move])
        if len(left):
            found.append((order[left], at[left] + t, auto.accept[s[left]] & ~auto.accept[new[left]]))
        s[:] = new
    if live:
        table, ends = auto.plain()
        accept, n = auto.accept.tolist(), auto.n_classes
        for k in range(live):
            a, b, out = int(at[k]), int(at[k] + sizes[k]), []
            s = int(state[k]) * n
            for i, c in enumerate(classes[a + t : b].tobytes(), a + t):
                move = s + c
                s, was = table[move], s
                if ends[move]:
                    out.append((i, accept[was // n] & ~accept[s // n]))
            if accept[s // n]:
                out.append((b, accept[s // n]))
            if out:
                x = np.array(out, np.int64)
                found.append((np.full(len(x), order[k]), x[:, 0], x[:, 1]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    lane, end, rules = map(np.concatenate, zip(*found, strict=True))
    order = np.lexsort((end, lane))
    return lane[order], end[order], rules[order]


def match_starts(auto: Automaton, buffer: np.ndarray, rule: int, least: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The leftmost start, not before ``least``, of the match of ``rule`` at each end: the reversed rule is read backwards,
    by all at once, until only few are left."""
    rows, ok = auto.back[rule]
    state, best = np.zeros(len(ends), np.int64), ends.copy()
    at, live = ends - 1, np.arange(len(ends))
    dead = np.flatnonzero((rows == np.arange(len(rows))[:, None]).all(1) & ~ok)
    while len(live) > FEW:
        live = live[at[live] >= least[live]]
        state[live] = rows[state[live], auto.byte_class[buffer[at[live]]]]
        hit = live[ok[state[live]]]
        best[hit] = at[hit]
        at[live] -= 1
        if len(dead):
            live = live[state[live] != dead[0]]
    table, good, stop = rows.tolist(), ok.tolist(), set(dead.tolist())
    for k in live.tolist():
        s, low, high = int(state[k]), int(least[k]), int(at[k]) + 1
        for a in range(high, low, -(1 << 16)):  # pieces, the last one first
            piece = auto.byte_class[buffer[max(low, a - (1 << 16)) : a]][::-1].tobytes()
            for i, c in enumerate(piece, 1):
                s = table[s][c]
                if good[s]:
                    best[k] = a - i
                elif s in stop:
                    break
            if s in stop:
                break
    return best


def matches(auto: Automaton, buffer: np.ndarray, offsets: np.ndarray, group_of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each rule the documents, starts and ends (places of ``buffer``) of its matches. group_of: the group of each rule."""
    starts = lanes_of(buffer, offsets, auto.resets)
    lane, end, rules = match_ends(auto, buffer, starts)
    owner = np.searchsorted(offsets, starts, "right") - 1
    out: list = [None] * len(group_of)
    for g in range(int(group_of.max()) + 1):
        mine = np.flatnonzero(group_of == g)
        some = np.flatnonzero(rules & sum(1 << int(r) for r in mine))
        before = np.where(np.append(True, lane[some[1:]] != lane[some[:-1]]) if len(some) else [], starts[lane[some]], np.append(0, end[some[:-1]]) if len(some) else [])
        for r in mine.tolist():
            k = np.flatnonzero(rules[some] >> r & 1)
            e = end[some[k]]
            out[r] = (owner[lane[some[k]]], match_starts(auto, buffer, r, before[k].astype(np.int64), e), e)
    return out
