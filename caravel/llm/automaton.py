"""Regular expressions over bytes compiled to one minimised transition array.

The supported syntax: literals, ``\\`` escapes (``\\xHH`` too), classes with ranges
and ``^``, groups ``(...)``, ``(?:...)`` and ``(?i:...)`` (ASCII letters in either
case), ``|`` and the quantifiers ``? * + {n} {n,} {n,m}``. Text is bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

ALL = frozenset(range(256))


class _Parser:
    """Recursive descent to nested tuples: set, cat, alt, rep."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.alternation(False)
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def peek(self, text: str) -> bool:
        return self.p.startswith(text, self.i)

    def alternation(self, fold: bool):
        options = [self.sequence(fold)]
        while self.peek("|"):
            self.i += 1
            options.append(self.sequence(fold))
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self, fold: bool):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.quantified(self.atom(fold)))
        return ("cat", parts)

    def quantified(self, node):
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), int(high) if high else (None if comma else int(low)))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def atom(self, fold: bool):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            if self.peek("?"):
                end = self.p.index(":", self.i)
                fold = fold or "i" in self.p[self.i : end]
                self.i = end + 1
            node = self.alternation(fold)
            if not self.peek(")"):
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self.cased(self.bracket(), fold))
        if c == ".":
            self.i += 1
            return ("set", ALL - {10})
        return ("set", self.cased(frozenset({self.byte()}), fold))

    def byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"unsupported escape \\{c}")
        if ord(c) > 127:
            raise ValueError("write bytes above 127 as \\xHH")
        return ord(c)

    def bracket(self) -> frozenset:
        self.i += 1
        negated = self.peek("^")
        self.i += negated
        found: set[int] = set()
        while not self.peek("]"):
            low = self.byte()
            if self.peek("-") and self.p[self.i + 1] != "]":
                self.i += 1
                found.update(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.i += 1
        return ALL - found if negated else frozenset(found)

    @staticmethod
    def cased(chars: frozenset, fold: bool) -> frozenset:
        if not fold:
            return chars
        letters = {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return chars | letters


def _reversed(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    if kind == "rep":
        return ("rep", _reversed(node[1]), node[2], node[3])
    return node


class _Nfa:
    """Thompson construction: moves on byte sets, and empty moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, at: int) -> int:
        """Adds ``node`` after state ``at``; returns the state behind it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1]:
                at = self.add(x, at)
            return at
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(x, start)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, at)
        if high is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.empty[at].append(end)
            at = self.add(inner, at)
        self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``table[256 * state + byte]`` is 256 times the next state.

    States from ``accepting`` (already times 256) on accept; ``tags`` holds the
    bit mask of the rules for those, by state. ``dead`` is the state, times 256,
    that nothing leaves, or -1.
    """

    table: list[int]
    start: int
    accepting: int
    tags: dict[int, int]
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) // 256


def _minimise(rows: list[list[int]], masks: list[int]) -> tuple[list[list[int]], list[int], int]:
    """Partition refinement: states stay together while their masks and moves agree."""
    block = list(masks)
    names: dict = {}
    block = [names.setdefault(m, len(names)) for m in block]
    count = len(names)
    while True:
        names = {}
        new = [names.setdefault((block[s], *[block[t] for t in row]), len(names)) for s, row in enumerate(rows)]
        block = new
        if len(names) == count:
            break
        count = len(names)
    kept: dict[int, int] = {}
    for s, b in enumerate(block):
        kept.setdefault(b, s)
    # accepting states last, so that one comparison tells them
    order = sorted(kept, key=lambda b: (masks[kept[b]] != 0, b))
    place = {b: n for n, b in enumerate(order)}
    out = [[place[block[t]] for t in rows[kept[b]]] for b in order]
    return out, [masks[kept[b]] for b in order], place[block[0]]


def compile_rules(patterns: list[str], *, backwards: bool = False, anywhere: bool = False) -> Dfa:
    """One automaton for all patterns: subset construction, then minimisation.

    backwards: it reads the reversed text. anywhere: a match may start at any byte.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends: dict[int, int] = {}
    for n, pattern in enumerate(patterns):
        tree = _Parser(pattern).parse()
        first = nfa.state()
        nfa.empty[start].append(first)
        end = nfa.add(_reversed(tree) if backwards else tree, first)
        ends[end] = ends.get(end, 0) | 1 << n

    # bytes that every move treats alike form a class
    sets = {s for moves in nfa.moves for s, _ in moves}
    classes: dict[tuple, int] = {}
    of_byte = [classes.setdefault(tuple(b in s for s in sets), len(classes)) for b in range(256)]
    example = {c: b for b, c in enumerate(of_byte)}

    base = nfa.closure([start])
    ids, todo, rows = {base: 0}, [base], []
    while todo:
        new_todo = []
        for states in todo:
            row = []
            for c in range(len(classes)):
                b = example[c]
                to = {t for s in states for chars, t in nfa.moves[s] if b in chars}
                target = nfa.closure(to) | base if anywhere else nfa.closure(to)
                if target not in ids:
                    ids[target] = len(ids)
                    new_todo.append(target)
                row.append(ids[target])
            rows.append(row)
        todo = new_todo
    masks = [0] * len(ids)
    for states, n in ids.items():
        for e, bit in ends.items():
            if e in states:
                masks[n] |= bit
    rows, masks, first = _minimise(rows, masks)
    # states as shared numbers, so that the array holds no number twice
    number = [256 * s for s in range(len(rows))]
    table = [number[row[of_byte[b]]] for row in rows for b in range(256)]
    plain = sum(m == 0 for m in masks)
    dead = next((256 * s for s, row in enumerate(rows) if not masks[s] and all(t == s for t in row)), -1)
    return Dfa(table, 256 * first, 256 * plain, {256 * s: m for s, m in enumerate(masks) if m}, dead)
