"""A deterministic automaton over bytes for a set of regular expressions.

Expressions are parsed to position automata, joined into one, turned deterministic by subset
construction and minimised; the result is a transition array over byte classes, with the set of expressions that
each state accepts. Expressions may be reversed, to find where matches begin. Supported: literals,
\\xHH and escaped punctuation, classes, (...), (?:...), (?i:...) for ASCII letters, |, ?, *, +, {n}, {n,}, {n,m}.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Positions:
    """Position automaton under construction: the bytes of each position and what may follow it."""

    bytes_of: list[int] = field(default_factory=list)
    follow: list[int] = field(default_factory=list)

    def new(self, byte_set: int) -> int:
        self.bytes_of.append(byte_set)
        self.follow.append(0)
        return len(self.bytes_of) - 1


def _bits(x: int) -> list[int]:
    out = []
    while x:
        out.append((x & -x).bit_length() - 1)
        x &= x - 1
    return out


class _Parser:
    """Parses to trees: ("set", bytes), ("cat", parts), ("or", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def parse(self):
        tree = self.alternation(False)
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return tree

    def alternation(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence(fold))
        return parts[0] if len(parts) == 1 else ("or", parts)

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def sequence(self, fold: bool):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.quantified(self.atom(fold)))
        return ("cat", parts)

    def quantified(self, tree):
        while self.peek() in ("?", "*", "+", "{") and self.peek():
            c = self.p[self.i]
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            tree = ("rep", tree, least, most)
        return tree

    def atom(self, fold: bool):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            for opening, f in (("?i:", True), ("?:", fold), ("", fold)):
                if self.p.startswith(opening, self.i):
                    self.i += len(opening)
                    break
            tree = self.alternation(f)
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.char_class(fold))
        return ("set", self.folded(1 << self.char(), fold))

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} is not supported")
        return ord(c)

    def char_class(self, fold: bool) -> int:
        self.i += 1
        negated = self.peek() == "^"
        self.i += negated
        found = 0
        while self.peek() != "]":
            low = high = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                high = self.char()
            found |= (1 << (high + 1)) - (1 << low)
        self.i += 1
        found = self.folded(found, fold)
        return (1 << 256) - 1 - found if negated else found

    @staticmethod
    def folded(found: int, fold: bool) -> int:
        if fold:
            for b in _bits(found):
                if chr(b).isascii() and chr(b).isalpha():
                    found |= 1 << (b ^ 32)
        return found


def _build(tree, a: Positions) -> tuple[bool, int, int]:
    """(may be empty, first positions, last positions); fills in what follows what."""
    kind = tree[0]
    if kind == "set":
        p = 1 << a.new(tree[1])
        return False, p, p
    if kind == "or":
        made = [_build(t, a) for t in tree[1]]
        empty, first, last = False, 0, 0
        for e, f, x in made:
            empty, first, last = empty or e, first | f, last | x
        return empty, first, last
    if kind == "rep":
        _, part, least, most = tree
        parts = [part] * least + ([("star", part)] if most is None else [("opt", part)] * (most - least))
        return _build(("cat", parts), a)
    if kind in ("star", "opt"):
        _, first, last = _build(tree[1], a)
        if kind == "star":
            for p in _bits(last):
                a.follow[p] |= first
        return True, first, last
    empty, first, last = True, 0, 0
    for t in tree[1]:
        e, f, x = _build(t, a)
        for p in _bits(last):
            a.follow[p] |= f
        first |= f if empty else 0
        last = x | (last if e else 0)
        empty = empty and e
    return empty, first, last


def _reversed(tree):
    """The tree of the expression's strings read backwards."""
    if tree[0] == "set":
        return tree
    if tree[0] in ("cat", "or"):
        parts = [_reversed(t) for t in tree[1]]
        return (tree[0], parts[::-1] if tree[0] == "cat" else parts)
    return (tree[0], _reversed(tree[1]), *tree[2:])


@dataclass
class Automaton:
    """step[state + class_of[byte]] is the next state; states are multiples of ``classes``, 0 is the start.

    States from ``accepting`` on end a match; masks[state // classes] has the bits of the expressions that do.
    ``dead``: the state that nothing leads out of, -1 if there is none.
    """

    step: np.ndarray
    class_of: np.ndarray
    classes: int
    accepting: int
    masks: np.ndarray
    dead: int


def build(patterns: list[str], backwards: bool = False, anchored: bool = False) -> Automaton:
    """The minimal automaton that, after any bytes, accepts the patterns of which a match ends there.

    backwards: the patterns are reversed, for bytes read from the end; anchored: matches begin with the first byte only.
    """
    a, first, lasts = Positions(), 0, []
    for pattern in patterns:
        tree = _Parser(pattern).parse()
        empty, f, x = _build(_reversed(tree) if backwards else tree, a)
        if empty:
            raise ValueError(f"{pattern!r} matches nothing")
        first |= f
        lasts.append(x)
    signature = [sum(1 << p for p, s in enumerate(a.bytes_of) if s >> b & 1) for b in range(256)]
    kinds = list(dict.fromkeys(signature))
    class_of = np.array([kinds.index(s) for s in signature], np.int32)
    # The start is -1: unlike the empty set, it may go on if the automaton is anchored.
    number, todo, rows = {-1: 0}, [-1], []
    for state in todo:
        reach = first if state == -1 or not anchored else 0
        for p in _bits(max(state, 0)):
            reach |= a.follow[p]
        row = []
        for s in kinds:
            target = reach & s
            if target not in number:
                number[target] = len(todo)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    accepts = np.array([sum(1 << k for k, last in enumerate(lasts) if state > 0 and state & last) for state in todo])
    return _minimal(np.array(rows), accepts, class_of)


def _minimal(step: np.ndarray, accepts: np.ndarray, class_of: np.ndarray) -> Automaton:
    """Partition refinement, then renumbering: the start first, accepting states last."""
    block = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        _, refined = np.unique(np.c_[block, block[step]], axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == block.max():
            break
        block = refined
    _, one = np.unique(block, return_index=True)
    order = sorted(range(len(one)), key=lambda b: (accepts[one[b]] > 0, b != block[0]))
    renamed = np.empty(len(one), np.int64)
    renamed[order] = np.arange(len(one))
    table = renamed[block[step[one[order]]]]
    classes = table.shape[1]
    masks = accepts[one[order]]
    stays = np.flatnonzero((table == np.arange(len(table))[:, None]).all(1) & (masks == 0))
    return Automaton((table * classes).astype(np.int32).ravel(), class_of, classes, int((masks == 0).sum()) * classes, masks, int(stays[0]) * classes if len(stays) else -1)


def scan(automaton: Automaton, data: np.ndarray, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last byte, mask of the patterns) of all places of data (uint8) where matches end, in one pass.

    The bytes are cut into pieces that advance together, a byte each per step, from the state that the end of the piece
    before leads to; a piece whose predecessor turns out to end elsewhere is scanned again from there.
    """
    pieces = -(-len(data) // width)
    symbols = np.zeros(pieces * width, np.int32)
    np.take(automaton.class_of, data, out=symbols[: len(data)])
    symbols[len(data) :] = automaton.class_of[10]
    columns = symbols.reshape(pieces, width)
    places: list[list] = [[] for _ in range(3)]
    latest = np.zeros(pieces, np.int64)

    def run(which: np.ndarray, start: np.ndarray, turn: int) -> np.ndarray:
        latest[which] = turn
        state = start.copy()
        for j, symbol in enumerate(np.ascontiguousarray(columns[which].T)):
            state += symbol
            state = automaton.step[state]
            hit = np.flatnonzero(state >= automaton.accepting)
            if len(hit):
                for found, x in zip(places, (which[hit] * width + j, state[hit], np.full(len(hit), turn))):
                    found.append(x)
        return state

    start = np.zeros(pieces, np.int32)
    state = start[:-1].copy()
    for symbol in np.ascontiguousarray(columns[:-1, -min(64, width) :].T):
        state = automaton.step[state + symbol]
    start[1:] = state
    end = run(np.arange(pieces), start, 0)
    turn = 0
    while len(wrong := np.flatnonzero(end[:-1] != start[1:]) + 1):
        turn += 1
        start[wrong] = end[wrong - 1]
        end[wrong] = run(wrong, start[wrong], turn)
    if not places[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, state, by = (np.concatenate(x) for x in places)
    valid = (by == latest[at // width]) & (at < len(data))
    at, state = at[valid], state[valid]
    order = np.argsort(at, kind="stable")
    return at[order], automaton.masks[state[order] // automaton.classes]
