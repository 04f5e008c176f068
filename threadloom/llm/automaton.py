"""Rules compiled into one deterministic byte automaton by subset construction and minimisation.

``search`` reads every text once for all rules: a state of the combined automaton says which rules have a match that
ends here, wherever it began. Texts are cut into chunks that advance side by side, one byte a step, each from the
state that a short run-up suggests; a chunk whose true entry state (the end of the chunk before) turns out different
is run again from it, until all agree, so the result is that of one pass from each text's start.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np

CHUNK, RUN_UP = 256, 32
_CATEGORY = {C.CATEGORY_DIGIT: b"0123456789", C.CATEGORY_SPACE: b" \t\n\r\x0b\x0c"}


class _Nfa:
    def __init__(self) -> None:
        self.step: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def node(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, items, ignore: bool, at: int, back: bool) -> int:
        """Append the items of a parsed rule after node ``at``, mirrored if ``back``; returns the last node."""
        for op, arg in reversed(items) if back else items:
            at = self.one(op, arg, ignore, at, back)
        return at

    def one(self, op, arg, ignore: bool, at: int, back: bool) -> int:
        if op in (C.LITERAL, C.IN):
            new = self.node()
            self.step[at].append((_bytes([(op, arg)] if op == C.LITERAL else arg, ignore), new))
            return new
        if op == C.SUBPATTERN:
            return self.add(arg[3], bool((ignore or arg[1] & re.I) and not arg[2] & re.I), at, back)
        if op == C.BRANCH:
            end = self.node()
            for way in arg[1]:
                self.free[self.add(way, ignore, at, back)].append(end)
            return end
        if op == C.MAX_REPEAT:
            low, high, body = arg
            for _ in range(low):
                at = self.add(body, ignore, at, back)
            if high == C.MAXREPEAT:
                loop = self.node()
                self.free[at].append(loop)
                self.free[self.add(body, ignore, loop, back)].append(loop)
                return loop
            end = self.node()
            for _ in range(high - low):
                self.free[at].append(end)
                at = self.add(body, ignore, at, back)
            self.free[at].append(end)
            return end
        raise ValueError(f"a rule may not use {op}")

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def _bytes(items, ignore: bool) -> frozenset:
    out, negate = set(), False
    for op, arg in items:
        if op == C.NEGATE:
            negate = True
        elif op == C.LITERAL:
            out.add(arg)
        elif op == C.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        elif op == C.CATEGORY:
            out.update(_CATEGORY[arg])
        else:
            raise ValueError(f"a rule may not use {op}")
    if ignore:
        out |= {ord(chr(b).swapcase()) for b in out if chr(b).isalpha() and b < 128}
    return frozenset(set(range(256)) - out if negate else out)


@dataclass
class Dfa:
    """classes: the class of each byte. table: next state by state * n_classes + class. accepts: a bit for each rule.
    State 0 is the start."""

    classes: np.ndarray
    table: np.ndarray
    accepts: np.ndarray
    n_classes: int


def compile_rules(rules: list[str], floating: bool, back: bool = False) -> Dfa:
    """floating: matches may begin anywhere. back: of the rules' mirror images."""
    nfa, first, last = _Nfa(), [], {}
    for k, rule in enumerate(rules):
        begin = nfa.node()
        first.append(begin)
        last[nfa.add(list(_parser.parse(rule)), False, begin, back)] = 1 << k
    sets = sorted({s for steps in nfa.step for s, _ in steps}, key=sorted)
    signs = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {sign: i for i, sign in enumerate(dict.fromkeys(signs))}
    classes = np.array([kinds[s] for s in signs], dtype=np.uint8)
    sample = [signs.index(s) for s in kinds]
    start = nfa.closure(first)
    names, table, todo = {start: 0}, [], [start]
    for state in todo:
        row = []
        for byte in sample:
            to = {n for at in state for s, n in nfa.step[at] if byte in s}
            to = nfa.closure(to | set(first) if floating else to)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        table.append(row)
    moves = np.array(table)
    accepts = np.array([sum(bit for n, bit in last.items() if n in state) for state in todo], dtype=np.int64)
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:  # states that no text tells apart become one
        key = np.column_stack([group, group[moves]])
        new = np.unique(key, axis=0, return_inverse=True)[1].ravel()
        if new.max() == group.max():
            break
        group = new
    order = np.full(group.max() + 1, -1)
    order[group[0]] = 0
    order[order < 0] = np.arange(1, len(order))
    group = order[group]
    keep = np.zeros(group.max() + 1, dtype=int)
    keep[group] = np.arange(len(group))
    return Dfa(classes, group[moves[keep]].astype(np.int32).ravel(), accepts[keep], len(kinds))


def _run(dfa: Dfa, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, hits: list | None) -> np.ndarray:
    """Advance chunks sorted by falling size; hits gets (chunk, byte after the match's end, state) of accepting steps."""
    state = state.copy()
    live = len(size)
    for j in range(int(size[0]) if len(size) else 0):
        while size[live - 1] <= j:
            live -= 1
        now = dfa.table.take(state[:live] * dfa.n_classes + codes.take(begin[:live] + j))
        state[:live] = now
        if hits is not None:
            found = np.flatnonzero(dfa.accepts.take(now))
            if len(found):
                hits.append((found, begin[found] + j + 1, now[found]))
    return state


def search(dfa: Dfa, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, byte after the end, and rule bits of every place where some match ends, in order. begin has an end."""
    length = np.diff(begin)
    chunks = -(-length // CHUNK)
    text = np.repeat(np.arange(len(length)), chunks)
    if not len(text):
        return (np.zeros(0, np.int64),) * 3
    nth = np.arange(len(text)) - (np.cumsum(chunks) - chunks)[text]
    at = begin[:-1][text] + nth * CHUNK
    size = np.minimum(begin[1:][text] - at, CHUNK)
    codes = dfa.classes[data].astype(np.int32)
    later = nth > 0
    state = np.zeros(len(text), dtype=np.int32)
    state[later] = _run(dfa, codes, at[later] - RUN_UP, np.full(later.sum(), RUN_UP), state[later], None)
    end, parts, todo = np.zeros(len(text), dtype=np.int32), [], np.arange(len(text))
    while len(todo):
        order = todo[np.argsort(-size[todo], kind="stable")]
        hits: list = []
        end[order] = _run(dfa, codes, at[order], size[order], state[order], hits)
        parts = [(c[keep], e[keep], s[keep]) for c, e, s in parts for keep in (~np.isin(c, todo),)]
        parts += [(order[c], e, s) for c, e, s in hits]
        true = np.where(later, np.roll(end, 1), 0)
        todo = np.flatnonzero(later & (true != state))
        state[todo] = true[todo]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    chunk, stop, s = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(stop, kind="stable")
    return text[chunk[order]], stop[order], dfa.accepts[s[order]]


def longest(dfa: Dfa, data: bytes, at: int, end: int, step: int) -> int:
    """From ``at`` towards ``end``, where the longest match of an anchored automaton ends; -1: none."""
    state, best, table, classes, n, accepts = 0, -1, dfa.table, dfa.classes, dfa.n_classes, dfa.accepts
    dead = None
    while at != end:
        byte = data[at] if step > 0 else data[at - 1]
        state = int(table[state * n + int(classes[byte])])
        at += step
        if accepts[state]:
            best = at
        if dead is None:
            loops = table.reshape(-1, n)
            dead = {i for i in np.flatnonzero((loops == np.arange(len(loops))[:, None]).all(axis=1)).tolist() if not accepts[i]}
        if state in dead:
            break
    return best
