"""Finite-state machines over small integer alphabets: weighted acceptors, transducers, composition, and runs over many rows at once."""

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Machine:
    """A nondeterministic machine. arcs: state to (symbol or None, next state); ends: accepting state to its weights by label."""

    arcs: dict[int, list[tuple[int | None, int]]] = field(default_factory=lambda: defaultdict(list))
    ends: dict[int, dict[int, float]] = field(default_factory=dict)
    size: int = 1

    def new(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, pattern, weights: dict[int, float]) -> None:
        """Accept pattern with these weights. A pattern is a symbol, a list (in sequence), a set or frozenset (one of), or ("opt"|"star", pattern)."""
        self.ends[self._build(0, pattern)] = weights

    def _build(self, state: int, pattern) -> int:
        if isinstance(pattern, list):
            for p in pattern:
                state = self._build(state, p)
            return state
        end = self.new()
        if isinstance(pattern, tuple):
            kind, inner = pattern
            begin = self.new()
            self.arcs[state].append((None, begin))
            last = self._build(begin, inner)
            self.arcs[last].append((None, end))
            self.arcs[begin].append((None, end))
            if kind == "star":
                self.arcs[last].append((None, begin))
        elif isinstance(pattern, (set, frozenset)):
            for p in pattern:
                self.arcs[self._build(state, p)].append((None, end))
        else:
            self.arcs[state].append((pattern, end))
        return end

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for symbol, to in self.arcs[todo.pop()]:
                if symbol is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


@dataclass
class Sequential:
    """A deterministic transducer: next state and output symbol by state and input symbol."""

    next: np.ndarray
    out: np.ndarray


@dataclass
class Scorer:
    """A deterministic machine: next state by state and symbol, and the weights reached in each state by label."""

    next: np.ndarray
    weight: np.ndarray

    def best(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The greatest weight of each label at any place of each row of symbols."""
        states = run(self.next, symbols, starts)
        out = np.zeros((len(starts) - 1, self.weight.shape[1]))
        full = np.flatnonzero(np.diff(starts) > 0)
        if len(full):
            out[full] = np.maximum.reduceat(self.weight[states], starts[full], axis=0)
        return out


def searching(machine: Machine, symbols: int, labels: int) -> Scorer:
    """The deterministic machine that finds what machine accepts anywhere in a row."""
    begin = machine.closure(frozenset([0]))
    number, todo, rows = {begin: 0}, [begin], []
    while todo:
        state = todo.pop(0)
        reached = defaultdict(set)
        for s in state:
            for symbol, to in machine.arcs[s]:
                if symbol is not None:
                    reached[symbol].add(to)
        row = [0] * symbols
        for a in range(symbols):
            to = machine.closure(frozenset(reached[a]) | begin)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[a] = number[to]
        rows.append(row)
    weight = np.zeros((len(rows), labels))
    for state, i in number.items():
        for s in state:
            for label, w in machine.ends.get(s, {}).items():
                weight[i, label] = max(weight[i, label], w)
    return Scorer(np.array(rows, np.int32), weight)


def composed(first: Sequential, second: Scorer) -> Scorer:
    """One machine that reads what first reads and weighs what second makes of first's output."""
    number, todo, rows = {(0, 0): 0}, [(0, 0)], []
    while todo:
        a, b = todo.pop(0)
        row = []
        for to in zip(first.next[a].tolist(), second.next[b, first.out[a]].tolist(), strict=True):
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    return Scorer(np.array(rows, np.int32), second.weight[[b for _, b in number]])


def run(table: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The state after each symbol, all rows in step; each row begins in state 0."""
    out = np.zeros(len(symbols), table.dtype)
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    at, size = starts[:-1][order], size[order]
    state = np.zeros(len(order), table.dtype)
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    for t, n in enumerate(active.tolist()):
        here = at[:n] + t
        state = table[state[:n], symbols[here]]
        out[here] = state
    return out


class Lexicon:
    """Words to their class, found at every place of a text of symbols (Aho and Corasick)."""

    def __init__(self, words: dict[str, int]):
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        width = len(self.alphabet) + 1
        goto: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int]] = [(0, 0)]
        for word, kind in words.items():
            state = 0
            for c in word:
                a = self.alphabet[c]
                if a not in goto[state]:
                    goto.append({})
                    ends.append((0, 0))
                    goto[state][a] = len(goto) - 1
                state = goto[state][a]
            ends[state] = (len(word), kind)
        table, fail, shorter = np.zeros((len(goto), width), np.int32), [0] * len(goto), [0] * len(goto)
        todo = [0]
        for s in todo:
            table[s] = table[fail[s]] if s else 0
            for a, to in goto[s].items():
                fail[to] = int(table[fail[s], a]) if s else 0
                shorter[to] = fail[to] if ends[fail[to]][0] else shorter[fail[to]]
                table[s, a] = to
                todo.append(to)
        self.table, self.shorter = table, np.array(shorter, np.int32)
        self.length, self.kind = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
        self.symbol = np.zeros(0x110000, np.int32)
        for c, i in self.alphabet.items():
            self.symbol[ord(c)] = i

    def find(self, cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, class) of every word at every place."""
        state = run(self.table, self.symbol[cp], starts)
        found = []
        at = np.flatnonzero((self.length[state] > 0) | (self.shorter[state] > 0))
        state = state[at]
        while len(at):
            n = self.length[state]
            here = n > 0
            found.append((at[here] - n[here] + 1, at[here], self.kind[state[here]]))
            state = self.shorter[state]
            at, state = at[state > 0], state[state > 0]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
