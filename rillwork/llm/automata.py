"""Regular expressions to minimal byte automata.

Syntax: literals, ``\\xHH`` and escaped bytes, ``[...]`` classes with ranges, ``(...)``, ``|``, ``?``, ``*``, ``+``,
``{m}``, ``{m,}``, ``{m,n}``. Bytes only, no captures, no look-around.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class _Parser:
    """Recursive descent to a tree of ('set', bytes) | ('cat', parts) | ('alt', parts) | ('rep', part, least, most)."""

    def __init__(self, pattern: str, ignore_case: bool = False):
        self.s, self.i, self.ignore_case = pattern, 0, ignore_case

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unbalanced ')' at {self.i} in {self.s!r}")
        return tree

    def alternatives(self):
        parts = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            if c == "{":
                end = self.s.index("}", self.i)
                least, comma, most = self.s[self.i + 1 : end].partition(",")
                bounds = (int(least or 0), (int(most) if most else None) if comma else int(least))
                self.i = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                self.i += 1
            part = ("rep", part, *bounds)
        return part

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            if ord(c) > 127:
                raise ValueError("patterns are ASCII; write other bytes as \\xHH")
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return _ESCAPES.get(c, ord(c))

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            tree = self.alternatives()
            if self.i >= len(self.s):
                raise ValueError(f"unclosed '(' in {self.s!r}")
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.cased(self.bracket()))
        return ("set", self.cased({self.byte()}))

    def bracket(self) -> set[int]:
        self.i += 1
        negate = self.s[self.i] == "^"
        self.i += negate
        found: set[int] = set()
        while self.s[self.i] != "]":
            low = self.byte()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found.update(range(low, self.byte() + 1))
            else:
                found.add(low)
        self.i += 1
        return set(range(256)) - found if negate else found

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.ignore_case:
            found = found | {b ^ 32 for b in found if 65 <= (b & ~32) <= 90}
        return frozenset(found)


class _Nfa:
    def __init__(self, backwards: bool = False):
        self.backwards = backwards
        self.free: list[list[int]] = []  # moves that read nothing
        self.reads: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.reads.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Builds ``tree`` from ``start``; returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.reads[start] = (tree[1], end)
            return end
        if kind == "cat":
            for part in reversed(tree[1]) if self.backwards else tree[1]:
                entry = self.state()
                self.free[start].append(entry)
                start = self.add(part, entry)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                entry = self.state()
                self.free[start].append(entry)
                self.free[self.add(part, entry)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            entry = self.state()
            self.free[start].append(entry)
            start = self.add(part, entry)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            entry = self.state()
            self.free[loop] += [entry, end]
            self.free[self.add(part, entry)].append(loop)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            entry = self.state()
            self.free[start].append(entry)
            start = self.add(part, entry)
            self.free[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``step[state * 256 + byte]`` is the next state; state 0 starts; bit i of ``accepts`` is pattern i.

    ``dead`` is the state that nothing leaves and nothing accepts, or -1.
    """

    step: np.ndarray
    accepts: np.ndarray
    dead: int

    @property
    def states(self) -> int:
        return len(self.accepts)

    def resets(self) -> np.ndarray:
        """For each byte, whether it leads to the start from every state: no match can cover it."""
        return (self.step.reshape(-1, 256) == 0).all(axis=0)

    def longest(self, data: bytes, start: int, end: int) -> int:
        """End of the longest match that begins at ``start``, or -1 (anchored automata)."""
        state, found, step, dead = 0, -1, self._step, self.dead
        good = self._good
        for i in range(start, end):
            state = step[state * 256 + data[i]]
            if state == dead:
                break
            if good[state]:
                found = i + 1
        return found

    def seen(self, data: bytes, state: int) -> int:
        """All patterns that accept somewhere in ``data``, read from ``state``."""
        step, accepts, found = self._step, self._accepts, 0
        for byte in data:
            state = step[state << 8 | byte]
            if accepts[state]:
                found |= accepts[state]
        return found

    def begins(self, data: bytes, start: int, end: int) -> list[int]:
        """Where matches within ``start`` to ``end`` begin, ascending (automata that read backwards and aren't anchored)."""
        state, step, good, found = 0, self._step, self._good, []
        for i in range(end - 1, start - 1, -1):
            state = step[state * 256 + data[i]]
            if good[state]:
                found.append(i)
        return found[::-1]

    def __post_init__(self):
        object.__setattr__(self, "_step", self.step.tolist())
        object.__setattr__(self, "_accepts", self.accepts.tolist())
        object.__setattr__(self, "_good", (self.accepts > 0).tolist())


def compile_patterns(patterns: list[tuple[str, bool]], anchored: bool, backwards: bool = False) -> Automaton:
    """One minimal automaton for all ``(pattern, ignore_case)``; unanchored: a match may begin at any byte. ``backwards``: it reads from the end."""
    nfa = _Nfa(backwards)
    root = nfa.state()
    final: dict[int, int] = {}
    for i, (pattern, ignore_case) in enumerate(patterns):
        entry = nfa.state()
        nfa.free[root].append(entry)
        end = nfa.add(_Parser(pattern, ignore_case).parse(), entry)
        final[end] = final.get(end, 0) | 1 << i

    closed: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closed:
            seen, todo = {state}, [state]
            while todo:
                for t in nfa.free[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            closed[state] = frozenset(s for s in seen if nfa.reads[s] or s in final)
        return closed[state]

    # bytes that no pattern tells apart share a class
    sets = list({r[0] for r in nfa.reads if r})
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {sig: k for k, sig in enumerate(dict.fromkeys(signature))}
    of_byte = np.array([kinds[sig] for sig in signature])
    sample = [signature.index(sig) for sig in kinds]

    first = closure(root)
    index, todo, rows, accepts = {first: 0}, [first], [], []
    while len(rows) < len(index):
        current = todo[len(rows)]
        row = []
        for b in sample:
            target: set[int] = set(first) if anchored is False else set()
            for s in current:
                if nfa.reads[s] and b in nfa.reads[s][0]:
                    target |= closure(nfa.reads[s][1])
            key = frozenset(target)
            if key not in index:
                index[key] = len(index)
                todo.append(key)
            row.append(index[key])
        rows.append(row)
        bits = 0
        for s in current:
            bits |= final.get(s, 0)
        accepts.append(bits)
    table, accept = np.array(rows), np.array(accepts, dtype=np.int64)

    # minimise: split groups of states until all of a group step into equal groups
    _, group = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    _, where = np.unique(group, return_index=True)
    number = np.empty(len(where), dtype=np.int64)
    number[group[np.sort(where)]] = np.arange(len(where))  # in order of first sight, so the start stays 0
    small, bits = np.empty((len(where), len(sample)), dtype=np.int32), np.empty(len(where), dtype=np.int64)
    small[number[group]], bits[number[group]] = number[group[table]], accept
    dead = [s for s in range(len(where)) if not bits[s] and (small[s] == s).all() and s]
    return Automaton(small[:, of_byte].astype(np.int32).ravel(), bits, dead[0] if dead else -1)
