"""Regular expressions over bytes, compiled into one minimal deterministic automaton.

The syntax is that of the rules: literal characters, ``\\xHH`` and escaped characters,
classes, groups with alternatives, and the repeats ``?``, ``*``, ``+``, ``{n}`` and ``{n,}``. Matches are
the longest from their start.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np

Set = frozenset


class _Parser:
    """A pattern as nested tuples: ("set", bytes), ("seq", parts), ("or", parts), ("rep", part, least, many)."""

    def __init__(self, pattern: str, either_case: bool) -> None:
        self.text, self.at, self.either_case = pattern, 0, either_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def parse(self):
        tree = self.choice()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} in {self.text!r}")
        return tree

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeat())
        return ("seq", parts)

    def repeat(self):
        part = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "?":
                part = ("or", [part, ("seq", [])])
            elif sign in "*+":
                part = ("rep", part, int(sign == "+"))
            else:
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : end].partition(",")
                if most:
                    raise ValueError("a repeat has no upper bound here")
                self.at = end + 1
                part = ("rep", part, int(least)) if comma else ("seq", [part] * int(least))
        return part

    def atom(self):
        char = self.take()
        if char == "(":
            tree = self.choice()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return tree
        if char == "[":
            return ("set", self.members())
        return ("set", self.cases({self.code(char)}))

    def code(self, char: str) -> int:
        if char != "\\":
            return ord(char)
        char = self.take()
        if char != "x":
            return ord(char)
        self.at += 2
        return int(self.text[self.at - 2 : self.at], 16)

    def members(self) -> Set:
        found: set[int] = set()
        while self.peek() != "]":
            low = high = self.code(self.take())
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.code(self.take())
            found.update(range(low, high + 1))
        self.take()
        return self.cases(found)

    def cases(self, codes: set[int]) -> Set:
        if self.either_case:
            codes = codes | {ord(f(chr(c))) for c in codes if chr(c).isalpha() for f in (str.lower, str.upper)}
        if max(codes, default=0) > 127:
            raise ValueError("rules are in ASCII")
        return Set(codes)


def _reverse(tree):
    if tree[0] == "seq":
        return ("seq", [_reverse(part) for part in reversed(tree[1])])
    if tree[0] == "or":
        return ("or", [_reverse(part) for part in tree[1]])
    if tree[0] == "rep":
        return ("rep", _reverse(tree[1]), tree[2])
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []  # moves without a byte
        self.moves: list[list[tuple[Set, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, begin: int) -> int:
        """Lay ``tree`` out from ``begin`` and return where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[begin].append((tree[1], end))
            return end
        if kind == "seq":
            for part in tree[1]:
                begin = self.add(part, begin)
            return begin
        end = self.state()
        if kind == "or":
            for part in tree[1]:
                self.free[self.add(part, begin)].append(end)
            return end
        for _ in range(tree[2]):
            begin = self.add(tree[1], begin)
        loop = self.state()
        self.free[begin].append(loop)
        self.free[self.add(tree[1], loop)].append(loop)
        self.free[loop].append(end)
        return end

    def closure(self, states) -> Set:
        found, todo = set(states), list(states)
        while todo:
            for state in self.free[todo.pop()]:
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return Set(found)


@dataclass(frozen=True)
class Automaton:
    """``moves[state * n_classes + byte_class]`` is the next state; ``accepts`` has a bit per rule.

    Accepting states come last, from ``first_accepting`` on. State ``start`` begins.
    """

    classes: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray
    first_accepting: int
    start: int

    @property
    def n_classes(self) -> int:
        return int(self.classes.max()) + 1


def compile_rules(trees: list, anywhere: bool) -> Automaton:
    """One automaton for all rules, by subset construction and then minimisation."""
    nfa = _Nfa()
    begin = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        first = nfa.state()
        nfa.free[begin].append(first)
        ends[nfa.add(tree, first)] = 1 << rule
    # Bytes that all sets treat alike form a class.
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    of_class = [int(np.argmax(classes == k)) for k in range(len(kinds))]

    start = nfa.closure([begin])
    numbers = {start: 0}
    table: list[list[int]] = []
    for subset in (todo := [start]):
        row = []
        for byte in of_class:
            reached = {to for state in subset for members, to in nfa.moves[state] if byte in members}
            found = nfa.closure(reached) | (start if anywhere else Set())
            if found not in numbers:
                numbers[found] = len(numbers)
                todo.append(found)
            row.append(numbers[found])
        table.append(row)
    accepts = np.array([sum({ends[s] for s in subset if s in ends}) for subset in numbers], np.int64)
    return _minimal(np.array(table, np.int64), accepts, classes)


def _minimal(table: np.ndarray, accepts: np.ndarray, classes: np.ndarray) -> Automaton:
    """Merge states that no text tells apart: split blocks until their moves agree."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, member = np.unique(block, return_index=True)
    order = np.argsort(accepts[member], kind="stable")  # accepting blocks last
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    moves = number[block[table[member[order]]]]
    accepting = accepts[member[order]]
    return Automaton(
        classes.astype(np.uint8),
        moves.astype(np.uint16 if len(order) < 1 << 16 else np.uint32).reshape(-1),
        accepting,
        int(np.searchsorted(accepting, 1)),
        int(number[block[0]]),
    )


class RuleSet:
    """Rules scanned together, each found leftmost, longest and without overlaps of its own."""

    # Bytes that are scanned abreast, and those of one lane.
    LANE = 1 << 10

    def __init__(self, rules: dict[str, tuple[str, bool]]) -> None:
        """``rules``: a pattern by name, and whether letters count in either case."""
        self.names = list(rules)
        trees = [_Parser(pattern, either).parse() for pattern, either in rules.values()]
        # Read backwards, a rule ends where its matches begin.
        self.starts = compile_rules([_reverse(tree) for tree in trees], anywhere=True)
        self.single = [compile_rules([tree], anywhere=False) for tree in trees]

    def _scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where some rule matches and the rules' bits there, in one pass over the bytes.

        The pass runs from the last byte to the first, in lanes side by side. Lanes begin as if nothing
        stood behind them; where that was wrong, they are run again from the state their neighbour ended
        in, until all agree.
        """
        auto, n = self.starts, len(data)
        width, n_classes = self.LANE, auto.n_classes
        n_lanes = -(-n // width)
        # Lane 0 holds the last bytes. Bytes before the text are in no match, at its far end.
        padded = np.zeros(n_lanes * width, np.uint8)
        padded[:n] = auto.classes[data[::-1]]
        lanes = np.ascontiguousarray(padded.reshape(n_lanes, width).T)
        states = np.empty((width, n_lanes), auto.moves.dtype)
        entry = np.full(n_lanes, auto.start, np.int64)
        todo = np.arange(n_lanes)
        while len(todo):
            state = entry[todo]
            whole = len(todo) == n_lanes
            for step in range(width):
                row = lanes[step] if whole else lanes[step, todo]
                state = auto.moves[state * n_classes + row].astype(np.int64)
                if whole:
                    states[step] = state
                else:
                    states[step, todo] = state
            wanted = np.concatenate([[auto.start], states[-1, :-1]]).astype(np.int64)
            todo = np.flatnonzero(wanted != entry)
            entry = wanted
        step, lane = np.nonzero(states >= auto.first_accepting)
        at = n - 1 - (lane * width + step)
        inside = at >= 0
        at, found = at[inside], auto.accepts[states[step[inside], lane[inside]]]
        order = np.argsort(at)
        return at[order], found[order]

    def longest(self, rule: int, text: bytes, begin: int) -> int:
        """Where the longest match of a rule that begins at ``begin`` ends, or -1."""
        auto = self.single[rule]
        moves, classes, n_classes = self._lists(rule)
        state, end = auto.start, -1
        dead = self._dead(rule)
        for at in range(begin, len(text)):
            state = moves[state * n_classes + classes[text[at]]]
            if state >= auto.first_accepting:
                end = at + 1
            elif state == dead:
                break
        return end

    def _lists(self, rule: int):
        if not hasattr(self, "_kept"):
            self._kept = [
                (auto.moves.tolist(), auto.classes.tolist(), auto.n_classes) for auto in self.single
            ]
        return self._kept[rule]

    def _dead(self, rule: int) -> int:
        """The state that nothing leads out of, or -1."""
        auto = self.single[rule]
        rows = auto.moves.reshape(-1, auto.n_classes)
        if not hasattr(self, "_ends"):
            self._ends = {}
        if rule not in self._ends:
            stuck = [s for s in range(auto.first_accepting) if (rows[s] == s).all()]
            self._ends[rule] = stuck[0] if stuck else -1
        return self._ends[rule]

    def find(self, text: bytes) -> dict[str, list[tuple[int, int]]]:
        """Byte spans of every rule in one text."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[bytes]) -> list[dict[str, list[tuple[int, int]]]]:
        """Byte spans of every rule in each text; the texts are scanned together.

        A NUL byte, which no rule may contain, keeps matches within their text.
        """
        found: list[dict[str, list[tuple[int, int]]]] = [{} for _ in texts]
        joined = b"\0".join(texts)
        if not joined:
            return found
        at, bits = self._scan(np.frombuffer(joined, np.uint8))
        if not len(at):
            return found
        begins = np.cumsum([0, *(len(text) + 1 for text in texts[:-1])])
        owner = np.searchsorted(begins, at, side="right") - 1
        for rule, name in enumerate(self.names):
            mine = np.flatnonzero(bits & (1 << rule))
            starts, owners = at[mine], owner[mine]
            i = 0
            while i < len(mine):
                doc, first = int(owners[i]), int(starts[i] - begins[owners[i]])
                end = self.longest(rule, texts[doc], first)
                found[doc].setdefault(name, []).append((first, end))
                i = int(np.searchsorted(starts, begins[doc] + max(end, first + 1)))
        return found


def spans_in_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans, in order, as code points."""
    if text.isascii():
        return spans
    at, count, out = 0, 0, []
    for place in itertools.chain.from_iterable(spans):
        count += len(text[at:place].decode(errors="ignore")) if place >= at else 0
        at = place
        out.append(count)
    return list(zip(out[::2], out[1::2]))
