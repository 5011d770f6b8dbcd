"""Byte automata: a small regular-expression parser, subset construction, minimisation, transition arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Lines of more bytes are walked alone.
_LONG_LINE = 2048

# A parsed expression is ("set", frozenset of bytes), ("cat", parts), ("alt", parts) or ("rep", part, least, most or None).


def parse(pattern: str):
    """Literals, escapes (\\xHH, \\. ...), classes, groups, |, ?, *, +, {m}, {m,}, {m,n}; ASCII only."""
    pos = 0

    def char() -> int:
        nonlocal pos
        c = pattern[pos]
        pos += 1
        if c == "\\":
            c = pattern[pos]
            pos += 1
            if c == "x":
                pos += 2
                return int(pattern[pos - 2 : pos], 16)
        return ord(c)

    def charset() -> frozenset:
        nonlocal pos
        negated = pattern[pos] == "^"
        pos += negated
        members: set[int] = set()
        while pattern[pos] != "]":
            low = high = char()
            if pattern[pos] == "-" and pattern[pos + 1] != "]":
                pos += 1
                high = char()
            members.update(range(low, high + 1))
        pos += 1
        return frozenset(range(256)) - members if negated else frozenset(members)

    def atom():
        nonlocal pos
        if pattern[pos] == "(":
            pos += 1
            inner = alternatives()
            pos += 1
            return inner
        if pattern[pos] == "[":
            pos += 1
            return ("set", charset())
        return ("set", frozenset((char(),)))

    def sequence():
        nonlocal pos
        parts = []
        while pos < len(pattern) and pattern[pos] not in "|)":
            part = atom()
            if pos < len(pattern) and pattern[pos] in "?*+{":
                mark = pattern[pos]
                pos += 1
                if mark == "{":
                    end = pattern.index("}", pos)
                    low, _, high = pattern[pos:end].partition(",")
                    bounds = (int(low), int(high) if high else (None if "," in pattern[pos:end] else int(low)))
                    pos = end + 1
                else:
                    bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
                part = ("rep", part, *bounds)
            parts.append(part)
        return ("cat", parts)

    def alternatives():
        nonlocal pos
        options = [sequence()]
        while pos < len(pattern) and pattern[pos] == "|":
            pos += 1
            options.append(sequence())
        return ("alt", options) if len(options) > 1 else options[0]

    return alternatives()


def any_case(node):
    """The same expression with ASCII letters in either case."""
    kind = node[0]
    if kind == "set":
        return (kind, frozenset(x for b in node[1] for x in ((b, b ^ 32) if chr(b).isalpha() and b < 128 else (b,))))
    if kind == "rep":
        return (kind, any_case(node[1]), *node[2:])
    return (kind, [any_case(x) for x in node[1]])


def mirrored(node):
    """The expression of the reversed language."""
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return (kind, mirrored(node[1]), *node[2:])
    parts = [mirrored(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds node's states after start; returns its end."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                inner = self.state()
                self.empty[start].append(inner)
                self.empty[self.build(part, inner)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.build(part, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass
class Dfa:
    """classes: byte -> column. table: state * width + column -> state * width. States from `accepting` on accept; tags by state."""

    classes: bytes
    width: int
    table: np.ndarray
    start: int
    accepting: int
    tags: list[tuple[int, ...]]
    dead: int
    _flat: list | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_flat": None}

    @property
    def flat(self) -> list[int]:
        if self._flat is None:
            self._flat = self.table.tolist()
        return self._flat

    def hits(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(end, accepting state number) of every position where some rule ends; one pass, nothing is held."""
        table, state, accepting, width = self.flat, self.start, self.accepting, self.width
        for i, c in enumerate(data.translate(self.classes), 1):
            state = table[state + c]
            if state >= accepting:
                yield i, state // width

    def hits_of(self, texts: list[bytes]) -> Iterator[Iterable[tuple[int, int]]]:
        """The same for many texts, one after the other. Where a line's end leads from every state back to the start, all lines are walked side by side, a byte of each in one step; texts with a very long line are walked alone."""
        table = np.asarray(self.table)
        together = [t if max(map(len, t.split(b"\n"))) <= _LONG_LINE else None for t in texts]
        if (table[self.classes[10] :: self.width] != self.start).any() or len(texts) - together.count(None) < 2:
            yield from map(self.hits, texts)
            return
        data = b"\n".join(t or b"" for t in together) + b"\n"
        ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        starts = np.append(0, ends[:-1] + 1)
        lengths = ends - starts
        lines = np.argsort(-lengths, kind="stable")
        place, state = starts[lines], np.full(len(lines), self.start, dtype=np.int64)
        columns = np.frombuffer(data.translate(self.classes), dtype=np.uint8)
        left = len(lines) - np.cumsum(np.bincount(lengths, minlength=1))  # lines of more than t bytes
        at, states = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for t in range(int(lengths.max(initial=0))):
            n = left[t]
            now = table[state[:n] + columns[place[:n] + t]]
            state[:n] = now
            hit = np.flatnonzero(now >= self.accepting)
            if len(hit):
                at.append(place[hit] + t + 1)
                states.append(now[hit])
        at, states = np.concatenate(at), np.concatenate(states)
        order = np.argsort(at, kind="stable")
        at, states = at[order], states[order] // self.width
        begins = np.cumsum([0, *(len(t or b"") + 1 for t in together)])
        cuts = np.searchsorted(at, begins, side="right").tolist()  # an end lies behind its text's begin
        for k, begin in enumerate(begins[:-1].tolist()):
            if together[k] is None:
                yield self.hits(texts[k])
            else:
                i, j = cuts[k], cuts[k + 1]
                yield zip((at[i:j] - begin).tolist(), states[i:j].tolist(), strict=True)

    def walk(self, data: bytes, begin: int, end: int, state: int) -> int:
        """The state after the bytes from begin to end."""
        table = self.flat
        for c in data[begin:end].translate(self.classes):
            state = table[state + c]
        return state

    def longest(self, data: bytes, begin: int = 0) -> int:
        """End of the longest match that starts at begin, or -1."""
        table, state, classes, best = self.flat, self.start, self.classes, -1
        for i in range(begin, len(data)):
            state = table[state + classes[data[i]]]
            if state >= self.accepting:
                best = i + 1
            elif state == self.dead:
                break
        return best


def compile_dfa(nodes: list, unanchored: bool) -> Dfa:
    """One minimal automaton for all expressions; tag k is nodes[k]. Unanchored: a match can begin anywhere."""
    nfa = _Nfa()
    root = nfa.state()
    ends = {}
    for tag, node in enumerate(nodes):
        begin = nfa.state()
        nfa.empty[root].append(begin)
        ends[nfa.build(node, begin)] = tag
    sets = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
    by_signature: dict[tuple, int] = {}
    classes = bytes(by_signature.setdefault(tuple(b in s for s in sets), len(by_signature)) for b in range(256))
    width = len(by_signature)
    sample = [classes.index(k) for k in range(width)]
    # Sets of states are rows of bits; a state's moves, its targets' closures by class.
    n = len(nfa.empty)
    reach = np.zeros((n, n), dtype=bool)
    for k in range(n):
        reach[k, list(nfa.closure([k]))] = True
    step = np.zeros((n, width, n), dtype=bool)
    for k, moves_of in enumerate(nfa.moves):
        for allowed, target in moves_of:
            step[k, [c for c, byte in enumerate(sample) if byte in allowed]] |= reach[target]
    step, again = np.packbits(step, axis=2), np.packbits(reach[root]) if unanchored else np.zeros(-(-n // 8), dtype=np.uint8)
    first = np.packbits(reach[root])
    number, order, rows, subsets = {first.tobytes(): 0}, [first], [], []
    for bits in order:
        subsets.append(np.flatnonzero(np.unpackbits(bits)))
        targets = np.bitwise_or.reduce(step[subsets[-1]], axis=0, initial=0) | again
        row = []
        for target in targets:
            key = target.tobytes()
            if key not in number:
                number[key] = len(order)
                order.append(target)
            row.append(number[key])
        rows.append(row)
    tags = [tuple(sorted({ends[s] for s in subset.tolist() if s in ends})) for subset in subsets]
    moves = np.array(rows)
    # Minimisation: refine the partition by tags until no two states of a block lead to different blocks.
    kinds = {t: k for k, t in enumerate(sorted(set(tags)))}
    block, count = np.array([kinds[t] for t in tags]), len(kinds)
    while True:
        whole = np.ascontiguousarray(np.column_stack([block, block[moves]]).astype(np.int32))
        _, refined = np.unique(whole.view(f"V{whole.itemsize * whole.shape[1]}").ravel(), return_inverse=True)
        if refined.max() + 1 == count:
            break
        block, count = refined, refined.max() + 1
    chosen = [int(np.flatnonzero(refined == k)[0]) for k in range(count)]
    ranked = sorted(range(count), key=lambda k: (bool(tags[chosen[k]]), k))
    renumber = np.empty(count, dtype=np.int64)
    renumber[ranked] = np.arange(count)
    table = np.array([renumber[refined[moves[chosen[k]]]] for k in ranked])
    out_tags = [tags[chosen[k]] for k in ranked]
    loops = [k for k in range(count) if not out_tags[k] and (table[k] == k).all()]
    return Dfa(classes, width, (table * width).ravel().astype(np.int32), int(renumber[refined[0]]) * width, sum(not t for t in out_tags) * width, out_tags, loops[0] * width if loops else -1)
