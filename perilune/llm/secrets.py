"""Operator 1: secret scans by one combined deterministic automaton.

All rules become one minimal automaton whose transition array is walked once over a text's bytes; the lines of a batch, which no match
spans, are walked side by side. A hit gives the rule and an end. Whether a match that ends there began behind the rule's last one, the rule's own automaton tells, which goes on from where
it stood at the hit before; then the mirrored automaton walks back to the leftmost start and another on to the longest end. Matches
of a rule are leftmost and don't overlap; those that fail the rule's check (a length, measured behind the rule's head by
an automaton too) are dropped after they were taken. No byte is walked more than a few times, so time follows a text's length
however long it is and however many hits fail.

Null and empty texts have no spans. Spans that begin together are in the order of the rules; those of different rules may
overlap. Repeated rows are scanned each on its own; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from perilune.llm.automaton import Dfa, any_case, compile_dfa, mirrored, parse
from perilune.llm.common import map_texts, replace_text, utf8


@dataclass(frozen=True)
class Rule:
    """A match is `insensitive` in either case, then `head`, then `pattern`. least: bytes that what matches `pattern` must have."""

    kind: str
    pattern: str
    least: int
    insensitive: str = ""
    head: str = ""


# The base kinds and their lengths.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=\-]+", 6, "(password|passwd|secret|token|api_?key)", r"""["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{8,}", 24),  # shorter runs fail either way; a small count keeps the automaton small
)
#: Further kinds: well-known token formats.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-.]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", 39),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]+", 24),
)
RULES = BASE + EXTRA


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        heads = [("cat", [*([any_case(parse(r.insensitive))] if r.insensitive else []), parse(r.head)]) for r in rules]
        nodes = [("cat", [h, parse(r.pattern)]) for h, r in zip(heads, rules, strict=True)]
        self.rules = rules
        self.combined: Dfa = compile_dfa(nodes, unanchored=True)
        self.own = [compile_dfa([n], unanchored=True) for n in nodes]
        self.forward = [compile_dfa([n], unanchored=False) for n in nodes]
        self.backward = [compile_dfa([mirrored(n)], unanchored=False) for n in nodes]
        self.head = [compile_dfa([h], unanchored=False) if r.head or r.insensitive else None for h, r in zip(heads, rules, strict=True)]

    def spans(self, data: bytes, hits: Iterable[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, sorted, after the rules' checks."""
        taken, found = [0] * len(self.rules), []
        at, state = [0] * len(self.rules), [d.start for d in self.own]  # where each rule's own automaton stands, begun at `taken`
        for end, hit in self.combined.hits(data) if hits is None else hits:
            for k in self.combined.tags[hit]:
                if end <= taken[k]:
                    continue
                state[k] = self.own[k].walk(data, at[k], end, state[k])
                at[k] = end
                if state[k] < self.own[k].accepting:  # the match began before the rule's last one ended
                    continue
                start = end - self.backward[k].longest(data[taken[k] : end][::-1])
                taken[k] = at[k] = stop = self.forward[k].longest(data, start)
                state[k] = self.own[k].start
                body = self.head[k].longest(data[start:stop]) if self.head[k] else 0
                if stop - start - body >= self.rules[k].least:
                    found.append((start, k, stop))
        return sorted(found)

    def text_spans(self, text: str | None) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points."""
        return self.batch_spans([text])[0]

    def batch_spans(self, texts: list) -> list[list[tuple[int, str, int]]]:
        """The same of many texts, walked together."""
        held = [utf8(t) for t in texts]
        return [self._in_points(d, self.spans(d, h)) for d, h in zip(held, self.combined.hits_of(held), strict=True)]

    def _in_points(self, data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
        if not found:
            return []
        if data.isascii():
            return [(s, self.rules[k].kind, e) for s, k, e in found]
        at, points, done = {}, 0, 0
        for x in sorted({p for s, _, e in found for p in (s, e)}):
            points += len(data[done:x].decode("utf-8", "replace"))
            at[x], done = points, x
        return [(at[s], self.rules[k].kind, at[e]) for s, k, e in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) in code points, by start, then as the rules are listed."""
    engine = scanner(rules)

    def run(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "spans": [[{"kind": k, "start": s, "end": e} for s, k, e in spans] for spans in engine.batch_spans(texts)]}

    return map_texts(df, _typed(run), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _typed(run: Callable) -> Callable:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def typed(ids: list, texts: list) -> dict:
        out = run(ids, texts)
        return {"doc_id": pa.array(out["doc_id"], pa.int64()), "spans": pa.array(out["spans"], kind)}

    return typed


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns; in `text`, each stretch that spans cover becomes [SECRET]. A null text stays null."""
    engine = scanner(rules)

    def clean(text: str | None, spans: list[tuple[int, str, int]]) -> str | None:
        if not spans:
            return text
        parts, done = [], 0
        for start, _, end in spans:
            if end <= done:
                continue
            if start >= done:
                parts += [text[done:start], "[SECRET]"]
            done = end
        return "".join([*parts, text[done:]])

    return replace_text(df, lambda texts: list(map(clean, texts, engine.batch_spans(texts))))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
