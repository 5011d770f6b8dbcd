"""Operator 11 against whole-text encodings and loops over tokens."""

import hashlib
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from perilune.llm import alignment as A
from perilune.llm.op11_alignment import op11_alignment
from conftest import DATA
from llm.helpers import documents, empty

HOW = A.default_vocabularies()


def whole(text):
    """Both libraries on the whole text; none if the tokens don't spell it."""
    by = A.aligner(HOW.a, HOW.b)
    if not text:
        return [], []
    a, b = by.a.encode(f" {text}", add_special_tokens=False).ids, by.b.encode(text)
    raw = f" {text}".encode()
    return (a, b) if b"".join(by.a_bytes[i] for i in a) == raw == b"".join(by.b_bytes[i] for i in b) else ([], [])


def brute(rows):
    by = A.aligner(HOW.a, HOW.b)
    told, counts = [], Counter()
    for doc, text in rows:
        a, b = whole(text)
        ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
        ea, eb = ends(a, by.a_bytes), ends(b, by.b_bytes)
        groups, links = [], [(x, y) for x, i in zip(a, ea, strict=True) for y, j in (zip(b, eb, strict=True) if len(a) < 3000 else ()) if i == j]
        if len(a) >= 3000:
            at = dict(zip(eb, b, strict=True))
            links = [(x, at[i]) for x, i in zip(a, ea, strict=True) if i in at]
        last = 0
        for cut in sorted(set(ea) & set(eb)):
            side = lambda ids, at: ",".join(str(x) for x, i in zip(ids, at, strict=True) if last < i <= cut)  # noqa: B023, E731
            if len(a) < 3000:
                groups.append(f"{side(a, ea)}|{side(b, eb)}")
            last = cut
        counts.update(links)
        told.append((doc, len(a), len(b), len(set(ea) & set(eb)), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "" if not a else None))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(doc, n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha) for doc, n_a, n_b, n_g, links, sha in told]


def same(df, rows):
    got = sorted(map(tuple, df.collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert len(got) == len(want)
    want = [w if w[7] is not None else (*w[:7], g[7]) for g, w in zip(got, want, strict=True)]
    assert got == want


def test_units_encode_as_whole_texts_do():
    parts = "a|b|the|and| |  |\n|\t|\r\n|.|,|'s|é|漢|👍|\u2581|\x00|\xa0|\u3000|\x85|<s>|</s>|<unk>|<|endoftext||>|<0x41>|12|);| |ß|don|\ufeff|\x1c|" .split("|")
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["x" * 3000, " " * 900, "<|endoftext|> a"]
    for t, (a, b) in zip(texts, A.aligner(HOW.a, HOW.b).encode(texts), strict=True):
        assert (np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) == tuple(map(list, whole(t))), t


def test_tokens_without_bytes_link_with_all_that_end_there():
    g = A.cut_groups(np.array([2, 0, 3, 1]), np.array([1, 1, 4, 0, 0]))
    assert g.cuts.tolist() == [2, 6] and g.a.tolist() == [0, 0, 1, 1] and g.b.tolist() == [0, 0, 1, 1, 1]
    assert list(zip(g.a_links.tolist(), g.b_links.tolist(), strict=True)) == [(0, 1), (1, 1), (3, 2), (3, 3), (3, 4)]


def test_query_against_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    same(op11_alignment(spark, DATA), [tuple(r) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("capacity", [0, 40])
def test_odd_rows_and_pairs_that_are_joined(spark, capacity):
    docs = documents(spark)
    same(A.align(docs, replace(HOW, capacity=capacity)), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert A.align(empty(spark), replace(HOW, capacity=capacity)).count() == 0


def test_groups_and_the_map(spark):
    docs = documents(spark, [(1, "unaligned tokenizations", "en", "s", 0), (2, None, "en", "s", 0)])
    rows = A.token_groups(docs, HOW).collect()
    a, b = whole("unaligned tokenizations")
    assert sum((r["a"] for r in rows), []) == a and sum((r["b"] for r in rows), []) == b
    assert [r["start"] for r in rows[1:]] == [r["end"] for r in rows[:-1]] and rows[-1]["end"] == len(" unaligned tokenizations")
    by = A.aligner(HOW.a, HOW.b)
    for r in A.token_map(docs, HOW).collect():
        assert r["a_token"] == by.a_bytes[r["a_id"]].decode() and r["b_piece"] == by.b_bytes[r["b_id"]].decode()
        assert r["a_token"].endswith(r["b_piece"]) or r["b_piece"].endswith(r["a_token"])
