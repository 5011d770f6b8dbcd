"""Operator 13 against SQL and loops over terms."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from perilune.llm.divergence import Audit, audit_sources, columns_of, distinct_columns, divergence, probability, term_counts
from perilune.llm.op13_divergence import SQL, op13_divergence
from conftest import agree
from llm.helpers import documents, empty, lower


def brute(rows, audit):
    """From (text, lang, source)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        seen, of = Counter(), {}
        for at, source, terms in docs:
            if at == lang:
                seen.update(set(terms))
                of.setdefault(source, Counter()).update(terms)
        kept = sorted(t for t, n in seen.items() if n >= audit.least_docs)
        whole = Counter({t: sum(c[t] for c in of.values()) for t in kept})

        def p(c, kept=kept):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        f = lambda a, b: (a - b) * (a - b) // (a + b)
        q, ps = p(whole), {s: p(c) for s, c in of.items()}
        for s in of:
            pairs = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in of if o != s))
            terms = sorted((-f(ps[s][t], q[t]), t.encode()) for t in kept if of[s][t] and ps[s][t] > q[t])[: audit.top]
            out += [(lang, s, part, item.decode(), -value, k + 1) for part, ranked in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_query_against_sql(spark, duck):
    agree(spark, duck, op13_divergence, SQL)


@pytest.mark.parametrize(("tile", "salts"), [(256, 4), (2, 3), (1, 1), (3, 40)])
def test_tiles_and_salts_change_nothing(spark, tile, salts):
    words = "alpha beta gamma Delta épée über 漢字 x".split()
    rows = [(" ".join(words[(i * j + k) % 8] for k in range(i % 7 + 1)), ["en", "de", None][i % 3], f"s{i * i % 11}" if i % 13 else None) for i, j in ((i, i % 5 + 1) for i in range(120))]
    rows += [("", "fr", "a"), (None, "fr", "b"), ("only once", "fr", "b"), ("", "", ""), ("123 _ .", "en", "silent")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    audit = Audit(least_docs=3, tile=tile, salts=salts)
    got = sorted(map(tuple, audit_sources(docs, audit).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute(rows, audit)


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    for least in (1, 2):
        audit = Audit(least_docs=least)
        got = sorted(map(tuple, audit_sources(docs, audit).select("lang", "source", "part", "item", "value", "rank").collect()))
        assert got == brute(rows, audit)
    assert audit_sources(empty(spark)).count() == 0


def test_equal_columns_are_evaluated_once(spark):
    docs = spark.createDataFrame([("a b c d", "en", "x"), ("a b c", "en", "x"), ("d", "en", "y"), ("e e", "en", "y")], "text string, lang string, source string")
    terms, _, _ = columns_of(term_counts(docs), Audit(least_docs=1))
    assert sorted((r["id"], r["times"]) for r in distinct_columns(terms).collect()) == [("a", 3), ("d", 1), ("e", 1)]


def test_large_counts_do_not_overflow(spark):
    rows = [(0, 7), (10**15, 3 * 10**15), (9 * 10**14, 9 * 10**14 + 5)]
    got = spark.createDataFrame(rows, "c long, w long").select(probability(F.col("c"), F.col("w")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 2) // w for c, w in rows]
    f = spark.createDataFrame([(10**9, 1), (5, 5)], "p long, q long").select(divergence(F.col("p"), F.col("q")).alias("f")).collect()
    assert [r["f"] for r in f] == [(10**9 - 1) ** 2 // (10**9 + 1), 0]
