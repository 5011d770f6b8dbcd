"""Operators 3, 4, 5, 6, 8, 10 and the pipeline: what they do with whole tables."""

import collections
import gzip
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from conftest import agree
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm.helpers import WORD, documents, empty, lower, odd_documents

from pyspark.sql import functions as F

from perilune.llm import chat, jaccard_join, mixing, packing, queries, topk, warc
from perilune.llm.components import components
from perilune.llm.op5_packing import packed_digest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    agree(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


# 3: WARC


def test_magic_inside_payloads_is_rejected(spark):
    fake = "x WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20
    long = "WARC/1.0\r\n" + "y" * 300_000
    rows = [(1, "u", fake), (2, "u", fake), (3, "bad \r\nurl", long), (4, None, None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (2, "u", fake), (None, "u", fake)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as n")
    got = sorted(((r.page_id if r.page_id is not None else -1), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.intact) for r in warc.round_trip(pages).collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(-1, "revisit", 1, len(fake), digest(fake), True)]
    for i, _, t in rows[:-1]:
        again = t == fake and i != 1
        want.append((i, "revisit" if again else "response", 1 if again else None, len((t or "").encode()), digest(t), True))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=9), st.data())
def test_pointer_jumping_follows_the_chain(gaps, data):
    at = np.cumsum(gaps) + np.arange(len(gaps)) - gaps[0]
    after = np.array([data.draw(st.sampled_from([*(int(x) for x in at[i + 1 :]), 10_000, -1])) for i in range(len(at))], dtype=np.int64)
    seen, x = set(), 0
    while x in at.tolist() and x not in seen:
        seen.add(x)
        x = int(after[at.tolist().index(x)])
    assert set(at[warc.reachable(at, after)].tolist()) == seen


def test_long_urls_are_read(spark):
    pages = spark.createDataFrame([(1, "data:" + "u" * 100_000, "a" * 200), (2, "http://x", "b"), (3, "data:" + "v" * 70_000, "a" * 200)], "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.record_type, r.intact) for r in warc.round_trip(pages).collect())
    assert got == [(1, "response", True), (2, "response", True), (3, "revisit", True)]


def one_record(page=1, block=b"hi", more=b""):
    return b"WARC/1.1\r\nWARC-Type: response\r\n%bWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (more, page, len(block), block)


def test_broken_chains_are_errors(spark, tmp_path):
    one = one_record()
    for k, data in enumerate((one * 2, b"")):
        (tmp_path / f"good{k}.warc").write_bytes(data)
    assert warc.read_warc(spark, f"file://{tmp_path}").count() == 2
    for k, data in enumerate((one + one[:-5], one + one[:-4], one + b"x", b"x" + one, one + one.replace(b"Length: 2", b"Length: 9"), b"x")):
        (tmp_path / f"bad{k}").mkdir()
        (tmp_path / f"bad{k}" / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match="bytes do"):
            warc.read_warc(spark, f"file://{tmp_path}/bad{k}").count()


def test_compressed_members_are_read(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one_record(1)) + gzip.compress(one_record(2)))
    assert sorted(r.page_id for r in warc.read_warc(spark, f"file://{tmp_path}").collect()) == [1, 2]


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_files_are_cut_by_bytes(spark, tmp_path, size):
    """Records that span many splits, splits that hold none, and payloads full of breaks and magic: as a walk over the whole file."""
    g = random.Random(size)
    parts = [b"\r\n\r\n", b"\r", b"\n", b"\r\n", b"WARC/1.1\r\n", b"WARC/1.0\r\nContent-Length: 40\r\n\r\n", b"x" * 50, b"\xff\xfe", one_record(99, b"inner")]
    want = []
    for f in range(3):
        data = b""
        for page in range(30):
            block = b"".join(g.choice(parts) for _ in range(g.choice([0, 1, 5, 40, 200])))
            want.append((len(data), page, len(block), hashlib.sha256(block).hexdigest()))
            data += one_record(page, block, g.choice([b"", b"", b"WARC-Target-URI: http://WARC/1.1\r\nX: WARC/1.0\r\n"]))
        (tmp_path / f"{f}.warc").write_bytes(data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "8")
        got = warc.read_warc(spark, f"file://{tmp_path}")
        assert sorted((r.start, r.page_id, r.payload_bytes, r.payload_digest) for r in got.collect()) == sorted(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=9), st.data())
def test_exits_follow_the_chain(gaps, data):
    at = np.cumsum(gaps) + np.arange(len(gaps))
    after = np.array([data.draw(st.sampled_from([*(int(x) for x in at[i + 1 :]), 500, 700, int(at[i]) + 1])) for i in range(len(at))], dtype=np.int64)
    follow = dict(zip(at.tolist(), after.tolist(), strict=True))
    for i, got in enumerate(warc.exits(at, after, 500).tolist()):
        x = int(at[i])
        while x in follow:
            x = follow[x]
        assert got == (x if x >= 500 else -1)


# 4: chats


def test_control_strings_round_trip(spark):
    texts = ["<|turn|>", "\\", "<\\|", "<\\\\|", "</s>", "[INST] ok [/INST]", "<s>\\\\", "é<|end|>\n<|text|>", "", "<<|", "\\<|", "[\\INST]", "<\\/s>", None]
    df = spark.createDataFrame([(1, k, v, v, "x") for k, v in enumerate(texts)], "conv_id long, turn long, role string, text string, formatted string")
    row = chat.read_chats(chat.format_chats(chat.canonical_turns(df))).first()
    assert [t.text for t in row.turns] == [t or "" for t in texts] and [t.role for t in row.turns] == [t or "" for t in texts]
    inner = row.formatted.removeprefix("<s>").removesuffix("</s>")
    assert "</s>" not in inner and "[INST]" not in inner and inner.count("<|turn|>") == len(texts)


def test_turn_order_ties_and_nulls(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "first"), (1, 2, "assistant", "b"), (1, 600, "user", "z"), (1, 2, "user", "c"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert got[1] == [("user", "first", False), ("assistant", "b", True), ("user", "c", False), ("user", "c", False), ("user", "z", False)]
    assert got[None] == [("", "", False)]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    objects = [{"conv_id": 1, "prompt": "a", "response": "b"}, {"conv_id": 2, "messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]}, {"conv_id": 3, "instruction": "i", "input": "z", "output": "o"}, {"conv_id": 4, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, {"conv_id": 5, "foo": 1}]
    df = spark.createDataFrame([(json.dumps(x),) for x in objects] + [("not json",), (None,)], "json string")
    want = [(1, "user", "a"), (1, "assistant", "b"), (2, "user", "x"), (2, "assistant", "y"), (3, "user", "i\n\nz"), (3, "assistant", "o"), (4, "user", "q"), (4, "assistant", "r")]
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns_json(df).collect()) == [(c, k % 2, r, t) for k, (c, r, t) in enumerate(want)]
    assert sorted(map(str, (r.json for r in chat.misfits(df).collect()))) == ["None", "not json", '{"conv_id": 5, "foo": 1}']
    extra = [{"conv_id": 1, "id": "x", "prompt": "a", "response": "b", "source": {"k": [1]}}, {"conv_id": 2, "messages": [{"role": "user", "content": "x", "name": "n"}, {"role": "assistant", "content": None}], "prompt": None}, {"conv_id": 3, "messages": []}, {"conv_id": 4, "messages": [{"foo": 1}]}]
    more = spark.createDataFrame([(json.dumps(x), "kept") for x in extra], "json string, layout string")
    assert sorted((r.conv_id, r.turn, r.role, str(r.text)) for r in chat.canonical_turns_json(more).collect()) == [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "x"), (2, 1, "assistant", "None")]
    assert [(json.loads(r.json)["conv_id"], r.layout) for r in chat.misfits(more).collect()] == [(4, "kept")]
    typed = spark.createDataFrame([(3, "i", "o", 9)], "conv_id long, instruction string, output string, other int")
    assert [(r.role, r.text) for r in chat.canonical_turns(typed).collect()] == [("user", "i"), ("assistant", "o")]
    both = spark.createDataFrame([(3, 0, "user", "t", "p", "r", "i")], "conv_id long, turn long, role string, text string, prompt string, response string, instruction string")
    assert [(r.role, r.text) for r in chat.canonical_turns(both).collect()] == [("user", "t")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(typed.drop("output"))


# 5: packing


@settings(max_examples=80, deadline=None)
@given(st.sampled_from([10, 64, 4096]), st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_place_every_piece_once_without_gaps(size, counts):
    counts = {min(n, size): m for n, m in counts.items()}
    plan, used = packing.plan_best_fit(counts, size), {}
    for n, m in counts.items():
        for s, o in zip(*plan.place(np.full(m, n), np.arange(m)), strict=True):
            used.setdefault(int(s), []).append((int(o), n))
    assert sorted(used) == list(range(plan.sequences))
    for parts in used.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) <= size
    room = []  # best-fit decreasing, one piece at a time
    for n in sorted((n for n, m in counts.items() for _ in range(m)), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(size - n)
    assert plan.sequences == len(room)


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, rnd = Tokenizer.from_file(path), random.Random(3)
    parts = ["a", "B", "é", "ß", "ẞ", "İ", "ſ", "ŉ", "Σ", "1", "²", "ª", "_", "-", "'s", "’", "<|endoftext|>", "<|", " ", "\n", "\u0085", "\x1c", " ", "é", "漢字", "👍", "\x00", "\xad", "don't", "I'LL", "...", "ﬁ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    for t, ids in zip(texts, packing.encoder(path).encode(texts), strict=True):
        assert whole.encode(t, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_packing_of_odd_rows(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packed_digest(documents(spark)).toPandas()
    want = collections.Counter()
    for i, t, *_ in odd_documents():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[str(i), k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert want == collections.Counter((str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 4096
    assert packed_digest(empty(spark)).count() == 0
    packed = packing.pack(packing.tokenize(documents(spark), packing.default_tokenizer()))
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == 4 * rows.length.sum()


# 6: Jaccard join


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, copies, words, edits):
    g = random.Random(seed)
    base = [f"w{g.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        x = base[:]
        for _ in range(g.randrange(edits + 1)):
            x[g.randrange(words)] = f"n{g.randrange(10**9)}"
        out.append(" ".join(x))
    return out


def test_components_equal_brute_force(spark):
    g = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [t for s in range(12) for t in near_copies(s, 4, g.choice([4, 6, 12, 40, 200]), 3)]
    texts += [passage + " " + " ".join(f"q{g.randrange(10**9)}" for _ in range(g.choice([8, 14, 16, 90]))) for _ in range(40)]
    texts += near_copies(99, 70, 120, 4)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[0]), (1001, texts[0].upper()), (1002, None), (1003, "")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_large_keys_compared_in_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_LARGE_KEY", 3)
    monkeypatch.setattr(jaccard_join, "_BLOCK_DOCS", 5)
    monkeypatch.setattr(jaccard_join, "_MOST_STARS", 1)
    monkeypatch.setattr(jaccard_join, "_STRETCH_ROWS", 4)
    rows = list(enumerate(near_copies(7, 60, 100, 5) + near_copies(8, 20, 100, 5)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_pairs_of_a_hot_document_are_dealt(spark):
    hot, warm = 5000, 5001
    found = [(i, hot) for i in range(3000)] + [(i, warm) for i in range(700)] + [(hot, warm)] + [(6000 + i, 7000 + i) for i in range(50)]
    pairs = spark.createDataFrame(found, "lo long, hi long")
    rows, copies = jaccard_join.oriented(pairs)
    got = rows.collect()
    assert sorted((min(r.leaf, r.hub), max(r.leaf, r.hub)) for r in got) == sorted(found)
    assert {(r.leaf, r.hub) for r in got if {r.leaf, r.hub} == {hot, warm}} == {(warm, hot)}
    sizes = collections.Counter((r.hub, r.hub_s) for r in got if r.hub_s is not None)
    assert {h for h, _ in sizes} == {hot, warm} and max(sizes.values()) < 2 * jaccard_join._STRETCH_ROWS
    assert {r.doc: r.k for r in copies.collect()} == {hot: 12, warm: 3}
    texts = spark.range(8000).selectExpr("id as doc_id", "concat('t', id) as text")
    met = jaccard_join.with_sides(rows, copies, texts, ["text"]).collect()
    assert sorted((min(r.leaf, r.hub), max(r.leaf, r.hub)) for r in met) == sorted(found)
    assert all(r.text == f"t{r.leaf}" and r.text_hub == f"t{r.hub}" for r in met)
    calm, none = jaccard_join.oriented(pairs.where("hi >= 7000"))
    assert none is None and jaccard_join.with_sides(calm, none, texts, ["text"]).count() == 50


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6))
def test_similar_sets_share_a_key_and_pass_the_sketch(seed):
    g = random.Random(seed)
    n, share = g.choice([2, 3, 5, 8, 16, 20, 25, 40, 60, 130, 300]), g.choice([0, 0.3, 0.9, 1])
    a = [g.getrandbits(64) for _ in range(n)]
    b = a[g.randint(0, n // 5) :] + [g.getrandbits(64) for _ in range(g.randint(0, n // 9 + 1))]
    frequent = {t: g.random() < share for t in a + b}
    both = len(set(a) & set(b))
    if set(a) == set(b) or 100 * both < 80 * len(set(a) | set(b)):
        return
    x, y = (np.array(sorted(set(s)), dtype=np.uint64) for s in (a, b))
    keys = [set(jaccard_join.index_keys(s, np.array([frequent[int(t)] for t in s]))[0].tolist()) for s in (x, y)]
    assert keys[0] & keys[1]
    assert jaccard_join.may_link(len(x), len(y), jaccard_join.sketch(x), jaccard_join.sketch(y))


def test_long_words_built_to_collide_differ():
    from perilune.llm.shingles import word_hashes

    turns = "".join("ab"[bin(i).count("1") % 2] for i in range(4096)).encode()
    other = turns.translate(bytes.maketrans(b"ab", b"ba"))
    h = word_hashes(turns + b" " + other + b" " + turns.upper() + b" " + turns)[0]
    assert h[0] != h[1] and h[0] == h[2] == h[3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 28) - 1), max_size=40), st.integers(1, 3))
def test_counts_survive_their_coding(values, times):
    got = jaccard_join.decode_counts(jaccard_join.encode_counts(np.array(values * times, dtype=np.int64)))
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == collections.Counter(values * times)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_connected_components(spark, edges):
    got = {r.doc: r.comp for r in components(spark.createDataFrame(edges, "lo long, hi long")).collect()}
    parent = {x: x for e in edges for x in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_join_of_odd_rows(spark):
    rows = jaccard_join.jaccard_components(documents(spark)).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(odd_documents()) and got[8] == 7 and got[1] == 1 and got[2] == 2 and got[None] is None
    kept = jaccard_join.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "10", "2", "3", "4", "5", "6", "7", "9", "None"])
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


# 8: mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), set()
    while True:
        rest, free = total - sum(2 * sizes[s] for s in capped), [s for s in names if s not in capped]
        out = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 2 * sizes[s]}
        if not over:
            return out
        capped |= over


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "é", "Z", None, "c"]), st.integers(0, 500), min_size=1))
def test_targets_equal_brute_force(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    for s, t in brute_targets(sizes).items():
        assert got[s] == pytest.approx(t, abs=1e-6)


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = sorted((r.doc_id, r["size"], r.source, r.target, tuple(map(tuple, r.copies))) for r in mixing.mix_sources(docs).collect())
    again = sorted((r.doc_id, r["size"], r.source, r.target, tuple(map(tuple, r.copies))) for r in mixing.mix_sources(docs.repartition(5)).collect())
    assert first == again
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for _, n, source, goal, copies in first:
        assert len(copies) <= 2
        taken[source] += n * len(copies)
        target[source], largest[source] = goal, max(n, largest[source])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)


def taken_and_targets(rows):
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        taken[r.source] += r["size"] * len(r.copies)
        target[r.source], largest[r.source] = r.target, max(r["size"], largest[r.source])
        assert len(r.copies) <= 2
    return taken, target, largest


@pytest.mark.parametrize("ids", ["distinct", "shared", "null", "one"])
def test_ids_that_repeat_across_sources_meet_their_targets(spark, ids):
    """Skipped rows are told by source, block and size, not by their id alone."""
    g = random.Random(4)
    name = {"distinct": lambda s, i: 1000 * ord(s) + i, "shared": lambda s, i: i, "null": lambda s, i: None, "one": lambda s, i: 7}[ids]
    rows = [(name(s, i), s, "w " * (5 if ids == "one" else g.randint(1, 12))) for s in "abc" for i in range(300)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, target, largest = taken_and_targets(got)
    assert len(got) == 900 and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)


def test_quotas_are_split_exactly_and_fairly(spark):
    df = spark.createDataFrame([(0, 300), (1, 20), (2, 0)], "k int, quota long")
    rows = mixing.split_quotas(df, mixing.Mix(depth=4)).collect()
    total = collections.Counter()
    shard = collections.Counter()
    for r in rows:
        total[r.k] += r.quota
        shard[r.shard] += r.quota
    assert total == {0: 300, 1: 20, 2: 0} and set(shard.values()) == {20} and len(shard) == 16
    assert max(r.quota for r in rows if r.k == 1) <= 8


def test_hypergeometric_quantiles(spark):
    from math import comb

    from pyspark.sql import functions as F

    big, marked, drawn = 30, 12, 9
    us = [k / 50 + 0.01 for k in range(50)]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    lit = lambda x: F.lit(x).cast("long")
    got = [r.x for r in df.select("u", mixing.hypergeometric(lit(big), lit(marked), lit(drawn), F.col("u")).alias("x")).orderBy("u").collect()]
    cdf = np.cumsum([comb(marked, x) * comb(big - marked, drawn - x) / comb(big, drawn) for x in range(drawn + 1)])
    assert got == [int(np.searchsorted(cdf, u)) for u in us]


def test_sources_fill_their_targets(spark):
    """Past long documents: each source is within a tenth of its target or half of its shortest document; on the table, and with one huge document that never fits."""
    tables = [spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text")]
    rows = [(i, f"s{i % 4}", "w " * n) for i, n in enumerate([9000, 100, 150, 50] + [300 + 7 * i % 90 for i in range(40)])]
    tables.append(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    for docs in tables:
        of = {}
        for r in mixing.mix_sources(docs).collect():
            of.setdefault(r.source, []).append((r["size"], r["size"] * len(r.copies), r.target))
        for held in of.values():
            taken, target, shortest = sum(t for _, t, _ in held), held[0][2], min(n for n, _, _ in held if n)
            assert abs(taken - target) <= max(target / 10, shortest / 2), (taken, target, sorted(n for n, _, _ in held))


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 4)), min_size=1, max_size=12), st.integers(0, 90))
@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
def test_gaps_are_filled_as_a_loop_does(spark, groups, gap):
    rows = [(k, {"size": n}, many) for k, (n, many) in enumerate(groups)]
    df = spark.createDataFrame([(rows, float(gap) + 0.25)], "next array<struct<r:int,place:struct<size:bigint>,many:bigint>>, gap double")
    got = [(t["place"]["size"], t["many"], t["some"]) for t in df.select(mixing._filled(F.col("next"), F.col("gap")).alias("x")).first().x]
    left, some, short = gap, [], None
    for k, (n, many) in enumerate(groups):
        some.append(min(many, left // n) if n else many)
        left -= some[-1] * n
        if some[-1] < many and (short is None or n < groups[short][0]):
            short = k
    if short is not None and 2 * left > groups[short][0]:
        some[short] += 1
    assert got == [(n, many, x) for (n, many), x in zip(groups, some, strict=True) if x]


def test_columns_of_any_name_and_type_stay(spark):
    docs = documents(spark).select("*", F.lit(7).alias("_r"), F.lit(8).alias("_end"), F.lit(9).alias("a.b"), F.create_map(F.lit("x"), F.lit(1)).alias("m"), F.lit(3).alias("row"), F.lit(4).alias("place"))
    docs = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys(docs.columns) if c not in ("row",)))
    for out in (jaccard_join.keep_one(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        assert {(r["_r"], r["_end"], r["a.b"], r["m"]["x"], r["place"]) for r in out.collect()} == {(7, 8, 9, 1, 4)}
    assert {"a.b", "_end", "m"} <= set(mixing.mix_sources(docs).columns)


def test_mixing_of_odd_rows(spark):
    rows = mixing.mix_sources(documents(spark)).collect()
    assert len(rows) == len(odd_documents()) and all(len(r.copies) <= 2 for r in rows)
    mixed = mixing.mixed_rows(mixing.mix_sources(documents(spark)))
    assert mixed.count() == sum(len(r.copies) for r in rows) and {"text", "lang", "source"} <= set(mixed.columns)
    assert mixing.mix_sources(empty(spark)).count() == 0


# 10: top-k


def brute_topk(rows, k):
    ok = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: min(v for j, v in ok if j == i) for i, _ in ok if i % 20 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_topk_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "_SLICE", 32)
    g = np.random.default_rng(seed)
    centres = g.normal(size=(4, 64))
    rows = [(i, (centres[i % 4] + 0.1 * g.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(30)] + [(20, rows[3][1]), (41, None), (42, [None] * 64), (60, [float("nan")] * 64), (61, [float("inf")] + [0.0] * 63), (None, rows[0][1]), (400, [1.0, 2.0]), (401, []), (402, [1e12] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = sorted(tuple(r) for r in topk.nearest(topk.whole_vectors(df), "vec_id % 20 = 0", 20, block=16).collect())
    assert got == brute_topk(rows, 20)


def test_the_driver_holds_one_block_of_queries(spark, monkeypatch):
    """However many queries there are, no more than a block of them is gathered at once."""
    kind, gathered = type(spark.range(0)), []
    real = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: gathered.append(t := real(self)) or t)
    df = spark.range(400).selectExpr("id as vec_id", "array(cast(id % 7 as double), cast(id % 3 as double)) as v")
    got = topk.nearest(df, "vec_id % 2 = 0", 3, block=40).collect()
    assert len(got) == 600 and len(gathered) == 10 and max(t.num_rows for t in gathered) <= 40 and sum(t.num_rows for t in gathered) == 200


def test_bounds_hold_and_prune():
    g = np.random.default_rng(2)
    centres = 30 * g.normal(size=(8, 64)).round()
    c = np.floor(centres[np.arange(4000) % 8] + 3 * g.normal(size=(4000, 64)))
    for s in topk.LEVELS:
        assert (topk.segment_statistics(c[:50], s) @ topk.segment_statistics(c, s).T >= c[:50] @ c.T - 1e-6).all()
    search = topk.Search(np.arange(20), c[:20], 5)
    search.add(np.arange(4000), c)
    assert search.computed < 0.7 * 20 * 4000


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.nearest(topk.whole_vectors(df), "vec_id % 20 = 0").count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.nearest(topk.whole_vectors(few), "vec_id % 20 = 0").collect()] == [(0, 1, 1, 4096)]


# The pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = p.staged(p.quality(spark, docs, d))
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns and all(i in ids for i, q in labels.items() if q == 1) and not any(i in ids for i, q in labels.items() if q == 0)
    one = p.staged(p.near_duplicates(spark, good, d))
    groups = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id for r in one.select("doc_id").collect()} == groups
    clean = p.staged(p.redact(spark, one, d))
    assert clean.count() == one.count() and clean.where("text like '%[SECRET]%'").count() > 0
    mixed = p.staged(p.mix(spark, clean, d))
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    packed = p.pack(spark, mixed, d).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and set(packed.doc_id) == {r.doc_id for r in mixed.select("doc_id").collect()}


def brute_pipeline_stages(rows, good):
    """What the first three stages keep of (doc_id, text) rows: documents called good, one of each group, without secrets."""
    from perilune.llm.secrets import scanner

    kept = [(i, t) for i, t in rows if (i, t) in good]
    least = {d: c for d, _, c in brute_components([r for r in kept if r[0] is not None])}
    out = {(i, t) for i, t in kept if i is None or least[i] == i}

    def clean(text):
        spans, parts, done = scanner().text_spans(text), [], 0
        for begin, _, end in spans:
            if begin >= done:
                parts += [text[done:begin], "[SECRET]"]
            done = max(done, end)
        return text if not spans else "".join([*parts, text[done:]])

    return {(i, clean(t)) for i, t in out}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, empty, very long and repeated rows, clashing columns, an empty table: each stage by itself, then run()."""
    import corpus_pipeline as p

    good = [(100 + i, " ".join(f"word{(i * 7 + k) % 400}" for k in range(80)) + (" token=abcdef123" if i % 3 == 0 else "") + ".", "en", f"s{i % 2}", None) for i in range(60)]
    junk = [(300 + i, "$$$ ### %% 12 || " * 30, "en", "s0", None) for i in range(60)]
    rows = odd_documents() + good + junk + good[:2]
    d = str(tmp_path)
    documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in junk] + [(None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = p.staged(p.quality(spark, docs, d))
    pairs = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert kept.columns == docs.columns and {i for i, *_ in good} <= {i for i, _ in pairs} and not {i for i, *_ in junk} & {i for i, _ in pairs}
    clean = p.staged(p.redact(spark, p.staged(p.near_duplicates(spark, kept, d)), d))
    found = [(r.doc_id, r.text) for r in clean.collect()]
    assert clean.dtypes == docs.dtypes and len(found) == len(set(found)) and set(found) == brute_pipeline_stages([(i, t) for i, t, *_ in rows], set(pairs))
    mixed = p.staged(p.mix(spark, clean, d))
    assert mixed.dtypes == docs.dtypes and {(r.doc_id, r.text) for r in mixed.collect()} <= set(found)
    packed = p.pack(spark, mixed, d).toPandas()
    assert len(packed[packed.piece == 0]) == mixed.count() and packed.groupby("sequence_id").length.sum().max() <= 4096
    again = p.run(spark, d).toPandas()
    digest = lambda t: sorted(zip(t.doc_id.fillna(-1), t.piece, t.length, t.ids_crc32, strict=True))
    assert digest(again) == digest(packed)
    none = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").write.parquet(f"{none}/labels.parquet")
    assert p.run(spark, none).count() == 0
