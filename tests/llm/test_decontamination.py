"""Suffix arrays against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest

from genoloom.llm import suffixes as sx

LOW = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def split(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOW))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = {}
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (owners := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= owners
                    hit |= set(range(k, k + n))
        out[i] = (len(w), hit, sorted(found))
    return out


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def items_of(corpus):
    texts = [t for _, t in corpus if t and len(t.split()) >= 12]
    rng = random.Random(3)
    cut = lambda t, n: " ".join(t.split()[rng.randrange(3) :][:n])
    return [(1, cut(texts[0], 14)), (2, texts[1].upper()), (3, "A-b"), (4, "zz"), (5, None), (6, "..."), (7, cut(texts[0], 11)), (7, cut(texts[2], 12)), (30, cut(texts[3], 10)), (31, "no such words at all"), (200, cut(texts[5], 30))]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_plain_search(spark, docs, corpus, block_bytes):
    items = items_of(corpus)
    got = {r.doc_id: r for r in sx.contamination(docs, bench(spark, items), block_bytes=block_bytes).collect()}
    want = brute(corpus, items)
    assert sum(bool(x[1]) for x in want.values()) > 5
    for i, (n, hit, found) in want.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.items) == (n, len(hit), found)
        assert {k for a, b in zip(r.starts, r.ends, strict=True) for k in range(a, b)} == hit
    kept = {r.doc_id for r in sx.decontaminate(docs, bench(spark, items), block_bytes=block_bytes).collect()}
    assert kept == {i for i, x in want.items() if not x[1]}


def test_matches_are_the_longest(spark, corpus):
    text = "start " + " ".join(f"m{k}" for k in range(30)) + " end"
    item = "other " + " ".join(f"m{k}" for k in range(5, 27)) + " stop"
    docs = spark.createDataFrame([(1, text), (2, "m5 m6")], "doc_id long, text string")
    got = {r.doc_id: r.matches for r in sx.contamination(docs, bench(spark, [(9, item)])).collect()}
    assert [tuple(m) for m in got[1]] == [(9, 6, 1, 22)] and got[2] == []


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    seq = np.append(rng.integers(0, 3, 300), np.zeros(60, np.int64))
    at = np.flatnonzero(seq[:300] > 0)
    got = sx.suffix_array(seq, at, 20, 2)
    assert sorted(got) == sorted(at)
    keys = [tuple(seq[a : a + 20]) for a in got]
    assert keys == sorted(keys)


def test_odd_tables(spark, odd_docs, no_docs):
    items = bench(spark, [(1, "a b c d e f"), (None, "other words")])
    rows = sx.contamination(odd_docs, items).collect()
    assert len(rows) == 8 and sum(r.n_hit > 0 for r in rows) == 5
    assert [(r.items, [m.item_id for m in r.matches]) for r in rows if r.doc_id == 2] == [([], [None])]  # an item without an id
    assert sx.contamination(no_docs, items).count() == 0
    none = sx.contamination(odd_docs, bench(spark, [])).collect()
    assert all(r.n_hit == 0 for r in none) and sorted(r.n_words for r in none) == [0, 0, 0, 4, 6, 6, 6, 6]
    kept = sx.decontaminate(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == 3
    assert sx.decontaminate(no_docs, items).count() == 0 and sx.decontaminate(odd_docs, bench(spark, [])).count() == 8


def test_state_between_many_blocks(spark, docs, corpus, monkeypatch):
    """As many blocks as items, written to the shared folder after every second one."""
    monkeypatch.setattr(sx, "CHAINED", 2)
    items = bench(spark, [(k, corpus[3 * k][1]) for k in range(6)])
    many = {r.doc_id: (r.n_hit, r.items) for r in sx.contamination(docs, items, block_bytes=40).collect()}
    one = {r.doc_id: (r.n_hit, r.items) for r in sx.contamination(docs, items).collect()}
    assert many == one and {r.doc_id for r in sx.decontaminate(docs, items, block_bytes=40).collect()} == {i for i, x in one.items() if not x[0]}


def test_query_digest(spark):
    from genoloom.llm.queries import op1_suffix_decontamination

    rows = op1_suffix_decontamination(spark, "/root/testdata/sf0.001").collect()
    clean = hashlib.sha256(b"").hexdigest()
    assert all((r.items_sha256 == clean) == (r.n_items == 0) and r.contaminated == (r.n_hit > 0) for r in rows)
