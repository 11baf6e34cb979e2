"""Repeated spans and similar documents against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from genoloom.llm import debruijn as db
from genoloom.llm import jaccard as jc
from genoloom.llm.debruijn import remove_repeats
from genoloom.llm.store import materialize

from .conftest import frame


def brute_repeats(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "kmer"), [(13, 5), (4, 2)])
def test_repeats(spark, docs, corpus, window, kmer):
    got = sorted((tuple(r) for r in remove_repeats(docs.repartition(3), window, kmer).collect()), key=str)
    assert got == brute_repeats(corpus, window)
    assert sum(r[2] > 0 for r in got) > 10


def test_repeats_of_odd_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in remove_repeats(odd_docs, 5, 2).collect()), key=str)
    assert got == brute_repeats(rows, 5)
    assert remove_repeats(no_docs).count() == 0


def test_spans_are_compacted_and_have_coordinates(spark, monkeypatch):
    """A long passage is one span with its places in both texts; a changed word parts it; the words are verified."""
    a, b, c = ([f"{x}{k}" for k in range(100)] for x in "abc")
    second = b[:10] + a[20:80] + b[10:20]
    third = c[:5] + a[20:50] + ["other"] + a[51:80] + c[5:10] + b[30:40] + a[:13]
    rows = [(1, " ".join(a)), (2, " ".join(second)), (3, "\n".join(third))]
    seen = []

    def kept(pending, window, own=db.repeated_spans):
        got = own(pending, window)
        row = {r.row: r.doc_id for r in pending.select("row", "doc_id").collect()}
        seen.extend(sorted((row[r.row], r["first"], r.n, row[r.source_row], r.source_first) for r in got.collect()))
        return got

    monkeypatch.setattr(db, "repeated_spans", kept)
    got = sorted(tuple(r) for r in remove_repeats(frame(spark, rows).repartition(2)).collect())
    assert got == brute_repeats(rows, 13)
    assert {(2, 10, 60, 1, 20), (3, 5, 30, 1, 20), (3, 80, 13, 1, 0)} <= set(seen) and len(seen) <= 6
    texts = {i: t.split() for i, t in rows}
    for doc, first, n, source, source_first in seen:
        assert source < doc and texts[doc][first : first + n] == texts[source][source_first : source_first + n]
    assert {k for d, f, n, *_ in seen if d == 3 for k in range(f, f + n)} == {*range(5, 35), *range(36, 65), *range(80, 93)}
    monkeypatch.setattr(db, "_words_at", lambda pending, wanted, own=db._words_at: own(pending, wanted).withColumn("words", F.lit(b"no such words")))
    refused = {r.doc_id: r.n_removed for r in remove_repeats(frame(spark, rows)).collect()}
    assert refused[2] == 0 and refused[3] < 30 + 29 + 13  # only spans of two windows and less, which are not verified by words, still go


LOW = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOW).split()
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute_groups(rows, size, percent):
    sets = sets_of(rows, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for x in sets[i]:
            for j in lists[x]:
                common[j] += 1
            lists[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent", "per_member"), [(3, 90, 16), (2, 70, 2)])
def test_groups(spark, docs, corpus, monkeypatch, size, percent, per_member):
    monkeypatch.setattr(jc, "PER_MEMBER", per_member)
    monkeypatch.setattr(jc, "PER_DELTA", per_member)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jc.similar_groups(docs.repartition(3), size, percent).collect()}
    assert got == brute_groups(corpus, size, percent)


def test_light_and_heavy_sets_meet(spark, monkeypatch):
    """Sets around the boundary, each a few elements from the next."""
    rows = [(k, " ".join(f"w{j}" for j in range(k % 7, 8 + k))) for k in range(30)]
    for light in (0, 12, 19):
        monkeypatch.setattr(jc, "boundary", lambda sizes, percent, light=light: light)
        for percent in (90,):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jc.similar_groups(frame(spark, rows), 1, percent).collect()}
            assert got == brute_groups(rows, 1, percent), (light, percent)


def test_large_groups_make_few_candidates(spark, monkeypatch):
    """Near copies of one text with a few words changed, others of unlike sizes that share a passage, and what is compared of them."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        w = base[:]
        for _ in range(rng.choice((1, 1, 2, 2, 3, 4))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join(base[:20] + [f"y{k}.{j}" for j in range(rng.randrange(1, 60))])) for k in range(400, 480)]
    compared, filtered = [], jc._may_overlap

    def counted(pairs, *more):
        compared.append(pairs.count())
        return filtered(pairs, *more)

    monkeypatch.setattr(jc, "_may_overlap", counted)
    for size, percent in ((3, 90),):
        compared.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jc.similar_groups(frame(spark, rows).repartition(5), size, percent).collect()}
        assert got == brute_groups(rows, size, percent)
        assert sum(compared) < 30 * len(rows), compared


def test_entries_carry_few_earlier_elements(spark, monkeypatch):
    """Long texts that share passages: an entry does not grow with its text, and no link is lost, however few elements it carries."""
    rng = random.Random(9)
    passages = [[f"p{k}.{j}" for j in range(30)] for k in range(10)]
    rows = []
    for k in range(20):
        w = [f"y{k}.{j}" for j in range(12)] + [x for p in rng.sample(passages, 5) for x in p]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join([*w[:80], "other", *w[81:]])), (3 * k + 2, " ".join([*w[20:], *w[:20]]))]
    carried = []

    def counted(few, nodes, own=jc._with_earlier):
        got = own(few, nodes)
        carried.append(got.agg(F.max(F.size("earlier"))).first()[0])
        return got

    monkeypatch.setattr(jc, "_with_earlier", counted)
    monkeypatch.setattr(jc, "boundary", lambda sizes, percent: 0)
    monkeypatch.setattr(jc, "PER_MEMBER", 100)
    for most in (jc.EARLIER, 0):
        monkeypatch.setattr(jc, "EARLIER", most)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jc.similar_groups(frame(spark, rows).repartition(4), 3, 80).collect()}
        assert got == brute_groups(rows, 3, 80)
        assert carried and max(carried) <= most
        carried.clear()


def test_sizes_far_apart_in_one_bucket(spark, monkeypatch):
    """A bucket of many sizes is parted by bands, and links between neighbouring bands stay."""
    monkeypatch.setattr(jc, "PER_MEMBER", 0)
    monkeypatch.setattr(jc, "PER_DELTA", 0)
    monkeypatch.setattr(jc, "boundary", lambda sizes, percent: 0)
    rows = [(k, " ".join(f"w{j}" for j in range(6 + k))) for k in range(0, 60, 2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jc.similar_groups(frame(spark, rows), 1, 80).collect()}
    assert got == brute_groups(rows, 1, 80)


def test_texts_of_pairs_alone_are_shuffled(spark, monkeypatch):
    """Few pairs do not shuffle all texts; with more nodes than may be looked up the same pairs come from a join of all."""
    texts = materialize(spark.range(3000).select(F.col("id").alias("node"), F.concat(F.lit("text "), F.col("id")).alias("text")), "t")
    pairs = materialize(spark.createDataFrame([(1, 7), (1, 2999)], "u long, v long"), "p")
    for most, looked_up in ((1 << 19, True), (2, False)):
        monkeypatch.setattr(jc, "LOOKED_UP", most)
        got = jc._with_texts(pairs, texts)
        assert sorted(map(tuple, got.collect())) == [(1, 7, "text 1", "text 7"), (1, 2999, "text 1", "text 2999")]
        assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == looked_up


def test_order_within_texts():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, end in ((0, 1), (4000, 3), (4000, 1 << 45)):
        high, h = rng.integers(0, end, n), rng.integers(0, 1 << 64, n, dtype=np.uint64)
        h[::3] &= np.uint64(255)  # equal in all bits that fit beside a large ``high``
        got, want = jc.ordered(high, end, h), np.lexsort((h, high))
        assert (high[got] == high[want]).all() and (h[got] == h[want]).all()


def test_boundary_is_the_cheapest():
    import numpy as np

    sizes = np.array([0] + [10] * 64)
    assert jc.boundary(sizes, 80) == 9 and jc.boundary(np.zeros(65, int), 80) == 0
    assert jc._subset_keys(9, 90) == 1 and jc._subset_keys(10, 90) == 11


def test_groups_of_odd_tables(odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.similar_groups(odd_docs, 3, 90).collect()), key=str)
    assert rows == sorted([(None, 4, None), (None, 0, None), (1, 4, 1), (1, 4, 1), (2, 2, 2), (3, 0, 3), (3, 0, 3), (4, 4, 1)], key=str)
    assert jc.similar_groups(no_docs).count() == 0
    kept = jc.one_of_each_group(odd_docs, 3, 90)
    assert kept.columns == odd_docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("None", "a b c d e f"), ("None", ""), ("1", "a b c d e f"), ("2", "other words in here"), ("3", ""), ("3", "")])


def test_one_stays(spark, docs, corpus):
    groups = brute_groups(corpus, 5, 80)
    kept = {r.doc_id for r in materialize(jc.one_of_each_group(docs), "t").collect()}
    assert kept == {i for i, (_, c) in groups.items() if i == c}
