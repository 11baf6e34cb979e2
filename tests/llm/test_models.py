"""Language, quality, likelihood, nearest neighbours, mixing, and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoloom.llm import additive, language, mixing, quality
from genoloom.llm import pseudo_likelihood as pl
from genoloom.llm.textkernel import string_chunks

from .conftest import frame, words

DATA = "/root/testdata/sf0.01"


def test_codewords_differ():
    for n in (2, 3, 4, 7, 9, 40):
        code = language.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert all(0 < (c > 0).sum() < n for c in code.T)
        if n > 2:
            assert min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) >= 2


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, odd_docs, no_docs):
    rows = frame(spark, [(0, "the cat"), (1, "le chat"), (2, "12 34 !?"), (3, None), (4, ""), (5, "日本"), (6, "x" * 300_000)])
    got = {r.doc_id: r for r in language.language_id(rows).collect()}
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[5].lang_pred != "und" and got[3].score == 0
    assert language.language_id(odd_docs).count() == 8
    assert language.language_id(no_docs).count() == 0
    none = rows.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_id(none).collect()} == {"und"}
    one = rows.withColumn("lang", F.lit("en"))
    assert {r.doc_id: r.lang_pred for r in language.language_id(one).collect()}[0] == "en"


def test_ambiguous_texts_are_flagged(spark):
    same = frame(spark, [(k, "a b c") for k in range(40)])
    assert all(r.ambiguous for r in language.language_id(same).collect())


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert len(got) > 80 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    for chosen in (labels, labels.where("quality = 1"), labels.where("false")):
        rows = quality.quality_scores(odd_docs, chosen).collect()
        assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0.5 for r in rows)
    assert quality.quality_scores(no_docs, labels).count() == 0


def test_dropping_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    for chosen in (labels, labels.where("quality = 1"), labels.where("false")):
        kept = quality.drop_low_quality(odd_docs, chosen)
        assert kept.columns == odd_docs.columns
        want = {(r.doc_id, r.score >= 0.5) for r in quality.quality_scores(odd_docs, chosen).collect()}
        assert {r.doc_id for r in kept.collect()} == {i for i, good in want if good}
    assert kept.count() == 8
    assert quality.drop_low_quality(no_docs, labels).count() == 0


def test_a_share_of_many_labels_is_learnt(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.range(2_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    every = quality._learnt(docs, labels, "text")
    held = sum(r.h for r in docs.select(quality.held_out(F.col("doc_id")).alias("h")).collect())
    assert every.count() == 2_000 - held and every.where("label = 1").count() > 500
    assert 100 < quality._learnt(docs, labels, "text", 300).count() < 500


def test_quality_statistics_do_not_depend_on_the_block():
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(50)) for _ in range(40)] + ["", "\n", "é | ! A1"]
    whole = quality._of_column(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality._of_column(pa.array([t])) for t in texts]))
    assert (whole[-3] == 0).all() and np.isfinite(whole).all()


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(0, 1, (500, 2)), rng.normal(2, 0.5, (1500, 2))
    moments = [(len(x), x.sum(axis=0), x.T @ x) for x in (x0, x1)]
    model = quality._discriminant(*(np.array(a, dtype=float) for a in zip(*moments, strict=True)), 0.0, 0.0)
    point = np.array([[1.0, 1.2]])

    def log(x):
        cov, diff = np.cov(x.T), point[0] - x.mean(axis=0)
        return -0.5 * (diff @ np.linalg.solve(cov, diff) + np.log(np.linalg.det(cov)))

    want = 1 / (1 + np.exp(-(log(x1) - log(x0) + np.log(1501 / 501))))
    assert abs(model.score(point)[0] - want) < 1e-6


def test_gradients():
    flat = pl.Network.fresh()
    rng = np.random.default_rng(1)
    token = rng.integers(0, pl.VOCABULARY, 400) % 50
    context = pl.contexts(token, np.array([150, 0, 250]))
    assert (context[0, :2] == pl.BLANK).all() and context[1, 1] == token[0] and context[0, 2] == token[1] and context[149, 2] == pl.BLANK
    net = pl.Network(flat)
    before = net.log_probabilities(context, token).mean()
    for _ in range(60):
        net.step(context, token, 0.05)
    assert net.log_probabilities(context, token).mean() > before + 1
    every = np.arange(pl.VOCABULARY)
    total = np.exp(net.log_probabilities(np.repeat(context[:1], len(every), axis=0), every).astype(float)).sum()
    assert abs(total - 1) < 1e-3


def test_likelihood_prefers_the_order_learnt(spark):
    line = [f"k{k}" for k in range(40)]
    rows = [(k, " ".join(line[k % 40 :] + line[: k % 40])) for k in range(300)]
    flat = pl.train(frame(spark, rows).coalesce(1), epochs=3, rate=0.05, rounds=1)
    rng = random.Random(1)
    mixed = line[:]
    rng.shuffle(mixed)
    got = {r.doc_id: r for r in pl.score(frame(spark, [(0, " ".join(line)), (1, " ".join(mixed)), (2, None), (3, "")]), flat).collect()}
    assert got[0].log_likelihood > got[1].log_likelihood + 20
    assert (got[2].n_tokens, got[2].log_likelihood, got[2].mean_log_likelihood) == (0, 0.0, None) and got[3].n_tokens == 0


def test_training_over_partitions_beats_shares_of_slots(spark):
    """The parameters that the query uses, on texts left out, against shares of slots; and scores hardly depend on the partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(8)) == 0
    held, scores = docs.where(out), []
    n = sum(np.bincount(pl.tokens(d, o)[0], minlength=pl.VOCABULARY) for _, _, d, o in string_chunks(held.select("text").toArrow().column(0)))
    for parts in (3, 8):
        model = pl.train(docs.where(~out).repartition(parts))
        assert len(model.held_out) == pl.ROUNDS
        share = (model.slots + 1) / (model.slots + 1).sum()
        unigram = (n * np.log(share)).sum() / n.sum()
        assert pl.slot_likelihood(held, model.flat) > unigram + 0.05
        scores.append({r.doc_id: r.mean_log_likelihood for r in pl.score(held, model).collect()})
    a, b = (np.array([x[i] for i in sorted(scores[0]) if scores[0][i] is not None]) for x in scores)
    assert np.corrcoef(a, b)[0, 1] > 0.99


def test_document_scores_by_brute_force(spark):
    """Every probability from the formula, a token and a slot at a time."""
    rng = random.Random(6)
    rows = [(k, words(rng, rng.randrange(1, 12), 30)) for k in range(25)] + [(25, ""), (26, "once only here")]
    model = pl.train(frame(spark, rows).repartition(2))
    p, count = pl.Network(model.flat).p, {}
    p = {k: v.astype(float) for k, v in p.items()}
    for _, t in rows:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    (_, _, data, offsets), = string_chunks(pa.array([" ".join(count)]))
    slot = dict(zip(count, pl.tokens(data, offsets)[0].tolist(), strict=True))
    in_slot = {s: sum(n for w, n in count.items() if slot[w] == s) for s in set(slot.values())}

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    for r in pl.score(frame(spark, rows), model).collect():
        ws, total = dict(rows)[r.doc_id].split(), 0.0
        for i, w in enumerate(ws):
            near = [slot[ws[j]] if 0 <= j < len(ws) else pl.BLANK for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(np.concatenate([p["embed"][k] for k in near]) @ p["w1"] + p["b1"][0])
            a, b = divmod(slot[w], pl.SIDE)
            first = softmax(h @ p["wa"] + p["ba"][0])[a]
            second = softmax((h * (1 + p["ea"][a])) @ p["wb"] + p["bb"][a])[b]
            total += np.log(first * second * count[w] / in_slot[slot[w]])
        assert r.n_tokens == len(ws) and abs(r.log_likelihood - total) < 1e-3 * max(1, len(ws))


def test_sums_by_key():
    rng = np.random.default_rng(0)
    key, x = rng.integers(0, 30, 500).astype(np.uint16), rng.normal(size=(500, 3)).astype(np.float32)
    used, sums = pl._sums_by(key, x)
    assert used.tolist() == sorted(set(key.tolist())) and all(np.allclose(sums[i], x[key == k].sum(axis=0), atol=1e-5) for i, k in enumerate(used))


@pytest.mark.parametrize("frequent", [1 << 18, 1, 0])
def test_words_of_one_slot_have_their_own_likelihood(spark, monkeypatch, frequent):
    monkeypatch.setattr(pl, "FREQUENT", frequent)
    (_, _, data, offsets), = string_chunks(pa.array([" ".join(f"u{k}" for k in range(20_000))]))
    slot = pl.tokens(data, offsets)[0]
    one, two, three = (f"u{k}" for k in np.flatnonzero(slot == slot[0])[:3])
    rows = [(0, f"left {one} right"), (1, f"left {two} right"), (2, f"left {three} right")] + [(k, f"left {one} right") for k in range(3, 40)] + [(40, f"{two} {two}")]
    model = pl.train(frame(spark, rows).repartition(3))
    assert model.words.agg(F.sum("n")).first()[0] == model.slots.sum() == 3 * 40 + 2 and model.slots[slot[0]] == 42
    got = {r.doc_id: r.log_likelihood for r in pl.score(frame(spark, [*rows[:4], (99, f"left never{one} right")]), model).collect()}
    assert len(got) == 5 and abs(got[0] - got[3]) < 1e-9
    assert abs(got[0] - got[1] - np.log(38 / 3)) < 1e-4 and abs(got[1] - got[2] - np.log(3)) < 1e-4


def test_likelihood_of_odd_tables(odd_docs, no_docs):
    assert pl.pseudo_likelihood(odd_docs).count() == 8
    assert pl.pseudo_likelihood(no_docs).count() == 0


def _exact(rows, k):
    """By brute force, of (vec_id, vector); the rows must be usable and distinct."""
    ids, e = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (e * e[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -np.round(score, 9))) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), score[j]) for j in order]
    return out


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, id string")


def test_nearest_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(300, 8)).astype(np.float32).round(2)
    e[50:110] = e[40]
    rows = [(k, [float(x) for x in v], "s", "i") for k, v in enumerate(e)]
    bad = [(1000, None, "s", "i"), (1020, [0.0] * 8, "s", "i"), (1040, [float("nan")] + [1.0] * 7, "s", "i"), (1060, [None] * 8, "s", "i"), (1080, [1.0], "s", "i"), (1100, [float("inf")] * 8, "s", "i"), (None, [1.0] * 8, "s", "i"), rows[3]]
    got = {}
    for r in additive.nearest(_vectors(spark, rows + bad), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = _exact(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_nearest_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0], "", ""), (1, [0.0, 1.0], "", ""), (20, [1.0, 1.0], "", "")]
    got = [(r.query_id, r["rank"], r.vec_id) for r in additive.nearest(_vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert additive.nearest(_vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert additive.nearest(_vectors(spark, rows[1:2]), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("rows", [8_192, 700])
def test_recall(spark, monkeypatch, rows):
    """The settings that are shipped, on more vectors than are ranked again, in one shard and in many."""
    monkeypatch.setattr(additive, "SHARD_ROWS", rows)
    monkeypatch.setattr(additive, "FAN_IN", 3)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = {}
    for r in additive.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = _exact([tuple(r) for r in vectors.collect()], 20)
    assert len(got) == len(want) and vectors.count() > 640
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_search_ends_where_norms_are_too_small(monkeypatch):
    monkeypatch.setattr(additive, "STEP", 8)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(200, 6)) * rng.exponential(size=(200, 1))).astype(np.float32)
    model = additive.train(x, books=3, words=16)
    codes, norms = model.encode(x)
    near = sum(model.words[k][codes[:, k]] for k in range(3))
    order = np.argsort(-norms, kind="stable")
    place = codes[order].T.astype(np.intp) + (np.arange(3) * 16)[:, None]
    for q in x[:10]:
        table = (q @ model.words.reshape(48, 6).T).astype(np.float32)
        ids, score = additive._best_codes(table, float(np.linalg.norm(q)), place, order, np.sqrt(norms[order]), 7)
        want = near @ q
        assert np.allclose(-score, np.sort(want)[::-1][:7], atol=1e-4) and np.allclose(want[ids], -score, atol=1e-4)


def test_doubles_are_ranked_as_they_are(spark):
    rows = [(20, [1.0, 0.0], "", ""), (1, [1.0, 5.0], "", ""), (2, [1.0 + 1e-12, -5.0], "", ""), (3, [1.0 - 1e-12, 9.0], "", "")]
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, id string")
    assert [r.vec_id for r in additive.nearest(doubles, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [2, 1, 3]


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    model = additive.train(x, books=4, words=32)
    error = {}
    for beam in (1, 8):
        codes, norms = model.encode(x, beam)
        near = sum(model.words[k][codes[:, k]] for k in range(4))
        error[beam] = np.square(x - near).sum()
        assert np.allclose(np.square(near).sum(axis=1), norms, atol=1e-2)
    assert error[8] < error[1]


def _rake(cells, targets, sweeps=400):
    w = {c: float(t) for c, t in cells.items()}
    total = sum(w.values())
    for _ in range(sweeps):
        for d, shares in enumerate(targets):
            for value, share in shares.items():
                mine = [c for c in w if c[d] == value]
                now = sum(w[c] for c in mine)
                for c in mine:
                    w[c] *= share * total / now if now else 0
    return {c: w[c] / total / (cells[c] / total) for c in cells}


@pytest.mark.parametrize("local", [20_000, 0])
def test_raking(spark, monkeypatch, local):
    monkeypatch.setattr(mixing, "LOCAL_CELLS", local)
    rng = random.Random(1)
    cells = {(s, g, t): rng.randrange(1, 900) for s in "abc" for g in "xy" for t in "12" if (s, g, t) != ("a", "x", "1")}
    targets = [{"a": 0.5, "b": 0.25, "c": 0.25}, {"x": 0.6, "y": 0.4}, {"1": 0.3, "2": 0.7}]
    frame_ = spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long")
    wanted = {d: mixing._given(frame_, t) for d, t in zip(mixing.DIMENSIONS, targets, strict=True)}
    got = {(r.source, r.lang, r.topic): r.ratio for r in mixing.rake(frame_, wanted, sweeps=5, tolerance=1e-7, most_rounds=30).collect()}
    want = _rake(cells, targets)
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-3 for c in want)


def test_large_tables_get_as_many_sweeps(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", "1", 90), ("a", "y", "1", 5), ("b", "x", "1", 7), ("b", "y", "1", 800)], "source string, lang string, topic string, tokens long")
    wanted = {"source": mixing._given(cells, {"a": 0.5, "b": 0.5}), "lang": mixing._given(cells, {"x": 0.3, "y": 0.7})}
    got = []
    for local in (20_000, 0):
        monkeypatch.setattr(mixing, "LOCAL_CELLS", local)
        with pytest.warns(UserWarning, match="after 2 sweeps"):
            rows = mixing.rake(cells, wanted, sweeps=2, tolerance=1e-12, most_rounds=1).collect()
        got.append({(r.source, r.lang): r.ratio for r in rows})
    assert all(abs(got[0][c] - got[1][c]) < 1e-9 for c in got[0])


def test_mix(spark, docs, corpus):
    rows = mixing.mix(docs, {"source": {"s0": 1, "s1": 1, "s2": 1}, "lang": 0.5, "topic": 0.9}).collect()
    assert len(rows) == len(corpus)
    weight = {s: sum(r.tokens * r.ratio for r in rows if r.source == s) for s in ("s0", "s1", "s2")}
    total = sum(weight.values())
    assert all(abs(w / total - 1 / 3) < 1e-3 for w in weight.values())
    assert all(r.tokens == len((dict(corpus)[r.doc_id] or "").encode().split()) for r in rows if " " not in (dict(corpus)[r.doc_id] or ""))
    assert all(r.sampled for r in rows if r.probability == 1.0)
    kept = mixing.sample_mixed(docs, {"source": {"s0": 1, "s1": 1, "s2": 1}, "lang": 0.5, "topic": 0.9})
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.sampled}
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sampled_rows_have_the_raked_marginals(spark):
    sizes = {"big": 12_000, "middle": 6_600, **{f"small{k}": 70 for k in range(20)}}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame([(i, f"a b c d{i}", "en", s, 8) for i, (s, _) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    targets = {"source": 0.5, "lang": 0.5, "topic": 0.5}
    got = mixing.mix(docs, targets, topic=F.lit("t")).collect()
    whole = sum(n**0.5 for n in sizes.values())
    want = {"big": 12_000**0.5 / whole, "middle": 6_600**0.5 / whole, "small": 20 * 70**0.5 / whole}
    for weight, near in ((lambda r: r.tokens * r.probability, 1e-6), (lambda r: r.tokens * r.sampled, 0.04)):
        total = sum(map(weight, got))
        assert total > 0 and max(r.probability for r in got) > 1 - 1e-6
        for s, share in want.items():
            assert abs(sum(weight(r) for r in got if r.source.startswith(s)) / total - share) < near
    assert mixing.sample_mixed(docs, targets, topic=F.lit("t")).count() == sum(r.sampled for r in got)


def test_mix_of_odd_tables(odd_docs, no_docs):
    targets = {"source": 0.5, "lang": 0.5, "topic": 0.5}
    odd = odd_docs.withColumn("source", F.when(F.col("doc_id") > 1, F.col("source")))
    rows = mixing.mix(odd, targets).collect()
    assert len(rows) == 8 and all(r.sampled for r in rows if r.tokens == 0)
    clashing = odd.withColumns({c: F.lit("kept") for c in ("_mix_source", "_mix_probability", "probability", "share")})
    sampled = mixing.sample_mixed(clashing, targets)
    assert sampled.columns == clashing.columns and {r["_mix_source"] for r in sampled.collect()} <= {"kept"}
    assert mixing.mix(no_docs, targets).count() == 0 and mixing.sample_mixed(no_docs, targets).count() == 0


def test_block_of_one_long_text():
    (_, _, data, offsets), = string_chunks(pa.array(["a" * 9_000_000]), 100)
    assert len(data) == 9_000_000 and offsets.tolist() == [0, 9_000_000]


def test_stages_on_odd_tables(spark, odd_docs, no_docs, tmp_path):
    """Every stage over null ids and texts, repeated rows, clashing names and no rows at all."""
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "other words in here"), (None, "no such words")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs, n in ((odd_docs, 8), (no_docs, 0)):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = corpus_pipeline.materialize(stage(spark, left, sf), f"odd-{name}")
            assert left.columns == docs.columns and left.count() <= n
            n = left.count()
        assert corpus_pipeline.STAGES[-1][1](spark, left, sf).count() == n


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_output"]
    left, n = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.materialize(stage(spark, left, sf), f"test-{name}")
        assert left.columns == docs.columns and 0 < left.count() <= n
        n = left.count()
    assert corpus_pipeline.run(spark, sf).count() == n
