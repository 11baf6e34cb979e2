import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): random, copies, near copies, shared passages, null, empty, blank, very long, odd characters."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 80), 200) for _ in range(60)]
    passage = words(rng, 40, 500)
    texts = list(base)
    for t in base[:15]:
        w = t.split()
        texts += [t, t.upper(), " ".join(w[: len(w) // 2] + ["x"] + w[len(w) // 2 + 1 :]), "\n".join(w)]
    texts += [f"{words(rng, 5)} {passage} {words(rng, 5)}" for _ in range(8)] + [passage[:-3], "a b", "a b", "a", "A", "a b c", "b c"]
    texts += [None, "", "  \n\t ", "é日本 ß x", "<|endoftext|> it's  <|endoftext|>", words(rng, 6000, 50), "x" * 30_000, passage, passage]
    rng.shuffle(texts)
    return [(7 * k, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    """Documents with the usual columns from (doc_id, text)."""
    return spark.createDataFrame([(i, t, ("en", "fr")[(i or 0) % 2], f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture()
def docs(spark, corpus):
    return frame(spark, corpus)


CLASHING = ("hash", "n", "node", "key", "anchor", "part", "x", "score", "label", "items", "root", "tokens", "ratio", "_mix")


@pytest.fixture()
def odd_docs(spark):
    """Null ids, repeated rows, and more columns that have the names of inner ones."""
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words in here"), (3, None), (3, ""), (4, "a b c d e f")]
    out = frame(spark, rows)
    for name in CLASHING:
        out = out.selectExpr("*", f"'c' AS `{name}`")
    return out


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
