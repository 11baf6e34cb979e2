"""Token counts and token files against the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from genoloom.llm import bpe
from genoloom.llm.queries import tokenizer_path
from genoloom.llm.store import new_path
from genoloom.llm.token_counts import token_counts
from genoloom.llm.token_files import read_token_files, token_digest, write_token_files

PATH = tokenizer_path()


def library(text):
    return bpe.load(PATH).full.encode(text or "", add_special_tokens=False).ids


def test_random_texts_have_the_librarys_ids():
    rng = random.Random(1)
    letters = " \n\t 'stremvdl19.,!éß日<|endoftext|>Ᲊ\U000105c0😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["it's we'll  \n\n they're ''s 's", "a<|endoftext|>b", "  ", "'"]
    tok = bpe.load(PATH)
    for a, b, data, offsets in bpe.blocks(pa.array(texts)):
        ids, counts = tok.encode(data, offsets)
        assert (tok.counts(data, offsets) == counts).all()
        for text, got in zip(texts[a:b], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == library(text), text


def test_whole_tokens_are_proved():
    tok = bpe.load(PATH)
    assert 0.9 * 50_256 < len(tok._whole[0]) <= 50_256


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50_100)
    tok = bpe.ByteBpe(PATH)
    rng = random.Random(2)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(60))]
        (_, _, data, offsets), = bpe.blocks(pa.array(texts))
        assert tok.encode(data, offsets)[0].tolist() == library(texts[0])
        assert len(tok.key) <= 50_100


def test_counts(docs, corpus):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH).collect()}
    assert got == {i: (len((t or "").encode()), len(library(t))) for i, t in corpus}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(docs, corpus, name):
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, tokenizer_path(name)).collect()}
    if name.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        ids = lambda t: piece.encode(t)
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path(name))
        ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    assert got == {i: len(ids(t or "")) for i, t in corpus}


def test_counts_of_odd_tables(odd_docs, no_docs):
    assert token_counts(odd_docs, PATH).count() == 8
    assert token_counts(no_docs, PATH).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, docs, corpus, encoding):
    path = new_path(spark, "t")
    write_token_files(docs.repartition(5), path, PATH, encoding=encoding)
    start = 0
    got = {r.doc_id: r for r in token_digest(read_token_files(spark, path)).collect()}
    for i, t in sorted(corpus):
        ids = [*library(t), 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    ids = read_token_files(spark, path).where("doc_id = 14").first().ids
    assert ids == [*library(dict(corpus)[14]), 0]
    plan = read_token_files(spark, path, metadata_only=True)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    local = path.removeprefix("file://")
    files = [f for f in pa.fs.LocalFileSystem().get_file_info(pa.fs.FileSelector(f"{local}/tokens")) if f.path.endswith(".parquet")]
    column = pq.ParquetFile(files[0].path).metadata.row_group(0).column(4)
    assert column.has_offset_index and ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


def test_files_of_odd_tables(spark, odd_docs, no_docs):
    path = new_path(spark, "t")
    write_token_files(odd_docs, path, PATH)
    rows = read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 3, 4]
    path = new_path(spark, "t")
    write_token_files(no_docs, path, PATH)
    assert token_digest(read_token_files(spark, path)).count() == 0
    with pytest.raises(ValueError):
        write_token_files(no_docs, path, PATH, encoding="none")
