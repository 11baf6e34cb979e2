"""Byte-level BPE over whole columns: numpy pre-tokens, and the library's merges for each distinct one.

A byte-level BPE vocabulary splits text by a fixed pattern and merges inside
each pre-token only, so the ids of a text are the ids of its pre-tokens in
order.  Pre-tokens are found for a whole block of texts at once; each distinct
one is merged once by the ``tokenizers`` library and kept in a bounded cache.

Whole-token shortcut: a vocabulary string which the library encodes alone as
exactly one id counts as one token wherever it is a pre-token.  This is proved
for every string of the vocabulary when the cache is made.

Texts that hold a special string, and tokenizers of another make, go to the
library as they are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textkernel import _BASE, _BASE_INV, _power_table, mix64, string_chunks

LETTER, NUMBER, SPACE, UNKNOWN = 1, 2, 3, 4
#: Most entries of a worker's cache; it starts anew from the vocabulary beyond that.
CACHE_ENTRIES = 1_200_000
BLOCK_BYTES = 2 << 20

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, not assigned as far as Python knows, or (0) other."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                out[c] = LETTER
            elif kind == "N":
                out[c] = NUMBER
            elif kind == "C" and unicodedata.category(chr(c)) == "Cn":
                out[c] = UNKNOWN
        white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        out[white] = SPACE
        _classes = out
    return _classes


def pretoken_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Start indices of the pre-tokens of concatenated texts (code points).

    text_starts: first index of each text, ascending; empty texts may repeat one.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[text_starts] = True
    first[0] = True
    edge = first[:-1].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    what = kind[start]
    mark = edge
    linked = np.append(~first[start[1:]], False)  # the next run is of the same text
    space = what == SPACE
    follow = space & linked
    last = cp[end - 1]
    plain = follow & (last == 32)
    mark[end[plain]] = False
    split = plain | (follow & (end - start > 1))
    mark[end[split] - 1] = True
    after_blank = np.append(False, plain[:-1])
    quote = np.flatnonzero((what == 0) & (end - start == 1) & (cp[start] == 39) & linked & ~after_blank)
    quote = quote[what[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        at, stop = start[quote + 1], end[quote + 1]
        one = cp[at]
        two = np.where(stop - at > 1, cp[np.minimum(at + 1, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(long, 2, 0))
        hit = size > 0
        mark[at[hit]] = False
        rest = at + size
        mark[rest[hit & (rest < stop)]] = True
    return np.flatnonzero(mark)


def _byte_letters() -> list[int]:
    """The code point that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [0] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = b
        else:
            out[b], extra = 256 + extra, extra + 1
    return out


class ByteBpe:
    """A byte-level BPE tokenizer file, with the cache described above."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.letters = np.array(_byte_letters(), dtype=np.uint32)
        self.merger = Tokenizer(self.full.model)
        self.merger.pre_tokenizer = pre_tokenizers.Split("\n", behavior="removed")
        vocab = self.full.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for word, i in vocab.items():
            self.length[i] = len(word)
        self.specials = [x.content.encode() for x in self.full.get_added_tokens_decoder().values()]
        self._whole = self._prove(vocab)
        self._reset()

    def _prove(self, vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, id) of the strings that alone are one pre-token and one token, by hash."""
        back = {c: b for b, c in enumerate(self.letters.tolist())}
        texts = []
        for word in vocab:
            try:
                texts.append(bytes(back[ord(c)] for c in word).decode())
            except (KeyError, UnicodeDecodeError):
                continue
        got = self.full.encode_batch_fast(texts, add_special_tokens=False)
        whole = [(t, e.ids[0]) for t, e in zip(texts, got, strict=True) if len(e.ids) == 1]
        cp = np.frombuffer("".join(t for t, _ in whole).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(t) for t, _ in whole])
        stop = np.cumsum(size)
        alone = np.isin(stop - size, pretoken_starts(cp, stop - size))
        cut = np.zeros(len(cp), dtype=np.int64)
        cut[pretoken_starts(cp, stop - size)] = 1
        inner = np.append(0, np.cumsum(cut))
        alone &= inner[stop] - inner[stop - size] == 1
        h = self._hashes(cp, stop - size, stop)[alone]
        ids = np.array([i for _, i in whole], dtype=np.int32)[alone]
        order = np.argsort(h)
        return h[order], ids[order]

    def _reset(self) -> None:
        self.key, ids = self._whole
        self.size = np.ones(len(ids), dtype=np.int32)
        self.at = np.arange(len(ids), dtype=np.int64)
        self.pool = [ids]
        self.pool_size = len(ids)

    @staticmethod
    def _hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = cp.astype(np.uint64)
        total += np.uint64(0x632BE59BD9B4E019)
        total *= _power_table(_BASE, len(cp))
        np.cumsum(total, out=total)
        h = total[end - 1]
        inner = start > 0
        h[inner] -= total[start[inner] - 1]
        h *= _power_table(_BASE_INV, len(cp))[start]
        return mix64(h ^ (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def _merge(self, text: str, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the given pre-tokens of text, by the library."""
        words = [text[a:b].encode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        size = np.array([len(w) for w in words], dtype=np.int64)
        stop = np.cumsum(size)
        mapped = np.insert(self.letters[np.frombuffer(b"".join(words), dtype=np.uint8)], stop, 10)
        ids = np.array(self.merger.encode_batch_fast([mapped.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, dtype=np.int32)
        done = np.cumsum(self.length[ids])
        assert len(done) and done[-1] == stop[-1], "the merges do not cover the text"
        last = np.searchsorted(done, stop)
        assert (done[last] == stop).all(), "a token crosses a pre-token"
        return ids, np.diff(last + 1, prepend=0)

    def _ensure(self, text: str, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cache slot of each (distinct) hash; start and end give an occurrence of each."""
        if len(self.key) + len(h) > CACHE_ENTRIES:
            self._reset()
        slot = np.searchsorted(self.key, h)
        known = self.key[np.minimum(slot, len(self.key) - 1)] == h
        new = np.flatnonzero(~known)
        if len(new):
            ids, counts = self._merge(text, start[new], end[new])
            at = self.pool_size + np.cumsum(counts) - counts
            self.pool.append(ids)
            self.pool_size += len(ids)
            key = np.concatenate([self.key, h[new]])
            order = np.argsort(key, kind="stable")
            self.key = key[order]
            self.size = np.concatenate([self.size, counts.astype(np.int32)])[order]
            self.at = np.concatenate([self.at, at])[order]
            slot = np.searchsorted(self.key, h)
        return slot

    def _special_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts with a special string, or with characters that the library may know and Python does not."""
        raw, rows = data.tobytes(), set()
        if len(data) and data.max() >= 0xE0:
            text = raw.decode()
            odd = np.flatnonzero(char_classes()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)] == UNKNOWN)
            at = np.flatnonzero((data & 0xC0) != 0x80)[odd]
            rows.update((np.searchsorted(offsets, at, side="right") - 1).tolist())
        for word in self.specials:
            at = raw.find(word)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(word) <= offsets[row + 1]:
                    rows.add(row)
                at = raw.find(word, at + 1)
        return sorted(rows)

    def _slots(self, data: np.ndarray, offsets: np.ndarray):
        text = data.tobytes().decode()
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        starts = before[offsets]
        at = pretoken_starts(cp, starts[:-1])
        end = np.append(at[1:], len(cp))
        h, where, back = np.unique(self._hashes(cp, at, end), return_index=True, return_inverse=True) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        slot = self._ensure(text, h, at[where], end[where])[back] if len(at) else np.zeros(0, np.int64)
        return slot, np.searchsorted(at, starts)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block."""
        slot, first = self._slots(data, offsets)
        total = np.append(0, np.cumsum(self.size[slot], dtype=np.int64))
        out = np.diff(total[first])
        for row in self._special_rows(data, offsets):
            out[row] = len(self.full.encode(data[offsets[row] : offsets[row + 1]].tobytes().decode(), add_special_tokens=False).ids)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each text)."""
        slot, first = self._slots(data, offsets)
        size = self.size[slot].astype(np.int64)
        stop = np.cumsum(size)
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        ids = self.pool[0][np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.at[slot] - (stop - size), size)]
        counts = np.diff(np.append(0, stop)[first])
        if rows := self._special_rows(data, offsets):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for row in rows:
                parts[row] = np.array(self.full.encode(data[offsets[row] : offsets[row + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.int32)
                counts[row] = len(parts[row])
            ids = np.concatenate(parts)
        return ids, counts


class LibraryTokenizer:
    """Any other tokenizer file: ``.model`` by sentencepiece, ``.json`` by tokenizers."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: piece.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            full = Tokenizer.from_file(path)
            full.no_truncation()
            full.no_padding()
            self._ids = lambda texts: [e.ids for e in full.encode_batch_fast(texts, add_special_tokens=False)]

    def _all(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        raw = data.tobytes()
        return self._ids([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.array([len(x) for x in self._all(data, offsets)], dtype=np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self._all(data, offsets)
        return np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64)


_loaded: dict[str, ByteBpe | LibraryTokenizer] = {}


def load(path: str) -> ByteBpe | LibraryTokenizer:
    """The tokenizer of a file, kept by this worker process."""
    if path not in _loaded:
        import os

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        plain = False
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                x = json.load(f)
            pre = x.get("pre_tokenizer") or {}
            model = x.get("model") or {}
            plain = (
                x.get("normalizer") is None
                and pre.get("type") == "ByteLevel"
                and not pre.get("add_prefix_space")
                and pre.get("use_regex", True)
                and model.get("type") == "BPE"
                and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
                and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in x.get("added_tokens", []))
            )
        _loaded[path] = ByteBpe(path) if plain else LibraryTokenizer(path)
    return _loaded[path]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return string_chunks(column, BLOCK_BYTES)
