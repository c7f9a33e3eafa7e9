"""Token ids of whole texts with a public byte-level BPE file and the ``tokenizers`` library.

The library needs about 2.5 microseconds a token, and a corpus repeats its
words, so texts are cut where the pre-tokenizer cuts anyway and each distinct
piece is encoded once per worker: a single space that follows a character
other than white space always starts a new pre-token, and so do the
punctuation and line ends of ``ALSO``.  Texts where this does
not hold (a space after white space, separators that only one of the two
regular expression dialects counts as white space, the special token's own
string) are encoded whole.  ``tests/llm`` holds the result against the library
on whole texts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IRREGULAR = re.compile(r"\s |[\x1c-\x1f\x85]|<\|")
CUT = "\x1f"
SPACE = "\u0120"  # how the byte-level vocabulary writes a space
# What follows the first starts a pre-token there (an apostrophe would not).
ALSO = [("[a-zA-Z]", "[.,!*$%&#]"), ("[a-zA-Z.,!*$%&#]", "\n")]


def byte_bpe() -> str:
    """Path of the byte-level BPE file; other files of the same kind may be given instead."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes batches of texts; remembers up to ``limit`` distinct pieces, the ones met in several batches longest."""

    def __init__(self, path: str, limit: int = 400_000, together: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.together = limit, together
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids whose bytes start with a space
        self.opens[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        self._store({}, np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))

    def _store(self, known: dict[str, int], ids: np.ndarray, length: np.ndarray) -> None:
        self.known, self.n, self.size = known, len(length), len(ids)
        self.ids = np.concatenate([ids, np.zeros(max(1 << 16, len(ids)), dtype=np.uint32)])
        room = max(1 << 14, self.n)
        self.length = np.concatenate([length, np.zeros(room, dtype=np.int64)])
        self.start = np.concatenate([np.cumsum(length) - length, np.zeros(room, dtype=np.int64)])
        self.met = np.zeros(self.n + room, dtype=np.int32)

    def _forget(self) -> None:
        """Keeps the pieces met again since they were learned, if they leave room for others."""
        kept = np.flatnonzero(self.met[: self.n] > 0)
        if len(kept) > self.limit // 2:
            kept = kept[:0]
        place = {int(i): k for k, i in enumerate(kept)}
        known = {w: place[i] for w, i in self.known.items() if i in place}
        parts = [self.ids[self.start[i]: self.start[i] + self.length[i]] for i in kept]
        self._store(known, np.concatenate(parts) if parts else self.ids[:0], self.length[kept])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = self._encode(pieces)
        return (np.fromiter((i for x in new for i in x), dtype=np.uint32),
                np.fromiter(map(len, new), dtype=np.int64, count=len(new)))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces made of a space and other characters, many in one text: an id that opens with a space starts one."""
        joined = ["".join(words[i: i + self.together]) for i in range(0, len(words), self.together)]
        flat, _ = self._pieces(joined)
        first = np.flatnonzero(self.opens[flat])
        if len(first) != len(words):
            return self._pieces(words)
        return flat, np.diff(first, append=len(flat))

    def _learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if p[:1] == " " and p[1:].split() == [p[1:]]]
        simple = set(words)
        rest = [p for p in pieces if p not in simple]
        for names, (flat, length) in ((words, self._words(words)), (rest, self._pieces(rest))):
            n, end = self.n + len(names), self.size + len(flat)
            while len(self.start) < n:
                self.start, self.length, self.met = (np.concatenate([x, np.zeros_like(x)])
                                                     for x in (self.start, self.length, self.met))
            while len(self.ids) < end:
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.size: end] = flat
            self.length[self.n: n] = length
            self.start[self.n: n] = self.size + np.cumsum(length) - length
            self.known.update(zip(names, range(self.n, n)))
            self.n, self.size = n, end

    def _regular(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), " ", CUT + " ")
        for before, after in ALSO:
            marked = pc.replace_substring_regex(marked, f"({before})({after})", rf"\1{CUT}\2")
        cut = pc.split_pattern(marked, CUT)
        pieces = pc.dictionary_encode(cut.flatten())
        words = pieces.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self._forget()
            new = [w for w in words if w not in self.known]
        old = self.n
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        self.met[at[at < old]] += 1
        at = at[np.asarray(pieces.indices)]
        length = self.length[at]
        total = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.start[at] - total[:-1], length)]
        return flat, np.diff(total[np.asarray(cut.offsets) - cut.offsets[0].as_py()])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids per text); null counts as empty."""
        texts = [t or "" for t in texts]
        odd = np.fromiter((IRREGULAR.search(t) is not None for t in texts), dtype=bool, count=len(texts))
        flat, count = self._regular([t for t, o in zip(texts, odd) if not o])
        if not odd.any():
            return flat, count
        whole = iter(self._encode([t for t, o in zip(texts, odd) if o]))
        rest = iter(np.split(flat, np.cumsum(count)[:-1])) if len(count) else iter(())
        each = [np.array(next(whole), dtype=np.uint32) if o else next(rest) for o in odd]
        return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file; its memory of pieces lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batch: pa.RecordBatch, path: str, end: int, at_once: int = 6_000_000):
    """Yields (row, ids with the end id) of a batch with a ``text`` column, ``at_once`` characters at a time."""
    texts = batch.column("text").to_pylist()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < at_once):
            size += len(texts[last] or "")
            last += 1
        flat, count = encoder(path)(texts[first:last])
        stop = np.cumsum(count)
        for row, a, b in zip(range(first, last), (stop - count).tolist(), stop.tolist()):
            ids = np.empty(b - a + 1, dtype="<u4")
            ids[:-1] = flat[a:b]
            ids[-1] = end
            yield row, ids
        first = last
