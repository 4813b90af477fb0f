"""Token ids of whole texts, each distinct word of a batch encoded once.

A text is cut before each space that follows a character which is no white space. Byte-level BPE never merges across
such a place (its pre-tokenizer begins a piece there), nor does a sentence-piece model none of whose pieces has a space
inside. So the ids of a text are those of its words, one after the other. Distinct words are joined again into strings
of some length, encoded in one call each, and the ids dealt back by the bytes they stand for; where the bytes do not
meet, the words are encoded one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm.common import buffers
from quire.llm.packing import Encoder

#: Bytes of distinct words encoded in one call; of these calls, one in SAMPLED is compared with the library.
JOINED, SAMPLED = 1 << 14, 64


#: Bytes that end a character which is surely no white space: printable ASCII by themselves; the second of two bytes after
#: a lead from 0xC3 on. Other characters only make longer words.
_ASCII = np.array([0x20 < c < 0x7F for c in range(256)])
_SECOND = np.array([0x80 <= c < 0xC0 for c in range(256)])
_LEAD = np.array([0xC3 <= c < 0xE0 for c in range(256)])


def _ends(data: np.ndarray) -> np.ndarray:
    """Whether each byte ends a character that is surely no white space."""
    out = _ASCII[data]
    out[1:] |= _SECOND[data[1:]] & _LEAD[data[:-1]]
    return out


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of rows with these offsets, and the number of words before each row and in all."""
    lo, hi = int(off[0]), int(off[-1])
    part = data[lo:hi]
    cut = part == 0x20
    cut[1:] &= _ends(part)[:-1]
    if len(part):
        cut[off[:-1][np.diff(off) > 0] - lo] = True
    at = np.flatnonzero(cut) + lo
    return at, np.searchsorted(at, off)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Adjacent spans of bytes, as strings that share the bytes."""
    off = np.append(start, end[-1:] if len(end) else 0).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])


def distinct(off: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (binary), the index of each word of the rows, and the words before each row."""
    at, before = words(off, data)
    if not len(at):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), before
    coded = spans(data, at, np.append(at[1:], off[-1])).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), before


class ByteLevel:
    """Ids of a byte-level BPE file of the tokenizers library. plain: added tokens' strings are ordinary text; otherwise
    texts that hold one go to the library as they are."""

    def __init__(self, path: str, plain: bool):
        self.encoder = Encoder(path)
        tok = self.encoder.tokenizer
        byte = {chr(c): c for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        byte |= {chr(0x100 + i): c for i, c in enumerate(c for c in range(256) if chr(c) not in byte)}
        vocabulary = tok.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.bytes_of[i] = word.encode() if word in self.encoder.added else bytes(byte[c] for c in word)
        self.size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.plain, self.calls = plain, 0
        tok.encode_special_tokens = True
        self.special = None
        if not plain:
            from tokenizers import Tokenizer

            self.special = Tokenizer.from_file(path)

    def _library(self, text: str) -> list[int]:
        return self.encoder.tokenizer.encode(text, add_special_tokens=False).ids

    def join(self, raw: bytes) -> np.ndarray:
        text = raw.decode()
        self.calls += 1
        if not self.encoder.ranked:
            return np.array(self._library(text), np.int64)
        ids = self.encoder.ranked.encode_to_numpy(text).astype(np.int64)
        if self.calls % SAMPLED == 1 and ids.tolist() != self._library(text):
            self.encoder.ranked = None
            return self.join(raw)
        return ids

    def one(self, raw: bytes) -> np.ndarray:
        return np.array(self._library(raw.decode()), np.int64)

    def texts(self, arr) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts (a string array without nulls), and the ids before each text and in all."""
        off, data = buffers(arr)
        held = np.zeros(len(off) - 1, bool)
        whole = data[off[0] : off[-1]].tobytes()
        for token in [] if self.plain else self.encoder.added:
            found, raw = whole.find(token.encode()), token.encode()
            while found >= 0:
                row = int(np.searchsorted(off, found + off[0], "right")) - 1
                held[row] = True
                found = whole.find(raw, int(off[row + 1] - off[0]))
        known, index, before = distinct(off, data)
        ids, first = encoded(known, self)
        out, at = spread(ids, first, index)
        at = at[before]
        if not held.any():
            return out, at
        each = [np.array(self.special.encode(arr[i].as_py(), add_special_tokens=False).ids, np.int32) if h else out[at[i] : at[i + 1]] for i, h in enumerate(held)]
        return np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each])))


class Pieces:
    """Ids of a sentence-piece model, which adds the space that words begin with. A piece's bytes are its UTF-8 with U+2581 as a space; <0xHH> is that byte."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        byte = [self.model.is_byte(i) for i in range(n)]
        self.bytes_of = [bytes([int(s[3:5], 16)]) if b else s.replace("▁", " ").encode() for s, b in zip(names, byte)]
        self.size = np.array([len(x) for x in self.bytes_of], np.int64)
        if any("▁" in s.lstrip("▁") for s, b in zip(names, byte) if not b):
            raise ValueError(f"{path}: pieces with a space inside would cross words")
        # a text's last space is a word of its own, but of an empty text the model makes nothing
        self.space = np.array(self.model.encode("0 ")[len(self.model.encode("0")) :], np.int64)

    def join(self, raw: bytes) -> np.ndarray:
        if raw == b" ":
            return self.space
        return np.array(self.model.encode(raw[1:].decode(), num_threads=1), np.int64)

    one = join


def spread(flat: np.ndarray, first: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[first[i]:first[i + 1]] of each i of index, one after the other, and where each begins, and the end."""
    n = np.diff(first)[index]
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    kind = np.int32 if max(at[-1], len(flat)) < 1 << 31 else np.int64
    take = np.repeat((first[:-1][index] - at[:-1]).astype(kind), n)
    take += np.arange(len(take), dtype=kind)
    return flat[take], at


def encoded(known: pa.Array, model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each of these distinct words, and the ids before each and in all."""
    off, data = buffers(known)
    n = len(off) - 1
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    size = np.diff(off)
    joins = (data[off[:-1]] == 0x20) & _ends(data[off[0] : off[-1]])[off[1:] - 1 - off[0]]
    count = np.zeros(n, np.int64)
    order = np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins)))
    flat, at = [], 0
    together = np.flatnonzero(joins)
    total = np.cumsum(size[together])
    while at < len(together):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + JOINED, "right")))
        some = together[at:to]
        at = to
        raw = data[np.arange(size[some].sum()) + np.repeat(off[some] - np.cumsum(size[some]) + size[some], size[some])].tobytes()
        got = model.join(raw)
        ends = np.cumsum(model.size[got])
        want = np.cumsum(size[some])
        cut = np.searchsorted(ends, want)
        if len(ends) and ends[-1] == len(raw) and cut[-1] < len(ends) and np.array_equal(ends[cut], want):
            flat.append(got)
            count[some] = np.diff(np.concatenate(([0], cut + 1)))
        else:
            each = [model.one(known[int(i)].as_py()) for i in some]
            flat += each
            count[some] = [len(x) for x in each]
    for i in np.flatnonzero(~joins):
        flat.append(model.one(known[int(i)].as_py()))
        count[i] = len(flat[-1])
    flat = np.concatenate(flat).astype(np.int32)
    begin = np.zeros(n + 1, np.int64)
    begin[order] = np.cumsum(count[order]) - count[order]
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(len(flat), np.int32)
    out[np.arange(len(flat)) - np.repeat(begin[order], count[order]) + np.repeat(first[order], count[order])] = flat
    return out, first
