"""Token ids of whole texts, with a byte-level BPE applied once to each distinct piece.

The pattern of byte-level BPE never joins a non-space to a space that follows it, nor a letter to a
mark that follows it, so a text is cut before each run of ASCII space and before an ASCII mark after
an ASCII letter; equal pieces of a batch, and of earlier batches of a worker, are encoded once.  Texts with other Unicode spaces are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from tessellum.llm.textcore import WHITE_SPACE, _ranges, span_hashes, utf8

_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Distinct pieces a worker remembers, about 5 MB; beyond, it forgets those that the last batch did not hold.
REMEMBERED = 300_000
#: Bytes of one text that are encoded at once; longer texts are cut before a space, which changes no token.
SEGMENT = 1 << 20
_LETTER = bytes(int(65 <= b <= 90 or 97 <= b <= 122) for b in range(256))
_MARK = bytes(int(33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126) for b in range(256))
_workers: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.plain = self.tokenizer.pre_tokenizer
        # The same merges on lists of words: a line break, which no word holds, closes each.
        self.listed = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.tokenizer.pre_tokenizer = self.listed
        (self.closing,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.tokenizer.pre_tokenizer = self.plain
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # Remembered pieces: sorted keys, and the place of their ids in the pool.
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _pieces(self, keys: np.ndarray, blob: bytes, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids in the pool of distinct pieces, given by sorted keys and places in ``blob``."""
        at = np.searchsorted(self.keys, keys)
        met = np.zeros(len(keys), bool)
        if len(self.keys):
            met = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~met)
        ids, sizes = self._encode([blob[a:b].decode("utf-8", "replace") for a, b in zip(first[new].tolist(), end[new].tolist(), strict=True)])
        start, size = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        start[met], size[met] = self.start[at[met]], self.size[at[met]]
        start[new], size[new] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        self.pool = np.concatenate([self.pool, ids])
        if len(self.keys) + len(new) > REMEMBERED:
            self.pool = self.pool[_ranges(start, size)]
            start = np.cumsum(size) - size
            self.keys, self.start, self.size = keys, start, size
        else:
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.start, self.size = np.concatenate([self.start, start[new]])[order], np.concatenate([self.size, size[new]])[order]
        return start, size

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and their numbers."""
        # A space at most, then letters only: one word of the pattern.
        word = np.fromiter((t[t[:1] == " " :].isalpha() for t in texts), bool, len(texts))
        sizes = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for kind, encode in ((True, self._encode_words), (False, self._encode_texts)):
            own = np.flatnonzero(word == kind)
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                ids, sizes[part] = encode([texts[i] for i in part.tolist()])
                parts.append((part, ids))
        out = np.empty(int(sizes.sum()), self.dtype)
        start = np.cumsum(sizes) - sizes
        for part, ids in parts:
            out[_ranges(start[part], sizes[part])] = ids
        return out, sizes

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.tokenizer.pre_tokenizer = self.listed
        try:
            lists = self.tokenizer.encode_batch_fast(["\n".join(texts[a : a + 500]) + "\n" for a in range(0, len(texts), 500)], add_special_tokens=False)
        finally:
            self.tokenizer.pre_tokenizer = self.plain
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in lists])
        closes = np.flatnonzero(ids == self.closing)
        return np.delete(ids, closes), np.diff(closes, prepend=-1) - 1

    def _encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), self.dtype, int(sizes.sum())), sizes

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def batch(self, column: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by id ``last``, and the number of ids of each."""
        raw, at = utf8(column)
        if len(at) == 2 and len(raw) > SEGMENT:
            parts = [self._ids(raw[a:b], np.array([0, b - a]))[0] for a, b in _segments(raw)]
            parts.append(np.array([last], self.dtype))
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        ids, counts = self._ids(raw, at)
        out = np.full(len(ids) + len(counts), last, self.dtype)
        out[_ranges(np.cumsum(counts + 1) - counts - 1, counts)] = ids
        return out, counts + 1

    def _ids(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between offsets ``at`` of ``raw``, and the number of ids of each."""
        blob = raw.tobytes()
        n = len(raw)
        space = np.frombuffer(blob.translate(WHITE_SPACE), np.uint8) == 1
        begin = np.zeros(n + 1, bool)
        letter, mark = (np.frombuffer(blob.translate(table), np.uint8) == 1 for table in (_LETTER, _MARK))
        begin[1:n] = (space[1:] & ~space[:-1]) | (mark[1:] & letter[:-1])
        begin[at] = True
        begin[n] = True
        edge = np.flatnonzero(begin)
        first, end = edge[:-1], edge[1:]
        piece_doc = np.searchsorted(at, first, "right") - 1
        docs = len(at) - 1
        special = np.zeros(docs, bool)
        for m in _OTHER_SPACE.finditer(blob):
            special[np.searchsorted(at, m.start(), "right") - 1] = True
        if special.any():
            use = ~special[piece_doc]
            first, end, piece_doc = first[use], end[use], piece_doc[use]
        hashed, where, inverse = np.unique(span_hashes(raw, first, end), return_index=True, return_inverse=True)
        start, size = self._pieces(hashed, blob, first[where], end[where])
        counts = np.bincount(piece_doc, size[inverse], docs).astype(np.int64)
        plain = self.pool[_ranges(start[inverse], size[inverse])]
        if not special.any():
            return plain, counts
        extra = {int(d): self.whole(blob[at[d] : at[d + 1]].decode("utf-8", "replace")) for d in np.flatnonzero(special)}
        counts[list(extra)] = [len(ids) for ids in extra.values()]
        out = np.empty(int(counts.sum()), self.dtype)
        begins = np.cumsum(counts) - counts
        out[_ranges(begins[~special], counts[~special])] = plain
        for d, ids in extra.items():
            out[begins[d] : begins[d] + len(ids)] = ids
        return out, counts


def _segments(raw: np.ndarray) -> list[tuple[int, int]]:
    """Parts of about SEGMENT bytes, cut between an ASCII character and a space that follows it."""
    cuts = [0]
    while len(raw) - cuts[-1] > SEGMENT:
        at = cuts[-1] + SEGMENT
        found = None
        while found is None and at < len(raw):
            part = raw[at - 1 : at + SEGMENT]
            ok = np.flatnonzero((part[1:] == 32) & (part[:-1] > 32) & (part[:-1] < 128))
            found = at + int(ok[0]) if len(ok) else None
            at += SEGMENT
        if found is None:
            break
        cuts.append(found)
    return list(zip(cuts, [*cuts[1:], len(raw)], strict=True))
