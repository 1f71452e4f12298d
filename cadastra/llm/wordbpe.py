"""Exact batch encoding with a word-level BPE file of the tokenizers library.

The file's pre-tokenizer drops white space and never joins across it, so the ids
of a text are those of its space-separated units in order. Each distinct unit of
a chunk goes to the library once; recent units are kept in a table of fixed size
with one place for each hash (of 64 bits; equal hashes count as equal units).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from cadastra.llm import _text

_PUNCT = np.zeros(256, bool)
_PUNCT[[44, 46]] = True


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """Encodes columns of texts. 2 ** bits units are remembered at most; most_ids bounds their ids."""

    def __init__(self, path: str, bits: int = 21, most_ids: int = 8_000_000):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # Words of letters alone, normal already, need only the merges of the same file.
        self.ascii, self.letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bits, self.most_ids = bits, most_ids
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.sizes = np.zeros(1 << self.bits, np.int32)
        self.pool = np.zeros(0, self.dtype)

    def _fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each unit: (starts, sizes, flat ids). Plain words share calls; their last tokens tell them apart."""
        kinds: tuple[list, list, list] = ([], [], [])
        for i, u in enumerate(units):
            plain = u.isalpha()
            kinds[2 if not plain or u != u.lower() else 0 if u.isascii() else 1 if unicodedata.is_normalized("NFC", u) else 2].append(i)
        at, sizes, flat, n = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [], 0
        alone = kinds[2]
        for kind, tokenizer in ((kinds[0], self.ascii), (kinds[1], self.letters)):
            groups = [kind[i : i + 256] for i in range(0, len(kind), 256)]
            for group, found in zip(groups, tokenizer.encode_batch_fast([" ".join([units[i] for i in g]) for g in groups], add_special_tokens=False)):
                ids = np.array(found.ids, self.dtype)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(group) and cuts[-1] == len(ids):
                    sizes[group] = np.diff(cuts, prepend=0)
                    at[group] = n + cuts - sizes[group]
                    flat.append(ids)
                    n += len(ids)
                else:
                    alone = alone + group
        for i, found in zip(alone, self.tokenizer.encode_batch_fast([units[i] for i in alone], add_special_tokens=False)):
            at[i], sizes[i] = n, len(found.ids)
            flat.append(np.array(found.ids, self.dtype))
            n += len(found.ids)
        return at, sizes, np.concatenate(flat) if flat else np.zeros(0, self.dtype)

    def encode(self, column: pa.Array, end: int, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, offsets) of chunks of rows; end closes every document."""
        for a, b, data, off in _text.chunks(column, limit):
            raw = data.tobytes()
            if b"<|" not in raw:  # the strings of special tokens keep their case
                data = _text.LOWER[data]
                raw = data.tobytes()
            starts, stops, at = _text.spans(data, off, _text.NOT_SPACE)
            starts, stops, at = self._cut(data, starts, stops, at)
            keys = _text.hashes(data, starts, stops)
            slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
            place, sizes = self.at[slot].astype(np.int64), self.sizes[slot].astype(np.int64)
            new = np.flatnonzero((self.keys[slot] != keys) | (sizes == 0))
            if len(new):
                some, first, inverse = np.unique(keys[new], return_index=True, return_inverse=True)
                first = new[first]
                found, counts, flat = self._fresh([raw[x:y].decode() for x, y in zip(starts[first].tolist(), stops[first].tolist())])
                found += len(self.pool)
                self.pool = np.concatenate([self.pool, flat])
                place[new], sizes[new] = found[inverse], counts[inverse]
                self.keys[slot[first]] = some
                self.at[slot[first]], self.sizes[slot[first]] = found, counts
            before = np.concatenate([[0], np.cumsum(sizes)])
            ids = self.pool[np.repeat(place - before[:-1], sizes) + np.arange(before[-1])]
            offsets = before[at]
            if len(self.pool) > self.most_ids:
                self._forget()
            yield a, b, np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))

    @staticmethod
    def _cut(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Make a last comma or full stop after a letter a unit of its own: the pre-tokenizer cuts there too."""
        if not len(starts):
            return starts, stops, at
        long = stops - starts >= 2
        before = data[np.maximum(stops - 2, 0)]
        lead = data[np.maximum(stops - 3, 0)]
        latin = (stops - starts >= 3) & (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        cut = long & _PUNCT[data[stops - 1]] & (((before >= 97) & (before <= 122)) | latin)
        extra = np.concatenate([[0], np.cumsum(cut)])
        n = len(starts) + extra[-1]
        s, e = np.empty(n, np.int64), np.empty(n, np.int64)
        own = np.arange(len(starts)) + extra[:-1]
        s[own], e[own] = starts, stops - cut
        last = own[cut] + 1
        s[last], e[last] = stops[cut] - 1, stops[cut]
        return s, e, at + extra[at]


_kept: dict[str, WordEncoder] = {}


def shared_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker: later tasks of a worker take over its table."""
    if path not in _kept:
        _kept[path] = WordEncoder(path)
    return _kept[path]


def binary_column(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value per document, over the bytes of ids."""
    width = ids.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
