"""Token ids of whole texts, with each distinct piece of text encoded once for each worker process.

The vocabulary's pre-tokenizer never joins text across white space, nor an
ASCII letter with a following ASCII character that is no letter, so a text's
ids are those of the pieces between such borders.  Texts that hold the start
of a special token's name are encoded whole.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import public_tokenizers

from .textwords import LOWER, SPACES, U64, Hasher, blocks, byte_table, runs

VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces kept by a worker process; beyond it starts afresh.
CACHE_PIECES = 1_000_000

_LETTERS = byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_OTHER_ASCII = byte_table(bytes(range(128))) & ~_LETTERS & ~SPACES


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


class PieceTokenizer:
    """Encodes Arrow arrays of texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hasher = Hasher()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    @classmethod
    def of_process(cls, path: str) -> PieceTokenizer:
        """The worker process's tokenizer, kept from one task to the next."""
        held = sys.modules.setdefault("_piece_tokenizers", types.ModuleType("_piece_tokenizers")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def encode(self, texts: pa.Array):
        """Yield the ids (uint32) of each text, in order."""
        for _, data, offsets in blocks(texts):
            ids, ends = self._block(data, offsets)
            starts = np.r_[0, ends[:-1]]
            special = set()
            if b"<|" in data.tobytes():
                for i in range(len(offsets) - 1):
                    if b"<|" in data[offsets[i]:offsets[i + 1]].tobytes():
                        special.add(i)
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                if i in special:
                    text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                else:
                    yield ids[a:b]

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and where each text's ids end."""
        lowered = LOWER[data]
        starts, ends = runs(~SPACES[data], offsets)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        inner = np.flatnonzero(_LETTERS[data[:-1]] & _OTHER_ASCII[data[1:]]) + 1
        inner = inner[~np.isin(inner, offsets)]
        starts, ends = np.sort(np.r_[starts, inner]), np.sort(np.r_[ends, inner])
        pieces, first, which = np.unique(self.hasher.ranges(lowered, starts, ends), return_index=True, return_inverse=True)
        place = self._places(pieces, lowered, starts[first], ends[first])[which]
        count = self.count[place]
        upto = np.cumsum(count)
        flat = np.arange(upto[-1]) + np.repeat(self.at[place] - (upto - count), count)
        text_ends = np.r_[0, upto][np.searchsorted(starts, offsets[1:])]
        return self.pool[flat], text_ends

    def _places(self, pieces, lowered, starts, ends) -> np.ndarray:
        if len(self.keys) > CACHE_PIECES:
            self.forget()
        place = np.searchsorted(self.keys, pieces)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == pieces[known]
        new = np.flatnonzero(~known)
        if len(new):
            whole = lowered.tobytes()
            texts = [whole[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate([self.pool, *(np.array(x, dtype=np.uint32) for x in ids)])
            keys = np.concatenate([self.keys, pieces[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at, self.count = np.concatenate([self.at, at])[order], np.concatenate([self.count, count])[order]
            place = np.searchsorted(self.keys, pieces)
        return place
