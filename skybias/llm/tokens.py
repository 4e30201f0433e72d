"""Token ids of whole texts by a word-wise public tokenizer.

The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its words in a row.
Every different word of a batch is encoded once and looked up by its hash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from skybias.llm import texts

END_OF_TEXT = 2
KEPT_WORDS = 1 << 19
LEARNT_AT_ONCE = 1 << 12
#: Words that the tokenizer splits into one run of letters and one run of marks.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


class Encoder:
    """Ids of text columns; remembers the ids of up to ``KEPT_WORDS`` words and starts anew beyond."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

        # one pre-token of letters goes to the model as it is, written as the byte-level alphabet writes it
        self.model, self.closing = self.tokenizer.model, {"": []}
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)])}

    def _closing(self, marks: str) -> list[int]:
        if marks not in self.closing:
            if len(self.closing) >= LEARNT_AT_ONCE:
                self.closing = {"": []}
            self.closing[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
        return self.closing[marks]

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = raw.tobytes()
        found, hard = [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            word = data[a:b].decode().lower()
            plain = PLAIN.fullmatch(word)
            if plain:
                found.append([t.id for t in self.model.tokenize(plain[1].translate(self.letters))] + self._closing(plain[2]))
            else:
                hard.append((len(found), data[a:b].decode()))
                found.append(None)
        for at in range(0, len(hard), LEARNT_AT_ONCE):
            part = hard[at:at + LEARNT_AT_ONCE]
            for (i, _), e in zip(part, self.tokenizer.encode_batch_fast([w for _, w in part], add_special_tokens=False), strict=True):
                found[i] = e.ids
        if len(self.known) + len(keys) > KEPT_WORDS:
            self._forget()
            # words of this batch that were known before are learned again by the caller
        sizes = np.concatenate([np.diff(self.start), [len(x) for x in found]]).astype(np.int64)
        ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32)])
        known = np.concatenate([self.known, keys])
        order = np.argsort(known)
        begin = np.cumsum(sizes) - sizes
        self.ids = ids[spread(begin[order], sizes[order])]
        self.start = np.concatenate([[0], np.cumsum(sizes[order])])
        self.known = known[order]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        return at, (self.known[at] == keys) if len(self.known) else np.zeros(len(keys), bool)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows: first row, end row, ids (uint32) and the offset of each row's ids."""
        raw, offsets = texts.buffers(column)
        for a, b in texts.slices(offsets):
            part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            starts, ends, first = texts.spans(part, at)
            keys, one, back = np.unique(texts.hashes(part, starts, ends), return_index=True, return_inverse=True)
            place, here = self._places(keys)
            while not here.all():
                self._learn(keys[~here], part, starts[one[~here]], ends[one[~here]])
                place, here = self._places(keys)
            begin, size = self.start[place], (self.start[place + 1] - self.start[place]) if len(place) else np.zeros(0, np.int64)
            begin, size = begin[back], size[back]
            ends_at = np.concatenate([[0], np.cumsum(size)])
            yield a, b, self.ids[spread(begin, size)], ends_at[first]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... begin + size - 1 for each pair, in a row."""
    total = int(size.sum())
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(total)
