"""Token ids of whole texts by a public tokenizer, inside Spark tasks."""

from __future__ import annotations

import os
from array import array

import numpy as np

from .common import SPACE_TABLE, Words, splitter

#: Distinct words whose ids a Python worker remembers; then it starts afresh.
REMEMBERED = 400_000
TABLE_BITS = 20
END_ID = 2

# Letters as bytes: a to z, and those of U+00C0 to U+00FF, which begin with C3; U+00D7 and U+00F7 are signs.
_LETTERS = bytes([*range(97, 123), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))])
_AZ = splitter(bytes(range(97, 123)))
_SIGN = splitter(bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"))
_TAIL = splitter(bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)))


def cut_at_borders(words: Words) -> None:
    """Cuts lower-cased words between letters and ASCII signs."""
    data = words.data
    before, here = data[:-1], data[1:]
    wide = (before == 0xC3) & _TAIL[here]  # a letter of two bytes begins at before and ends at here
    ends = _AZ[before]
    ends[1:] |= wide[:-1]
    begins = _AZ[here]
    begins[:-1] |= wide[1:]
    sign = _SIGN[data]
    cuts = np.flatnonzero((ends & sign[1:]) | (sign[:-1] & begins)) + 1
    words.starts = np.sort(np.concatenate([words.starts, cuts]))
    words.ends = np.sort(np.concatenate([words.ends, cuts]))
    words.doc = np.searchsorted(words.first, words.starts, side="right") - 1
    words.count = np.bincount(words.doc, minlength=len(words.count)).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, which every machine has with the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts word by word.

    The tokenizer's own patterns never cross white space, nor the border between a letter and ASCII
    punctuation other than the apostrophe, and it lower-cases. So the ids of a text are those of its
    lower-cased pieces between these borders, one after the other. Each distinct piece is encoded once:
    pieces of letters alone many at a time, as their ids are told apart by the end-of-word mark. Known
    pieces are found in a table of 2 ** TABLE_BITS places by their hash, without sorting; the rest by a
    dictionary. Where a special token's string may stand, texts are cut at white space only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])
        self.table_key = np.zeros(1 << TABLE_BITS, dtype=np.uint64)
        self.table_slot = np.zeros(1 << TABLE_BITS, dtype=np.int32)

    def _encode_pieces(self, pieces: list[bytes]) -> list:
        """Each piece's ids."""
        out: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if not p.translate(None, _LETTERS)]
        for a in range(0, len(plain), 512):
            some = plain[a : a + 512]
            ids = self.tokenizer.encode(b" ".join([pieces[i] for i in some]).decode(), add_special_tokens=False).ids
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer's words don't end with </w>")
            first = 0
            for i, end in zip(some, ends.tolist(), strict=True):
                out[i] = ids[first:end]
                first = end
        rest = [i for i in range(len(pieces)) if out[i] is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _slots(self, words: Words) -> np.ndarray:
        """The place of each word's ids in self.ends."""
        h = words.hashes()
        h[h == 0] = 1  # 0 marks a free place
        place = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = self.table_slot[place]
        missed = np.flatnonzero(self.table_key[place] != h)
        if len(missed):
            kinds, at, kind = np.unique(h[missed], return_index=True, return_inverse=True)
            keys = kinds.tolist()
            new = [i for i, k in enumerate(keys) if k not in self.slot]
            for i, ids in zip(new, self._encode_pieces([words.word(missed[at[i]]) for i in new]), strict=True):
                self.slot[keys[i]] = len(self.ends) - 1
                self.ids.extend(ids)
                self.ends.append(len(self.ids))
            slots = np.fromiter((self.slot[k] for k in keys), dtype=np.int32, count=len(keys))
            out[missed] = slots[kind]
            place = (kinds >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            free = self.table_key[place] == 0  # who comes first stays: common words come early
            place, first = np.unique(place[free], return_index=True)
            self.table_key[place], self.table_slot[place] = kinds[free][first], slots[free][first]
        return out

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and each text's number of them."""
        if len(self.slot) > REMEMBERED:
            self.forget()
        special = any(t and "<|" in t for t in texts)
        words = Words(texts, SPACE_TABLE, ascii_lower=not special)
        if not special:
            cut_at_borders(words)
        slots = self._slots(words)
        ends = np.frombuffer(self.ends, dtype=np.int64)
        first = ends[slots]
        size = ends[slots + 1] - first
        sums = np.concatenate([[0], np.cumsum(size)])
        where = np.arange(sums[-1]) + np.repeat(first - sums[:-1], size)
        ids = np.frombuffer(self.ids, dtype=np.uint32)[where] if len(where) else np.empty(0, dtype=np.uint32)
        doc_end = np.concatenate([[0], np.cumsum(words.count)])
        del ends
        return ids, sums[doc_end[1:]] - sums[doc_end[:-1]]


def encode(texts: list, path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts of the texts (null: empty), each followed by end_id."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    ids, n = _encoders[path].encode(texts)
    if end_id is None:
        return ids, n
    total = np.cumsum(n)
    return np.insert(ids, total, np.uint32(end_id)), n + 1
