"""Token ids of texts whose ids are those of their white-space separated words, one after the other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import common


#: Fixed value: the pattern of tokenizers whose words `letter_pieces` may cut further, if they lower-case as well.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: 0: white space, 1: letter, 2: sign that no contraction or special token contains, 3: anything else, which is never cut off.
_class = np.full(256, 3, np.uint8)
_class[[0x20, *range(9, 14)]] = 0
_class[[*range(65, 91), *range(97, 123)]] = 1
_class[list(b'!"#$%&()*+,-./:;=?@[]^_`{}~')] = 2


def letter_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased, and the words cut between letters and signs: SPLIT parts them there as well."""
    if b"<|" not in data.tobytes():  # else a special token could come about
        data = _lower[data]
    kind = _class[data]
    # two-byte characters from U+00C0 to U+027F are letters, but for the signs of multiplication and division; and the dotted
    # capital I, of which lower case makes a letter and a mark
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    lead = lead[((data[lead] != 0xC3) | (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)) & ((data[lead] != 0xC4) | (data[lead + 1] != 0xB0))]
    kind[lead] = kind[lead + 1] = 1
    edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    before, after = kind[edges - 1], kind[edges]
    starts = np.concatenate((np.zeros(int(kind[0] != 0), np.int64), edges[(before == 0) | (before + after == 3) & (before > 0) & (after > 0)]))
    ends = np.concatenate((edges[(after == 0) | (before + after == 3) & (before > 0) & (after > 0)], np.full(int(kind[-1] != 0), len(data))))
    return data, starts, ends


def plain_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return data, *common.word_spans(data)


class WordIds:
    """Remembers the ids of words in a table of fixed size.

    A word's place is given by its hash, and a later word takes the place of an earlier one.  128 bits of hashes tell whether
    a place holds the word.  Words of more than `most` ids aren't kept.
    """

    def __init__(self, kind: np.dtype, words=plain_words, slots_log2: int = 20, most: int = 8):
        n = 1 << slots_log2
        self.words, self.shift, self.most, self.kind = words, np.uint64(64 - slots_log2), most, kind
        self.keys, self.checks = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.counts, self.ids = np.zeros(n, np.uint8), np.zeros((n, most), kind)

    def encode(self, texts: list[bytes], learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each text begin and the last end.  learn: new words -> their ids, and numbers of ids."""
        data, text_starts = common.joined(texts)
        data, s, e = self.words(data) if len(data) else (data, *[np.zeros(0, np.int64)] * 2)
        first, number = common.distinct_spans(data, s, e)
        lo, hi = s[first], e[first]
        key, check = (common.span_hashes(data, lo, hi, seed) for seed in (0, 1))
        slot = (key >> self.shift).astype(np.int64)
        known = (self.keys[slot] == key) & (self.checks[slot] == check)
        counts = np.where(known, self.counts[slot], 0).astype(np.int64)
        new, raw = np.flatnonzero(~known), data.tobytes()
        learned, sizes = learn([raw[a:b] for a, b in zip(lo[new].tolist(), hi[new].tolist(), strict=True)]) if len(new) else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        counts[new] = sizes
        offsets = np.concatenate(([0], np.cumsum(counts)))
        flat = np.zeros(offsets[-1], self.kind)
        old, step = np.flatnonzero(known), np.arange(self.most)
        used = step < counts[old, None]
        flat[(offsets[old, None] + step)[used]] = self.ids[slot[old]][used]
        ends = np.cumsum(sizes)
        flat[np.repeat(offsets[new] - (ends - sizes), sizes) + np.arange(len(learned))] = learned
        keep = sizes <= self.most
        rows, at = new[keep], slot[new[keep]]
        # of new words that share a place the last one has it, in all columns
        at, last = np.unique(at[::-1], return_index=True)
        rows = rows[::-1][last]
        self.keys[at], self.checks[at], self.counts[at] = key[rows], check[rows], counts[rows]
        used = step < counts[rows, None]
        values = np.zeros(used.shape, self.kind)
        values[used] = flat[(offsets[rows, None] + step)[used]]
        self.ids[at] = values
        each = counts[number]
        ends = np.concatenate(([0], np.cumsum(each)))
        out = flat[np.repeat(offsets[:-1][number] - ends[:-1], each) + np.arange(ends[-1])]
        return out, ends[np.searchsorted(s, text_starts)]
