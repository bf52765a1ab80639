"""The tokenizers library inside tasks: whole texts, or each different white-space separated word of a chunk once."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from .word_ids import SPLIT, WordIds, letter_pieces, plain_words


class LibraryEncoder:
    """Ids of texts as packed little-endian integers of `width` bytes.

    words_apart: for tokenizers that drop white space, so that a text's ids are its words' ids one after the other; then
    each different word of a chunk is encoded once, and words that were seen lately aren't encoded again.  Others encode
    whole texts.  literal: strings of special tokens are plain text.
    """

    def __init__(self, path: str, words_apart: bool = False, literal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = literal
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        self.words_apart, self.words = words_apart, None
        if words_apart:
            spec = json.loads(self.library.to_str())
            known = any(n["type"] == "Lowercase" for n in (spec["normalizer"] or {}).get("normalizers", [])) and [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])][:1] == [SPLIT]
            self.words = WordIds(self.kind, letter_pieces if known else plain_words)

    def _coded(self, texts: list[bytes], most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their numbers."""
        flat, counts = array(self.code), []
        for lo in range(0, len(texts), most):  # the library's results are large
            for e in self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[lo : lo + most]], add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                counts.append(len(ids))
        return np.frombuffer(flat, self.kind), np.array(counts, np.int64)

    def encode(self, texts: list[bytes], stop: bytes = b"") -> list[bytes]:
        """The ids of each text, and `stop`."""
        if self.words_apart:
            ids, ends = self.words.encode(texts, self._coded)
        else:
            ids, counts = self._coded(texts)
            ends = np.concatenate(([0], np.cumsum(counts)))
        at, out = (ends * self.width).tolist(), ids.tobytes()
        return [out[a:b] + stop for a, b in zip(at, at[1:], strict=False)]


_encoders: dict[tuple, LibraryEncoder] = {}


def encoder(path: str, words_apart: bool = False, literal: bool = False) -> LibraryEncoder:
    key = path, words_apart, literal
    if key not in _encoders:
        _encoders[key] = LibraryEncoder(*key)
    return _encoders[key]
