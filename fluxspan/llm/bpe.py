"""BPE encoding and decoding by speculation: greedy longest match, pair checks, exact merging for the rest.

A token sequence is what BPE gives exactly if each token stands for its own string and each adjacent pair survives when
it is encoded alone, so a proposal can be checked pair by pair.  Only words that fail are merged step by step.
Encoding a text is encoding its white-space separated words, each different word once per task.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .word_ids import SPLIT, WordIds, letter_pieces, plain_words

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed values of the file format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LongTable:
    """Non-negative long keys to long values, looked up many at a time: open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        size = 1 << self.bits
        self.keys, self.values, self.reach = np.full(size, -1, np.int64), np.full(size, -1, np.int64), 0
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = todo[self.keys[at] < 0]
            spots, first = np.unique(at[self.keys[at] < 0], return_index=True)
            self.keys[spots], self.values[spots] = keys[free[first]], values[free[first]]
            left = np.setdiff1d(todo, free[first], assume_unique=True)
            at = (self._home(keys[left]) + self.reach + 1) & (size - 1)
            self.reach += len(left) > 0
            todo = left

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        live = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.reach):
            if not len(live):
                break
            at[live] = (at[live] + 1) & (len(self.keys) - 1)
            found = self.keys[at[live]]
            hit = found == keys[live]
            out[live[hit]] = self.values[at[live[hit]]]
            live = live[~hit & (found >= 0)]
        return out


class SpeculativeBPE:
    """Encoder and decoder for a byte-level BPE file with word ends (`end_of_word_suffix`), ids in order of merges.

    The steps before merging (NFC, lower case, splitting) are done here for characters below U+0250, where all Unicode
    versions agree, and by the file's own normaliser and splitter for words with others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.strings = [self.tokens.get(i, "").encode() for i in range(max(self.tokens) + 1)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        byte_of = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.inner, self.final = {}, {}
        for t, i in vocab.items():
            if self.end and t.endswith(self.end):
                self.final[raw(t[: -len(self.end)])] = i
            else:
                self.inner[raw(t)] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        # merges: pair -> token, and for each token the pair it is made of
        size = max(self.tokens) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.size, self.made = size, {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.made[x, y] = t
            self.left[t], self.right[t] = x, y
        keys = np.array([x * size + y for x, y in self.made], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_tokens = keys[order], np.array(list(self.made.values()), np.int64)[order]
        self.merge_of = LongTable(self.pair_keys, self.pair_tokens)
        self._build_trie()
        self._byte_of = byte_of
        self.byte_inner = np.array([self.inner[bytes([b])] for b in range(256)], np.int64)
        self.byte_final = np.array([self.final.get(bytes([b]), -1) for b in range(256)], np.int64)
        # whether a token is what BPE makes of its own string: only such tokens may be proposed
        self.stands = np.ones(size, bool)
        self.stands[sorted(vocab.values())] = False
        for table, last in ((self.inner, False), (self.final, True)):
            raws, ids = list(table), np.array(list(table.values()), np.int64)
            ends = np.cumsum([len(r) for r in raws])
            end, self.end = self.end, self.end if last else ""
            owner, got = self.merge_many(np.frombuffer(b"".join(raws), np.uint8), np.concatenate(([0], ends[:-1])), ends)
            self.end = end
            single = np.bincount(owner, minlength=len(raws)) == 1
            first = np.searchsorted(owner, np.arange(len(raws)))
            self.stands[ids] = single & (got[np.minimum(first, len(got) - 1)] == ids)
        self.words = WordIds(np.dtype("<u4"), letter_pieces if self.split.pattern == SPLIT else plain_words)
        self.spaced = [t + b" " for t in self.strings]

    # -- one word ----------------------------------------------------------------------------------------------
    def merge(self, word: bytes, last: bool = True) -> list[int]:
        """Exact BPE of one split word: the earliest merge first, from the left."""
        ids = [self.inner[word[i : i + 1]] for i in range(len(word))]
        if last and self.end:
            ids[-1] = self.final[word[-1:]]
        while len(ids) > 1:
            best = min((self.made.get(p, self.size) for p in zip(ids, ids[1:], strict=False)))
            if best == self.size:
                break
            x, y, out, i = int(self.left[best]), int(self.right[best]), [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == x and ids[i + 1] == y:
                    out.append(best)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _build_trie(self) -> None:
        """States for all prefixes of token strings; byte 256 is the word end."""
        states, keys, values, ends = {b"": 0}, [], [], {}
        for table, last in ((self.inner, False), (self.final, True)):
            for raw, token in table.items():
                at = 0
                for n in range(1, len(raw) + 1):
                    to = states.setdefault(raw[:n], len(states))
                    if n == len(raw) and not last:
                        ends[to] = token
                    at = to
                if last:
                    ends[-1 - at] = token
        for raw, to in states.items():
            if raw:
                keys.append(states[raw[:-1]] * 256 + raw[-1])
                values.append(to)
        self.step = LongTable(np.array(keys, np.int64), np.array(values, np.int64))
        self.ends_inner, self.ends_final = np.full(len(states), -1, np.int64), np.full(len(states), -1, np.int64)
        for at, token in ends.items():
            if at >= 0:
                self.ends_inner[at] = token
            else:
                self.ends_final[-1 - at] = token

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: (word, token), sorted by word and position."""
        owners, tokens, places = [], [], []
        words, at = np.arange(len(starts)), starts.copy()
        while len(words):
            end = ends[words]
            state, pos, live = np.zeros(len(words), np.int64), at.copy(), np.arange(len(words))
            best, to = np.full(len(words), -1, np.int64), at.copy()
            while len(live):
                nxt = self.step(state[live] * 256 + data[pos[live]])
                live, nxt = live[nxt >= 0], nxt[nxt >= 0]
                state[live] = nxt
                pos[live] += 1
                last = pos[live] == end[live]
                token = np.where(last, self.ends_final[nxt] if self.end else self.ends_inner[nxt], self.ends_inner[nxt])
                hit = token >= 0
                best[live[hit]], to[live[hit]] = token[hit], pos[live[hit]]
                live = live[~last]
            owners.append(words)
            tokens.append(best)
            places.append(at)
            more = to < end
            words, at = words[more], to[more]
        owner, token, place = np.concatenate(owners), np.concatenate(tokens), np.concatenate(places)
        order = np.argsort(place, kind="stable")
        return owner[order], token[order]

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words, one merge of each word in a step, the earliest merge and then the leftmost first: (word, token)."""
        lengths = ends - starts
        owner = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[owner]
        ids = self.byte_inner[data[at]]
        if self.end:
            final = at == ends[owner] - 1
            ids[final] = self.byte_final[data[at[final]]]
        done_owner, done_ids = [], []
        while len(ids):
            rank = np.full(len(ids), self.size, np.int64)
            same = owner[1:] == owner[:-1]
            made = self.merge_of(ids[:-1][same] * self.size + ids[1:][same])
            rank[:-1][same] = np.where(made >= 0, made, self.size)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            counts = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            idle = np.repeat(best == self.size, counts)
            if idle.any():
                done_owner.append(owner[idle])
                done_ids.append(ids[idle])
                busy = ~idle
                ids, owner, rank = ids[busy], owner[busy], rank[busy]
                counts, best = counts[best < self.size], best[best < self.size]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, counts))
            one = np.concatenate(([True], owner[hits][1:] != owner[hits][:-1]))  # the leftmost of each word
            hits = hits[one]
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ids, owner = ids[keep], owner[keep]
        owner, ids = np.concatenate([*done_owner, np.zeros(0, np.int64)]), np.concatenate([*done_ids, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return owner[order], ids[order]

    # -- many words --------------------------------------------------------------------------------------------
    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For many pairs of tokens: whether no merge reaches across their border.

        Undoes the later of the two merges at the border again and again; a merge across the border that comes before
        the one just undone would have been taken instead.
        """
        a, b, n = first.copy(), second.copy(), len(first)
        limit, ok, live = np.full(n, np.iinfo(np.int64).max), np.ones(n, bool), np.arange(n)
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_tokens[at] < limit[live])
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            undo_left = (x > y) & (self.right[x] >= 0) | (self.left[y] < 0) & (self.right[x] >= 0)
            undo_right = ~undo_left & (self.left[y] >= 0)
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_right, self.left[y], y)
            live = live[undo_left | undo_right]
        return ok

    def encode_split(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of many split words, none of them empty."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        owner, flat = self.propose(data, starts, ends)
        inside = owner[1:] == owner[:-1]
        keys = (flat[:-1] * self.size + flat[1:])[inside]
        wrong = np.zeros(len(words), bool)
        if len(keys):
            pairs, where = np.unique(keys, return_inverse=True)
            wrong[owner[:-1][inside][~self.compatible(pairs // self.size, pairs % self.size)[where]]] = True
        wrong[owner[~self.stands[flat]]] = True
        failed = np.flatnonzero(wrong)
        self.failed = len(failed)
        if self.failed:
            again, merged = self.merge_many(data, starts[failed], ends[failed])
            good = ~wrong[owner]
            owner, flat = np.concatenate((owner[good], failed[again])), np.concatenate((flat[good], merged))
            order = np.argsort(owner, kind="stable")
            owner, flat = owner[order], flat[order]
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def parts(self, word: str) -> list[str]:
        """The split words of one white-space separated word; its special tokens stay whole."""
        if max(word) < "ɐ":
            return self.split.findall(unicodedata.normalize("NFC", word).lower())
        text = self.library.normalizer.normalize_str(word)
        letter = self._byte_of
        return [bytes(letter[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, and their numbers."""
        todo, plan, flat, counts = {}, [], [], []
        for w in words:
            s, items = w.decode("utf-8", "replace"), []
            for i, piece in enumerate(self.special_re.split(s) if "<|" in s and self.special_re else [s]):
                if i % 2:
                    items.append(self.special[piece])
                elif piece:
                    for p in self.parts(piece):
                        items.append(todo.setdefault(p.encode(), ~len(todo)))
            plan.append(items)
        coded = self.encode_split(list(todo))
        for items in plan:
            before = len(flat)
            for x in items:
                if x < 0:
                    flat += coded[~x]
                else:
                    flat.append(x)
            counts.append(len(flat) - before)
        return np.array(flat, "<u4"), np.array(counts, np.int64)

    def decode(self, ids) -> str:
        """The tokens, joined by blanks: the file has no decoder."""
        return " ".join(self.tokens[i] for i in ids)

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        ids, ends = self.words.encode(texts, self.learn)
        decoded, to = common.gathered(self.spaced, ids)
        raw, at, to = ids.tobytes(), (4 * ends).tolist(), to[ends].tolist()
        return [(raw[at[k] : at[k + 1]], decoded[to[k] : max(to[k], to[k + 1] - 1)]) for k in range(len(texts))]


_coders: dict[str, SpeculativeBPE] = {}


def coder(path: str) -> SpeculativeBPE:
    if path not in _coders:
        _coders[path] = SpeculativeBPE(path)
    return _coders[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every document: doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    Null or empty text: no ids, empty decoded text.  Each row stands alone, so repeated rows give repeated results.
    """

    def work(batches):
        bpe = coder(path)
        for b in common.chunks(batches):
            coded = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary())], ["doc_id", "ids", "decoded"])

    return common.documents(docs, id_col, text_col).mapInArrow(work, "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `encode_decode` with digests made in the same task."""

    def work(batches):
        bpe = coder(path)
        for b in common.chunks(batches):
            coded = bpe.encode(b.column("text").to_pylist())
            sha = lambda k: pa.array([hashlib.sha256(c[k]).hexdigest() for c in coded], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(c[0]) // 4 for c in coded], pa.int64()), sha(0), sha(1)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.documents(docs, id_col, text_col).mapInArrow(work, SCHEMA)
