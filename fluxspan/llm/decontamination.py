"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training words stream through the automaton, which tracks the longest match that ends at each word.  Words that no item
has, and pairs of neighbours that no item has, can't be inside a window; a vectorised look-up leaves only stretches that
may match, and the automaton reads those.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import get, put

#: Item words, about, in one automaton; further items go to further automata, which a task takes one after another.
AUTOMATON_WORDS = 200_000
#: Bytes of text that a task holds while it goes through several automata.
HELD_BYTES = 64 << 20

_gap = np.ones(256, bool)
_gap[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of letters a-z, digits and non-ASCII characters."""
    data = _lower[np.frombuffer(text or b"", np.uint8)]
    s, e = common.word_spans(data, _gap) if len(data) else ([], [])
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)] if len(data) else []


class SuffixAutomaton:
    """Generalised suffix automaton over words; states know the items that contain their strings."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]
        self.names, self.short = [], {}
        self.owners: list[set[int]] = [set()]
        states_of = []
        for name, words in items:
            if not words:
                continue
            number, last = len(self.names), 0
            self.names.append(name)
            for w in words:
                last = self._extend(last, w)
            states_of.append((number, words))
        for number, words in states_of:
            at = 0
            for w in words:
                at = self.next[at][w]
                up = at
                while up > 0 and number not in self.owners[up]:
                    self.owners[up].add(number)
                    up = self.link[up]
            if len(words) < window:
                self.short.setdefault(at, []).append((len(words), number))
        # the nearest state up the links, itself included, at which a short item ends
        self.short_above = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.short_above[s] = s if s in self.short else self.short_above[self.link[s]] if s else -1
        least = [len(w) for _, w in states_of]
        self.least = min(window, *least) if least else window
        every = [w for _, words in states_of for w in words]
        self.vocabulary = np.unique(_hashes(sorted(set(every)))) if every else np.zeros(0, np.uint64)
        pairs = {p for _, words in states_of for p in zip(words, words[1:], strict=False)}
        a, b = _hashes([p[0] for p in pairs]), _hashes([p[1] for p in pairs])
        self.pairs = np.unique(pair_hash(a, b))

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: bytes) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _state(self, length: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.owners.append(set())
        return len(self.next) - 1

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words inside windows, and the items whose windows occur."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        at = matched = 0
        spans, items = [], set()
        for i, w in enumerate(words):
            while at and w not in nxt[at]:
                at = link[at]
                matched = length[at]
            to = nxt[at].get(w)
            if to is None:
                matched = 0
                continue
            at, matched = to, matched + 1
            if matched >= window:
                spans.append((i + 1 - matched, i + 1))
                up = at
                while length[link[up]] >= window:
                    up = link[up]
                items |= self.owners[up]
            if self.short:
                up = self.short_above[at]
                while up > 0:
                    for n, item in self.short.get(up, ()):
                        if n <= matched:
                            spans.append((i + 1 - n, i + 1))
                            items.add(item)
                    up = self.short_above[link[up]]
        return spans, items


def _hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
    return common.span_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64) if words else ends, ends)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return common.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def match_chunk(texts: list[bytes], auto: SuffixAutomaton) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Words of each text; for texts with hits, merged spans of words and items."""
    data, text_starts = common.joined(texts)
    data = _lower[data]
    s, e = common.word_spans(data, _gap) if len(data) else (np.zeros(0, np.int64),) * 2
    doc = np.searchsorted(text_starts, s, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    found: dict[int, tuple[list, set]] = {}
    if not len(s) or not len(auto.vocabulary):
        return n_words, found
    h = common.span_hashes(data, s, e)
    known = _member(h, auto.vocabulary)
    # stretches of known words; from two words on, each neighbouring pair must be one of an item as well
    tied = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
    if auto.least > 1:
        some = np.flatnonzero(tied)
        tied[some] = _member(pair_hash(h[:-1][some], h[1:][some]), auto.pairs)
    new = np.ones(len(s), bool)
    new[1:] = ~tied
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(s)))
    take = (size >= auto.least) & known[head]
    first_word = np.searchsorted(s, text_starts[:-1])
    raw = data.tobytes()
    for lo, n in zip(head[take].tolist(), size[take].tolist(), strict=True):
        words = [raw[a:b] for a, b in zip(s[lo : lo + n].tolist(), e[lo : lo + n].tolist(), strict=True)]
        spans, items = auto.stream(words)
        if spans:
            d = int(doc[lo])
            base = lo - int(first_word[d])
            have = found.setdefault(d, ([], set()))
            have[0].extend((a + base, b + base) for a, b in spans)
            have[1].update(items)
    for spans, _ in found.values():
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        spans[:] = merged
    return n_words, found


def item_groups(items: DataFrame, id_col: str, text_col: str, limit: int = AUTOMATON_WORDS) -> list[str]:
    """Writes the items in groups of at most about `limit` words, and returns the files: none passes through the driver."""
    it = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).where("text is not null").distinct()
    size = it.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, base = max(1, -(-size // (6 * limit))), common.folder(items.sparkSession)

    def write(group: pa.Table) -> pa.Table:
        uri = f"{base}/items-{group.column('g')[0].as_py():06d}"
        rows = sorted(zip(group.column("id").to_pylist(), group.column("text").to_pylist(), strict=True))
        put(uri, pickle.dumps([(name, normal_words(text)) for name, text in rows]))
        return pa.table([pa.array([uri])], ["uri"])

    dealt = it.withColumn("g", F.expr(f"cast(pmod(xxhash64(id, text), {groups}) as int)")).groupBy("g").applyInArrow(write, "uri string")
    return sorted(r.uri for r in dealt.collect())  # names of files alone


_automata: dict[tuple[str, int], SuffixAutomaton] = {}


def automaton(uri: str, window: int) -> SuffixAutomaton:
    """The automaton of a group of items; a worker keeps the last one."""
    if (uri, window) not in _automata:
        _automata.clear()
        _automata[uri, window] = SuffixAutomaton(pickle.loads(get(uri)), window)
    return _automata[uri, window]


def matched(batches, uris: list[str], window: int):
    """(chunk, words of each text, spans and item names of texts with hits) for all chunks; `text` holds the texts.

    Several automata: chunks are held up to HELD_BYTES, so that each is loaded once for many chunks.
    """

    def passed(held):
        found: list[dict[int, tuple[list, set]]] = [{} for _ in held]
        counts = [np.zeros(c.num_rows, np.int64) for c in held]
        for uri in uris:
            auto = automaton(uri, window)
            for k, c in enumerate(held):
                counts[k], new = match_chunk(c.column("text").to_pylist(), auto)
                for d, (spans, hit) in new.items():
                    have = found[k].setdefault(d, ([], set()))
                    have[0].extend(spans)
                    have[1].update(auto.names[i] for i in hit)
        if not uris:
            counts = [match_chunk(c.column("text").to_pylist(), SuffixAutomaton([], window))[0] for c in held]
        yield from zip(held, counts, found, strict=True)

    held, size = [], 0
    for c in common.chunks(batches):
        held.append(c)
        size += c.column("text").nbytes
        if len(uris) < 2 or size > HELD_BYTES:
            yield from passed(held)
            held, size = [], 0
    yield from passed(held)


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_WORDS) -> DataFrame:
    """Each document with the spans of words inside item windows: n_words, starts, ends (words), items (sorted ids).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.  Null or empty
    text: no words.  Items without words match nothing; repeated items count once; a null item id is the empty string.
    Repeated documents have the same result; an empty table gives no rows.
    """
    uris = item_groups(items, item_id, item_text, limit)

    def work(batches):
        for b, n_words, found in matched(batches, uris, window):
            starts, ends, names = ([[] for _ in range(b.num_rows)] for _ in range(3))
            for d, (spans, hit) in found.items():
                starts[d], ends[d], names[d] = [x for x, _ in spans], [x for _, x in spans], sorted(hit)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "starts", "ends", "items"])

    return common.documents(docs, id_col, text_col).mapInArrow(work, "doc_id long, text binary, n_words long, starts array<int>, ends array<int>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated: as `matches`."""
    uris, none = item_groups(items, item_id, item_text, limit), hashlib.sha256(b"").hexdigest()

    def work(batches):
        for b, n_words, found in matched(batches, uris, window):
            hits, n_items, sha = [0] * b.num_rows, [0] * b.num_rows, [none] * b.num_rows
            for d, (spans, names) in found.items():
                last = 0
                for x, y in sorted(spans):
                    hits[d] += max(0, y - max(x, last))
                    last = max(last, y)
                n_items[d], sha[d] = len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return common.documents(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut(text: bytes, n_words: int, spans: list[tuple[int, int]], max_coverage: float) -> bytes | None:
    """The text without its spans of words, each from its first word's first byte to its last word's last; None if they
    cover more than `max_coverage` of the words."""
    mask = np.zeros(n_words, bool)
    for x, y in spans:
        mask[x:y] = True
    if mask.sum() > max_coverage * n_words:
        return None
    s, e = common.word_spans(_lower[np.frombuffer(text, np.uint8)], _gap)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    at, left = 0, []
    for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        left.append(text[at : int(s[x])])
        at = int(e[y - 1])
    return b"".join([*left, text[at:]])


def clean_rows(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", chars_col: str | None = "n_chars", item_id: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_WORDS) -> DataFrame:
    """All columns of `docs`, texts without the spans inside item windows; rows whose words are covered by more than
    `max_coverage` go.  Rows without hits are unchanged, those with null texts too; in others `chars_col`, if given, is set
    to the new length.  Repeated rows are treated alike; an empty table gives no rows.

    All items are matched on the unchanged text; the spans of all are cut at once.
    """
    uris = item_groups(items, item_id, item_text, limit)

    def work(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            small = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(at).cast(pa.binary())], ["row", "text"])
            for c, n_words, found in matched([small], uris, window):
                rows, texts = c.column("row").to_pylist(), c.column("text").to_pylist()
                part = b.slice(rows[0], len(rows)) if rows else b.slice(0, 0)
                if found:
                    new = {d: cut(texts[d], int(n_words[d]), spans, max_coverage) for d, (spans, _) in found.items()}
                    old = part.column(at).to_pylist()
                    values = [new[d].decode("utf-8", "replace") if new.get(d) is not None else t for d, t in enumerate(old)]
                    part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
                    if chars_col in part.schema.names:
                        k = part.schema.get_field_index(chars_col)
                        sizes = [len(values[d]) if new.get(d) is not None else v for d, v in enumerate(part.column(k).to_pylist())]
                        part = part.set_column(k, part.schema.field(k), pa.array(sizes, part.schema.field(k).type))
                    part = part.filter(pa.array([not (d in new and new[d] is None) for d in range(part.num_rows)]))
                yield part

    return docs.mapInArrow(work, docs.schema)
