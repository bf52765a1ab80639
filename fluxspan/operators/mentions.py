"""Mentions of many aliases in texts: a word automaton in flat arrays, walked from all words of a batch at once (AGG48)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Aliases of one automaton.  More are dealt to several by their hashes; the texts are read once for each.
GROUP = 200_000
#: Bytes of text that a step takes at once; a longer text is taken alone.
STEP_BYTES = 2 << 20

#: Words are runs of letters and digits, A-Z as a-z, bytes from 0x80 on as letters; all else separates them.
_words = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_words).split()


@dataclass
class AliasAutomaton:
    """vocabulary: word -> number; keys: state * size + word, sorted, and the states they lead to; ends: name of the alias that
    ends in a state, or -1; depth: words of the longest alias."""

    vocabulary: dict[bytes, int]
    keys: np.ndarray
    targets: np.ndarray
    ends: np.ndarray
    depth: int

    @classmethod
    def of(cls, aliases: list[tuple[str, int]]) -> AliasAutomaton:
        """From (alias, number of its name); of several names of one alias the smallest counts, aliases without a word none."""
        vocabulary: dict[bytes, int] = {}
        steps: dict[tuple[int, int], int] = {}
        ends, depth = [-1], 0
        for alias, name in aliases:
            state, n = 0, 0
            for n, w in enumerate(words_of(alias), 1):
                at = (state, vocabulary.setdefault(w, len(vocabulary)))
                if at not in steps:
                    steps[at] = len(ends)
                    ends.append(-1)
                state = steps[at]
            if n:
                ends[state] = name if ends[state] < 0 else min(name, ends[state])
                depth = max(depth, n)
        size = max(len(vocabulary), 1)
        keys = np.array([s * size + w for s, w in steps], np.int64)
        order = np.argsort(keys)
        return cls(vocabulary, keys[order], np.array(list(steps.values()), np.int64)[order], np.array(ends, np.int64), depth)

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, number of words, name) of every occurrence, by text, first word and length."""
        get = self.vocabulary.get
        ids = [np.fromiter((get(w, -1) for w in words_of(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        sizes = np.array([len(i) for i in ids], np.int64)
        # a word that no alias has between texts
        flat = np.concatenate([np.append(i, -1) for i in ids]) if ids else np.zeros(0, np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        size, out = max(len(self.vocabulary), 1), []
        at = np.flatnonzero(flat >= 0)
        state = np.zeros(len(at), np.int64)
        for n in range(1, self.depth + 1):
            word = flat[at + n - 1]
            key = state * size + word
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = (word >= 0) & (self.keys[place] == key)
            at, state = at[go], self.targets[place[go]]
            hit = self.ends[state] >= 0
            out.append((at[hit], np.full(hit.sum(), n), self.ends[state[hit]]))
        first, n, name = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((n, first))
        first, n, name = first[order], n[order], name[order]
        text = np.searchsorted(begins, first, side="right") - 1
        return text, first - begins[text], n, name


def longest(text: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which occurrences stay if none may overlap: from the left, of those that begin at a word the longest."""
    keep, last, k = [], (-1, 0), 0
    while k < len(text):
        j = k  # of those with one beginning the last is the longest
        while j + 1 < len(text) and text[j + 1] == text[k] and first[j + 1] == first[k]:
            j += 1
        if text[j] != last[0] or first[j] >= last[1]:
            keep.append(j)
            last = (text[j], first[j] + n[j])
        k = j + 1
    return np.array(keep, np.int64)


def alias_mentions(texts: DataFrame, aliases: DataFrame, article: str = "article", text: str = "text", overlaps: str = "all") -> DataFrame:
    """name, mention_count, n_articles and articles (sorted, joined by `;`) of the names that are mentioned (AGG48).

    aliases: alias, name.  An alias is found where its words stand one after another, whatever their case and what separates
    them; a part of a word is no word.  overlaps: `all` counts every occurrence of every alias; `longest` none that overlaps
    another, the leftmost and of these the longest first (for up to GROUP aliases).  Null texts and aliases have no words.
    """
    spark = texts.sparkSession
    rows = aliases.where("alias is not null and name is not null").groupBy("alias").agg(F.min(F.col("name").cast("string")).alias("name"))
    groups = max(1, -(-rows.count() // GROUP))
    if overlaps == "longest" and groups > 1:
        raise ValueError(f"overlaps can be resolved among {GROUP} aliases")
    parts = []
    for g in range(groups):
        own = rows.where(F.pmod(F.xxhash64("alias"), F.lit(groups)) == g) if groups > 1 else rows
        got = own.orderBy("name", "alias").collect()  # about GROUP rows
        names = sorted({r.name for r in got})
        number = {n: k for k, n in enumerate(names)}
        if got:
            shared = spark.sparkContext.broadcast((AliasAutomaton.of([(r.alias, number[r.name]) for r in got]), names))  # bounded by GROUP
            parts.append(_counted(texts, shared, article, text, overlaps))
    if not parts:
        return spark.createDataFrame([], "name string, mention_count long, n_articles long, articles string")
    per = reduce(DataFrame.unionByName, parts).groupBy("name", "article").agg(F.sum("n").alias("n"))
    return per.groupBy("name").agg(F.sum("n").alias("mention_count"), F.count("*").alias("n_articles"), F.array_join(F.array_sort(F.collect_set("article")), ";").alias("articles"))


def _counted(texts: DataFrame, shared, article: str, text: str, overlaps: str) -> DataFrame:
    """name, article, n: occurrences summed in the task for each step."""

    def work(batches):
        automaton, names = shared.value
        for b in batches:
            articles, all_texts = b.column("article").to_pylist(), b.column("text").to_pylist()
            lo = 0
            while lo < len(all_texts):
                hi, size = lo, 0
                while hi < len(all_texts) and (hi == lo or size + len(all_texts[hi] or "") <= STEP_BYTES):
                    size += len(all_texts[hi] or "")
                    hi += 1
                owner, first, n, name = automaton.found(all_texts[lo:hi])
                if overlaps == "longest":
                    keep = longest(owner, first, n)
                    owner, name = owner[keep], name[keep]
                where, code = np.unique(np.array([str(a) if a is not None else "" for a in articles[lo:hi]]), return_inverse=True)
                pair, count = np.unique(code[owner] * len(names) + name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in (pair % len(names)).tolist()], pa.string()), pa.array(where[pair // len(names)].tolist(), pa.string()), pa.array(count)], ["name", "article", "n"])
                lo = hi

    rows = texts.select(F.col(article).cast("string").alias("article"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "name string, article string, n long")
