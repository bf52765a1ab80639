"""The alias automaton against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxspan.operators import mentions


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, aliases, how):
    best = {}
    for a, n in aliases:
        if a is not None and n is not None and words(a):
            k = tuple(words(a))
            best[k] = min(n, best.get(k, n))
    out, where = Counter(), {}
    for article, t in texts:
        w, i = words(t), 0
        while i < len(w):
            hits = [n for n in range(1, 6) if tuple(w[i : i + n]) in best and i + n <= len(w)]
            for n in hits if how == "all" else hits[-1:]:
                name = best[tuple(w[i : i + n])]
                out[name] += 1
                where.setdefault(name, set()).add(article or "")
            i += hits[-1] if hits and how == "longest" else 1
    return {n: (c, len(where[n]), ";".join(sorted(where[n]))) for n, c in out.items()}


VOCABULARY = ["NGC", "ngc", "1380", "été", "M", "87", "of", "the", "x9", "日本"]


@pytest.mark.parametrize("how", ["all", "longest"])
def test_mentions(spark, how):
    rng = random.Random(4)
    aliases = [(" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 4))), f"n{rng.randint(0, 40)}") for _ in range(300)]
    aliases += [("NGC-1380", "n1"), ("", "n2"), (None, "n3"), ("--", "n4"), ("of", None), ("Never Seen", "n5")]
    texts = [(f"a{k % 5}", "".join(rng.choice(VOCABULARY) + rng.choice([" ", "-", ". ", "\n", ", ", ""]) for _ in range(rng.randint(0, 80)))) for k in range(60)] + [("a1", None), (None, "ngc 1380"), ("a2", ""), ("a2", "ngc 1380")]
    t = spark.createDataFrame(texts, "article string, text string").withColumn("name", F.lit("x"))
    a = spark.createDataFrame(aliases, "alias string, name string")
    got = {r.name: (r.mention_count, r.n_articles, r.articles) for r in mentions.alias_mentions(t, a, overlaps=how).collect()}
    assert got == brute(texts, aliases, how)
    assert mentions.alias_mentions(t, a.limit(0)).count() == 0 and mentions.alias_mentions(t.limit(0), a).count() == 0


def test_groups_of_aliases(spark, monkeypatch):
    texts = [("a", "one two three four"), ("b", "two three")]
    aliases = [("one", "x"), ("two three", "y"), ("three four", "x"), ("three", "z")]
    t, a = spark.createDataFrame(texts, "article string, text string"), spark.createDataFrame(aliases, "alias string, name string")
    monkeypatch.setattr(mentions, "GROUP", 1)
    assert {r.name: (r.mention_count, r.n_articles, r.articles) for r in mentions.alias_mentions(t, a).collect()} == brute(texts, aliases, "all")
    with pytest.raises(ValueError):
        mentions.alias_mentions(t, a, overlaps="longest")
