"""Conversation repair against enumeration of all edits, against SQL, and in ranges of any size."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxspan.llm import conversations as con

PATTERN = re.compile(r"(s?(ua)+)?")


def enumerated(rows):
    """Cheapest and least audit among all edits: rows are (initial, must go, truncated)."""
    best = (10**9, "")

    def go(i, roles, audit, cost):
        nonlocal best
        if cost > best[0] or not re.fullmatch(r"(s?(ua)*u?)?|s", roles):
            return
        if i == len(rows) and PATTERN.fullmatch(roles):
            best = min(best, (cost, audit))
        for r in "ua":
            go(i, roles + r, audit + "I", cost + 3)
        if i < len(rows):
            k, bad, cut = rows[i]
            go(i + 1, roles, audit + "D", cost + 4)
            if not bad:
                go(i + 1, roles + k, audit + "K", cost + 3 * cut)
                for r in "ua":
                    go(i + 1, roles + r, audit + "R", cost + 3 + 3 * cut)

    best = (4 * len(rows) + 1, "~")
    go(0, "", "", 0)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_cheapest(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("sua t"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
    assert con.final(con.cheapest(rows)) == enumerated(rows)


@pytest.mark.parametrize("mod", [con._PRIME, 7, 2])
def test_persistent_audits(mod):
    """Order and first differences, with hashes that collide often too."""
    rng = random.Random(mod)
    audits, texts = con.PersistentAudits(mod), [""]
    for _ in range(400):
        node = rng.randrange(max(0, len(texts) - 12), len(texts))
        letter = rng.choice("DIKR")
        assert audits.add(node, letter) == len(texts)
        texts.append(texts[node] + letter)
    for _ in range(3000):
        x, y = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert audits.less(x, y) == (texts[x] < texts[y]) and audits.text(x) == texts[x]


def brute(rows):
    """Rows of (conv_id, turn, role, text), in order of their ranks; what the report must be."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, [])
        m = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        r, x = "user" if m == 4 else r, "" if m == 1 else re.sub("[.!?]", "", x) if m == 2 else x
        out[c] += [] if m == 0 else [(t, r, x)] * (1 + (m == 3))
    for c, got in out.items():
        got.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        seen, n, small = set(), [0, 0, 0], []
        for _, r, x in got:
            last = re.sub(r"[\x20\x09-\x0D]", "", x)[-1:]
            kinds = [last == "", (r, x) in seen, last not in (".", "!", "?")]
            first = kinds.index(True) if True in kinds else 3
            if first < 3:
                n[first] += 1
            seen.add((r, x))
            small.append((r[:1], first < 2, first == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(small, small[1:], strict=False))
        turns = {t for t, _, _ in got if t is not None}
        cost, audit = con.final(con.cheapest(small))
        lines, state, k = [], "", 0
        for e in audit:
            want = "assistant" if state == "u" else "user"
            if e == "I":
                lines.append(f"{want}:")
                state = want[0]
                continue
            _, r, x = got[k]
            k += 1
            if e != "D":
                r = want if e == "R" else r
                lines.append(f"{r}:{x}")
                state = r[0]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), None, 1000]:
        size = 250 if c == 1000 else rng.randint(1, 9)
        for k in range(size):
            role = rng.choice(["system"] if k == 0 and rng.random() < 0.4 else [("user", "assistant")[k % 2]] * 8 + ["tool", None, "user"])
            text = rng.choice([f"Words {rng.randint(0, 5)}.", f"é {k}!", f"cut {k}", "", " \t\n", None, "End?  \n"])
            rows.append((c, rng.choice([k] * 12 + [None, k + 3]), role, text))
    rows += [(7, 2, "user", "Twice.")] * 40  # repeated rows of one turn
    return rows


def as_dict(df):
    got = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_report(spark, monkeypatch, parts):
    rows = odd_rows(parts)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("x")).withColumn("pos", F.lit(1))
    want = brute(rows)
    sort = con._sorted_runs
    monkeypatch.setattr(con, "_sorted_runs", lambda r, n, texts: sort(r, parts, texts))  # conversations cross many borders
    assert as_dict(con.repair_report(df)) == want
    full = con.repair(con.damaged(df), texts=True).collect()
    assert {r.conv_id: hashlib.sha256(r.repaired.encode()).hexdigest() for r in full} == {c: v[-1] for c, v in want.items()}


def test_equals_sql(spark):
    rows = odd_rows(5) + odd_rows(6)[:100]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    db = duckdb.connect()
    db.register("conversations", df.toArrow())
    names = ["conv_id", *con.COUNTS, "audit", "repaired_sha256"]
    assert {tuple(r) for r in con.repair_report(df).select(names).collect()} == set(db.sql(f"select {', '.join(names)} from ({con.report_sql()})").fetchall())


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert con.repair_report(spark.createDataFrame([], schema)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = con.repair_report(spark.createDataFrame([(dropped, 0, "user", "Gone.")], schema)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
