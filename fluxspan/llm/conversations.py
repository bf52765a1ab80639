"""Repair of conversations: the cheapest edits after which roles alternate, with an audit of each edit.

Roles must read `(s?(ua)+)?` by their initials.  Every row is kept, gets another role, or goes; empty turns may be put in.
A dynamic program goes along the rows with the best audit of each of the pattern's four states.  Audits are nodes of a shared
tree (PersistentAudits): each adds a letter to its parent, so prefixes are stored once.  Equal costs are settled by the
letters: rolling hashes at binary-lifting ancestors find where two audits part, the letters up to there are compared too.

Rows are sorted by ranges, so that no task holds more than its range.  A conversation that lies inside a range is repaired
there.  For one at a range's border each range gives the best audit from every state to every state; these are joined in
order (the costs form a semiring of minimum and sum), and a last pass spells out the repaired rows in a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: States of the pattern: nothing yet, after s, after u, after a (whole).  A conversation may end in the first or the last.
START, S, U, A = range(4)
KEEP = [{"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U}]
#: The turn that may stand next, where one is put in or gets its role.
NEXT = [U, U, A, U]
ROLES = {U: "user", A: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes of text that a range of rows holds, about.
RANGE_BYTES = 32 << 20
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
WHITE = " \t\n\x0b\x0c\r"
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593_9E3779B1 % ((1 << 61) - 1)


class PersistentAudits:
    """Strings of letters as nodes of a tree; node 0 is the empty string.

    For each node: its letter, depth, the hash of the letters from the root, and its ancestors 1, 2, 4, ... steps up.
    """

    def __init__(self, mod: int = _PRIME):
        self.letter, self.depth, self.hash, self.up, self.mod = [""], [0], [0], [[]], mod

    def add(self, node: int, letter: str) -> int:
        up, hop = [node], node
        while len(self.up[hop]) >= len(up):
            hop = self.up[hop][len(up) - 1]
            up.append(hop)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % self.mod)
        self.up.append(up)
        return len(self.letter) - 1

    def at_depth(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            steps = self.depth[node] - depth
            node = self.up[node][min(steps.bit_length(), len(self.up[node])) - 1]
        return node

    def first_difference(self, x: int, y: int) -> tuple[int, int]:
        """The first nodes along x and y with different letters, or (0, 0) where one string begins with the other."""
        depth = min(self.depth[x], self.depth[y])
        x, y = self.at_depth(x, depth), self.at_depth(y, depth)
        found, top = (0, 0), (x, y)
        if self.hash[x] != self.hash[y]:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            found = (x, y)
            top = (self.up[x][0], self.up[y][0])
        # equal hashes may come from different letters: what lies above is compared up to the first shared node
        x, y = top
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        return found

    def less(self, x: int, y: int) -> bool:
        if x == y:
            return False
        a, b = self.first_difference(x, y)
        return self.letter[a] < self.letter[b] if (a, b) != (0, 0) else self.depth[x] < self.depth[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _better(audits: PersistentAudits, best: list, state: int, cost: int, node: int, letter: str) -> None:
    """Puts the audit of `node` and `letter` in place of the state's, if it is cheaper, or as cheap and less."""
    old = best[state]
    if old is None or cost < old[0]:
        best[state] = (cost, audits.add(node, letter))
    elif cost == old[0]:
        new = audits.add(node, letter)
        if audits.less(new, old[1]):
            best[state] = (cost, new)


def _inserts(audits: PersistentAudits, best: list) -> None:
    for state in (START, S, A, U):  # the turns put in before U is looked at may lead to U
        if best[state] is not None:
            _better(audits, best, NEXT[state], best[state][0] + INSERT, best[state][1], "I")


def cheapest(rows: list[tuple[str, bool, bool]], begin: int | None = None) -> list:
    """(cost, audit) of the best way to each state, or None.  rows: initial, must go, truncated.

    begin: the state before the rows; None for the beginning of a conversation, where turns may be put in first.
    """
    audits = PersistentAudits()
    best: list = [None] * 4
    best[begin or START] = (0, 0)
    if begin is None:
        _inserts(audits, best)
    for initial, bad, cut in rows:
        new: list = [None] * 4
        for state, old in enumerate(best):
            if old is None:
                continue
            _better(audits, new, state, old[0] + DELETE, old[1], "D")
            if not bad:
                extra = TRUNCATED if cut else 0
                to = KEEP[state].get(initial)
                if to is not None:
                    _better(audits, new, to, old[0] + extra, old[1], "K")
                _better(audits, new, NEXT[state], old[0] + extra + REROLE, old[1], "R")
        _inserts(audits, new)
        best = new
    return [None if b is None else (b[0], audits.text(b[1])) for b in best]


def final(best: list) -> tuple[int, str]:
    return min(b for b in (best[START], best[A]) if b is not None)


def repaired_lines(rows, audit: str, state: int = START):
    """Lines `role:text` of the rows after the edits of an audit; last, the state they end in.  rows: (role, text)."""
    rows = iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield f"{ROLES[state]}:"
            continue
        role, text = next(rows)
        if edit == "R":
            state = NEXT[state]
            yield f"{ROLES[state]}:{text}"
        elif edit == "K":
            state = KEEP[state][role[:1]]
            yield f"{role}:{text}"
    yield state


def _known(role: str, text: str) -> bytes:
    return hashlib.md5(f"{role}\0{text}".encode("utf-8", "surrogatepass")).digest()


def faults(rows: list[tuple], seen: set[bytes] = frozenset()) -> tuple[dict[str, int], list[tuple[str, bool, bool]]]:
    """Counts of faults, of turns and of role changes; and what `cheapest` takes.  rows: (turn, role, text) in order;
    seen: hashes of rows that come before them."""
    had: set[bytes] = set()
    n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    out = []
    for _, role, text in rows:
        key, end = _known(role, text), text.rstrip(WHITE)[-1:]
        blank, twice = not end, key in had or key in seen
        had.add(key)
        cut = not blank and not twice and end not in ".!?"
        for name, is_ in (("blank", blank), ("duplicate", twice and not blank), ("truncated", cut)):
            n[name] += is_
        out.append((role[:1], blank or twice, cut))
    n["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(out, out[1:], strict=False))
    return n, out


def _gaps(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def repaired(rows: list[tuple]) -> dict:
    """Everything about one conversation that is at hand whole.  rows: (turn, role, text) in order."""
    n, small = faults(rows)
    cost, audit = final(cheapest(small))
    lines = list(repaired_lines(((r, t) for _, r, t in rows), audit))[:-1]
    return n | {"gaps": _gaps({t for t, _, _ in rows if t is not None}), "cost": cost, "audit": audit, "repaired": "\n".join(lines)}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of each row after damage that the checksum of `conv_id:turn` picks.

    Nulls of role and text become a space, as do nulls in the checksum's string.  Dropped rows stay with gone = true, so that
    their conversation is known; repeated ones appear twice.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = rows.withColumn("_m", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("_m") == 1, "").when(F.col("_m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_m") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    gone = F.col("_m") == 0
    rows = rows.select("conv_id", "turn", F.when(F.col("_m") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(text).alias("text"), gone.alias("gone"), F.explode(copies).alias("_copy"))
    return rows.drop("_copy")


_ROW = [("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_())]
_RESULT = [*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired", pa.string()), ("repaired_sha256", pa.string())]
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}


def _ddl(fields) -> str:
    def name(t: pa.DataType) -> str:
        return f"array<struct<{', '.join(f'{f.name}: {name(f.type)}' for f in t.value_type)}>>" if pa.types.is_list(t) else _SQL[t]

    return ", ".join(f"{c} {name(t)}" for c, t in fields)


def _result(conv_id, r: dict, texts: bool) -> dict:
    whole = r["repaired"]
    return {"conv_id": conv_id, **{c: r[c] for c in COUNTS}, "audit": r["audit"], "repaired": whole if texts else None, "repaired_sha256": hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()}


def _sorted_runs(rows: DataFrame, parts: int, texts: bool) -> DataFrame:
    """Sorts all rows by ranges; conversations inside a range come out as results, the first and the last one of each range as rows."""
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "tie").sortWithinPartitions(*keys, "tie")
    dealt = dealt.drop("tie").withColumn("part", F.spark_partition_id())
    fields = [*_ROW, *_RESULT]
    schema = pa.schema(fields)

    def raw(conv_id, part, at, run):
        return [{"conv_id": conv_id, "part": part, "pos": at + k, "turn": t, "role": r, "text": x, "gone": g} for k, (t, r, x, g) in enumerate(run)]

    def work(batches):
        out, run, conv, at, first, part = [], [], None, 0, True, 0
        for b in batches:
            part = b.column("part")[0].as_py()
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")]
            for conv_id, *row in zip(*columns, strict=True):
                if run and conv_id != conv:
                    if first:
                        out += raw(conv, part, at, run)
                    else:
                        out.append(_result(conv, repaired([r[:3] for r in run if not r[3]]), texts))
                    at, run, first = at + len(run), [], False
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                conv = conv_id
                run.append(tuple(row))
        if run:
            out += raw(conv, part, at, run)
        for lo in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_pylist(out[lo : lo + 10_000], schema)

    return dealt.mapInArrow(work, _ddl(fields))


_WAY = pa.list_(pa.struct([("begin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_SUMMARY = [("key", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), *[(c, pa.int64()) for c in ("rows", "blank", "duplicate", "truncated", "illegal")], ("head", pa.string()), ("tail", pa.string()), *[(c, pa.int64()) for c in ("lo", "hi", "turns")], ("ways", _WAY)]


def _summaries(rest: DataFrame) -> DataFrame:
    """For each range of a conversation: counts, ends, and the best audits from every state to every state."""
    live = rest.where("not gone").withColumn("digest", F.md5(F.concat_ws("\0", "role", "text").cast("binary")))
    first = F.min("part").over(Window.partitionBy("key", "digest"))  # a group holds a row for each range at most
    seen = live.select("key", "part", "digest").distinct().withColumn("first", first).where("first < part").select("key", "part", "digest")

    def work(rows: pa.Table, before: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        known = {bytes.fromhex(d) for d in before.column("digest").to_pylist()}
        got = [r[:3] for r in zip(*[rows.column(c).to_pylist() for c in ("turn", "role", "text", "gone")], strict=True) if not r[3]]
        n, small = faults(got, known)
        turns = {t for t, _, _ in got if t is not None}
        key, conv_id, part = (rows.column(c)[0].as_py() for c in ("key", "conv_id", "part"))
        ways = [{"begin": -1 if begin is None else begin, "state": s, "cost": w[0], "audit": w[1]} for begin in (None, START, S, U, A) for s, w in enumerate(cheapest(small, begin)) if w is not None]
        row = {"key": key, "conv_id": conv_id, "part": part, "rows": len(got), **n, "head": small[0][0] if small else None, "tail": small[-1][0] if small else None, "lo": min(turns, default=None), "hi": max(turns, default=None), "turns": len(turns), "ways": ways}
        return pa.Table.from_pylist([row], pa.schema(_SUMMARY))

    return rest.groupBy("key", "part").cogroup(seen.groupBy("key", "part")).applyInArrow(work, _ddl(_SUMMARY))


_HEAD = [("key", pa.string()), *_ROW, *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())]


def _joined(parts: list[dict]) -> list[dict]:
    """Counts of a conversation, and the part of its audit for each of its ranges.  parts: summaries in order."""
    best: list = [None] * 4
    n = dict.fromkeys(COUNTS, 0)
    last_hi, tail, begun = None, None, False
    lo = hi = None
    turns = 0
    for p in parts:
        for c in ("blank", "duplicate", "truncated", "illegal"):
            n[c] += p[c]
        if p["rows"]:
            n["illegal"] += tail is not None and tail + p["head"] not in ("su", "ua", "au")
            tail = p["tail"]
        if p["turns"]:
            turns += p["turns"] - (last_hi == p["lo"])
            lo, hi, last_hi = p["lo"] if lo is None else lo, p["hi"], p["hi"]
        new: list = [None] * 4
        for w in p["ways"]:
            if w["begin"] == -1 and not begun:
                new[w["state"]] = (w["cost"], None, w["audit"])
            elif begun and w["begin"] >= 0 and best[w["begin"]] is not None:
                old, state = best[w["begin"]], w["state"]
                way = (old[0] + w["cost"], old, w["audit"])
                if new[state] is None or way[0] < new[state][0] or way[0] == new[state][0] and _spelled(way) < _spelled(new[state]):
                    new[state] = way
        best, begun = new, True
    way = min((b for b in (best[START], best[A]) if b is not None), key=lambda b: (b[0], _spelled(b)))
    n["cost"], n["gaps"] = way[0], hi - lo + 1 - turns if lo is not None else 0
    slices = []
    while way is not None:
        slices.append(way[2])
        way = way[1]
    return [{"key": p["key"], "conv_id": p["conv_id"], "part": p["part"], "pos": -1, "audit": a, **n} for p, a in zip(parts, reversed(slices), strict=True)]


def _spelled(way) -> str:
    out = []
    while way is not None:
        out.append(way[2])
        way = way[1]
    return "".join(reversed(out))


def _spelling(texts: bool):
    """Streams the sorted rows of conversations, each range led by its part of the audit, and hashes what is left of them."""
    fields = [("conv_id", pa.int64()), *_RESULT]

    def work(batches):
        out, at = [], None  # at: key, head, digest, audits, lines, state, number of lines
        waiting: list[str] = []

        def put(line: str) -> None:
            at[2].update((("\n" if at[6] else "") + line).encode("utf-8", "surrogatepass"))
            at[6] += 1
            if texts:
                at[4].append(line)

        def spell(row=None) -> None:
            """Edits up to the next row; with the row, its own edit."""
            while waiting and (waiting[-1] == "I" or row is not None):
                edit = waiting.pop()
                *lines, at[5] = repaired_lines([row] if edit != "I" else [], edit, at[5])
                for line in lines:
                    put(line)
                if edit != "I":
                    return

        def close():
            spell()
            head = at[1]
            out.append({"conv_id": head["conv_id"], **{c: head[c] for c in COUNTS}, "audit": "".join(at[3]), "repaired": "\n".join(at[4]) if texts else None, "repaired_sha256": at[2].hexdigest()})

        for b in batches:
            for r in b.to_pylist():
                if at is None or r["key"] != at[0]:
                    if at is not None:
                        close()
                    at = [r["key"], r, hashlib.sha256(), [], [], START, 0]
                if r["pos"] < 0:
                    spell()
                    at[3].append(r["audit"])
                    waiting[:] = reversed(r["audit"])
                elif not r["gone"]:
                    spell()
                    spell((r["role"], r["text"]))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, pa.schema(fields))
                out = []
        if at is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, pa.schema(fields))

    return work, _ddl(fields)


def repair(rows: DataFrame, texts: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation; with `texts`
    also `repaired`, its lines `role:text`.

    rows: conv_id, turn, role, text and gone (rows that only name their conversation).  Null ids make one conversation, null
    turns come first, rows of one turn follow their role and text; an empty role fits no state and can't be kept.  Without rows left: zeros, an empty audit, the
    hash of nothing.  A row's first fault counts: blank, seen earlier with role and text, not ended by `.!?`.  Equal rows
    outside one range are known by 128 bits of hashes.  No task holds more than a range of rows; the hash of a conversation
    that covers many ranges is a chain, so its rows go through one task, as a stream.
    """
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = int(max(size // range_bytes, min(rows.sparkSession.sparkContext.defaultParallelism, size >> 20), 1))
    runs = common.written(_sorted_runs(rows.select("conv_id", "turn", "role", "text", "gone"), parts, texts))
    names = ["conv_id", *[c for c, _ in _RESULT]]
    rest = runs.where("part is not null").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("key"), *[c for c, _ in _ROW])

    def join(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_joined(table.sort_by("part").to_pylist()), pa.schema(_HEAD))

    heads = common.written(_summaries(rest).groupBy("key").applyInArrow(join, _ddl(_HEAD)))
    n = max(1, -(-parts // 8))
    stream = heads.unionByName(rest, allowMissingColumns=True).repartition(n, "key").sortWithinPartitions("key", "part", "pos")
    work, schema = _spelling(texts)
    out = runs.where("part is null").select(names).unionByName(stream.mapInArrow(work, schema))
    return out if texts else out.drop("repaired")


def repair_report(conversations: DataFrame) -> DataFrame:
    """What `repair` finds in the conversations after `damaged`; a row for each original conv_id."""
    return repair(damaged(conversations)).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def report_sql() -> str:
    """The same report as SQL: a recursion goes along the rows with the best (cost, audit, lines) of each state."""
    crc = common.crc32_sql("h")
    white = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    never = "{'c': 1000000000, 't': '', 'r': ''}"

    def best(*ways: str) -> str:
        return "list_min([" + ", ".join(ways) + "])"

    def step(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 't': {state}.t || '{letter}', 'r': {state}.r || {line}}}"

    def keep(state: str, initial: str) -> str:
        way = step(state, "(case when cut then 3 else 0 end)", "K", "role || ':' || text || chr(10)")
        return f"case when not bad and k = '{initial}' then {way} else {never} end"

    def rerole(state: str, role: str) -> str:
        way = step(state, "(case when cut then 6 else 3 end)", "R", f"'{role}:' || text || chr(10)")
        return f"case when not bad then {way} else {never} end"

    def insert(state: str, role: str) -> str:
        return step(state, "3", "I", f"'{role}:' || chr(10)")

    def drop(state: str) -> str:
        return step(state, "4", "D")

    def relaxed(columns: str, source: str, x: str, s: str, u: str, a: str) -> str:
        """x, s, u, a with turns put in, from a source where they are computed without."""
        first = f"select {columns}, {x} as x, {s} as s, {u} as u0, {a} as a0 from {source}"
        second = f"select {columns}, x, s, a0, {best('u0', insert('x', 'user'), insert('s', 'user'), insert('a0', 'user'))} as u from ({first})"
        return f"select {columns}, x, s, u, {best('a0', insert('u', 'assistant'))} as a from ({second})"

    source = "(select r.conv_id, r.i, r.role, r.text, r.k, r.bad, r.cut, w.x, w.s, w.u, w.a from w join f r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1)"
    u = best(drop("u"), *[f(v, z) for v in "xsa" for f, z in ((keep, "u"), (rerole, "user"))])
    a = best(drop("a"), keep("u", "a"), rerole("u", "assistant"))
    s = best(drop("s"), keep("x", "s"))
    nothing = "{'c': 0, 't': '', 'r': ''}"
    begin = relaxed("conv_id, i", "(select conv_id, 0::bigint as i from conversations group by conv_id)", nothing, never, never, never)
    return f"""
    with recursive named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations),
    marked as (select *, {crc} % 20 as m from named),
    d as (select conv_id, turn, case when m = 4 then 'user' else role end as role, case when m = 1 then '' when m = 2 then translate(text, '.!?', '') else text end as text,
          unnest(case when m = 3 then [0, 1] else [0] end) as copy from marked where m <> 0),
    p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, right(rtrim(text, {white}), 1) as last from d),
    o as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as twice from p),
    f as (select conv_id, turn, role, text, i, left(role, 1) as k, last = '' as blank, last <> '' and twice as again, last <> '' and not twice and last not in ('.', '!', '?') as cut, last = '' or twice as bad,
          lag(left(role, 1)) over (partition by conv_id order by i) as before from o),
    w as ({begin} union all {relaxed("conv_id, i", source, drop("x"), s, u, a)}),
    ends as (select conv_id, least_of.c as cost, least_of.t as audit, least_of.r as lines from
          (select conv_id, {best("x", "a")} as least_of from w qualify row_number() over (partition by conv_id order by i desc) = 1)),
    n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum(again::int)::bigint as duplicate, sum(cut::int)::bigint as truncated,
          sum((before is not null and before || k not in ('su', 'ua', 'au'))::int)::bigint as illegal from f group by conv_id)
    select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
           e.cost::bigint as cost, e.audit, sha256(case when lines = '' then '' else substr(lines, 1, length(lines) - 1) end) as repaired_sha256
    from ends e left join n on n.conv_id is not distinct from e.conv_id"""
