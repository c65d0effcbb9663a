"""Conversation structure repair by Wagner-Fischer alignment with the grammar ``(s?(ua)+)?`` of role initials.

A conversation's turns are keys, roles and texts in the order of turn (nulls first), role and text. Each has a fault at most,
the first of: blank (no ``[^\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier), truncated (the last such character
is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate turns),
Insert an empty user or assistant turn 5; a truncated turn that stays costs 5 more. Of the cheapest repairs the one with the
ASCII-least audit (the edits' initials in order) counts.

Target alignment: the targets are ``ua`` repeated, alone or after an ``s`` (which only a kept turn can give), and nothing. The
letter of a target's place depends on how many letters follow, so one Wagner-Fischer table from the last turn to the first
holds the alignments with the targets of every feasible length. An incumbent, a repair found by one greedy walk, bounds the
cost, and with it how far the remaining letters can be from the remaining turns (Ukkonen's band). The audits of all lengths
with the least cost are traced back and compared. Beyond ``LONG`` turns the table would be large: there all lengths of one
parity share a column, which gives the same cost and audit (tests compare both) in bytes that grow with the turns alone.

Turns reach a task sorted, and stream through it: of a conversation it holds a few bytes a turn, a 16-byte mark of each turn
seen, and texts up to ``HELD_BYTES``, the rest in an unnamed temporary file until the conversation ends. One conversation is
one sequence, whose digest and alignment no split can give, so it is one task's work, however long.

Null role or text: one space. Null key: a conversation of its own. Other roles, the empty one among them, have to be reroled or
deleted. Repeated rows are duplicates. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import TEXT_BYTES, arrow_schema, slices

SPACE = " \t\n\x0b\x0c\r"
RENAME, REMOVE, INSERT, TRUNCATED = 1, 2, 5, 5
LONG, HELD_BYTES = 4096, 16 << 20
FAR = 1 << 28
NEXT = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"


def fault_of(role: str, text: str, seen: set[bytes]) -> str | None:
    """The turn's first fault; ``seen`` gets its mark."""
    mark = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
    again = mark in seen
    seen.add(mark)
    whole = text.rstrip(SPACE)
    return BLANK if not whole else DUPLICATE if again else None if whole[-1] in ".!?" else CUT


def _greedy(turns: list[tuple[str, bool]]) -> int:
    """The cost of one repair: whole turns keep or get the letter that is due, truncated ones go, an odd one out is taken off."""
    cost, placed, leading = 0, 0, 0
    for k, (initial, cut) in enumerate(turns):
        if cut:
            cost += REMOVE
        elif initial == "s" and not k:
            leading = 1
        else:
            cost += initial != "ua"[placed % 2]
            placed += 1
    cost += REMOVE * (placed % 2)
    if leading and placed < 2:
        cost += REMOVE
    return min(cost, REMOVE * len(turns))


class Table:
    """Least costs of aligning the turns from k on with the last r letters of ``ua`` repeated, for all r in the band."""

    def __init__(self, turns: list[tuple[str, bool]]):
        self.turns, self.n = turns, len(turns)
        budget = _greedy(turns)
        self.low = [max(0, self.n - k - budget // REMOVE) for k in range(self.n + 1)]
        self.high = [self.n - k + budget // INSERT for k in range(self.n + 1)]
        self.rows: list[np.ndarray] = [np.zeros(0, np.int32)] * (self.n + 1)
        self.rows[self.n] = INSERT * np.arange(self.high[-1] + 1, dtype=np.int32)
        for k in range(self.n - 1, -1, -1):
            letters = np.arange(self.low[k], self.high[k] + 1)
            initial, cut = turns[k]
            match = np.where(letters % 2 == 1, initial != "a", initial != "u") * RENAME + TRUNCATED * cut
            best = np.minimum(self._span(k + 1, self.low[k], self.high[k]) + REMOVE, self._span(k + 1, self.low[k] - 1, self.high[k] - 1) + match)
            self.rows[k] = (np.minimum.accumulate(best - INSERT * letters) + INSERT * letters).astype(np.int32)
        self.leads = self._with_lead() if any(i == "s" for i, _ in turns) else None

    def _span(self, k: int, low: int, high: int) -> np.ndarray:
        """Row k from ``low`` to ``high``, far outside its band."""
        out = np.full(high - low + 1, FAR, np.int32)
        first, last = max(low, self.low[k]), min(high, self.high[k])
        if first <= last:
            out[first - low : last - low + 1] = self.rows[k][first - self.low[k] : last - self.low[k] + 1]
        return out

    def at(self, k: int, r: int) -> int:
        return int(self.rows[k][r - self.low[k]]) if self.low[k] <= r <= self.high[k] else FAR

    def _with_lead(self) -> list[np.ndarray]:
        """The same for ``s`` and then r letters; until its turn comes, turns can only go."""
        low, high = 0, self.high[0]
        out = [np.full(high + 1, FAR, np.int32)] * (self.n + 1)
        for k in range(self.n - 1, -1, -1):
            initial, cut = self.turns[k]
            out[k] = np.minimum(out[k + 1] + REMOVE, FAR)
            if initial == "s":
                out[k] = np.minimum(out[k], self._span(k + 1, low, high) + TRUNCATED * cut)
        return out

    def targets(self) -> tuple[int, list[tuple[bool, int]]]:
        """The least cost, and (with an s, letters after it) of the targets that have it."""
        found = [(self.at(0, r), False, r) for r in range(self.low[0] + self.low[0] % 2, self.high[0] + 1, 2)]
        if self.leads is not None:
            found += [(int(self.leads[0][r]), True, r) for r in range(2, self.high[0] + 1, 2)]
        least = min(f[0] for f in found)
        return least, [f[1:] for f in found if f[0] == least]

    def audit(self, lead: bool, r: int) -> str:
        """The ASCII-least audit for one target: every letter leads to one place, so the least letter is taken each time."""
        out, k = [], 0
        while lead:
            if self.leads[k + 1][r] + REMOVE == self.leads[k][r]:
                out.append("D")
            else:
                out.append("K")
                lead = False
            k += 1
        while k < self.n:
            here = self.at(k, r)
            if self.at(k + 1, r) + REMOVE == here:
                out.append("D")
                k += 1
            elif r and self.at(k, r - 1) + INSERT == here:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[k][0] == "ua"[r % 2] else "R")
                k, r = k + 1, r - 1
        return "".join(out) + "I" * r


def align(turns: list[tuple[str, bool]]) -> tuple[int, str]:
    """(cost, audit) for turns of (role's initial, whether truncated) that need not go."""
    table = Table(turns)
    cost, targets = table.targets()
    return cost, min(table.audit(*t) for t in targets)


#: States of ``align_long``: letters left even, odd, even and two at least, and before the s.
EVEN, ODD, PAIR, LEAD = range(4)


def align_long(turns: list[tuple[str, bool]]) -> tuple[int, str]:
    """As ``align``; of all lengths with the same next letter only the best cost is kept, four numbers a turn."""
    n = len(turns)
    costs = np.full((n + 1, 4), FAR, np.int32)
    costs[n, :3] = 0, INSERT, 2 * INSERT
    even, odd, pair, lead = (int(x) for x in costs[n])
    for k in range(n - 1, -1, -1):
        initial, cut = turns[k]
        stay = TRUNCATED * cut
        as_u, as_a = stay + (initial != "u"), stay + (initial != "a")
        lead = min(lead + REMOVE, pair + stay if initial == "s" else FAR)
        a, b, c = min(even + REMOVE, odd + as_u), min(odd + REMOVE, even + as_a), min(pair + REMOVE, odd + as_u)
        even, odd = min(a, b + INSERT), min(b, a + INSERT)
        pair = min(c, odd + INSERT)
        costs[k] = even, odd, pair, lead
    least, out, k = min(even, lead), [], 0
    front = {s for s, v in ((EVEN, even), (LEAD, lead)) if v == least}
    follow = {EVEN: ODD, PAIR: ODD, ODD: EVEN}
    while k < n or EVEN not in front:
        here = costs[k]
        after = costs[k + 1] if k < n else here
        if k < n and (gone := {s for s in front if after[s] + REMOVE == here[s]}):
            out.append("D")
            front, k = gone, k + 1
            continue
        if added := {follow[s] for s in front if s != LEAD and here[follow[s]] + INSERT == here[s]}:
            out.append("I")
            front = added
            continue
        initial, cut = turns[k]
        kept = {follow[s] for s in front if s != LEAD and initial == ("a" if s == ODD else "u")} | ({PAIR} if LEAD in front else set())
        kept = {s for s in kept if any(after[s] + TRUNCATED * cut == here[q] for q in front if (follow.get(q, PAIR)) == s)}
        out.append("K" if kept else "R")
        front = kept or {follow[s] for s in front if s != LEAD and after[follow[s]] + TRUNCATED * cut + RENAME == here[s]}
        k += 1
    return least, "".join(out)


class Conversation:
    """The turns of one conversation, one after the other, and what comes of them at its end."""

    def __init__(self, key: int | None):
        self.key, self.counts = key, {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.turns: list[tuple[str, bool]] = []
        self.must_go = bytearray()
        self.seen: set[bytes] = set()
        self.held: list[tuple[str, str]] = []
        self.file, self.bytes, self.illegal, self.before = None, 0, 0, None
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        initial, fault = role[:1], fault_of(role, text, self.seen)
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:  # they come in order
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.must_go.append(fault in (BLANK, DUPLICATE))
        if not self.must_go[-1]:
            self.turns.append((initial, fault == CUT))
        self.held.append((role, text))
        self.bytes += len(role) + len(text) + 64
        if self.bytes > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.held, self.file)
            self.held, self.bytes = [], 0

    def _texts(self) -> Iterator[tuple[str, str]]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.held

    def audit(self) -> tuple[int, str]:
        """(cost, audit) of all turns: those that must go do so before anything is inserted at their place, as D comes before I."""
        cost, kept = (align if len(self.turns) <= LONG else align_long)(self.turns)
        out, letters = [], iter(kept)
        for gone in self.must_go:
            if gone:
                out.append("D")
                continue
            for letter in letters:
                out.append(letter)
                if letter != "I":
                    break
        return cost + REMOVE * sum(self.must_go), "".join(out) + "".join(letters)

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of every turn that is there after the repair, in order."""
        texts, due = self._texts(), "u"
        for edit in audit:
            if edit == "I":
                role, text = NEXT[due], ""
            else:
                role, text = next(texts)
                if edit == "D":
                    continue
                role = NEXT[due] if edit == "R" else role
            yield edit, role, text
            due = "a" if role[:1] == "u" else "u"

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.distinct


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """Rows (key, turn, role, text, there) sorted by key and order, as whole conversations."""
    now = None
    for batch in slices(batches, most_bytes=TEXT_BYTES):
        for key, turn, role, text, there in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now
                now = Conversation(key)
            if there:
                now.add(turn, role, text)
    if now is not None:
        yield now


def _blocks(rows: Iterator[tuple], schema: pa.Schema, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, str) else 8 for v in row)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) with every conversation in one task, in order. Rows that are not ``there`` only name theirs."""
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), there.alias("there"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(turns: DataFrame) -> DataFrame:
    """``SUMMARY`` of every conversation of (conv_id, turn, role, text): its faults, the repair and the repaired turns' digest."""
    schema = arrow_schema(turns.sparkSession, SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for c in _conversations(batches):
                cost, audit = c.audit()
                digest = hashlib.sha256()
                for i, (_, role, text) in enumerate(c.repaired(audit)):
                    digest.update(f"{'\n' if i else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield c.key, c.gaps, c.counts[BLANK], c.counts[DUPLICATE], c.counts[CUT], c.illegal, cost, audit, digest.hexdigest()

        return _blocks(rows(), schema)

    return ordered(turns).mapInArrow(run, SUMMARY)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def repair(turns: DataFrame) -> DataFrame:
    """``REPAIRED``: the turns of every conversation after its repair, numbered from 0; kept, reroled or inserted ones."""
    schema = arrow_schema(turns.sparkSession, REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(((c.key, place, *turn) for c in _conversations(batches) for place, turn in enumerate(c.repaired(c.audit()[1]))), schema)

    return ordered(turns).mapInArrow(run, REPAIRED)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by CRC-32 of key and turn: turns drop (``there`` is false), go empty, lose stops, come twice or become the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(space("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), copies.alias("copy")).drop("copy")


def op12(turns: DataFrame) -> DataFrame:
    """The summary of every conversation of the damaged table."""
    return audits(damaged(turns))


def _step(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """SQL: one edit more before a repair (cost, audit, lines)."""
    lines = f"list_prepend({line}, {state}.l)" if line else f"{state}.l"
    return f"struct_pack(c := {state}.c + {cost}, a := '{letter}' || {state}.a, l := {lines})"


def _best(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _stay(state: str, initial: str) -> str:
    keep = _step(state, "late", "K", "role || ':' || text")
    return f"case when i = '{initial}' then {keep} else {_step(state, 'late + 1', 'R', f"'{NEXT[initial]}:' || text")} end"


ORACLE_SQL = f"""with recursive
crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as t),
o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
h as (select o.*, xor(list_reduce(list_transform(string_split(k, ''), lambda c: unicode(c)::bigint), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 as kind from o cross join crc),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as n
  from h where kind <> 0
), n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as r, role[1:1] as i from d),
q as (
  select *, row_number() over (partition by conv_id, role, text order by r) > 1 as again, lag(i) over (partition by conv_id order by r) || i as pair, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as final from n
), f as (select *, final = '' as blank, final <> '' and again as dup, final <> '' and not again and final not in ('.', '!', '?') as cut from q),
g as (
  select conv_id, count(*) as size, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, sum(blank::int)::bigint as blank, sum(dup::int)::bigint as duplicate, sum(cut::int)::bigint as truncated,
    sum((coalesce(pair, 'ua') not in ('su', 'ua', 'au'))::int)::bigint as illegal from f group by conv_id
), z as (
  select conv_id, size as r, struct_pack(c := 0, a := '', l := []::varchar[]) as e, struct_pack(c := 5, a := 'I', l := ['assistant:']) as o,
    struct_pack(c := 10, a := 'II', l := ['user:', 'assistant:']) as p, struct_pack(c := 1000000, a := '', l := []::varchar[]) as s from g
  union all
  select conv_id, r - 1, case when gone then de else {_best("xe", _step("xo", "5", "I", "'user:'"))} end, case when gone then do_ else {_best("xo", _step("xe", "5", "I", "'assistant:'"))} end,
    case when gone then dp else {_best("xp", _step("xo", "5", "I", "'user:'"))} end, s
  from (
    select conv_id, r, gone, de, do_, dp, case when i = 's' and not gone then {_best("ds", _step("p", "late", "K", "role || ':' || text"))} else ds end as s,
      {_best("de", _stay("o", "u"))} as xe, {_best("do_", _stay("e", "a"))} as xo, {_best("dp", _stay("o", "u"))} as xp
    from (
      select z.*, f.role, f.text, f.i, f.blank or f.dup as gone, case when f.cut then 5 else 0 end as late, {_step("e", "2", "D")} as de, {_step("o", "2", "D")} as do_, {_step("p", "2", "D")} as dp, {_step("s", "2", "D")} as ds
      from z join f on z.conv_id is not distinct from f.conv_id and z.r = f.r where z.r > 0
    )
  )
), w as (select conv_id, {_best("e", "s")} as b from z where r = 0)
select k.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(b.c, 0)::bigint as cost, coalesce(b.a, '') as audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join g on k.conv_id is not distinct from g.conv_id left join w on k.conv_id is not distinct from w.conv_id"""
