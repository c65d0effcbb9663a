"""Conversation repair against a search through all repairs, and the query against a plain computation."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tidemark.llm import conversations
from tidemark.llm.conversations import SPACE


def cheapest(turns):
    """The cheapest repair of (initial, truncated) turns with the least audit, over all edits with up to two insertions at a place."""

    @lru_cache(maxsize=None)
    def best(k, shape):
        """shape: what the letters so far allow. Returns the best (cost, audit) of the rest."""
        found = []
        if k == len(turns) and shape in ("none", "whole"):
            found.append((0, ""))
        for letters in ("u", "a", "ua", "au"):
            after = shape
            for letter in letters:
                after = then(after, letter)
            if after:
                found += [(c + 5 * len(letters), "I" * len(letters) + a) for c, a in options(k, after)]
        return min([*found, *options(k, shape)], default=(10**9, ""))

    def options(k, shape):
        if k == len(turns):
            return [(0, "")] if shape in ("none", "whole") else []
        initial, cut = turns[k]
        out = [add(2, "D", best(k + 1, shape))]
        for letter in "sua":
            if after := then(shape, letter):
                if initial == letter:
                    out.append(add(5 * cut, "K", best(k + 1, after)))
                elif letter != "s":
                    out.append(add(5 * cut + 1, "R", best(k + 1, after)))
        return out

    def add(cost, letter, rest):
        return cost + rest[0], letter + rest[1]

    def then(shape, letter):
        """none: nothing yet; lead: s; odd: after u; whole: after a."""
        return {("none", "s"): "lead", ("none", "u"): "odd", ("lead", "u"): "odd", ("odd", "a"): "whole", ("whole", "u"): "odd"}.get((shape, letter))

    return best(0, "none")


def random_turns(rnd, n, regular=0.6):
    return [("ua"[k % 2] if rnd.random() < regular else rnd.choice(["u", "a", "s", "x", "", " "]), rnd.random() < 0.2) for k in range(n)]


def test_alignment_is_the_cheapest_repair():
    rnd = random.Random(11)
    for _ in range(1500):
        turns = random_turns(rnd, rnd.randint(0, 9), rnd.random())
        want = cheapest(turns)
        assert conversations.align(turns) == want, turns
        assert conversations.align_long(turns) == want, turns


def test_long_alignments_agree():
    rnd = random.Random(12)
    for n in (30, 100, 700):
        for _ in range(8):
            turns = random_turns(rnd, n, rnd.choice([0.3, 0.9, 1.0]))
            found = conversations.align(turns)
            assert found == conversations.align_long(turns)
            letters, at = "", iter(turns)
            for edit in found[1]:
                initial = "" if edit == "I" else next(at)[0]
                letters += initial if edit == "K" else "" if edit == "D" else "?"
            assert re.fullmatch(r"(s?([u?][a?])+)?", letters)
    assert conversations.align_long([("ua"[k % 2], False) for k in range(20_000)]) == (0, "K" * 20_000)


def damage(rows):
    """The contract's damage in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows, damaged=None):
    damaged = damage(rows) if damaged is None else damaged
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damaged if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t for t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        stay = [(i, f == "truncated") for i, f in zip(initials, faults, strict=True) if f in ("", "truncated")]
        cost, kept = cheapest(stay)
        # turns that have to go: D stands before an insertion at the same place
        audit, at = "", iter(kept)
        for f in faults:
            if f in ("blank", "duplicate"):
                audit += "D"
            else:
                for letter in at:
                    audit += letter
                    if letter != "I":
                        break
        audit += "".join(at)
        lines, texts, names = [], iter(own), {"u": "user", "a": "assistant"}
        for edit in audit:
            due = "a" if lines and lines[-1][:1] == "u" else "u"
            if edit == "I":
                lines.append(f"{names[due]}:")
                continue
            _, role, text = next(texts)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else names[due]}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost + 2 * sum(f in ("blank", "duplicate") for f in faults), audit, digest)
    return out


@pytest.fixture
def turns(spark):
    """Makes conversations, with columns whose names clash with those that the operator adds."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("clash") for c in ("there", "copy", "gaps", "audit", "cost", "kind", "place", "edit")}
    return lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(extra)


def summaries(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_equals_a_plain_computation(spark, turns, sf):
    rnd = random.Random(13)
    roles = ["user", "assistant", "system", "User", "tool", "", None, "usher"]
    texts = ["Hello.", "What?", "cut", "", " \t", None, "é!", "no stop", "　", "end. ", "x. ", "日本。"]
    rows = []
    for conv in [None, *range(60)]:
        for k in range(rnd.randint(1, 9)):
            role = ("user", "assistant")[k % 2] if rnd.random() < 0.6 else rnd.choice(roles)
            rows.append((conv, rnd.choice([k, k, k, None, 3]), role, rnd.choice(texts) if rnd.random() < 0.5 else f"turn {rnd.random()}."))
    rows += [(100, 5, "user", "same."), (100, 5, "user", "same."), (101, None, "user", "a."), (102, 2**40, None, None)]
    rows += [(200 + k, 0, "user", "Hi.") for k in range(60)]  # some lose their only turn
    got = summaries(conversations.op12(turns(rows)))
    assert got == expected(rows)
    nothing = hashlib.sha256(b"").hexdigest()
    assert (0, 0, 0, 0, 0, 0, "", nothing) in got.values()
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert summaries(conversations.op12(spark.read.parquet(f"{sf}/conversations.parquet"))) == expected(given)


def test_one_conversation_with_most_rows(turns):
    rnd = random.Random(14)
    rows = [(7, k, ("user", "assistant")[k % 2] if rnd.random() < 0.95 else "user", f"turn {k if rnd.random() < 0.97 else 1}" + "." * (rnd.random() < 0.95)) for k in range(250)]
    rows += [(8, 0, "user", "x" * 3_000_000 + "."), (8, 1, "assistant", "y.")]
    assert summaries(conversations.op12(turns(rows))) == expected(rows)


def test_held_turns_come_back_from_the_file(monkeypatch):
    monkeypatch.setattr(conversations, "HELD_BYTES", 500)
    c = conversations.Conversation(1)
    for k in range(300):
        c.add(k, ("user", "assistant")[k % 2], f"text {k}.")
    assert c.file is not None and len(c.held) < 10
    assert [t for _, _, t in c.repaired(c.audit()[1])] == [f"text {k}." for k in range(300)]


def test_repair_gives_the_turns(turns):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "Yes?"), (1, 4, "user", "Go on."), (2, 0, "user", " ")]
    got = [(r.conv_id, r.place, r.edit, r.role, r.text) for r in conversations.repair(turns(rows).drop("there")).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Hi."), (1, 2, "K", "assistant", "Yes?")]
    found = summaries(conversations.audits(turns(rows).drop("there")))
    assert found == expected(rows, rows) and found[1][6] == "KKDKD" and found[2][6] == "D"


def test_empty_table(turns):
    assert conversations.op12(turns([])).count() == 0 and conversations.repair(turns([]).drop("there")).count() == 0
