"""Conversation repair against an exhaustive shortest path over (cost, audit) pairs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from mirrorledger.llm import dialogues as dg

ROWS = "conv_id bigint, turn bigint, role string, text string, gaps string, audit string"
BLANK = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """The least (cost, audit) by a search over (row, state), each edit tried; rows are (role, text, must go, extra)."""
    state_of = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, q, made = heapq.heappop(queue)
        if i > len(rows) and q in ("", "a"):
            return cost, audit, "\n".join(made)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows):
            heapq.heappush(queue, (cost, audit, i + 1, q, made)) if q in ("", "a") else None
        for role in ("user", "assistant"):
            if (q, role[0]) in state_of and i <= len(rows):
                heapq.heappush(queue, (cost + 3, audit + "I", i, state_of[q, role[0]], (*made, role + ":")))
        if i < len(rows):
            role, text, must_go, extra = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, q, made))
            if not must_go:
                for to, letter, c in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                    if (q, to[:1]) in state_of:
                        heapq.heappush(queue, (cost + c + extra, audit + letter, i + 1, state_of[q, to[:1]], (*made, f"{to}:{text}")))


def plain(rows):
    """The figures of one conversation from its (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, work = set(), [0, 0, 0], []
    for _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        work.append((role, text, fault in (0, 1), 3 if fault == 2 else 0))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, text = plain_repair(work)
    return gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        mine += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def found(result):
    return {r.conv_id: tuple(r[c.split()[0]] for c in dg.SCHEMA.split(", ")) for r in result.collect()}


def made(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "ux", None]
    texts = ["yes.", "no", " \t", "", "Ünd so!", "why?\n", "a b", None, "same."]
    return [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_rows_against_the_search():
    rng = random.Random(3)
    for n in [*range(9)] * 40 + [70, 130]:
        rows = made(rng, n)
        talk = dg.Conversation(keep_messages=True)
        order = sorted(((t, (" " if r is None else r).encode(), (" " if x is None else x).encode()) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        seen = set()
        for t, r, x in order:
            talk.add(t, r, x, (r, x) in seen)
            seen.add((r, x))
        figures, messages = talk.result()
        assert figures == plain(rows)
        text = b"\n".join(r + b":" + x for r, x in messages)
        assert hashlib.sha256(text).hexdigest() == figures[-1]


@pytest.mark.parametrize("block", [1, 3])
def test_written_off_letters_change_nothing(block, monkeypatch):
    """Short blocks force many settlements; integers and audits stay those of one block."""
    monkeypatch.setattr(dg, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        rows = [(k, *r[1:]) for k, r in enumerate(made(rng, rng.randint(1, 14)))]
        talk, seen = dg.Conversation(), set()
        for t, r, x in rows:
            r, x = (" " if v is None else v for v in (r, x))
            talk.add(t, r.encode(), x.encode(), (r, x) in seen)
            seen.add((r, x))
        assert talk.result()[0] == plain(rows)


def test_damage_and_repair_of_a_table(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(60)]), *r) for r in made(rng, 600)]
    rows += [(1000, k, "user" if k % 2 else "assistant", f"turn {k}" + "." * (k % 5 > 0)) for k in range(900)]
    rows += [rows[0], rows[0], (2000, 1 << 62, "user", "x" * 100_000 + "."), (2000, -(1 << 62), "user", "y.")]
    lost = next(k for k in range(5000, 9000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    table = spark.createDataFrame([(*r, "g", "a") for r in rows], ROWS).repartition(7)
    result = found(dg.repair(*dg.damaged(table)))
    expected = {conv: plain(part) for conv, part in damage(rows).items()}
    assert result == expected
    assert result[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_messages_and_empty_table(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", "", ""), (1, 1, "tool", "Ho.", "", "")], ROWS)
    row = dg.repair(table, messages=True).first()
    assert [tuple(m) for m in row.messages] == [("user", "Hi."), ("assistant", "Ho.")] and row.audit == "KR" and row.cost == 3
    assert dg.repair(table.limit(0), messages=True).count() == 0
    plan = dg.ordered(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
