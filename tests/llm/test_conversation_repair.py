"""Conversation repair against a search over all edits in plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import conversation_repair, queries
from plumbline.llm.conversation_repair import damaged, digests, repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = {"su", "ua", "au"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub("[.!?]", "", text)
        if draw == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's rows: a search through all states, position by position."""
    rows = [(c, t, *(" " if x is None else x for x in more)) for c, t, *more in rows]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    follows = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    best = {(0, ""): (0, "", ())}  # (rows used, last initial) -> cheapest
    todo = [(0, "")]
    while todo:
        todo.sort(key=lambda k: (k[0], best[k][:2]))
        at = todo.pop(0)
        used, last = at
        cost, audit, lines = best[at]
        ways = [(5, "I", used, r[0], ((r, ""),)) for r in ("user", "assistant") if r[0] in follows[last]]
        if used < len(rows):
            role, text = rows[used][2:]
            ways.append((2, "D", used + 1, last, ()))
            if faults[used] not in ("blank", "duplicate"):
                more = 5 if faults[used] == "truncated" else 0
                if role[:1] in follows[last]:
                    ways.append((more, "K", used + 1, role[:1], ((role, text),)))
                ways += [(1 + more, "R", used + 1, r[0], ((r, text),)) for r in ("user", "assistant") if r[0] in follows[last]]
        for price, letter, to, initial, new in ways:
            found = (cost + price, audit + letter, lines + new)
            if (to, initial) not in best or found[:2] < best[to, initial][:2]:
                best[to, initial] = found
                if (to, initial) not in todo:
                    todo.append((to, initial))
    ends = [best[len(rows), x] for x in ("", "a") if (len(rows), x) in best]
    cost, audit, lines = min(ends, key=lambda x: x[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    wrong = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], wrong, cost, audit, sha)


def plain(rows, damage=True):
    groups = {r[0]: [] for r in rows}
    for r in plain_damage(rows) if damage else rows:
        groups[r[0]].append(r)
    return {c: plain_repair(g) for c, g in groups.items()}


def check(spark, rows, damage=True):
    df = spark.createDataFrame(rows, SCHEMA)
    found = digests(repair(damaged(df) if damage else df)).collect()
    want = plain(rows, damage)
    assert {r.conv_id: tuple(r)[1:] for r in found} == want
    assert len(found) == len(want)
    return want


def invented(seed, conversations, longest, roles=("user", "assistant", "system", "tool", "", "User", None)):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "open", " ", "", "Well. ", "tail ", "Mixed. end", None, "Ünï."]
    out = []
    for c in range(conversations):
        for k in range(draw.randint(1, longest)):
            role = ("user", "assistant")[k % 2] if draw.random() < 0.5 else draw.choice(roles)
            out.append((c, k if draw.random() < 0.9 else draw.choice([None, k + 3, k - 1]), role, f"{draw.choice(['', 'a', 'b'])}{draw.choice(texts) or ''}" if draw.random() < 0.8 else draw.choice(texts)))
    return out


def test_invented_conversations(spark):
    check(spark, invented(1, 150, 9))
    check(spark, invented(2, 60, 25), damage=False)


def test_spans_join_to_the_whole(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SPAN_TURNS", 3)
    check(spark, invented(3, 60, 14))
    check(spark, invented(4, 20, 40), damage=False)


def test_repeats_ties_nulls_and_nothing_left(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, 5, "user", "One."), (7, 5, "user", "One."), (7, 5, "user", "Two."), (7, 6, "assistant", "Fine.")]
    rows += [(8, k, "user", "same.") for k in range(12)] + [(9, k, "system", "rule.") for k in range(4)]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    found = check(spark, [*rows, (gone, 1, "user", "Lost.")])
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    check(spark, rows, damage=False)


def test_tables_without_rows_and_other_columns(spark):
    assert digests(repair(damaged(spark.createDataFrame([], SCHEMA)))).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("Cost", "audit", "SPAN", "parts", "Turns", "digest", "N2")})
    assert {r.conv_id: tuple(r)[1:] for r in digests(repair(damaged(df))).collect()} == plain(rows)


def test_one_long_conversation_is_many_spans(spark):
    rows = [(1, k, ("user", "assistant")[k % 2 if k % 17 else 0], f"{'very long ' * (k % 5)}t{k % 900}{'.' if k % 11 else ''}") for k in range(3000)]
    found = repair(spark.createDataFrame(rows, SCHEMA))
    assert found.agg(F.max("parts")).first()[0] == 12
    assert tuple(digests(found).first())[1:] == plain(rows, damage=False)[1]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op12_conversation_repair(spark, folder)
    assert dict(found.dtypes) == {"conv_id": "bigint", **{c: "bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "string", "repaired_sha256": "string"}
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == plain(rows)
