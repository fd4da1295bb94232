"""Repair of conversations by a fold in Spark SQL.

A repaired conversation has roles ``(s?(ua)+)?``. Rows may be kept (0), given
another role (1) or deleted (2; blank and repeated ones must be), and empty turns
inserted (5); a truncated row that is not deleted costs 5 more. The cheapest edits
are found by ``aggregate()`` over the sorted turns: it carries, for each of the
four states of the role pattern (start, system, user, assistant), the least
(cost, audit) struct, where an audit is the edits' initials. Python takes no part
in it.

A conversation is cut into spans of its turn numbers, so that a very long one is
no single group. A span is folded from each of the four states, and a second
fold joins the spans. Equal rows of a turn are one row with a count: all but the
first are repeats, whose edits are given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, fresh_path

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLED, DELETED, INSERTED, TRUNCATED = 1, 2, 5, 5
STATES = ("start", "system", "user", "assistant")
#: Cost of what cannot be.
NEVER = 1 << 50
#: Turn numbers of a span; the span of null turns.
SPAN_TURNS, NO_TURN = 256, -(1 << 62)
WHITE = " \t\n\x0b\x0c\r"


def record(**fields: Column) -> Column:
    """A struct of named fields."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


# ---------------------------------------------------------------- faults


def faulty(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) with each one's ``initial`` and ``fault``: blank, duplicate, truncated or empty.

    The fault is that of the first of ``n`` equal rows. A row is a duplicate
    where role and text stand at an earlier turn; the earliest turns are a table
    of their own, and both sides of the join are bare shuffles, which adaptive
    execution splits where one text or conversation holds very many rows.
    """
    bare = F.rtrim("text", F.lit(WHITE))
    last = F.right(bare, F.lit(1))
    rows = cut(rows.select("conv_id", "turn", "role", "text", "n", F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open")))
    first = cut(rows.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull()).alias("any_null"), F.min("turn").alias("first_turn")))
    a, b = rows.alias("a"), first.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    earliest = F.col("turn").isNull() | (~F.col("any_null") & (F.col("turn") == F.col("first_turn")))
    fault = F.when(F.col("blank"), "blank").when(~earliest, "duplicate").when(F.col("open"), "truncated").otherwise("")
    return a.join(b, same, "left").select("a.conv_id", "turn", "a.role", "text", "n", F.left("a.role", F.lit(1)).alias("initial"), fault.alias("fault"))


# ---------------------------------------------------------------- folds


def option(cost: Column, audit: Column) -> Column:
    return record(cost=cost.cast("long"), audit=audit)


def edited(state: Column, cost: Column | int, letter: str) -> Column:
    return option(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def four(options: list[Column]) -> Column:
    return record(**dict(zip(STATES, options)))


def inserted(at: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the four structs after the inserts that may pay: to user, then to assistant."""
    more = [edited(at[s], INSERTED, INSERT) for s in ("start", "system", "assistant")]
    first = four([at["start"], at["system"], F.least(at["user"], *more), at["assistant"]])
    return let(first, lambda c: body(four([c["start"], c["system"], c["user"], F.least(c["assistant"], edited(c["user"], INSERTED, INSERT))])))


def step(at: Column, row: Column) -> Column:
    """The four structs after one row: inserts before it, then its edit."""

    def edit(c: Column) -> Column:
        gone = [edited(c[s], DELETED, DELETE) for s in STATES]
        more = F.when(row["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0))
        kept = lambda s, initial: F.when(row["initial"] == initial, edited(c[s], more, KEEP))
        other = lambda s: edited(c[s], more + REROLED, REROLE)
        free = four(
            [
                gone[0],
                F.least(gone[1], kept("start", "s")),
                F.least(gone[2], *[kept(s, "u") for s in ("start", "system", "assistant")], *[other(s) for s in ("start", "system", "assistant")]),
                F.least(gone[3], kept("user", "a"), other("user")),
            ]
        )
        return F.when(row["fault"].isin("blank", "duplicate"), four(gone)).otherwise(free)

    return inserted(at, lambda c: let(c, edit))


def paths(turns: Column) -> Column:
    """For each entry state: the four structs at the end of a span."""
    entries = F.array(*[four([option(F.lit(0 if s == e else NEVER), F.lit("")) for s in STATES]) for e in STATES])
    return F.transform(entries, lambda entry: F.aggregate(turns, entry, step))


def illegal(turns: Column) -> Column:
    """Adjacent rows of a span whose initials may not follow one another."""
    start = record(last=F.lit(None).cast("string"), n=F.lit(0).cast("long"))
    wrong = lambda a, b: F.coalesce((~F.concat(a, b).isin("su", "ua", "au")).cast("long"), F.lit(0).cast("long"))
    return F.aggregate(turns, start, lambda at, row: record(last=row["initial"], n=at["n"] + wrong(at["last"], row["initial"]) + row["n"] - 1))["n"]


def joined(spans: Column) -> Column:
    """The whole conversation's cheapest struct: cost, audits and entry states by span, and the inserts at the end."""

    def whole(cost, audits, entries):
        return record(cost=cost.cast("long"), audits=audits.cast("array<string>"), entries=entries.cast("array<int>"))

    def through(at: Column, span: Column) -> Column:
        def ways(state: str) -> list[Column]:
            own = [(span["paths"][k][state], at[e], k) for k, e in enumerate(STATES)]
            return [whole(a["cost"] + p["cost"], F.concat(a["audits"], F.array(p["audit"])), F.concat(a["entries"], F.array(F.lit(k)))) for p, a, k in own]

        return four([F.least(*ways(s)) for s in STATES])

    empty = F.array().cast("array<string>"), F.array().cast("array<int>")
    start = four([whole(F.lit(0 if s == "start" else NEVER), *empty) for s in STATES])

    def ended(c: Column) -> Column:
        end = lambda s, k: record(cost=c[s]["cost"] + k * INSERTED, audits=c[s]["audits"], entries=c[s]["entries"], tail=F.lit(INSERT * k))
        return F.least(end("start", 0), end("assistant", 0), end("user", 1), end("system", 2))

    return let(F.aggregate(spans, start, through), ended)


def rewritten(turns: Column, audit: Column, entry: Column) -> Column:
    """A span's repaired turns and full audit: the edits' initials applied from an entry state (0 to 3).

    ``turns`` of the result: edit, role and text of each that stays.
    """
    none = F.array().cast("array<struct<edit:string,role:string,text:string>>")
    start = record(state=entry.cast("int"), at=F.lit(0), audit=F.lit(""), turns=none)

    def apply(c: Column, edit: Column) -> Column:
        row, inserts = F.try_element_at(turns, c["at"] + 1), edit == INSERT
        other = F.when(c["state"] == 2, "assistant").otherwise("user")
        role, text = F.when(edit == KEEP, row["role"]).otherwise(other), F.when(inserts, "").otherwise(row["text"])
        reached = F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).otherwise(3)
        repeats = F.when(inserts, F.lit("")).otherwise(F.repeat(F.lit(DELETE), (row["n"] - 1).cast("int")))
        return record(
            state=F.when(edit == DELETE, c["state"]).otherwise(reached).cast("int"),
            at=F.when(inserts, c["at"]).otherwise(c["at"] + 1),
            audit=F.concat(c["audit"], edit, repeats),
            turns=F.when(edit == DELETE, c["turns"]).otherwise(F.concat(c["turns"], F.array(record(edit=edit, role=role, text=text)))),
        )

    edits = F.filter(F.split(audit, ""), lambda x: x != "")
    return F.aggregate(edits, start, apply, lambda c: record(audit=c["audit"], turns=c["turns"]))


# ---------------------------------------------------------------- operator


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of rows (conv_id, turn, role, text), with an optional count ``n`` of equal rows.

    One row per conversation and span: conv_id, part (from 0), parts, gaps, blank,
    duplicate, truncated, illegal, cost (of the whole conversation), audit and
    turns (array of edit, role, text; both the span's own).

    Rows are taken by turn, nulls first, then role and text. Rows with ``n`` = 0
    only name their conversation, which then has one row without turns. Null
    conv_ids are one conversation; null roles and texts are one space. Other
    columns are ignored; an empty table gives no rows. Texts are held whole; a span
    holds ``SPAN_TURNS`` turn numbers and the different rows on them.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    counted = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), n.cast("long").alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    row = F.when(F.col("n") > 0, F.struct("turn", "role", "text", "n", "initial", "fault"))
    span = F.coalesce(F.floor(F.col("turn") / SPAN_TURNS).cast("long"), F.lit(NO_TURN)).alias("span")
    spans = faulty(counted).groupBy("conv_id", span).agg(F.array_sort(F.collect_list(row)).alias("turns"))

    count = lambda of: F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + of(t))
    repeats = lambda t: F.when(t["fault"] == "blank", F.lit(0)).when(t["fault"] == "duplicate", t["n"]).otherwise(t["n"] - 1)
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    light = F.transform("turns", lambda t: record(initial=t["initial"], fault=t["fault"], n=t["n"]))
    path = fresh_path(rows.sparkSession, "conversation-spans")
    spans.select(
        "conv_id",
        "span",
        "turns",
        count(lambda t: F.when(t["fault"] == "blank", t["n"]).otherwise(F.lit(0))).alias("blank"),
        count(repeats).alias("duplicate"),
        count(lambda t: (t["fault"] == "truncated").cast("long")).alias("truncated"),
        # Repeats of a row are deleted, and so are those of a blank or duplicate row: two each.
        count(lambda t: (t["n"] - 1) * DELETED).alias("repeats_cost"),
        illegal(light).alias("illegal"),
        paths(light).alias("paths"),
        F.array_min(numbers).alias("low"),
        F.array_max(numbers).alias("high"),
        F.size(F.array_distinct(numbers)).cast("long").alias("distinct"),
        F.try_element_at("turns", F.lit(1))["initial"].alias("first"),
        F.try_element_at("turns", F.lit(-1))["initial"].alias("last"),
    ).write.parquet(path)
    spans = rows.sparkSession.read.parquet(path)

    inner = F.array_sort(F.collect_list(F.struct("span", "paths", "first", "last")))
    whole = spans.groupBy("conv_id").agg(
        inner.alias("spans"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "repeats_cost", "illegal")],
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct"), F.lit(0)).cast("long").alias("gaps"),
    )
    ends = F.filter("spans", lambda s: s["first"].isNotNull())
    between = illegal(F.flatten(F.transform(ends, lambda s: F.array(*[record(initial=s[e], n=F.lit(1).cast("long")) for e in ("first", "last")]))))
    # Each span's own first and last stand side by side there: that pair is taken off again.
    within = F.aggregate(ends, F.lit(0).cast("long"), lambda a, s: a + (~F.concat(s["first"], s["last"]).isin("su", "ua", "au")).cast("long"))
    whole = whole.withColumn("best", joined(F.col("spans"))).select(
        "conv_id",
        F.size("spans").alias("parts"),
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + between - within).alias("illegal"),
        (F.col("best.cost") + F.col("repeats_cost")).alias("cost"),
        F.posexplode(F.arrays_zip(F.col("spans.span").alias("span"), F.col("best.audits").alias("audits"), F.col("best.entries").alias("entries"))).alias("part", "own"),
        F.col("best.tail").alias("tail"),
    )
    a, b = whole.alias("a"), spans.select("conv_id", "span", "turns").alias("b")
    both = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.own.span") == F.col("b.span")))
    audit = F.concat("a.own.audits", F.when(F.col("part") == F.col("parts") - 1, F.col("tail")).otherwise(""))
    done = both.withColumn("done", rewritten(F.col("turns"), audit, F.col("a.own.entries")))
    return done.select("a.conv_id", "part", "parts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "done.audit", "done.turns")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` damaged by crc32(``conv_id:turn``) modulo 20, nulls as one space, with a count ``n``: 0 where a row is dropped, 2 where it is repeated."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(draw == 4, "user").otherwise(blank("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("n"))


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: the counts, cost and whole audit of ``repair``, and the SHA-256 of its ``role:text`` lines.

    A conversation of one span is digested by Spark. The spans of a longer one
    are sorted and digested one after another, so it is never held whole.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    rows = repaired.select("conv_id", "part", "parts", *names, "audit", lines.alias("lines"), (F.size("turns") > 0).alias("some"))
    short = rows.where("parts = 1").select("conv_id", *names, "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.part == 0:
                    digest, audits, begun, head = hashlib.sha256(), [], False, r
                if r.some:
                    digest.update(("\n" * begun + r.lines).encode())
                    begun = True
                audits.append(r.audit)
                if r.part == r.parts - 1:
                    out.append([head.conv_id, *[int(getattr(head, c)) for c in names], "".join(audits), digest.hexdigest()])
            yield pd.DataFrame(out, columns=["conv_id", *names, "audit", "repaired_sha256"])

    long = rows.where("parts > 1").withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), "part")
    schema = "conv_id string, " + ", ".join(f"{c} long" for c in names) + ", audit string, repaired_sha256 string"
    return short.unionByName(long.mapInPandas(run, schema).withColumn("conv_id", F.col("conv_id").cast(kind)))
