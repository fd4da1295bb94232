"""Per-review decisions as column arithmetic.

A decision is a struct (code, score, reasons): the action's severity code, the
integrity score and at most three reasons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import ACTIONS, Policy, Weights

KEEP, DOWNWEIGHT, FLAG, EXCLUDE = 1, 2, 3, 4


def decision(code, score, reasons: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).cast("int").alias("code"), lit(score).cast("double").alias("score"), reasons.alias("reasons"))


def names(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def led_by(reason: Column | str, reasons: Column) -> Column:
    """``reasons`` with one put first, three at most."""
    first = F.lit(reason) if isinstance(reason, str) else reason
    return F.slice(F.concat(F.array(first), F.array_remove(reasons, first)), 1, 3)


def action_name(code: Column) -> Column:
    return F.element_at(names(*ACTIONS), code + 1)


def weight_of(code: Column, w: Weights = Weights()) -> Column:
    """Weight of an action code; a pending review weighs as much as a kept one."""
    return F.element_at(F.array(*[F.lit(x) for x in (w.keep, w.keep, w.downweight, w.flag, w.exclude)]), code + 1)


def heuristic(n_tokens: Column, symbols: Column, promo: Column, low_info: int = 3) -> Column:
    """Decision without a model: promotion is flagged, little content weighs less."""
    return (
        F.when(promo, decision(FLAG, 0.5, names("SPAM")))
        .when((n_tokens <= low_info) | (symbols > 0.5), decision(DOWNWEIGHT, 0.4, names("LOW_INFO")))
        .otherwise(decision(KEEP, 1.0, names()))
    )


def floored(base: Column, when: Column, action: str, reason: str) -> Column:
    """``base``, at least ``action`` and led by ``reason`` where ``when`` holds."""
    worse = decision(F.greatest(base["code"], F.lit(ACTIONS.index(action))), base["score"], led_by(reason, base["reasons"]))
    return F.when(F.coalesce(when, F.lit(False)), worse).otherwise(base)


def contributions(p: Policy = Policy(), levels: int = 4) -> list[tuple[str, str, Column]]:
    """(reason, weight's name, value) of what lowers a score, in order.

    Columns: informativeness, support, p_contradicts, spam, templated,
    about_game (null: the topic decides), p_offtopic, low_playtime, influence.
    """
    offgame = F.coalesce(1 - F.col("about_game"), F.col("p_offtopic"))
    influence = F.greatest(F.lit(0.0), F.col("influence") - p.influence_floor) / (1 - p.influence_floor)
    return [
        ("LOW_INFO", "w_informativeness", 1 - F.col("informativeness") / (levels - 1)),
        ("UNSUPPORTED_VERDICT", "w_rating_support", 1 - F.col("support") / (levels - 1)),
        ("CONTRADICTS_VERDICT", "w_contradiction", F.col("p_contradicts")),
        ("SPAM", "w_spam", F.col("spam")),
        ("TEMPLATED", "w_templated", F.col("templated")),
        ("OFF_TOPIC", "w_offgame", offgame),
        ("LOW_EXPERIENCE", "w_low_experience", F.when(F.coalesce("low_playtime", F.lit(False)), offgame).otherwise(0.0)),
        ("INFLUENCE_ATTEMPT", "w_influence", F.coalesce(influence, F.lit(0.0))),
    ]


def ledger(p: Policy = Policy()) -> Column:
    """Array of (reason, weight, value, contribution)."""
    lines = []
    for reason, name, value in contributions(p):
        weight = F.lit(getattr(p, name))
        if name == "w_offgame":
            weight = F.when(F.col("about_game").isNull(), p.w_offtopic).otherwise(p.w_offgame)
        lines.append(F.struct(F.lit(reason).alias("reason"), weight.alias("weight"), value.cast("double").alias("value"), (weight * value).alias("contribution")))
    return F.array(*lines)


def judged(p: Policy = Policy(), promo: Column | None = None) -> Column:
    """Decision from answers (see ``contributions``; also support_conf, topic_conf, info_conf).

    Order: spam (excluded only with a deterministic sign of promotion), low
    confidence in questions that carry weight, low score.
    """
    promo = F.lit(False) if promo is None else F.coalesce(promo, F.lit(False))
    lines = ledger(p)
    score = F.greatest(F.lit(0.0), 1 - F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["contribution"]))
    numbered = F.transform(lines, lambda x, i: F.struct((-x["contribution"]).alias("minus"), i.alias("i"), x["reason"].alias("reason")))
    telling = F.filter(numbered, lambda x: -x["minus"] >= p.reason_min)
    reasons = F.transform(F.slice(F.array_sort(telling), 1, 3), lambda x: x["reason"])
    unsure = lambda c, w: F.when((w > 0) & (F.col(c) < p.low_confidence), 1).otherwise(0)
    topic_weight = F.when(F.col("about_game").isNull(), p.w_offtopic).otherwise(0.0)
    low = unsure("info_conf", F.lit(p.w_informativeness)) + unsure("support_conf", F.lit(p.w_rating_support + p.w_contradiction)) + unsure("topic_conf", topic_weight)
    spam = F.col("spam") > p.spam_exclude
    return (
        F.when(spam, decision(F.when(promo, EXCLUDE).otherwise(FLAG), score, led_by("SPAM", reasons)))
        .when(low >= p.low_confidence_questions, decision(FLAG, score, led_by("LOW_CONFIDENCE", reasons)))
        .when(score < p.downweight_below, decision(DOWNWEIGHT, score, reasons))
        .otherwise(decision(KEEP, score, reasons))
    )


def is_later_copy(id_: Column, dup_of: Column, n_tokens: Column, min_tokens: int = 8) -> Column:
    return (dup_of >= 0) & (dup_of != id_) & (n_tokens >= min_tokens)


def clustered(base: Column, suspicion: Column, kind: Column, later_copy: Column, p: Policy = Policy()) -> Column:
    """``base`` after the rules for members of a suspicious burst or cluster."""
    penalised = base["score"] * (1 - p.cluster_strength * suspicion)
    code = F.greatest(base["code"], F.when(penalised < p.downweight_below, DOWNWEIGHT).otherwise(KEEP))
    code = F.when(later_copy, F.greatest(code, F.lit(ACTIONS.index(p.duplicate_in_burst_action)))).otherwise(code)
    if p.grey_width > 0:
        near = (F.abs(penalised - p.downweight_below) <= p.grey_width) & (code != EXCLUDE)
        code = F.when(near if p.grey_both_sides else near & (code == KEEP), FLAG).otherwise(code)
    reason = F.when(kind == "burst", "BURST_WINDOW").otherwise("COORDINATED_CLUSTER")
    applies = kind.isNotNull() & (suspicion > p.cluster_threshold)
    return F.when(applies, decision(code, penalised, led_by(reason, base["reasons"]))).otherwise(base)
