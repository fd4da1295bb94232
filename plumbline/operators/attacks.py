"""Synthetic attacks on a corpus of reviews, and how well a run withstands them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import ACTIONS, Policy, Weights
from plumbline.operators.evaluate import adjusted_rand
from plumbline.operators.running import running_sums


@dataclass(frozen=True)
class Attack:
    """One wave: its size, window, verdict (None: mixed), and shares of new accounts and of low playtime."""

    kind: str
    n: int
    start: str
    hours: float
    positive: bool | None
    new_accounts: float
    low_playtime: float
    parts: tuple[tuple[str, ...], ...]


# Sizes, windows and account mixes of the five waves.
ATTACKS = (
    Attack("template_flood", 150, "2024-04-10 06:00:00", 48, False, 0.5, 0.3, (("Fair warning:", "Frankly,", "To be honest:"), ("it is broken", "it does not run"), ("since the update.", "since last week."), ("Do not buy.", "I want my money back.", "Avoid."))),
    Attack("paraphrase_flood", 150, "2024-04-14 00:00:00", 24, False, 0.4, 0.3, (("The owners", "The company", "Its makers", "The people behind it"), ("paid for a campaign", "took a side in politics", "backed a cause"), ("that I reject,", "that I can't stand,", "that I won't fund,"), ("so I am out.", "so they get nothing more.", "so this is my vote."))),
    Attack("coordinated_burst", 200, "2024-04-18 14:00:00", 3, False, 0.8, 0.6, (("Servers are down", "It crashes", "Lost my save", "Matches never start", "Frames drop", "Audio cuts out", "Rewards are gone", "Menus freeze", "Input lags", "Friends can't join"), (".", " again.", " every day.", ". Fix it."))),
    Attack("astroturf_flood", 150, "2024-04-22 20:00:00", 6, True, 0.8, 0.6, (("Great game,", "Best of the year,", "Love it,"), ("the team listens,", "worth every cent,", "never had a bug,"), ("buy it now!", "ten out of ten!", "ignore the others!"))),
    Attack("spam", 40, "2024-04-02 00:00:00", 624, None, 0.9, 0.8, (("Cheap keys at", "Free skins at", "Join us at"), ("bit.ly/a1b2", "discord.gg/c3d4", "example.com/promo"))),
)
#: Shares of the rows with these properties.
PURCHASED = 0.85


def draw(kind: str, i: Column, what: str, seed: int) -> Column:
    """A whole number below 2**32 from the digest of seed, wave, row and purpose; the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{kind}|"), i.cast("string"), F.lit(f"|{what}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def injected_rows(spark: SparkSession, seed: int = 7, attacks: tuple[Attack, ...] = ATTACKS) -> DataFrame:
    """All waves' reviews: ext_id, author_hash, text, lang, created_at, rating_norm, meta (JSON); all drawn by digests."""
    out = None
    for a in attacks:
        i = F.col("i")
        pick = lambda what, n: draw(a.kind, i, what, seed) % n  # noqa: B023, E731
        share = lambda what: draw(a.kind, i, what, seed) / F.lit(float(1 << 32))  # noqa: B023, E731
        words = [F.element_at(F.array(*[F.lit(x) for x in p]), (pick(f"part{k}", len(p)) + 1).cast("int")) for k, p in enumerate(a.parts)]
        fresh = share("account") < a.new_accounts
        minutes = F.when(share("playtime") < a.low_playtime, 5 + pick("minutes", 106)).otherwise(150 + pick("minutes", 8851))
        positive = F.lit(a.positive) if a.positive is not None else share("verdict") < 0.5
        at = F.timestamp_seconds(F.unix_seconds(F.lit(a.start + "+00:00").cast("timestamp")) + pick("time", int(a.hours * 3600)))
        rows = spark.range(a.n).select(F.col("id").alias("i"))
        made = rows.select(
            F.format_string(f"inj-{a.kind}-%04d", i).alias("ext_id"), F.sha2(F.concat(F.lit(f"inj|{seed}|{a.kind}|"), i.cast("string")), 256).alias("author_hash"), F.concat_ws(" ", *words).alias("text"), F.lit("en").alias("lang"),
            at.cast("timestamp_ntz").alias("created_at"), positive.cast("double").alias("rating_norm"),
            F.to_json(F.struct(F.when(fresh, F.lit(1)).otherwise(2 + pick("reviews", 59)).alias("author_num_reviews"), minutes.alias("author_playtime_at_review"), (share("purchase") < PURCHASED).alias("steam_purchase"), F.lit(False).alias("received_for_free"))).alias("meta"),
        )
        out = made if out is None else out.unionByName(made)
    return out


def truth(ext_id: Column) -> Column:
    """The wave that a review was injected with, null for organic ones."""
    return F.when(ext_id.like("inj-%"), F.split_part(ext_id, F.lit("-"), F.lit(2)))


def attacked(clean: DataFrame, waves: DataFrame) -> DataFrame:
    """Organic and injected reviews together, cast to the columns of ``clean`` (those that ``waves`` lacks are null)."""
    fitted = [(F.col(f.name) if f.name in waves.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in clean.schema]
    return clean.unionByName(waves.select(*fitted))


def bench_weight(code: Column, w: Weights = Weights()) -> Column:
    """Weight of an action when a run is measured: a review that is still pending weighs nothing."""
    return F.element_at(F.array(*[F.lit(x) for x in (0.0, w.keep, w.downweight, w.flag, w.exclude)]), code + 1)


def weighted_rating(weight: Column, mask: Column | None = None) -> Column:
    """Aggregate: weighted mean rating of the rows that have one and lie in ``mask``."""
    inside = F.col("rating_norm").isNotNull() if mask is None else F.col("rating_norm").isNotNull() & mask
    return F.sum(F.when(inside, weight * F.col("rating_norm"))) / F.nullif(F.sum(F.when(inside, weight)), F.lit(0.0))


def cluster_map(members: DataFrame, clusters: DataFrame, p: Policy = Policy()) -> DataFrame:
    """(id, by_kind): each review's cluster by kind with whether it is penalised; of several of a kind the last id."""
    penalised = (F.col("suspicion") > p.cluster_threshold) & (F.col("size") >= p.cluster_min_size)
    joined = members.select("cluster_id", "id").join(clusters.select("cluster_id", "kind", penalised.alias("penalised")), "cluster_id")
    last = joined.groupBy("id", "kind").agg(F.max(F.struct("cluster_id", "penalised")).alias("c"))
    return last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "c")))).alias("by_kind"))  # a row a kind


def attack_metrics(decided: DataFrame, by_kind: DataFrame, w: Weights = Weights()) -> DataFrame:
    """How each wave's reviews fared (decided: id, wave, code): caught, discounted, excluded, flagged, mean weight, in a cluster, in a penalised one."""
    rows = decided.where("wave IS NOT NULL").join(by_kind, "id", "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    hit = F.exists(F.map_values("by_kind"), lambda c: c["penalised"])
    return rows.groupBy("wave").agg(
        F.count("*").alias("n"), share(F.col("code") != 1).alias("caught"), share(F.col("code").isin(2, 4)).alias("discounted"), share(F.col("code") == 4).alias("excluded"), share(F.col("code") == 3).alias("flagged"),
        F.avg(bench_weight(F.col("code"), w)).alias("mean_weight"), share(F.col("by_kind").isNotNull()).alias("in_cluster"), share(hit).alias("in_penalised_cluster"),
    )


def aligned(clean: DataFrame, attacked_: DataFrame, block: int = 8192) -> DataFrame:
    """The k-th organic review of an attacked run (id, wave, rating_norm, code) beside review k of the clean run (id, ...); ratings that differ raise.

    Ids are whole numbers from 0 without gaps, so an organic one moves back by
    the injected ones before it: those of earlier blocks, and those before it in
    its own block of ``block`` ids. Blocks are accumulated in two levels.
    """
    at = F.floor(F.col("id") / block).cast("long").alias("block")
    inside = F.array_sort(F.collect_list(F.when(F.col("wave").isNotNull(), F.col("id")))).alias("inside")  # at most ``block`` ids
    blocks = running_sums(attacked_.groupBy(at).agg(inside).withColumn("before", F.size("inside")), "block", ["before"], inclusive=False)
    blocks = blocks.withColumn("before", F.coalesce("before", F.lit(0)))
    organic = attacked_.where("wave IS NULL").withColumn("block", at).join(blocks, "block")
    back = F.col("before") + F.size(F.filter("inside", lambda x: x < F.col("id")))
    moved = organic.select("id", (F.col("id") - back).cast("long").alias("clean_id"), "rating_norm", "code", *[c for c in ("penalised",) if c in attacked_.columns])
    other = clean.select(F.col("id").alias("clean_id"), F.col("rating_norm").alias("clean_rating"), F.col("code").alias("clean_code"), *[F.col(c).alias(f"clean_{c}") for c in ("penalised",) if c in clean.columns])
    both = moved.join(other, "clean_id")
    same = F.col("rating_norm").eqNullSafe(F.col("clean_rating"))
    return both.withColumn("rating_norm", F.when(same, F.col("rating_norm")).otherwise(F.raise_error(F.lit("organic reviews do not line up with the clean run")).cast("double"))).drop("clean_rating")


def collateral(both: DataFrame, w: Weights = Weights()) -> DataFrame:
    """One row over ``aligned`` reviews (optionally penalised, clean_penalised): organic reviews whose weight fell or rose, newly penalised ones, discounted shares."""
    now, before = bench_weight(F.col("code"), w), bench_weight(F.col("clean_code"), w)
    newly = F.count_if(F.col("penalised") & ~F.col("clean_penalised")) if "penalised" in both.columns else F.lit(None).cast("long")
    return both.agg(
        F.count("*").alias("organic"), F.count_if(now < before - 1e-9).alias("lowered"), F.avg((now < before - 1e-9).cast("double")).alias("lowered_share"), F.count_if(now > before + 1e-9).alias("raised"),
        newly.alias("newly_penalised"), F.avg((before < 1).cast("double")).alias("discounted_clean"), F.avg((now < 1).cast("double")).alias("discounted_attacked"),
    )


def ari_by_kind(decided: DataFrame, members: DataFrame, clusters: DataFrame, kinds: tuple[str, ...] = ("duplicate", "semantic", "burst")) -> DataFrame:
    """(kind, n, ari): waves against the clusters of each kind; a review in none of them is a cluster of its own."""
    injected, out = decided.where("wave IS NOT NULL").select("id", "wave"), None
    for kind in kinds:
        own = members.join(clusters.where(F.col("kind") == kind).select("cluster_id"), "cluster_id").groupBy("id").agg(F.max("cluster_id").alias("c"))
        named = injected.join(own, "id", "left").select("wave", F.coalesce(F.col("c").cast("string"), F.concat(F.lit("none-"), F.col("id").cast("string"))).alias("label"))
        row = adjusted_rand(named, "wave", "label").select(F.lit(kind).alias("kind"), "n", "ari")
        out = row if out is None else out.unionByName(row)
    return out


def control_metrics(decided: DataFrame, in_burst: DataFrame) -> DataFrame:
    """One row of a corpus without attacks (id, rating_norm, code, about_game): negatives, those on topic, and how many of these were discounted, in all and in bursts."""
    inside = in_burst.select("id").distinct().withColumn("b", F.lit(True))
    rows = decided.where("rating_norm < 0.5").join(inside, "id", "left")
    on, hit, b = F.coalesce(F.col("about_game"), F.lit(0.0)) >= 0.5, F.col("code").isin(2, 4), F.col("b").isNotNull()
    return rows.agg(
        F.count("*").alias("negatives"), F.count_if(on).alias("on_topic"), F.count_if(on & hit).alias("discounted"), (F.count_if(on & hit) / F.nullif(F.count_if(on), F.lit(0))).alias("fp_rate"),
        F.count_if(on & b).alias("on_topic_in_bursts"), F.count_if(on & hit & b).alias("discounted_in_bursts"),
    )


def control_reasons(decided: DataFrame) -> DataFrame:
    """(reason, n): first reasons of discounted negatives on topic, OTHER without one."""
    rows = decided.where((F.col("rating_norm") < 0.5) & (F.coalesce("about_game", F.lit(0.0)) >= 0.5) & F.col("code").isin(2, 4))
    return rows.groupBy(F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("OTHER")).alias("reason")).agg(F.count("*").alias("n"))


def changed_by_period(a: DataFrame, b: DataFrame, in_burst: DataFrame) -> DataFrame:
    """(period, transition, n): reviews whose action (id, code) differs between two runs, in bursts and outside."""
    both = compared(a, b, in_burst).where("x <> y")
    return both.groupBy("period", F.concat_ws("->", "x", "y").alias("transition")).agg(F.count("*").alias("n"))


def compared(a: DataFrame, b: DataFrame, in_burst: DataFrame) -> DataFrame:
    """(id, x, y, period): both runs' actions of each review."""
    name = F.array(*[F.lit(x) for x in ACTIONS])
    x, y = (F.element_at(name, F.col("code") + 1) for _ in range(2))
    inside = in_burst.select("id").distinct().withColumn("b", F.lit(True))
    joined = a.select("id", x.alias("x")).join(b.select("id", y.alias("y")), "id").join(inside, "id", "left")
    return joined.select("id", "x", "y", F.when(F.col("b"), "bursts").otherwise("normal").alias("period"))


def period_shares(a: DataFrame, b: DataFrame, in_burst: DataFrame) -> DataFrame:
    both = compared(a, b, in_burst)
    return both.groupBy("period").agg(F.count("*").alias("reviews"), F.count_if(F.col("x") != F.col("y")).alias("changed"), F.avg((F.col("x") != F.col("y")).cast("double")).alias("changed_share"))


def changed_examples(a: DataFrame, b: DataFrame, in_burst: DataFrame, reviews: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` reviews outside bursts whose action differs, with the beginning of the text."""
    rows = compared(a, b, in_burst).where("x <> y AND period = 'normal'").orderBy("id").limit(n)
    return reviews.select("id", F.substring("text", 1, 200).alias("text")).join(F.broadcast(rows), "id").select("id", "x", "y", "text")


def cost_points(benchmarks: DataFrame) -> DataFrame:
    """(name, x, y) of benchmarks (name, cost, n_organic, n_injected, shift_removed): cost of a thousand reviews and share of the pull removed."""
    n = F.coalesce("n_organic", F.lit(0)) * 2 + F.coalesce("n_injected", F.lit(0))
    return benchmarks.where("shift_removed IS NOT NULL").select("name", F.when(n > 0, 1000 * F.col("cost") / n).otherwise(0.0).alias("x"), F.col("shift_removed").alias("y"))


def charged(runs: DataFrame) -> DataFrame:
    """``runs`` (id, backend, reuses, cost) with ``charged``: a cached run is charged what its source cost."""
    # Only runs that reuse another's answers meet their sources: nulls would all be dealt to one task.
    reusing = F.coalesce((F.col("backend") == "cached") & F.col("reuses").isNotNull(), F.lit(False))
    source = runs.select(F.col("id").alias("reuses"), F.col("cost").alias("_source"))
    joined = runs.where(reusing).join(source, "reuses", "left").withColumn("charged", F.coalesce("_source", F.lit(0.0))).drop("_source")
    return joined.unionByName(runs.where(~reusing).withColumn("charged", F.col("cost")))
