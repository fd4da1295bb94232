"""Thresholds of the engine, one frozen group a concern. Values enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Action codes in order of severity, and reason codes in the order of the waterfall.
ACTIONS = ("PENDING", "KEEP", "DOWNWEIGHT", "FLAG", "EXCLUDE")
REASONS = ("OFF_TOPIC", "CONTRADICTS_VERDICT", "SPAM", "TEMPLATED", "NEAR_DUPLICATE", "COORDINATED_CLUSTER", "BURST_WINDOW", "LOW_CONFIDENCE", "LOW_EXPERIENCE", "LOW_INFO", "UNSUPPORTED_VERDICT", "INFLUENCE_ATTEMPT")


# The defaults of the groups below.


@dataclass(frozen=True)
class Weights:
    keep: float = 1.0
    downweight: float = 0.25
    flag: float = 1.0
    exclude: float = 0.0


@dataclass(frozen=True)
class Policy:
    downweight_below: float = 0.55
    low_confidence: float = 0.5
    low_confidence_questions: int = 2
    spam_exclude: float = 0.9
    w_informativeness: float = 0.0
    w_rating_support: float = 0.0
    w_spam: float = 0.20
    w_templated: float = 0.15
    w_offtopic: float = 0.10
    w_offgame: float = 0.60
    w_contradiction: float = 0.50
    w_low_experience: float = 0.20
    w_influence: float = 0.60
    influence_floor: float = 0.5
    reason_min: float = 0.05
    model_note_action: str = "EXCLUDE"
    duplicate_action: str = "DOWNWEIGHT"
    duplicate_in_burst_action: str = "EXCLUDE"
    cluster_threshold: float = 0.5
    cluster_strength: float = 0.5
    cluster_min_size: int = 10
    cluster_kinds: tuple[str, ...] = ("burst", "duplicate", "semantic")
    semantic_in_bursts_only: bool = True
    grey_width: float = 0.1
    grey_both_sides: bool = False


@dataclass(frozen=True)
class Features:
    shingle: int = 5
    permutations: int = 128
    bands: int = 32
    rows: int = 4
    near_jaccard: float = 0.7
    dup_min_tokens: int = 8
    low_info_tokens: int = 3
    low_playtime_minutes: int = 120


@dataclass(frozen=True)
class Bursts:
    baseline_hours: int = 168
    min_history: int = 72
    z: float = 6.0
    min_scale: float = 1.0
    min_hour: int = 5
    gap: int = 2
    min_reviews: int = 30
    daily_min: int = 20
    segment_days: int = 3
    penalty: float = 3.0


@dataclass(frozen=True)
class Suspicion:
    scales_hours: tuple[float, ...] = (0.25, 1, 6, 24, 72)
    cosine: float = 0.8
    floor: float = 0.02
    half_weight: tuple[str, ...] = ("new_account_share", "offtopic_mean", "similarity")
    null_samples: int = 24
    null_floor: float = 0.5
    offtopic_topics: tuple[str, ...] = ("off_topic", "joke_meme", "platform_policy")
    dup_min_size: int = 3
    semantic_min_size: int = 15
    phrases: int = 6
    seed: int = 7


@dataclass(frozen=True)
class Platform:
    purchasers_only: bool = True
    share: float = 0.5
    min_judged: int = 20
    extend: bool = False
    extend_daily: int = 5
    extend_days: int = 45


@dataclass(frozen=True)
class Config:
    weights: Weights = field(default_factory=Weights)
    policy: Policy = field(default_factory=Policy)
    features: Features = field(default_factory=Features)
    bursts: Bursts = field(default_factory=Bursts)
    suspicion: Suspicion = field(default_factory=Suspicion)
    platform: Platform = field(default_factory=Platform)
    resamples: int = 2000
    seed: int = 7


@dataclass(frozen=True)
class Backend:
    """Where judgments come from and what they cost; a local service takes two calls at a time at most."""

    name: str
    url: str
    model: str
    price_per_million: float = 1.0
    calls_per_second: float = 40.0
    concurrency: int = 8
    local: bool = False

    @property
    def at_once(self) -> int:
        return min(2, self.concurrency) if self.local else self.concurrency

    def cost(self, tokens: int) -> float:
        return tokens * self.price_per_million / 1e6


def overridden(cfg: Config, changes: dict[str, object]) -> Config:
    """``cfg`` with values changed one level deep: ``{"policy.downweight_below": 0.6, "seed": 3}``; unknown names raise."""
    for path, value in changes.items():
        group, _, name = path.rpartition(".")
        target = getattr(cfg, group) if group else cfg
        if not any(f.name == name for f in fields(target)):
            raise KeyError(path)
        changed = replace(target, **{name: value})
        cfg = replace(cfg, **{group: changed}) if group else changed
    return cfg
