"""Margins of preference pairs: parsing, pooling and scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which a margin is looked for, and the fields that are pooled.
MARGIN_FIELDS = ("client_margin", "dpo_margin", "reward_gap", "implicit_reward_gap", "teacher_margin", "margin", "margins")


def safe_float(value: Column, default: float | None = None, finite: bool = True) -> Column:
    """A number, numeric text or boolean as a double; the default for anything else and, if finite, for NaN and infinities."""
    number = value.try_cast("double")
    if finite:
        number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def clamp(value: Column, low: float, high: float) -> Column:
    """Value within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def get_margin(fields: Mapping[str, Column], valid: Column | None = None, order: Sequence[str] = MARGIN_FIELDS) -> Column:
    """The first finite margin in order; null where the row is marked as invalid."""
    first = F.coalesce(*(safe_float(fields[n]) for n in order if n in fields))
    return first if valid is None else F.when(~valid.eqNullSafe(F.lit(False)), first)


def margin_sources(fields: Mapping[str, Column]) -> Column:
    """Map of all finite margins."""
    pairs = [x for n, c in fields.items() for x in (F.lit(n), safe_float(c))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


@dataclass(frozen=True)
class Pooling:
    """How margins become one probability: the range that counts, the floor of a probability."""

    low: float = -0.5
    high: float = 0.5
    floor: float = 1e-4

    def __post_init__(self):
        if self.high <= self.low:
            raise ValueError("the margin range is empty")


def margin_to_probability(margin: Column, pooling: Pooling = Pooling()) -> Column:
    """Clipped to the range, rescaled to 0..1, and kept off both ends."""
    floor = max(0.0, min(0.49, pooling.floor))
    share = (clamp(margin, pooling.low, pooling.high) - pooling.low) / (pooling.high - pooling.low)
    return clamp(share, floor, 1.0 - floor)


def bayes_pool(probabilities: Sequence[Column]) -> Column:
    """Product of p over that plus the product of 1 - p, over those that are not null; null where there is none."""
    yes = no = F.lit(1.0)
    for p in probabilities:
        yes, no = yes * F.coalesce(p, F.lit(1.0)), no * F.coalesce(1.0 - p, F.lit(1.0))
    return F.when(F.coalesce(*probabilities).isNotNull() & (yes + no > 0), yes / (yes + no))


def score_margin(margin: Column, probability: Column, mode: str = "bees", tau: float = 0.25, least: float = 0.5) -> Column:
    """Score by which candidates are ranked.

    ``boundary``: near 0 is best; ``bees``: the pooled probability;
    ``reliability_boundary``: boundary times how far the probability is above
    ``least``. Without a probability the last two are minus infinity.
    """
    boundary = F.exp(-F.abs(margin) / max(tau, 1e-8))
    if mode == "boundary":
        return boundary
    if mode == "bees":
        return F.coalesce(probability, F.lit(float("-inf")))
    if mode == "reliability_boundary":
        above = F.when(probability > least, probability - least).otherwise(F.lit(0.0))
        return F.when(probability.isNull(), F.lit(float("-inf"))).otherwise(boundary * above / max(1.0 - least, 1e-8))
    raise ValueError(f"unknown score mode {mode}")


def instability(margin: Column, accuracy: Column, target: float = 0.5) -> Column:
    """How unsettled the last training was; reported only."""
    zero = F.lit(0.0)
    return F.greatest(zero, -F.coalesce(margin, zero)) + F.greatest(zero, target - F.coalesce(accuracy, F.lit(target)))


def dpo_margin(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column | None = None, ref_rejected: Column | None = None, beta: float = 0.1) -> Column:
    """beta times policy log-ratio less reference log-ratio; without a reference its part is 0."""
    ratio = policy_chosen - policy_rejected
    return beta * (ratio if ref_chosen is None else ratio - (ref_chosen - ref_rejected))


def difficulty_score(bleu: Column, sim_char: Column, sim_jacc: Column, hardness: Column) -> Column:
    """The first metric that a pair has, within 0..1; hardness as it is."""
    return F.coalesce(clamp(bleu / 100.0, 0.0, 1.0), clamp(sim_char, 0.0, 1.0), clamp(sim_jacc, 0.0, 1.0), hardness, F.lit(0.0))


def pair_quality(bleu: Column, sim_char: Column, sim_jacc: Column, len_ratio: Column) -> Column:
    """Close enough to compare, not near-duplicates: high near fixed centres."""
    share = lambda c: clamp(F.coalesce(c, F.lit(0.0)), 0.0, 1.0)
    near = lambda c, centre: 1.0 - F.least(F.lit(1.0), F.abs(c - centre) / centre)
    return 0.35 * near(share(sim_char), 0.48) + 0.25 * near(share(sim_jacc), 0.22) + 0.25 * near(share(bleu / 100.0), 0.24) + 0.15 * share(len_ratio)


def token_logprob(logprobs: Column, token: Column) -> Column:
    """A token's log-probability from a map by text id: its own entry, or the only one."""
    return F.coalesce(F.try_element_at(logprobs, token.cast("string")), F.when(F.size(logprobs) == 1, F.get(F.map_values(logprobs), F.lit(0))))


def shard_of(rank: Column, n: Column, shards: int) -> Column:
    """Contiguous shards of ceil(n / shards) rows; rank from 0."""
    return F.floor(rank / F.ceil(n / shards)).cast("int")
