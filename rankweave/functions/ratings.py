"""Rating formulas as column expressions; every one stays in generated code."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import clamp, half_up

#: Event K and league K by event tier.
EVENT_K = {"worlds-playoffs": 34, "worlds-main": 24, "msi-bracket": 34, "msi-play-in": 24, "major-playoffs": 22, "minor-international": 20, "regional-regular": 14, "qualifier": 12}
LEAGUE_K = {"worlds-playoffs": 24, "worlds-main": 18, "msi-bracket": 24, "msi-play-in": 18, "major-playoffs": 0, "minor-international": 12, "regional-regular": 0, "qualifier": 0}
#: Scale of game odds, of the uncertainty penalty and its floor; the public scale's middle, slope and limits.
ODDS_SCALE, PENALTY_SCALE, PENALTY_FLOOR = 360.0, 620.0, 0.45
PUBLIC_MIDDLE, PUBLIC_SLOPE, PUBLIC_LOW, PUBLIC_HIGH, INTERNAL_MIDDLE = 1800.0, 3.25, 1000.0, 3000.0, 1500.0
#: Eligibility limits.
MIN_MATCHES, MIN_RECENT, RECENT_DAYS, MOST_UNCERTAINTY = 20, 6, 90, 105.0


def lookup(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def expected(a: Column, b: Column, scale: float = 400.0) -> Column:
    """Elo expectation of a against b."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (b - a) / scale))


def penalty(uncertainty_a: Column, uncertainty_b: Column) -> Column:
    """How far a probability keeps from one half, given both sides' uncertainty."""
    return clamp(1.0 - F.sqrt(uncertainty_a * uncertainty_a + uncertainty_b * uncertainty_b) / PENALTY_SCALE, PENALTY_FLOOR, 1.0)


def game_probability(a: Column, b: Column, uncertainty_a: Column, uncertainty_b: Column) -> Column:
    """Win probability of one game, to four places."""
    p = half_up(expected(a, b, ODDS_SCALE), 4)
    return half_up(0.5 + (p - 0.5) * half_up(penalty(uncertainty_a, uncertainty_b), 4), 4)


def series_probability(p: Column, best_of: int) -> Column:
    """Probability of more than half of ``best_of`` games, each won with ``p``, to four places."""
    q = 1.0 - p
    return half_up(sum(comb(best_of, w) * F.pow(p, F.lit(w)) * F.pow(q, F.lit(best_of - w)) for w in range(best_of // 2 + 1, best_of + 1)), 4)


def series_points(own: Column, other: Column, uncertainty: Column, other_uncertainty: Column, best_of: Column) -> Column:
    """Expected points of a series: the chance of a game, drawn to one half by uncertainty, over the format; to four places."""
    p = 0.5 + (expected(own, other, ODDS_SCALE) - 0.5) * penalty(uncertainty, other_uncertainty)
    three = p * p * (3.0 - 2.0 * p)
    five = p * p * p * (10.0 - 15.0 * p + 6.0 * p * p)
    return half_up(F.when(best_of <= 2, p).when(best_of <= 4, three).otherwise(five), 4)


def live_series_probability(p: Column, need_a: Column, need_b: Column) -> Column:
    """Probability of winning ``need_a`` more games before the other side wins ``need_b``: a negative-binomial sum, to four places."""
    ways = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda s, i: s * (need_a - 1 + i) / i)
    terms = F.transform(F.sequence(F.lit(0), need_b - 1), lambda k: F.when(k == 0, F.lit(1.0)).otherwise(ways(F.greatest(k, F.lit(1)))) * F.pow(1.0 - p, k))
    return half_up(F.when(need_a <= 0, 1.0).when(need_b <= 0, 0.0).otherwise(F.pow(p, need_a) * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)), 4)


def public_score(rating: Column) -> Column:
    return clamp(PUBLIC_MIDDLE + (rating - INTERNAL_MIDDLE) * PUBLIC_SLOPE, PUBLIC_LOW, PUBLIC_HIGH)


def internal_rating(score: Column) -> Column:
    """The inverse of ``public_score`` within its limits."""
    return INTERNAL_MIDDLE + (score - PUBLIC_MIDDLE) / PUBLIC_SLOPE


def event_weight(tier: Column) -> Column:
    return lookup(EVENT_K, tier, 14) / 14.0


def uncertainty_multiplier(u: Column) -> Column:
    return clamp(1.0 + (u - 50.0) / 100.0, 0.75, 1.75)


def next_uncertainty(u: Column, k: Column, cross_league: Column) -> Column:
    """Uncertainty after a series: less 5, up to 8 by the event's K, 7 more across leagues; at least 20."""
    return F.greatest(u - 5.0 - 8.0 * clamp((k - 12.0) / 22.0, 0.0, 1.0) - F.when(cross_league, 7.0).otherwise(0.0), F.lit(20.0))


def side_edge(blue: Column, red: Column) -> Column:
    """Rating points that the blue side is worth: shrunken log odds of its wins, to one place."""
    n = blue + red
    return half_up(400.0 / F.ln(F.lit(10.0)) * F.ln((blue + 0.5) / (red + 0.5)) * n / (n + 24.0), 1)


def effective_league(prior: Column, raw: Column, n: Column) -> Column:
    """A league's score, shrunken towards its prior by the number of its cross-league games."""
    return prior + n / (n + 8.0) * (raw - prior)


def eligibility_reasons(matches: Column, recent: Column, idle_days: Column, uncertainty: Column) -> Column:
    """Why a team is not ranked; an empty array if it is."""
    return F.array_compact(
        F.array(
            F.when(matches < MIN_MATCHES, "few-matches"),
            F.when(recent < MIN_RECENT, "few-recent"),
            F.when(idle_days > RECENT_DAYS, "inactive"),
            F.when(uncertainty > MOST_UNCERTAINTY, "uncertain"),
        )
    )


#: Fixed values of execution: weights of kills, gold and objectives, the index's cap, and its share of an outcome.
EXECUTION, EXECUTION_CAP, EXECUTION_SHARE = (0.14, 0.72, 0.14), 0.25, 0.25


def execution_index(kills: Column, kills_against: Column, gold: Column, gold_against: Column, objectives: Column, objectives_against: Column) -> Column:
    """How much better than its opponent a side played, -0.25 to 0.25, by shares of kills, gold and objectives."""
    edge = lambda a, b: (a - b) / F.greatest((a + b).cast("double"), F.lit(1.0))
    k, g, o = EXECUTION
    return clamp(edge(kills, kills_against) * k + edge(gold, gold_against) * g + edge(objectives, objectives_against) * o, -EXECUTION_CAP, EXECUTION_CAP)


def soft_outcome(won: Column, execution: Column) -> Column:
    """An outcome between 0 and 1 that a quarter of execution blends into."""
    return clamp((1.0 - EXECUTION_SHARE) * F.when(won, 1.0).otherwise(0.0) + EXECUTION_SHARE * (0.5 + execution), 0.0, 1.0)


def volatility_multiplier(continuity: Column) -> Column:
    """How much a changed roster raises K; 1 where continuity is not known."""
    return F.coalesce(clamp(1.0 + (1.0 - continuity) * 0.5, 1.0, 1.35), F.lit(1.0))


def matchup_bands(a: Column, b: Column, uncertainty_a: Column, uncertainty_b: Column, side_edge: float = 12.0, sigma: float = 1.0) -> dict[str, Column]:
    """Chances of one game: neutral, with a on either side, and at the ends of a band of ``sigma``."""
    u = (uncertainty_a, uncertainty_b)
    half = side_edge / 2.0
    wide = F.sqrt(uncertainty_a * uncertainty_a + uncertainty_b * uncertainty_b) * sigma / 2.0
    game = lambda x: game_probability(a + x, b - x, *u)
    return {"neutral": game_probability(a, b, *u), "blue": game(F.lit(half)), "red": game(F.lit(-half)), "low": game(-wide), "high": game(wide)}


def public_delta(delta: Column) -> Column:
    return delta * PUBLIC_SLOPE


def internal_delta(delta: Column) -> Column:
    return delta / PUBLIC_SLOPE


def league_adjustment(rating: Column, league: Column) -> Column:
    """What a league adds to a team's rating, whole."""
    return half_up(rating + (league - INTERNAL_MIDDLE) - rating)


def variant_probability(variants: Column, names: list[str], fallback: Column) -> Column:
    """The first variant of ``names`` that is there, else the fallback."""
    return F.coalesce(*[variants[n] for n in names], fallback)


def variant_present(variants: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | variants[n].isNotNull()
    return out


def feature_weight(mode: Column, live: float) -> Column:
    """The weight of a feature in published predictions: none in shadow or switched off."""
    return F.when(mode == "live", live).otherwise(0.0)
