"""The whole rating model by UTC date: teams, leagues, momentum, rosters and their decay, with standings from the state.

All series of a date are scored from the state frozen at its start. Series enter the fold summed up by what sets
their delta, so a step's task holds the state and a few rows for each pair that meets; scoring all series from
the frozen states is parallel again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import taxonomy as T
from ..functions.ratings import EVENT_K, LEAGUE_K, ODDS_SCALE, PENALTY_FLOOR, PENALTY_SCALE, lookup, series_points
from ..functions.rounding import clamp, half_up
from .series import outcome, sides
from .storage import new_path, write_back

#: Start; recency by gap; retention of teams and leagues at a new season, split and patch; of momentum likewise.
START, KEEP, FADE, FADE_DAYS = 1500.0, 0.62, 0.38, 180.0
SEASON, SPLIT, PATCH = (0.8, 0.94), (0.92, 0.97), 0.985
MOMENTUM_SPLIT, MOMENTUM_PATCH, MOMENTUM_GAME, MOMENTUM_CAP, SPLIT_DAYS = 0.2, 0.65, 0.88, 70.0, 21
#: Shares of evidence, and how much of it counts beyond the league by its tier.
STABLE, FORM, LEAGUE_SHARE = 0.9, 0.1, 0.12
TRANSFER = {"tier-one": 1.0, "tier-two": 0.65, "tier-three": 0.38, "emerging": 0.25, "unknown": 0.15}
#: Fixed values of rosters: least retention, uncertainty of a change, and most that a change raises K.
CONTINUITY_FLOOR, CHANGE_PENALTY, VOLATILE = 0.55, 40.0, 1.35
LEAST_UNCERTAIN, MOST_UNCERTAIN = 20.0, 140.0
#: Events after Worlds of a year count so much; events that are international.
PRESEASON = 0.35
INTERNATIONAL = ("worlds-playoffs", "worlds-main", "msi-bracket", "msi-play-in", "minor-international")
#: Fixed values of published offsets: soft cap, share beyond it; roster priors; league anchors; sparse records; relief; nudges.
SOFT_CAP, BEYOND = 70.0, 0.3
PRIOR_GAMES, FULL_RATE, FLOOR_RATE, FLOOR_SHARE = 12, 0.5, 0.35, 0.25
LEAST_RELIABLE, FULL_MATCHES = 0.35, 12.0
RELIEF_GAMES, RELIEF_UNCERTAIN, RELIEF_OFFSET, RELIEF_MOST, RELIEF_SHARE = 20, 50.0, 15.0, 20.0, 0.35
NUDGE_GAMES, NUDGE_UNCERTAIN, NUDGE_DAYS, NUDGE_FORMAT, NUDGE_GAP, NUDGE_MOST, NUDGE_MARGIN = 20, 50.0, 30, 3, 6.0, 3.0, 0.8
#: Dates that one step folds.
DATES = 128
SCHEMA = "kind string, period long, name string, rating double, momentum double, uncertainty double, continuity double, power double, played double"
#: What an entry of an event (one of its teams) has besides; its ``period`` is the day that the event ends.
ENTRY = "event string, league string, opens long, prior double, points double, k double, cap double, most double"
#: Placements that move a league's score by less do not count.
LEAST_DELTA = 0.05


def after_worlds(series: DataFrame) -> DataFrame:
    """``series`` with ``multiplier``: less than 1 after the last Worlds date of the same year, for other events."""
    worlds = F.col("tier").isin("worlds-playoffs", "worlds-main")
    ends = series.where(worlds).groupBy(F.year("date").alias("worlds_year")).agg(F.max("date").alias("worlds_end"))  # a row a year
    out = series.join(F.broadcast(ends), F.year("date") == F.col("worlds_year"), "left")
    late = ~worlds & (F.col("date") > F.col("worlds_end"))
    return out.withColumn("multiplier", F.when(late, PRESEASON).otherwise(1.0)).drop("worlds_year", "worlds_end")


#: All that tells a series from another one but its id, as far as the replay and the standings look.
TOLD = ("date", "season", "split", "patch", "team_a", "team_b", "league_a", "league_b", "tier", "state", "winner", "best_of", "games", "wins_a", "wins_b", "continuity_a", "continuity_b")


def tallied(series: DataFrame) -> DataFrame:
    """A row for all ``series`` that agree on what they have of ``TOLD``, with ``n``, their number, and ``series_id`` and ``last_id``, the least and greatest id."""
    return series.groupBy(*[c for c in TOLD if c in series.columns]).agg(F.count("*").alias("n"), F.min("series_id").alias("series_id"), F.max("series_id").alias("last_id"))


def with_evidence(series: DataFrame) -> DataFrame:
    """Two rows for each completed series with all that a delta hangs on but the state. ``series`` may have ``split``, and ``continuity_a`` and ``_b``."""
    rows = after_worlds(series.where("state = 'completed'"))
    for c in ("continuity_a", "continuity_b"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    rows = sides(rows).withColumn("continuity", F.when(F.col("side_no") == 1, F.col("continuity_a")).otherwise(F.col("continuity_b")))
    most = F.greatest("wins_a", "wins_b")
    decisive = (F.col("best_of") > 1) & (most >= F.floor(F.col("best_of") / 2) + 1)
    signal = F.when(decisive, 1.0 + F.least(F.lit(0.18), 0.06 * F.greatest(F.col("best_of") - F.col("games"), F.lit(0)))).otherwise(1.0)
    abroad = (F.col("league") != F.col("opponent_league")) & F.col("tier").isin(*INTERNATIONAL)
    league_k = lookup(LEAGUE_K, F.col("tier"), 0).cast("double") * F.col("multiplier")
    known = ~T.code(F.col("league")).isin("UNKNOWN") & ~T.code(F.col("opponent_league")).isin("UNKNOWN")
    return rows.withColumns(
        {
            "period": F.unix_date("date").cast("long"),
            "observed": outcome(),
            "k": lookup(EVENT_K, F.col("tier"), 14).cast("double") * F.col("multiplier"),
            "league_k": F.when(abroad & known, league_k).otherwise(0.0),
            "signal": half_up(signal, 2),
            "abroad": abroad,
            "transfer": F.lit(None).cast("double"),
        }
    ).where("team is not null and opponent is not null and date is not null")


def with_priors(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_evidence`` with ``own_prior``, what a team's roster adds to its power: that of the series (``prior_a``, ``prior_b``), else the one carried from its last date before, else 0."""
    if "prior_a" not in rows.columns:
        return rows.withColumn("own_prior", F.lit(0.0))
    told = F.when(F.col("side_no") == 1, F.col("prior_a")).otherwise(F.col("prior_b"))
    rows = rows.withColumn("told", told)
    held = carried(rows.select("team", "period", "series_id", "told")).withColumnRenamed("prior", "held")
    return rows.join(held, ["team", "period"]).withColumn("own_prior", F.coalesce("told", "held", F.lit(0.0))).drop("told", "held")


def carried(told: DataFrame) -> DataFrame:
    """(team, period, prior): what ``told`` (team, period, series_id, told) leaves a team with before each of its dates, by the last series of an earlier one that tells; null before any."""
    days = told.groupBy("team", "period").agg(F.max_by("told", "series_id").alias("told"))
    before = Window.partitionBy("team").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # a row a team and date
    return days.select("team", "period", F.last("told", ignorenulls=True).over(before).alias("prior"))


def transfer(rows: DataFrame, tiers: Column, opponent_tiers: Column) -> DataFrame:
    """``rows`` with ``transfer``: all of a series abroad counts; at home as much as the lower of both leagues' tiers."""
    own, other = lookup(TRANSFER, tiers, 0.15), lookup(TRANSFER, opponent_tiers, 0.15)
    return rows.withColumn("transfer", F.when(F.col("abroad"), 1.0).otherwise(F.least(own, other)))


def _round(x, scale):
    import numpy as np

    return np.floor(x * scale + 0.5) / scale


def expected_points(rating, other, uncertainty, other_uncertainty, best_of):
    """Expected points of series, in numpy: the chance of a game, drawn to one half by uncertainty, over the format."""
    import numpy as np

    raw = 1.0 / (1.0 + np.power(10.0, (other - rating) / ODDS_SCALE))
    penalty = np.clip(1.0 - np.sqrt(uncertainty**2 + other_uncertainty**2) / PENALTY_SCALE, PENALTY_FLOOR, 1.0)
    p = 0.5 + (raw - 0.5) * penalty
    three = p**2 * (3.0 - 2.0 * p)
    five = p**3 * (10.0 - 15.0 * p + 6.0 * p**2)
    return _round(np.where(best_of <= 2, p, np.where(best_of <= 4, three, five)), 1e4)


def placed(event, league, power, points, k, cap, most):
    """(event, league, delta) of the entries of events that end, in numpy: points made beyond those expected by softmax of the powers before the event."""
    import numpy as np

    _, at = np.unique(event, return_inverse=True)
    top = np.full(at.max() + 1, -np.inf)
    np.maximum.at(top, at, power)
    weight = np.round(np.exp((power - top[at]) / 400.0), 8)
    expected = np.round(1.0 + weight / np.bincount(at, weight)[at] * (most - 1.0), 6)
    (events, leagues), first, at = _groups(event, league)
    gap = np.round(np.bincount(at, points) - np.bincount(at, expected), 6)
    delta = _round(np.clip(k[first] * gap / np.sqrt(np.bincount(at)), -cap[first], cap[first]), 10.0)
    counts = np.abs(delta) >= LEAST_DELTA
    return events[counts], leagues[counts], delta[counts]


def _groups(*keys):
    """(keys of each group, its first row, each row's group), in numpy."""
    import numpy as np

    both, first, at = np.unique(np.stack(keys), axis=1, return_index=True, return_inverse=True)
    return both, first, at.reshape(-1)


def fold_model(days: list[tuple], before: tuple | None, priors: dict[str, tuple[float, float]], final: bool = True):
    """The fold of ``days``, each (period, season, split, patch of its first series, its two teams, and season, split and patch of its last).

    ``before`` is the day before them, and ``priors`` has each league's prior and cap. Entries of events are
    rows of the state: their powers are taken on the day their event opens, before its series, and the event moves
    the scores of its leagues on the first day after its end, before anything else; with ``final``, events
    that have ended by the last day move them too. Entries of events that are over leave the state.
    """

    def fold(state, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def table(kind):
            return state.filter(pc.equal(state.column("kind"), kind))

        team_state, league_state, entries = table("team"), table("league"), table("entry")
        teams = pc.unique(pa.concat_arrays([team_state.column("name").combine_chunks(), entries.column("name").combine_chunks(), *(rows.column(c).combine_chunks() for c in ("team", "opponent"))]))
        leagues = pc.unique(pa.concat_arrays([league_state.column("name").combine_chunks(), entries.column("league").combine_chunks(), *(rows.column(c).combine_chunks() for c in ("league", "opponent_league"))]))

        def start(names, own, column, value):
            out = np.full(len(names), value)
            if own.num_rows:
                out[pc.index_in(own.column("name"), value_set=names).to_numpy()] = own.column(column).to_numpy(zero_copy_only=False)
            return out

        prior = np.array([priors.get(x, priors[""])[0] for x in leagues.to_pylist()])
        cap = np.array([priors.get(x, priors[""])[1] for x in leagues.to_pylist()])
        rating, momentum = start(teams, team_state, "rating", START), start(teams, team_state, "momentum", 0.0)
        uncertain, continuity = start(teams, team_state, "uncertainty", MOST_UNCERTAIN), start(teams, team_state, "continuity", np.nan)
        score, played = start(leagues, league_state, "rating", np.nan), start(leagues, league_state, "played", 0.0)
        score = np.where(np.isnan(score), prior, score)
        # A team or league that comes later is at its start until then, which decay leaves as it is.
        rows = rows.sort_by("period")
        index = lambda c, names: pc.index_in(rows.column(c), value_set=names).to_numpy()
        own, other, home, away = index("team", teams), index("opponent", teams), index("league", leagues), index("opponent_league", leagues)
        number = lambda c: rows.column(c).to_numpy(zero_copy_only=False).astype("float64")
        k, league_k, signal, observed, best_of, share, n, kept = (number(c) for c in ("k", "league_k", "signal", "observed", "best_of", "transfer", "n", "continuity"))
        own_prior, other_prior = number("own_prior"), number("other_prior")
        abroad = number("abroad") > 0
        edges = np.searchsorted(rows.column("period").to_numpy(), [*(d[0] for d in days), days[-1][0] + 1])
        place = {x: i for i, x in enumerate(teams.to_pylist())}
        found, moves, last = [], [], before
        events = pc.unique(entries.column("event").combine_chunks())
        spot = lambda c, names: pc.index_in(entries.column(c), value_set=names).to_numpy()
        entered = lambda c: entries.column(c).to_numpy(zero_copy_only=False).astype("float64")
        event, entrant, entry_league = spot("event", events), spot("name", teams), spot("league", leagues)
        opens, closes, powers, entry_prior, *terms = (entered(c) for c in ("opens", "period", "power", "prior", "points", "k", "cap", "most"))
        over = np.zeros(len(event), "bool")

        def settle(until):
            due = ~over & ~np.isnan(powers) & (closes < until)
            if due.any():
                e, which, delta = placed(event[due], entry_league[due], powers[due], *(x[due] for x in terms))
                moves.append((closes[due][[np.flatnonzero(event[due] == x)[0] for x in e]].astype("int64"), e, which, delta))
                over[due] = True
                return np.bincount(which, delta, len(leagues))
            return 0.0

        for i, day in enumerate(days):
            date, season, split, patch, first, second, *end = day
            score = score + settle(date)
            if last is not None:
                gap = date - last[0]
                hold = KEEP + FADE * np.exp(-gap / FADE_DAYS) if gap > 0 else 1.0
                team_hold, league_hold = hold, hold
                if season != last[6]:
                    team_hold, league_hold = team_hold * SEASON[0], league_hold * SEASON[1]
                    momentum = np.zeros(len(teams))
                elif split != last[7] and gap >= SPLIT_DAYS:
                    team_hold, league_hold = team_hold * SPLIT[0], league_hold * SPLIT[1]
                    momentum = momentum * MOMENTUM_SPLIT
                elif patch and last[8] and patch != last[8]:
                    both = [place[t] for t in (first, second) if t in place]
                    rating[both] = START + PATCH * (rating[both] - START)
                    momentum[both] = momentum[both] * MOMENTUM_PATCH
                rating = START + team_hold * (rating - START)
                score = prior + league_hold * (score - prior)
            last = day
            now = slice(edges[i], edges[i + 1])
            a, b, la = own[now], other[now], home[now]
            if not len(a):
                continue
            seen = ~np.isnan(kept[now])
            at, one = np.unique(a[seen], return_index=True)
            c = kept[now][seen][one]
            rating[at] = START + (CONTINUITY_FLOOR + (1.0 - CONTINUITY_FLOOR) * c) * (rating[at] - START)
            uncertain[at] = np.where(c < 1, np.clip(uncertain[at] + CHANGE_PENALTY * (1.0 - c), LEAST_UNCERTAIN, MOST_UNCERTAIN), uncertain[at])
            continuity[at] = c
            effective = np.minimum(prior + played / (played + T.CONNECTIVITY) * (score - prior), cap)
            opening = (opens <= date) & np.isnan(powers)
            powers[opening] = (rating + momentum)[entrant[opening]] + (effective[entry_league[opening]] - START) + entry_prior[opening]
            playing, first_row = np.unique(a, return_index=True)
            power = np.zeros(len(teams))
            power[playing] = rating[playing] + (effective[la[first_row]] - START) + momentum[playing]
            found.append((np.full(len(playing), date), playing, rating[playing].copy(), momentum[playing].copy(), uncertain[playing].copy(), power[playing].copy()))
            expected = expected_points(power[a] + own_prior[now], power[b] + other_prior[now], uncertain[a], uncertain[b], best_of[now])
            multiplier = np.clip(1.0 + (uncertain[a] - 50.0) / 100.0, 0.75, 1.75)
            volatile = np.where(np.isnan(continuity[a]), 1.0, np.clip(1.0 + (1.0 - continuity[a]) * 0.5, 1.0, VOLATILE))
            evidence = k[now] * signal[now] * multiplier * volatile * (observed[now] - expected)
            left = 1.0 - np.where(league_k[now] > 0, LEAGUE_SHARE, 0.0)
            delta = np.floor(evidence * left * STABLE * share[now] + 0.5)
            sums = lambda values: np.bincount(a, values * n[now], len(teams))
            count = sums(np.ones(len(a)))
            rating = rating + sums(delta)
            momentum = np.where(count > 0, np.clip(momentum * MOMENTUM_GAME**count + sums(evidence * left * FORM), -MOMENTUM_CAP, MOMENTUM_CAP), momentum)
            lost = 5.0 + 8.0 * np.clip((k[now] - 12.0) / 22.0, 0.0, 1.0) + np.where(abroad[now], 7.0, 0.0)
            uncertain = np.maximum(uncertain - sums(lost), LEAST_UNCERTAIN)
            moved = _round(league_k[now] * signal[now] * (observed[now] - expected), 1e3) * n[now]
            score = score + np.bincount(la, moved, len(leagues))
            played = played + np.bincount(la, (league_k[now] > 0) * n[now], len(leagues))
        if final and last is not None:
            score = score + settle(last[0] + 1)
        period, who, *values = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, "int64"), np.zeros(0, "int64"), *[np.zeros(0)] * 4)
        ended, e, which, delta = (np.concatenate(x) for x in zip(*moves, strict=True)) if moves else (*[np.zeros(0, "int64")] * 3, np.zeros(0))
        schema = state.schema

        def part(kind, names, **values):
            full = {"kind": pa.array([kind] * len(names), pa.string()), "name": names, **values}
            return pa.table([pa.array(full[f.name], f.type) if full.get(f.name) is not None else pa.nulls(len(names), f.type) for f in schema], schema=schema)

        held = entries.set_column(entries.schema.get_field_index("power"), "power", pa.array(powers, pa.float64(), mask=np.isnan(powers))).filter(pa.array(~over))
        return pa.concat_tables(
            [
                part("frozen", teams.take(pa.array(who)), period=period, rating=values[0], momentum=values[1], uncertainty=values[2], power=values[3]),
                part("team", teams, rating=rating, momentum=momentum, uncertainty=uncertain, continuity=continuity),
                part("league", leagues, rating=score, played=played),
                part("placed", leagues.take(pa.array(which)), period=ended, rating=delta, event=events.take(pa.array(e))),
                held.cast(schema),
            ]
        )

    return fold


def entries_of(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the state for ``events`` (event_key, team, league, points, opens, closes, k, cap, most, in dates), with the roster prior that a team has before its event opens."""
    own = events.where("team is not null and opens is not null and closes is not null").withColumns({c: F.unix_date(c).cast("long") for c in ("opens", "closes")})
    if "prior_a" in rows.columns:
        told = rows.select("team", "period", "series_id", F.when(F.col("side_no") == 1, F.col("prior_a")).otherwise(F.col("prior_b")).alias("told"))
        asked = own.select("team", F.col("opens").alias("period")).distinct().withColumns({"series_id": F.lit(None).cast(told.schema["series_id"].dataType), "told": F.lit(None).cast("double")})
        own = own.join(carried(told.unionByName(asked)).withColumnRenamed("period", "opens"), ["team", "opens"])
    else:
        own = own.withColumn("prior", F.lit(None).cast("double"))
    made = {"kind": F.lit("entry"), "period": F.col("closes"), "name": F.col("team"), "event": F.col("event_key"), "prior": F.coalesce("prior", F.lit(0.0))}
    kinds = {f.split()[0]: f.split()[1] for f in f"{SCHEMA}, {ENTRY}".split(", ")}
    return own.select(*[(made[c] if c in made else F.col(c) if c in own.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def replay_model(series: DataFrame, league_tiers: dict[str, str], tallies: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(teams, leagues, predictions) of ``series`` (from ``resolve_series``, with ``split`` if splits count).

    ``league_tiers`` names each league's tier; others are unknown. Teams have rating, momentum, uncertainty
    and continuity at the end, leagues their score, effective rating and games abroad; predictions are two
    rows for each completed series with the power that either side had and the expected points. Within a
    date, momentum fades once for each of a team's series and then takes what all of them gave.

    ``series`` may have ``prior_a`` and ``prior_b``, what either roster adds to its team's power in the series, whose
    players' edges ``player_model.pregame_edges`` gives; a side with null keeps what it had after its last date.
    """
    return replay_placed(series, league_tiers, tallies=tallies)[:3]


def replay_placed(series: DataFrame, league_tiers: dict[str, str], events: DataFrame | None = None, tallies: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``replay_model`` with placements of ``events``: (teams, leagues, predictions, placements).

    ``events`` (see ``tournaments.placement_entries``) has a row for each team of an event. Points are
    expected by the powers that the replay has before an event's first series; what a league's teams make
    beyond them moves its score on the first date after the event's end, and so all later powers. Events
    without an end never count; entries are held by the state from their event's first date to its end only.
    Placements are (event_key, league, date of the end, delta); deltas below 0.05 and unknown leagues have none.

    Series are summed up before anything is told of them, unless they have priors, which differ by series; ``tallies`` are
    those of ``tallied``, if they are there already. Only predictions then look at each series, when they are read.
    """
    spark = series.sparkSession
    path = new_path(spark, "model")
    if "split" not in series.columns:
        series = series.withColumn("split", F.lit(""))
    tier = lambda c: F.create_map(*[F.lit(x) for p in league_tiers.items() for x in p])[F.col(c)]
    evidence = lambda x: transfer(with_evidence(x), F.coalesce(tier("league"), F.lit("unknown")), F.coalesce(tier("opponent_league"), F.lit("unknown")))
    if tallies is None:
        tallies = write_back(tallied(series), f"{path}/tallies")
    if "prior_a" in series.columns:
        # What follows reads them four times.
        rows = with_priors(write_back(evidence(series), f"{path}/evidence"))
        others = rows.select("series_id", F.col("team").alias("opponent"), F.col("own_prior").alias("other_prior"))
        rows = write_back(rows.join(others, ["series_id", "opponent"]), f"{path}/rows")
        each = rows.withColumn("n", F.lit(1))
    else:
        rows, each = (with_priors(evidence(x)).withColumn("other_prior", F.lit(0.0)) for x in (series, tallies))
    by = ["own_prior", "other_prior", "period", "team", "opponent", "league", "opponent_league", "k", "league_k", "signal", "observed", "best_of", "transfer", "abroad", "continuity"]
    summed = each.groupBy(*by).agg(F.sum("n").cast("double").alias("n")).withColumn("abroad", F.col("abroad").cast("double"))
    summed = write_back(summed.repartitionByRange("period").sortWithinPartitions("period"), f"{path}/summed")
    own = F.struct("season", "split", "patch")
    days = tallies.where("date is not null").groupBy(F.unix_date("date").cast("long").alias("period")).agg(F.min_by(F.struct("season", "split", "patch", "team_a", "team_b"), "series_id").alias("a"), F.max_by(own, "last_id").alias("b"))
    days = [(r["period"], *r["a"], *r["b"]) for r in days.orderBy("period").collect()]  # one short row a date
    priors = {name: (T.TIER_PRIORS[t], T.TIER_CAPS.get(t, float("inf"))) for name, t in {**league_tiers, "": "unknown"}.items()}
    schema = f"{SCHEMA}, {ENTRY}"
    state, before = spark.createDataFrame([], schema), None
    entries = state if events is None else write_back(entries_of(events.where("league is not null and league <> 'Unknown'"), rows), f"{path}/entries")
    one = F.lit(0).alias("one")
    for i in range(0, len(days), DATES):
        now = days[i : i + DATES]
        part = summed.where(F.col("period").between(now[0][0], now[-1][0]))
        fresh = entries.where(F.col("opens").between(now[0][0], now[-1][0]))
        held = state if events is None else state.unionByName(fresh)
        folded = held.groupBy(one).cogroup(part.groupBy(one)).applyInArrow(fold_model(now, before, priors, now[-1] == days[-1]), schema)
        state = write_back(folded, f"{path}/states/step={i}").where("kind not in ('frozen', 'placed')")
        before = now[-1]
    states = spark.read.schema(schema).parquet(f"{path}/states") if days else state.limit(0)
    frozen = states.where("kind = 'frozen'")
    placements = states.where("kind = 'placed'").select(F.col("event").alias("event_key"), F.col("name").alias("league"), F.date_from_unix_date(F.col("period").cast("int")).alias("date"), F.col("rating").alias("delta"))
    teams = state.where("kind = 'team'").select(F.col("name").alias("team"), "rating", "momentum", "uncertainty", F.nanvl("continuity", F.lit(None).cast("double")).alias("continuity"))
    prior, cap = (lookup({name: v[j] for name, v in priors.items() if name}, F.col("name"), priors[""][j]) for j in (0, 1))
    effective = F.least(prior + F.col("played") / (F.col("played") + T.CONNECTIVITY) * (F.col("rating") - prior), cap)
    leagues = state.where("kind = 'league'").select(F.col("name").alias("league"), F.col("rating").alias("score"), effective.alias("effective"), F.col("played").alias("abroad"))
    return teams, leagues, predict(rows, frozen), placements


def predict(rows: DataFrame, frozen: DataFrame) -> DataFrame:
    """Both sides of each series with the power and uncertainty frozen for its date, and expected points by the whole model and by ratings alone."""
    f = frozen.select("period", F.col("name").alias("team"), "rating", "power", "uncertainty")
    o = f.withColumnsRenamed({"team": "opponent", "rating": "other_rating", "power": "other_power", "uncertainty": "other_uncertainty"})
    out = rows.join(f, ["period", "team"]).join(o, ["period", "opponent"])
    out = out.withColumns({"power": F.col("power") + F.col("own_prior"), "other_power": F.col("other_power") + F.col("other_prior")})

    def points(own: Column, other: Column) -> Column:
        return series_points(own, other, F.col("uncertainty"), F.col("other_uncertainty"), F.col("best_of"))

    return out.select("series_id", "date", "team", "opponent", "league", "opponent_league", "power", "other_power", "uncertainty", "observed", points(F.col("power"), F.col("other_power")).alias("p"), points(F.col("rating"), F.col("other_rating")).alias("p_team_only"))


# Published standings from the state.


def soft_capped(offset: Column) -> Column:
    """A team's offset, compressed above the soft cap."""
    return F.when(offset <= SOFT_CAP, offset).otherwise(SOFT_CAP + (offset - SOFT_CAP) * BEYOND)


def reliability(matches: Column) -> Column:
    return LEAST_RELIABLE + (1.0 - LEAST_RELIABLE) * clamp(matches / FULL_MATCHES, 0.0, 1.0)


def league_anchor(score: Column, matches: Column) -> Column:
    """A league's rating as a team's anchor: drawn to 1500 where the team has few matches."""
    return START + (score - START) * reliability(matches)


def sparse_blend(current: Column, last: Column, matches: Column) -> Column:
    """A standing between that of the last match and the current one, by matches; the current one without a last."""
    return F.coalesce(last + (current - last) * reliability(matches), current)


def roster_prior(offset: Column, wins: Column, losses: Column) -> Column:
    """A positive roster prior, cut for teams whose record does not bear it out."""
    games = wins + losses
    rate = wins / F.greatest(games, F.lit(1))
    scale = FLOOR_SHARE + (1.0 - FLOOR_SHARE) * (rate - FLOOR_RATE) / (FULL_RATE - FLOOR_RATE)
    cut = half_up(offset * F.when(rate <= FLOOR_RATE, FLOOR_SHARE).otherwise(scale), 1)
    return F.when((offset <= 0) | (games < PRIOR_GAMES) | (rate >= FULL_RATE), offset).otherwise(cut)


def anchor_relief(league: Column, rating: Column, wins: Column, losses: Column, uncertain: Column, basis: Column) -> Column:
    """Points that a team with much evidence gets against its league's anchor, where record and offset point the other way."""
    offset, margin, gap = rating - START, wins - losses, league - START
    fits = (basis == "sourced") & (wins + losses >= RELIEF_GAMES) & (uncertain <= RELIEF_UNCERTAIN) & (F.abs(offset) >= RELIEF_OFFSET)
    fits = fits & (margin != 0) & (F.signum(margin.cast("double")) == F.signum(offset)) & (gap != 0) & (F.signum(gap) != F.signum(offset))
    return F.when(fits, half_up(F.signum(offset) * F.least(F.lit(RELIEF_MOST), F.abs(gap) * RELIEF_SHARE), 1)).otherwise(0.0)


def nudges(series: DataFrame, standings: DataFrame) -> DataFrame:
    """Points that recent meetings move close teams of one league by: (team, nudge).

    ``standings`` has team, league, rating, uncertainty, games and basis. The winner of a pair's latest
    best-of-three or longer in the last days gets half the gap and a margin if it stands a little below the
    loser, which loses as much; both need games and certainty.
    """
    done = series.where((F.col("state") == "completed") & F.col("winner").isNotNull() & (F.col("best_of") >= NUDGE_FORMAT))
    last = series.agg(F.max("date").alias("last"))
    rows = done.crossJoin(F.broadcast(last)).where(F.datediff("last", "date") <= NUDGE_DAYS)
    loser = F.when(F.col("winner") == F.col("team_a"), F.col("team_b")).otherwise(F.col("team_a"))
    rows = rows.withColumns({"loser": loser, "low": F.least("team_a", "team_b"), "high": F.greatest("team_a", "team_b")})
    latest = rows.groupBy("low", "high").agg(F.max_by(F.struct("winner", "loser"), F.struct("date", (-F.col("series_id")).alias("s"))).alias("m")).select("m.*")
    able = standings.where((F.col("basis") == "sourced") & (F.col("games") >= NUDGE_GAMES) & (F.col("uncertainty") <= NUDGE_UNCERTAIN)).select("team", "league", "rating")
    pairs = latest.join(able.withColumnsRenamed({"team": "winner", "league": "winner_league", "rating": "winner_rating"}), "winner").join(able.withColumnsRenamed({"team": "loser", "league": "loser_league", "rating": "loser_rating"}), "loser")
    pairs = pairs.where("winner_league = loser_league").withColumn("gap", F.col("loser_rating") - F.col("winner_rating")).where((F.col("gap") > 0) & (F.col("gap") <= NUDGE_GAP))
    points = half_up(F.least(F.lit(NUDGE_MOST), F.col("gap") / 2.0 + NUDGE_MARGIN), 4)
    each = F.explode(F.array(F.struct(F.col("winner").alias("team"), points.alias("v")), F.struct(F.col("loser").alias("team"), (-points).alias("v"))))
    total = pairs.select(each.alias("e")).groupBy("e.team").agg(F.sum(F.col("e.v").cast("decimal(18,4)")).cast("double").alias("v"))
    return total.select("team", half_up(clamp(F.col("v"), -NUDGE_MOST, NUDGE_MOST), 1).alias("nudge"))


def standings(teams: DataFrame, leagues: DataFrame, records: DataFrame, series: DataFrame) -> DataFrame:
    """Standings from the state: components, rating and rank, eligible teams first.

    ``records`` has team, league, wins, losses, matches, eligible and basis; the nudges come from ``series``.
    """
    rows = teams.join(records, "team").join(leagues.select("league", "effective"), "league", "left")
    rows = rows.withColumn("effective", F.coalesce("effective", F.lit(T.TIER_PRIORS["unknown"])))
    anchor = half_up(league_anchor(F.col("effective"), F.col("matches")))
    stable = half_up(soft_capped(F.col("rating") - START))
    relief = anchor_relief(league_anchor(F.col("effective"), F.col("matches")), F.col("rating"), F.col("wins"), F.col("losses"), F.col("uncertainty"), F.col("basis"))
    rows = rows.withColumns({"league_anchor": anchor, "stable_offset": stable, "form_offset": half_up(F.col("momentum"), 1), "relief": relief})
    rows = rows.withColumn("shown", F.col("league_anchor") + F.col("stable_offset") + F.col("form_offset") + F.col("relief"))
    nudge = nudges(series, rows.select("team", "league", F.col("shown").alias("rating"), "uncertainty", (F.col("wins") + F.col("losses")).alias("games"), "basis"))
    rows = rows.join(nudge, "team", "left").withColumn("nudge", F.coalesce("nudge", F.lit(0.0)))
    rows = rows.withColumn("shown", half_up(F.col("shown") + F.col("nudge")))
    order = Window.orderBy(F.col("eligible").desc(), F.col("shown").desc(), "team")  # a row a team
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).select("team", "league", "league_anchor", "stable_offset", "form_offset", "relief", "nudge", F.col("shown").alias("rating"), half_up(F.col("uncertainty")).alias("uncertainty"), "eligible", "rank")
