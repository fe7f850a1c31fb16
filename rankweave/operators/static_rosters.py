"""Players by fixed rosters, for contests without numbers of players: a team's results are shared out among its players.

No state crosses teams, so each team is folded by itself and all in parallel. What a game means to a team is
worked out by Spark beforehand; a step folds the games of DATES days, so that a task holds one team's games of a
step and its roster, however long the contest is. Steps leave only the state of each roster; the history is made
from the states before each step, all steps at once, where it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratings import event_weight, execution_index, lookup
from ..functions.rounding import clamp, half_up
from .player_model import IMPACT, IMPACT_HIGH, IMPACT_LOW, ROLE_SHARES, START, replay_players
from .series import sides
from .storage import new_path, write_back

#: Points of a win, of a loss, of dominance, and the share that counts once.
WIN, LOSS, DOMINANCE, EVEN = 1.6, -1.1, 5.0, 0.2
#: Days that one step folds; games whose results are summed up at once where no share changes but by form, and that are walked one by one before it is tried again.
DATES, BLOCK, SINGLE = 256, 8192, 64
STATE = "team string, player long, rating double, delta double, games long, lately array<double>"
HISTORY = "team string, player long, game_key string, period long, rating double, delta double"
SIGNALS = ("base", "objectives", "awards", "recent", "availability", "certainty")


def team_games(games: DataFrame) -> DataFrame:
    """Two rows for each game (game_key, date, series_id, game_number, teams, winner, tier, and kills, gold, objectives by side): whether the team won, and the game's points for it."""
    own = lambda c: F.when(F.col("side_no") == 1, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).cast("double")
    other = lambda c: F.when(F.col("side_no") == 1, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).cast("double")
    rows = sides(games.withColumns({"league_a": F.lit(""), "league_b": F.lit("")}))
    won = F.coalesce(F.col("winner") == F.col("team"), F.lit(False))
    dominance = execution_index(own("kills"), other("kills"), own("gold"), other("gold"), own("objectives"), other("objectives"))
    points = F.when(won, WIN).otherwise(LOSS) * event_weight(F.col("tier")) + dominance * DOMINANCE
    return rows.where("date is not null").select("team", F.unix_date("date").cast("long").alias("period"), "game_key", "series_id", "game_number", won.alias("won"), half_up(points, 6).alias("points"))


def with_signals(rosters: DataFrame) -> DataFrame:
    """``rosters`` (team, player, role, and objectives, awards, recent, availability, certainty, null for none) within their limits; one row a player and team."""
    value = lambda c, none, low, high: clamp(F.coalesce(F.col(c).cast("double"), F.lit(none)), low, high).alias(c)
    rows = rosters.where("team is not null and player is not null").dropDuplicates(["team", "player"])
    return rows.select("team", "player", "role", lookup(ROLE_SHARES, F.col("role"), 0.2).alias("base"), F.coalesce(F.col("objectives").cast("double"), F.lit(0.0)).alias("objectives"), value("awards", 0.0, -3.0, 3.0), F.coalesce(F.col("recent").cast("double"), F.lit(0.0)).alias("recent"), value("availability", 1.0, 0.0, 1.0), value("certainty", 1.0, 0.5, 1.0))


def _place(x, scale=10.0):
    import numpy as np

    return np.floor(x * scale + 0.5) / scale


def _signal(rating):
    import numpy as np

    return np.minimum(np.maximum((rating - START) / 24.0, -2.0), 2.0)


def _shares(signal, form, roster):
    """The shares of a team's players, in numpy."""
    import numpy as np

    clip = lambda x, low, high: np.minimum(np.maximum(x, low), high)
    objectives = clip(roster["objectives"] + signal * 0.35, -3.0, 3.0)
    recent = clip(roster["recent"] + form, -3.0, 3.0)
    impact = clip(1.0 + IMPACT[0] * objectives + IMPACT[1] * roster["awards"] + IMPACT[2] * recent, IMPACT_LOW, IMPACT_HIGH)
    raw = roster["base"] * impact * roster["availability"] * roster["certainty"]
    return raw / (raw.sum() or 1.0)


def forms(lately, won):
    """The form before each game and after the last: twice the share of wins among the last five, less one; 0 before any. ``lately`` has the last five results before, oldest first."""
    import numpy as np

    n, known = len(lately), np.append(lately, won)
    wins, end = np.append(0.0, np.cumsum(known)), np.arange(n, len(known) + 1)
    count = np.minimum(end, 5)
    return np.where(count > 0, _place(((wins[end] - wins[end - count]) / np.maximum(count, 1) - 0.5) * 2.0, 1e6), 0.0), known[-5:]


def walk(rating, points, form, roster):
    """(ratings, deltas) after each game, a block of games after another.

    A share hangs on the form, and on a rating within 48 points of the start only. While no rating is that near, the
    games of a block are summed up at once, to the first that brings one near; other games are walked one by one.
    """
    import numpy as np

    at, n, single = 0, len(points), 0
    while at < n:
        signal = _signal(rating)
        if single or (np.abs(signal) < 2.0).any():
            last = min(n, at + (single or SINGLE))
            ratings, deltas = np.empty((last - at, len(rating))), np.empty((last - at, len(rating)))
            for i in range(at, last):
                deltas[i - at] = _place(points[i] * (_shares(_signal(rating), form[i], roster) / EVEN))
                ratings[i - at] = rating = _place(rating + deltas[i - at])
            single = 0
        else:
            last = min(n, at + BLOCK)
            kinds, kind = np.unique(form[at:last], return_inverse=True)
            share = np.stack([_shares(signal, f, roster) for f in kinds])[kind]
            deltas = _place(points[at:last, None] * (share / EVEN))
            # Ratings are whole tenths, so that their sums are those of one game after another.
            ratings = np.cumsum(np.vstack([np.rint(rating * 10.0), np.rint(deltas * 10.0)]), axis=0)[1:] / 10.0
            moved = (_signal(ratings) != signal).any(axis=1)
            if moved.any():
                last = at + int(moved.argmax()) + 1
                ratings, deltas, single = ratings[: last - at], deltas[: last - at], SINGLE
            rating = ratings[-1]
        yield ratings, deltas
        at = last


def _games_of(state, rows):
    """(a roster with its ratings, points and forms of a team's games in order, results lately, the games), in numpy."""
    import numpy as np

    roster = {c: state[c].to_numpy() for c in SIGNALS}
    rows = rows.sort_by([(c, "ascending") for c in ("period", "series_id", "game_number")])
    form, lately = forms(np.array(state["lately"][0].as_py(), "float64"), rows["won"].to_numpy(zero_copy_only=False).astype("float64"))
    return roster, rows["points"].to_numpy(zero_copy_only=False), form, lately, rows


def fold_team(state, rows):
    """The fold of one team's games of a step: ``state`` has its roster with ratings so far."""
    import numpy as np
    import pyarrow as pa

    k = state.num_rows
    if not k:
        return pa.table({f: pa.array([], t) for f, t in (("team", pa.string()), ("player", pa.int64()), ("rating", pa.float64()), ("delta", pa.float64()), ("games", pa.int64()), ("lately", pa.list_(pa.float64())))})
    roster, points, form, lately, rows = _games_of(state, rows)
    rating, delta = state["rating"].to_numpy(), state["delta"].to_numpy()
    for ratings, deltas in walk(rating, points, form, roster):
        rating, delta = ratings[-1], deltas[-1]
    games = state["games"].to_numpy() + rows.num_rows
    return pa.table({"team": state["team"], "player": state["player"], "rating": rating, "delta": delta, "games": games, "lately": pa.array([lately.tolist()] * k, pa.list_(pa.float64()))})


def fold_history(state, rows):
    """A row for each player of a roster and game of its team in a step, from the state before it."""
    import numpy as np
    import pyarrow as pa

    k, n = state.num_rows, rows.num_rows
    if not k or not n:
        return pa.table({f: pa.array([], t) for f, t in (("team", pa.string()), ("player", pa.int64()), ("game_key", pa.string()), ("period", pa.int64()), ("rating", pa.float64()), ("delta", pa.float64()))})
    roster, points, form, _, rows = _games_of(state, rows)
    ratings, deltas = (np.concatenate(x).reshape(-1) for x in zip(*walk(state["rating"].to_numpy(), points, form, roster), strict=True))
    game, player = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    return pa.table({"team": state["team"].take(player), "player": state["player"].take(player), "game_key": rows["game_key"].take(game), "period": rows["period"].take(game), "rating": ratings, "delta": deltas})


def static_players(games: DataFrame, rosters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(standings, history) of the players of fixed rosters.

    Standings have rating, last delta, games, form, impact, share and rank; history has a row for each player
    and game of its team. Games of teams without a roster say nothing; a team without games stays at its start.
    """
    spark = games.sparkSession
    path = new_path(spark, "rosters")
    roster = write_back(with_signals(rosters), f"{path}/roster")
    # Only of teams with a roster, whatever else is in the contest.
    rows = team_games(games).join(roster.select("team").distinct(), "team", "left_semi")
    rows = rows.withColumn("step", F.floor(F.col("period") / DATES).cast("long"))
    rows.write.partitionBy("step").parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    steps = sorted(r["step"] for r in rows.select("step").distinct().collect())  # one number a step
    state = roster.select("team", "player", F.lit(START).alias("rating"), F.lit(0.0).alias("delta"), F.lit(0).cast("long").alias("games"), F.array().cast("array<double>").alias("lately"))
    before = state.limit(0).withColumn("step", F.lit(0).cast("long"))
    signals = roster.select("team", "player", *SIGNALS)
    for i in steps:
        before = before.unionByName(state.withColumn("step", F.lit(i).cast("long")))
        part = rows.where(F.col("step") == i).select("team", "period", "series_id", "game_number", "won", "points")
        held = signals.join(state, ["team", "player"])
        state = write_back(held.groupBy("team").cogroup(part.groupBy("team")).applyInArrow(fold_team, STATE), f"{path}/states/step={i}")
    history = signals.join(before, ["team", "player"]).groupBy("team", "step").cogroup(rows.groupBy("team", "step")).applyInArrow(fold_history, HISTORY)
    won = F.try_divide(F.aggregate("lately", F.lit(0.0), lambda total, x: total + x), F.size("lately"))
    form = F.coalesce(half_up((won - 0.5) * 2.0, 6), F.lit(0.0))
    out = roster.join(state, ["team", "player"]).withColumn("form", form)
    impact = clamp(1.0 + IMPACT[0] * clamp(F.col("objectives") + clamp((F.col("rating") - START) / 24.0, -2.0, 2.0) * 0.35, -3.0, 3.0) + IMPACT[1] * F.col("awards") + IMPACT[2] * clamp(F.col("recent") + F.col("form"), -3.0, 3.0), IMPACT_LOW, IMPACT_HIGH)
    out = out.withColumn("impact", impact).withColumn("weight", half_up(F.col("base") * F.col("impact") * F.col("availability") * F.col("certainty"), 9).cast("decimal(18,9)"))
    share = F.coalesce(F.try_divide(F.col("weight").cast("double"), F.sum("weight").over(Window.partitionBy("team")).cast("double")), F.lit(0.0))
    rank = F.row_number().over(Window.orderBy(F.col("rating").desc(), "team", "player")).cast("long")  # a row a player of a roster
    standings = out.withColumns({"share": half_up(share, 3), "impact": half_up(F.col("impact"), 2), "rank": rank})
    return standings.select("team", "player", "role", "games", "rating", "delta", "form", "impact", "share", "rank"), history.select("team", "player", "game_key", "period", "rating", "delta")


def observed(lines: DataFrame, stats: tuple[str, ...] = ("kills", "deaths", "assists", "damage_share", "gold_share", "vspm")) -> bool:
    """Whether any line has a number of a player."""
    known = [F.col(c).isNotNull() for c in stats if c in lines.columns]
    anything = F.lit(False)
    for k in known:
        anything = anything | k
    return not lines.where(anything).isEmpty()


def player_ratings(lines: DataFrame, pairs, games: DataFrame, rosters: DataFrame) -> DataFrame:
    """(basis, player, rating, games) by the numbers of players where there are any (``pairs(lines)`` gives the meetings to replay), else by fixed rosters."""
    if observed(lines):
        return replay_players(pairs(lines))[0].select(F.lit("sourced").alias("basis"), "player", "rating", "games")
    return static_players(games, rosters)[0].select(F.lit("fixed-rosters").alias("basis"), "player", "rating", "games")
