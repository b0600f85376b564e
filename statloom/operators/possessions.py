"""A log of actions folded into possessions, game by game.

Rows of a null game belong to no game and are left out; other nulls mean that a thing
isn't known. Games of one row, repeated rows and rows in which nobody acts still tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

ROW = "game, period, elapsed, action, team, ft_kind, ft_number, ft_of, ft_made, period_end, home_pts, away_pts".split(", ")
OTHER = {"home": "away", "away": "home"}
# Actions that decide nothing, awards after which the shooting team keeps the ball, outcomes that give the ball away, and those of a team's own free throw.
QUIET = {"foul", "substitution", "timeout", "jump_ball", "violation", "other"}
AWARDS = {"flagrant", "clear_path", "away_from_play", "transition_take", "inbound"}
TRANSFERS = {"made_shot", "and_one", "turnover", "defensive_rebound", "free_throw_made"}
OWN_THROW = {"free_throw_made", "and_one"}
SHOWS_BALL = {"made_shot", "missed_shot", "turnover"}


@dataclass
class Possession:
    period: int
    index: int
    first: int
    last: int
    outcome: str
    team: str | None
    home: float
    away: float
    ended: float | None  # the clock at its last row


@dataclass
class Open:
    """The rows since the last close: their points, whether nobody acted in them, whether
    somebody fouled, and what is known of the ball."""

    first: int
    home: float = 0.0
    away: float = 0.0
    quiet: bool = True
    fouled: bool = False
    missed: str | None = None
    control: str | None = None
    dead: bool = False

    def add(self, row) -> None:
        self.home += row.home_pts or 0.0
        self.away += row.away_pts or 0.0
        self.quiet &= row.action in QUIET
        self.fouled |= row.action == "foul"


@dataclass
class Make:
    """A made shot that a free throw may still extend, and the rows after it."""

    at: int
    team: str | None
    elapsed: float | None
    rows: list = field(default_factory=list)


class Fold:
    """One game's log, row by row. The last two possessions are held back: rows may still be
    added to the last, or it may be opened again."""

    def __init__(self):
        self.at, self.index, self.period, self.tail = -1, 0, None, None
        self.open, self.make = Open(0), None
        self.held: list[Possession] = []

    def take(self, row) -> Iterator[Possession]:
        self.at += 1
        if self.tail is not None and row.period == self.tail:
            self.extend(self.at, row)  # after the buzzer
            self.open = Open(self.at + 1)
        else:
            self.tail = None
            self.step(self.at, row)
        while len(self.held) > 2:
            yield self.held.pop(0)

    def finish(self) -> Iterator[Possession]:
        if self.make:
            rows = self.close_make()
            for _, row in rows:
                self.open.add(row)
        if self.open.first <= self.at:
            if self.held:
                last = self.held[-1]
                last.last, last.home, last.away = self.at, last.home + self.open.home, last.away + self.open.away
            else:
                self.close(self.at, "end_of_period", None, None)
        yield from self.held

    def close(self, end: int, outcome: str, team: str | None, elapsed) -> None:
        o = self.open
        self.held.append(Possession(self.period, self.index, o.first, end, outcome, team, o.home, o.away, elapsed))
        self.index += 1
        self.open = Open(end + 1)

    def close_make(self) -> list:
        """Closes at the make; gives the rows after it, which are looked at anew."""
        make, self.make = self.make, None
        self.close(make.at, "made_shot", make.team, make.elapsed)
        return make.rows

    def extend(self, i: int, row) -> None:
        last = self.held[-1]
        last.last, last.ended = i, row.elapsed
        last.home, last.away = last.home + (row.home_pts or 0.0), last.away + (row.away_pts or 0.0)

    def gained(self) -> str | None:
        """Who got the ball from the last possession of this period."""
        last = self.held[-1] if self.held else None
        return OTHER.get(last.team) if last and last.period == self.period and last.outcome in TRANSFERS else None

    def after_own_throw(self, row) -> bool:
        """A row of the team whose possession has just ended on its own free throw, at that clock."""
        last = self.held[-1] if self.held else None
        return bool(
            last and row.team in OTHER and self.open.quiet and last.period == self.period and last.outcome in OWN_THROW and last.team == row.team and row.elapsed is not None and last.ended == row.elapsed
        )

    def goes_on(self, row) -> bool:
        """Whether the row belongs to the possession before, which is opened again for it."""
        if row.action in SHOWS_BALL:
            return self.after_own_throw(row)
        if row.action != "free_throw":
            return False
        if row.ft_kind == "regular" and row.ft_number is not None:
            return (row.ft_number > 1 or self.open.fouled) and self.after_own_throw(row)
        return row.ft_kind in AWARDS and self.open.fouled and self.after_own_throw(row)

    def step(self, i: int, row) -> None:
        if i == self.open.first and row.period != self.period:
            self.period, self.index = row.period, 0
        if self.make:
            self.after_make(i, row)
            return
        if self.goes_on(row):
            last, o = self.held.pop(), self.open
            self.index = last.index
            self.open = Open(last.first, last.home + o.home, last.away + o.away, quiet=False)
        shows = row.action in SHOWS_BALL or row.action == "free_throw" and row.ft_kind == "regular"
        controller = self.open.control or (self.gained() if self.open.first < i else None)
        if shows and controller and row.team in OTHER and row.team != controller:
            self.close(i - 1, "implied_change", controller, None)
            self.step(i, row)
            return
        if row.action == "period" and row.period_end:
            self.end_period(i, row)
            return
        self.open.add(row)
        self.act(i, row)

    def act(self, i: int, row) -> None:
        o, team = self.open, row.team
        if row.action == "made_shot":
            o.control, self.make = team, Make(i, team, row.elapsed)
        elif row.action == "missed_shot":
            o.missed = o.control = team
        elif row.action == "turnover":
            self.close(i, "turnover", team, row.elapsed)
        elif row.action == "free_throw":
            self.throw(i, row)
        elif row.action == "rebound":
            if o.dead:
                o.dead = False
            elif team in OTHER and o.missed:
                if team == o.missed:
                    o.control = team  # the miss stays: a tip may be entered out of order
                else:
                    self.close(i, "defensive_rebound", o.missed, row.elapsed)

    def throw(self, i: int, row) -> None:
        o = self.open
        if row.ft_kind != "technical":
            o.control = row.team
        if row.ft_kind != "regular":
            return
        if row.ft_number is None or row.ft_number != row.ft_of:
            o.dead |= row.ft_made is False
        elif row.ft_made:
            self.close(i, "free_throw_made", row.team, row.elapsed)
        else:
            o.missed = row.team

    def after_make(self, i: int, row) -> None:
        make, own = self.make, row.team in OTHER and row.team == self.make.team
        throw = row.action == "free_throw"
        if throw and row.ft_kind == "regular" and row.ft_of == 1 and own:
            self.absorb(row)
            if row.ft_made:
                self.close(i, "and_one", row.team, row.elapsed)
            else:
                self.open.missed = self.open.control = row.team
        elif throw and row.ft_kind in AWARDS | {"unknown"} and own:
            self.absorb(row)
            self.open.control = row.team
        elif row.action in QUIET or throw and row.ft_kind != "regular" or row.action == "period" and not row.period_end or row.action == "rebound" and own and row.elapsed is not None and row.elapsed == make.elapsed:
            make.rows.append((i, row))
        else:
            for j, held in [*self.close_make(), (i, row)]:
                self.step(j, held)

    def absorb(self, row) -> None:
        """The make's possession goes on with the rows since, and this one."""
        for _, held in self.make.rows:
            self.open.add(held)
        self.open.add(row)
        self.make = None

    def end_period(self, i: int, row) -> None:
        if self.open.first == i and self.held:
            self.extend(i, row)
        else:
            team = self.open.control or self.gained()
            self.open.add(row)
            self.close(i, "end_of_period", team, row.elapsed)
        self.open, self.tail = Open(i + 1), self.period


OUT = "possession long, period int, period_index int, first_seq long, last_seq long, outcome string, team string, defense string, home_pts double, away_pts double"


def possessions(log: DataFrame, order: list[str]) -> DataFrame:
    """A game's possessions, numbered over the game and within each period; they tile its
    rows, which are numbered in `order` from 0, and have their points. log has game (long),
    period (int), elapsed (double), action (made_shot, missed_shot, free_throw, rebound, turnover,
    period, foul, others), team (home, away or null), ft_kind (regular, technical, unknown, or an
    award), ft_number, ft_of, ft_made, period_end, home_pts, away_pts and the order's columns. A
    shuffle by game and one pass: only the state of one game is held, whatever its length."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        game, state, n = None, None, 0

        def table(found: list[Possession]) -> pd.DataFrame:
            rows = [(n + k, p.period, p.index, p.first, p.last, p.outcome, p.team, OTHER.get(p.team), p.home, p.away) for k, p in enumerate(found)]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "game", game)
            return out

        for frame in frames:
            done: list[Possession] = []
            plain = frame.astype(object).where(frame.notna(), None)
            for row in plain.itertuples(index=False):
                if state is None or row.game != game:
                    if state:
                        yield table([*done, *state.finish()])
                    game, state, n, done = row.game, Fold(), 0, []
                done += state.take(row)
            if done:
                yield table(done)
                n += len(done)
        if state:
            yield table(list(state.finish()))

    rows = log.where("game is not null").repartition("game").sortWithinPartitions("game", *order).select(*ROW)
    return rows.mapInPandas(fold, f"game long, {OUT}")


def segments(log: DataFrame, found: DataFrame, order: list[str]) -> DataFrame:
    """Possessions cut where a lineup changes: game, possession, segment, home_on, away_on,
    first_seq, last_seq, home_pts, away_pts, offense_is_home, poss_count (1 on a possession's last
    segment, else 0). log as above with home_on and away_on (arrays or null). An as-of join
    gives each row its possession: that of the last first row up to it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from .relational import asof_strict, islands

    seq = (F.row_number().over(Window.partitionBy("game").orderBy(*order)) - 1).cast("long")
    rows = log.where("game is not null").select("game", "home_on", "away_on", "home_pts", "away_pts", seq.alias("seq"))
    begun = found.select("game", "possession", "team", (F.col("first_seq") - 1).alias("before"))
    held = asof_strict(rows, begun, "seq", "before", ["game"], ["possession", "team"])
    lineup = F.struct("home_on", "away_on")
    cut = islands(held, ["game", "possession"], ["seq"], lineup, "segment").groupBy("game", "possession", "team", F.col("segment").cast("int").alias("segment"), "home_on", "away_on")
    out = cut.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(F.coalesce("home_pts", F.lit(0.0))).alias("home_pts"), F.sum(F.coalesce("away_pts", F.lit(0.0))).alias("away_pts"))
    last = F.max("segment").over(Window.partitionBy("game", "possession"))
    return out.withColumn("poss_count", (F.col("segment") == last).cast("int")).withColumn("offense_is_home", F.col("team") == "home").drop("team")


def stints(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stints of the segments whose lineups are valid (five a side), and the exclusions: game and
    the possessions and points of the others. Both add up to the segments."""
    from pyspark.sql import functions as F

    five = F.coalesce((F.size("home_on") == 5) & (F.size("away_on") == 5), F.lit(False))
    made = segments.where(five).groupBy("game", "home_on", "away_on").agg(F.sum("home_pts").alias("home_points"), F.sum("away_pts").alias("away_points"), F.sum("poss_count").alias("possessions"))
    made = made.withColumn("net_points", F.col("home_points") - F.col("away_points")).withColumn("net_rating_per_100", F.try_divide(100 * F.col("net_points"), F.nullif(F.col("possessions"), F.lit(0))))
    out = segments.where(~five).groupBy("game").agg(F.sum("poss_count").alias("excluded_poss"), F.sum("home_pts").alias("excluded_home_pts"), F.sum("away_pts").alias("excluded_away_pts"))
    return made, out
