"""The possession fold, rule by rule, and that possessions tile every game."""

import os
from types import SimpleNamespace

from pyspark.sql import functions as F

from statloom.operators.numbering import numbered
from statloom.operators.possessions import Fold
from statloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def fold_of(*rows):
    """(action, team, more) of one game's rows."""
    state, out = Fold(), []
    for action, team, *more in rows:
        given = {"period": 1, "elapsed": 0.0, "ft_kind": "regular" if action == "free_throw" else None, "ft_number": 1, "ft_of": 1, "ft_made": False, "period_end": False, "home_pts": 0.0, "away_pts": 0.0, **(more[0] if more else {})}
        out += state.take(SimpleNamespace(action=action, team=team, **given))
    return [*out, *state.finish()]


def folded(*rows):
    """As (first, last, team, outcome)."""
    return [(p.first, p.last, p.team, p.outcome) for p in fold_of(*rows)]


END = ("period", None, {"period_end": True, "elapsed": 720.0})
MADE = {"ft_made": True}


def test_made_shot_closes_at_the_make():
    assert folded(("made_shot", "home"), ("turnover", "away")) == [(0, 0, "home", "made_shot"), (1, 1, "away", "turnover")]


def test_and_one_with_rows_between():
    assert folded(("made_shot", "home"), ("foul", "away"), ("free_throw", "home", MADE), ("turnover", "away"))[0] == (0, 2, "home", "and_one")


def test_missed_and_one_is_live():
    assert folded(("made_shot", "home"), ("free_throw", "home"), ("rebound", "home"), ("made_shot", "home"), ("turnover", "away"))[0] == (0, 3, "home", "made_shot")
    assert folded(("made_shot", "home"), ("free_throw", "home"), ("rebound", "away"))[0] == (0, 2, "home", "defensive_rebound")


def test_rebound_of_a_putback_after_the_make():
    assert folded(("made_shot", "home"), ("rebound", "home"), ("free_throw", "home", MADE))[0] == (0, 2, "home", "and_one")
    assert folded(("made_shot", "home"), ("rebound", "home", {"elapsed": 3.0}), ("turnover", "away"))[0] == (0, 0, "home", "made_shot")


def test_award_to_the_scorer_keeps_the_ball_and_a_technical_does_not():
    award, technical = {"ft_kind": "flagrant", "ft_made": True}, {"ft_kind": "technical", "ft_made": True}
    assert folded(("made_shot", "home"), ("free_throw", "home", award), ("turnover", "home")) == [(0, 2, "home", "turnover")]
    assert folded(("made_shot", "home"), ("free_throw", "home", technical), ("turnover", "away"))[0] == (0, 0, "home", "made_shot")


def test_mislabelled_trip_goes_on_at_the_same_clock_only():
    second = {"ft_number": 2, "ft_of": 2, "ft_made": True}
    assert folded(("free_throw", "home", MADE), ("free_throw", "home", second)) == [(0, 1, "home", "free_throw_made")]
    later = folded(("free_throw", "home", MADE), ("free_throw", "home", {**second, "elapsed": 9.0}))
    assert later == [(0, 0, "home", "free_throw_made"), (1, 1, "home", "free_throw_made")]


def test_one_shot_after_a_foul_at_the_same_clock():
    assert folded(("free_throw", "home", MADE), ("foul", "away"), ("free_throw", "home", MADE)) == [(0, 2, "home", "free_throw_made")]
    # without the foul the other team had the ball in between
    assert [x[3] for x in folded(("free_throw", "home", MADE), ("timeout", "away"), ("free_throw", "home", MADE))] == ["free_throw_made", "implied_change", "free_throw_made"]


def test_own_action_at_the_clock_of_the_throw_opens_the_possession_again():
    assert folded(("free_throw", "home", MADE), ("turnover", "home")) == [(0, 1, "home", "turnover")]
    assert folded(("free_throw", "home", MADE), ("made_shot", "home"), ("turnover", "away"))[0] == (0, 1, "home", "made_shot")
    assert folded(("made_shot", "home"), ("free_throw", "home", MADE), ("missed_shot", "home"), ("rebound", "away"))[0] == (0, 3, "home", "defensive_rebound")


def test_offensive_rebound_keeps_the_miss():
    assert folded(("missed_shot", "home"), ("rebound", "home"), ("rebound", "away")) == [(0, 2, "home", "defensive_rebound")]
    assert folded(("missed_shot", "home"), ("rebound", "home"), ("turnover", "home")) == [(0, 2, "home", "turnover")]


def test_implied_change():
    assert folded(("missed_shot", "home"), ("turnover", "away")) == [(0, 0, "home", "implied_change"), (1, 1, "away", "turnover")]
    # who gained the ball has it until somebody shows otherwise
    assert folded(("turnover", "home"), ("jump_ball", None), ("turnover", "home"))[1] == (1, 1, "away", "implied_change")
    # an implied change itself gives nobody the ball
    assert folded(("missed_shot", "home"), ("turnover", "away"), ("timeout", None), END)[-1] == (2, 3, "home", "end_of_period")


def test_non_final_miss_is_a_dead_ball():
    last = {"ft_number": 2, "ft_of": 2, "ft_made": True}
    assert folded(("free_throw", "home", {"ft_of": 2}), ("rebound", "away"), ("free_throw", "home", last)) == [(0, 2, "home", "free_throw_made")]
    assert folded(("free_throw", "home", {"ft_number": 2, "ft_of": 2}), ("rebound", "away")) == [(0, 1, "home", "defensive_rebound")]


def test_period_ends():
    assert folded(("turnover", "home"), END) == [(0, 1, "home", "turnover")]  # nothing since the last close
    assert folded(("missed_shot", "home"), END, ("rebound", "home")) == [(0, 2, "home", "end_of_period")]  # after the buzzer
    assert folded(("turnover", "home"), ("timeout", None), END) == [(0, 0, "home", "turnover"), (1, 2, "away", "end_of_period")]
    got = fold_of(("missed_shot", "home"), END, ("period", None, {"period": 2}), ("missed_shot", "away", {"period": 2}), ("rebound", "home", {"period": 2}), ("other", None, {"period": 2}))
    assert [(p.period, p.index, p.first, p.last) for p in got] == [(1, 0, 0, 1), (2, 0, 2, 5)]
    assert folded(("period", None), END) == [(0, 1, None, "end_of_period")] and folded(("other", None)) == [(0, 0, None, "end_of_period")]


def test_points_follow_the_rows():
    two, one = {"home_pts": 2.0}, {"home_pts": 1.0, "ft_made": True}
    got = fold_of(("made_shot", "home", two), ("foul", "away"), ("free_throw", "home", one), ("free_throw", "home", {"home_pts": 1.0, "ft_kind": "technical", "ft_made": True}), ("made_shot", "away", {"away_pts": 3.0}))
    assert [(p.outcome, p.home, p.away) for p in got] == [("and_one", 3.0, 0.0), ("made_shot", 1.0, 3.0)]


def test_tiling(spark):
    got = registry.QUERIES["possession_machine"](spark, FOLDER).toPandas().sort_values(["game", "possession"])
    events = spark.read.parquet(f"{FOLDER}/events.parquet").groupBy("user_id").count().toPandas().set_index("user_id")["count"]
    assert set(got["game"]) == set(events.index)
    for game, own in got.groupby("game"):
        assert own["possession"].tolist() == list(range(len(own)))
        assert own["first_seq"].tolist() == [0, *(own["last_seq"] + 1)[:-1]]
        assert own["last_seq"].iloc[-1] == events[game] - 1


def test_segments_tile_possessions(spark):
    whole = registry.QUERIES["possession_machine"](spark, FOLDER).toPandas().set_index(["game", "possession"]).sort_index()
    cut = registry.QUERIES["possession_segments"](spark, FOLDER).toPandas().sort_values(["game", "first_seq"])
    by = cut.groupby(["game", "possession"])
    assert by["poss_count"].sum().eq(1).all()
    assert by["first_seq"].min().sort_index().equals(whole["first_seq"]) and by["last_seq"].max().sort_index().equals(whole["last_seq"])
    follows = cut["first_seq"] == cut.groupby("game")["last_seq"].shift(fill_value=-1) + 1
    assert follows.all()


def test_numbered(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"))
    got = numbered(rows, ["k"], "place").orderBy("k").toPandas()
    assert got["place"].tolist() == list(range(1000))
    assert numbered(rows.where("k < 0"), ["k"], "place").count() == 0
