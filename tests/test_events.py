"""The normal form of events and the scoring ledger, on small games made by hand."""

import pytest

from statloom.operators import events as E

RAW = "gameId string, period int, event_time double, orderNumber int, actionType string, subType string, descriptor string, description string, teamId long, personId long, shotResult string, shotValue int, scoreHome string, scoreAway string, home_lineup array<long>, away_lineup array<long>, ingest_ord int"
HOME, AWAY = 10, 20
FIVES = [list(range(1, 6)), list(range(6, 11))]


def game(*rows, gid="22300001"):
    names = [x.split()[0] for x in RAW.split(", ")]
    out = []
    for k, (action, team, more) in enumerate(rows):
        given = dict.fromkeys(names) | {"gameId": gid, "period": 1, "event_time": float(k), "orderNumber": k, "actionType": action, "teamId": team, "personId": 3, "home_lineup": FIVES[0], "away_lineup": FIVES[1], "ingest_ord": k} | more
        out.append(tuple(given[c] for c in names))
    return out


def norm_of(spark, *rows, rosters=None):
    teams = spark.createDataFrame([("0022300001", HOME, AWAY)], "GAME_ID string, HOME_TEAM_ID long, AWAY_TEAM_ID long")
    players = rosters or [(22300001, p, HOME if p < 6 else AWAY) for p in range(1, 11)]
    return E.normalized(spark.createDataFrame(game(*rows), RAW), teams, spark.createDataFrame(players, "GAME_ID long, PLAYER_ID long, TEAM_ID long"))


def collected(spark, *rows, **more):
    return norm_of(spark, *rows, **more).orderBy("SEQ").collect()


THROW = {"subType": "Free Throw 1 of 1"}


def test_order_teams_and_points(spark):
    got = collected(
        spark, ("Made Shot", HOME, {"shotValue": 3, "event_time": 5.0, "scoreHome": "3"}), ("  TIMEOUT ", 0, {"personId": AWAY, "event_time": 6.0}), ("Turnover", 0, {"subType": "Excess Timeout Turnover", "event_time": 7.0}),
        ("Made Shot", 99, {"shotValue": 2, "event_time": 1.0, "orderNumber": 9}), ("Made Shot", AWAY, {"shotValue": 4, "event_time": 2.0}), ("Instant Replay", AWAY, {"event_time": None, "scoreHome": "9"}),
    )
    assert [(r.SEQ, r.ACTION, r.TEAM_ID, r.PTS_HOME, r.SCORE_HOME, r.SCORING_UNRESOLVED, r.ORDER_INVERSION) for r in got] == [
        (0, "made_shot", 99, 0.0, 0.0, True, False), (1, "made_shot", AWAY, 0.0, 0.0, True, True), (2, "made_shot", HOME, 3.0, 3.0, False, True), (3, "timeout", AWAY, 0.0, 3.0, False, True),
        (4, "turnover", AWAY, 0.0, 3.0, False, True), (5, "other", AWAY, 0.0, 3.0, False, True),
    ]
    assert got[0].GAME_ID == "0022300001" and [r.OBS_SCORE_HOME for r in got] == [None, None, 3.0, None, None, None] and list(got[0].asDict()) == E.COLUMNS


def test_outcomes_of_free_throws(spark):
    said = [{"shotResult": "Made "}, {"shotResult": "Missed"}, {"description": "Missi Free Throw 1 of 2 (1 PTS)"}, {"description": "MISS Roe Free Throw"}, {"description": "MISS Roe (2 PTS)"}, {}, {"event_time": 20.0}, {"event_time": 21.0}]
    rows = [("Free Throw", HOME, THROW | x) for x in said]
    got = collected(spark, *rows[:6], ("substitution", HOME, {}), ("Rebound", AWAY, {"event_time": 20.0, "orderNumber": 1}), rows[6], ("timeout", AWAY, {"event_time": 20.5}), rows[7])
    assert [(r.FT_MADE, r.FT_OUTCOME_SOURCE) for r in got if r.ACTION == "free_throw"] == [
        (True, "shot_result"), (False, "shot_result"), (True, "description_pts"), (False, "description_miss"), (None, "unknown"), (False, "inferred_next_rebound"), (False, "inferred_adjacent_rebound"), (None, "unknown"),
    ]


@pytest.mark.parametrize("fouls,throw,want", [
    ([], {"subType": "Free Throw 2 of 3"}, ("regular", 2, 3)), ([], {"subType": "Free Throw Technical"}, ("technical", None, None)), ([], {"subType": "1 of 2", "descriptor": "clear-path"}, ("clear_path", 1, 2)),
    ([], {"subType": "Free Throw Flagrant 1 of 2"}, ("flagrant", 1, 2)), ([], {"subType": None}, ("unknown", None, None)), ([("Away From Play", "x")], THROW, ("away_from_play", 1, 1)), ([("Inbound", "IN.FOUL")], THROW, ("inbound", 1, 1)),
    ([("Inbound", "IN.FOUL")], {"subType": "Free Throw 1 of 2"}, ("regular", 1, 2)), ([("Away From Play", "x"), ("Technical", "T.FOUL")], THROW, ("away_from_play", 1, 1)), ([("Away From Play", "x"), ("Personal", "P.FOUL")], THROW, ("regular", 1, 1)),
    ([("Technical", "T.FOUL")], THROW, ("technical", 1, 1)),
])
def test_kinds_of_free_throws(spark, fouls, throw, want):
    rows = [("Foul", AWAY, {"subType": a, "description": b, "event_time": 5.0}) for a, b in fouls]
    got = collected(spark, *rows, ("Free Throw", HOME, throw | {"event_time": 5.0}))[-1]
    assert (got.FT_KIND, got.FT_NUM, got.FT_OF) == want


def test_technical_beside_a_made_shot_is_an_and_one(spark):
    at = {"event_time": 5.0}
    got = collected(spark, ("Made Shot", HOME, at | {"shotValue": 2}), ("Foul", AWAY, at | {"subType": "Technical", "description": "T.FOUL"}), ("Free Throw", HOME, at | THROW))
    assert got[-1].FT_KIND == "regular"


def test_lineups(spark):
    got = collected(spark, ("Foul", HOME, {}), ("Foul", HOME, {"home_lineup": None}), ("Foul", HOME, {"home_lineup": FIVES[1], "away_lineup": FIVES[0]}), ("Foul", HOME, {"home_lineup": [1, 2, 3, 4, 99]}))
    assert [(r.LINEUP_VALID, r.HOME_ON, r.AWAY_ON) for r in got] == [(True, *FIVES), (False, None, None), (True, *FIVES), (False, None, None)]


BOX = "GAME_ID string, HOME_PTS int, AWAY_PTS int"


def status(spark, home, away, *rows):
    return E.game_status(norm_of(spark, *rows), spark.createDataFrame([("22300001", home, away)], BOX)).first()


def shot(team, score_home=None, score_away=None, **more):
    return ("Made Shot", team, {"shotValue": 2, "scoreHome": score_home, "scoreAway": score_away} | more)


END = ("Period", None, {"subType": "End"})


def test_status(spark):
    assert (lambda r: (r.STATUS, r.REASON, r.CHECKPOINTS, r.SCOREBOARD_FINAL_MATCHES_BOX))(status(spark, 2, 2, shot(HOME, "2"), shot(AWAY, None, "2"), END)) == ("ADMITTED", None, 2, True)
    assert status(spark, 4, 2, shot(HOME, "2"), shot(AWAY, None, "2"), END).REASON == "final_score_mismatch_box"
    assert status(spark, 2, 0, shot(HOME), ("Free Throw", HOME, THROW)).REASON == "unresolved_scoring_event; stream_missing_final_period_end"
    assert status(spark, 4, 0, shot(HOME), END, shot(HOME)).REASON == "scoring_after_final_period_end"
    assert status(spark, 2, 0, shot(HOME), END, ("Period", None, {"subType": "Start", "period": 5})).STATUS == "ADMITTED"  # a marker alone is no period
    # the feed counts two points too many in the first period, and its last value is the box's
    got = status(spark, 4, 0, shot(HOME, "4"), shot(HOME, "4", period=2), ("Period", None, {"subType": "End", "period": 2}))
    assert (got.REASON, got.CHECKPOINTS, got.CHECKPOINT_MISMATCHES, got.INSTANT_CHECKPOINT_MISMATCHES) == ("scoreboard_checkpoint_mismatch", 2, 1, 1)


def test_scoreboard_that_contradicts_itself(spark):
    end = ("Period", None, {"subType": "End", "period": 3})
    got = status(spark, 8, 0, shot(HOME, "9"), shot(HOME, "3", period=2), shot(HOME, "6", period=2), shot(HOME, "8", period=3), end)
    assert (got.STATUS, got.CHECKPOINTS, got.SCOREBOARD_UNCHECKED_PERIODS, got.SCOREBOARD_FINAL_MATCHES_BOX) == ("ADMITTED", 1, 2, True)
    got = status(spark, 4, 0, shot(HOME, "2"), shot(HOME, "5"), END)
    assert (got.CHECKPOINTS, got.SCOREBOARD_UNCHECKED_PERIODS, got.SCOREBOARD_FINAL_MATCHES_BOX) == (0, 1, False)


def test_scoring_events(spark):
    got = E.scoring_events(norm_of(spark, shot(HOME), ("Free Throw", AWAY, THROW | {"shotResult": "Made"}), ("Free Throw", AWAY, THROW), ("Rebound", HOME, {"event_time": None}))).orderBy("SEQ").collect()
    assert [(r.SCORING_TEAM_ID, r.POINTS, r.SOURCE_ACTION) for r in got] == [(HOME, 2.0, "made_shot"), (AWAY, 1.0, "free_throw")]


def test_a_feed_without_order_numbers(spark):
    """Action numbers order it; ids that aren't numbers aren't known."""
    from statloom.operators import events as EV

    rows = [("1", 1, 5.0, 7, 1, "Made Shot", "x1", "9"), ("1", 1, 5.0, 3, 2, "Rebound", "10", None), ("1", 1, 6.0, 2, 3, "Foul", "10.0", "5")]
    e = spark.createDataFrame(rows, "gameId string, period int, event_time double, actionNumber int, ingest_ord int, actionType string, teamId string, personId string").selectExpr("*", "cast(null as string) as subType", "10L as HOME_TEAM_ID", "11L as AWAY_TEAM_ID")
    got = EV.with_teams(EV.numbered_log(e)).orderBy("SEQ").collect()
    assert [(r.ACTION, r.TEAM_ID, r.PERSON_ID, r.ORDER_INVERSION) for r in got] == [("rebound", 10, None, False), ("made_shot", None, 9, False), ("foul", 10, 5, True)]
