"""The gate on a small sound run, and one broken thing for each check."""

import pytest

from statloom.operators import gate

G, LATE = "0022300001", "0022300002"
SCHEMAS = {
    "game_status": "GAME_ID string, STATUS string, REASON string, FINAL_HOME double, BOX_HOME double, FINAL_AWAY double, BOX_AWAY double, UNRESOLVED_SCORING_EVENTS int, ORDER_INVERSIONS int, EVENT_SCHEMA string",
    "possessions": "GAME_ID string, PERIOD int, POSS_IDX int, START_SEQ int, END_SEQ int, OUTCOME string, OFFENSE_TEAM_ID long, HOME_PTS double, AWAY_PTS double",
    "segments": "GAME_ID string, PERIOD int, POSS_IDX int, SEG_IDX int, HOME_PTS double, AWAY_PTS double, POSS_COUNT int",
    "stints": "game_id string, possessions long, home_points double, away_points double, net_rating_per_100 double",
    "exclusions": "GAME_ID string, EXCLUDED_POSS long, EXCLUDED_HOME_PTS double, EXCLUDED_AWAY_PTS double",
    "excluded_events": "GAME_ID string, SEQ int, ACTION string, TEAM_ID long, PERSON_ID long, PERSON_TEAM_ID long, ELAPSED double",
    "team_game": "GAME_ID long, MATCHUP string, PTS long",
}
SCHEMAS["excluded_possessions"] = SCHEMAS["possessions"]


def run():
    return {
        "game_status": [[G, "ADMITTED", None, 2.0, 2.0, 0.0, 0.0, 0, 0, "live"], [LATE, "QUARANTINED", "source_possession_unlogged", 4.0, 4.0, 0.0, 0.0, 0, 0, "live"]],
        "possessions": [[G, 1, 0, 0, 3, "made_shot", 10, 2.0, 0.0], [G, 1, 1, 4, 6, "turnover", 20, 0.0, 0.0]],
        "segments": [[G, 1, 0, 0, 2.0, 0.0, 1], [G, 1, 1, 0, 0.0, 0.0, 1]],
        "stints": [[G, 1, 2.0, 0.0, 200.0]],
        "exclusions": [[G, 1, 0.0, 0.0]],
        "excluded_possessions": [[LATE, 1, 0, 0, 1, "made_shot", 10, 2.0, 0.0], [LATE, 1, 1, 2, 3, "made_shot", 10, 2.0, 0.0], [LATE, 2, 2, 4, 5, "turnover", 20, 0.0, 0.0]],
        "excluded_events": [[LATE, 1, "made_shot", 10, 7, 10, 30.0], [LATE, 2, "missed_shot", 10, 7, 10, 55.0], [LATE, 3, "made_shot", 10, 7, 10, 60.0]],
        "team_game": [[int(G), "A vs. B", 2], [int(G), "B @ A", 0]],
    }


MANIFEST = {
    "run_id": "r1", "cohort": [G, LATE], "files": {"stints": "h1"}, "inputs": {"team_game": {"sha256": "i1"}}, "release": {"status": "PASS_WITH_EXCLUSIONS", "excluded": [LATE]},
    "declared_exclusions": {LATE: {"declared": "source_possession_unlogged", "actual": "source_possession_unlogged"}},
}


@pytest.fixture(autouse=True)
def small(spark):
    """Tables of a few rows."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def checks(spark, tables, manifest=MANIFEST, folder="r1", files=None, inputs=None):
    made = {k: spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[k]) for k, rows in tables.items()}
    return gate.run_checks(made, manifest, folder, {"stints": "h1"} if files is None else files, {"team_game": "i1"} if inputs is None else inputs)


def failed(got):
    return {k for k, ok in got.items() if not ok}


def test_sound_run(spark):
    got = checks(spark, run())
    assert len(got) == 19 and not failed(got) and gate.releasable("PASS_WITH_EXCLUSIONS", got)


def test_manifest(spark):
    changed = {**MANIFEST, "release": {"status": "MAYBE", "excluded": [G]}, "declared_exclusions": {G: {"declared": "scoring", "actual": "scoring"}}}
    got = checks(spark, run(), changed, "other", {"stints": "h2"}, {})
    assert failed(got) == {"manifest_file_hashes", "run_id_consistent", "sealed_inputs_unchanged", "release_status_recorded", "exclusions_are_declared_and_excludable"}
    assert not gate.releasable("PASS", got)


UNLOGGED, ORDER = "source_possession_unlogged_exclusions_meet_policy", "source_order_exclusions_meet_policy"


@pytest.mark.parametrize("changes,said", [
    ([("game_status", 0, 0, "x"), ("excluded_events", 1, 6, 30.0)], {"every_cohort_game_has_a_status", "only_admitted_games_reconstructed", UNLOGGED}),
    ([("game_status", 1, 2, ""), ("possessions", 1, 3, 5)], {"quarantine_has_reason", "exclusions_are_declared_and_excludable", "alternation_removals_sealed", "possessions_tile_each_game"}),
    ([("team_game", 0, 2, 3), ("segments", 1, 6, 2), ("excluded_possessions", 0, 5, "end_of_period")], {"admitted_points_equal_box_by_side", "segments_sum_to_possessions", "stints_plus_exclusions_equal_segments", UNLOGGED}),
    ([("stints", 0, 4, float("inf")), ("possessions", 1, 6, None), ("excluded_events", 1, 5, 99)], {"stint_rates_finite_or_nan", "every_possession_attributed", UNLOGGED}),
    ([("possessions", 0, 6, 20), ("game_status", 1, 2, "source_order_unresolvable")], {ORDER, "exclusions_are_declared_and_excludable"}),
    ([("game_status", 1, 3, 5.0), ("stints", 0, 2, 3.0)], {UNLOGGED, "stints_plus_exclusions_equal_segments"}),
])
def test_broken(spark, changes, said):
    tables = run()
    for table, row, column, value in changes:
        tables[table][row][column] = value
    if ORDER in said:  # two teams, all possessions of one
        tables["possessions"] += [[G, 1, 2, 7, 8, "turnover", 20, 0.0, 0.0], [G, 1, 3, 9, 9, "turnover", 10, 0.0, 0.0], [G, 1, 4, 10, 10, "turnover", 20, 0.0, 0.0]]
        tables["segments"] += [[G, 1, k, 0, 0.0, 0.0, 1] for k in (2, 3, 4)]
        tables["exclusions"][0][1] = 4
        said = said | {"possession_alternation_within_periods", "possession_alternation_per_period"}
    assert failed(checks(spark, tables)) == said


def test_release(spark):
    columns = "GAME_ID string, SEASON_ID string, PERIODS double, PBP_PTS_A double, PBP_PTS_B double, BOX_PTS_A double, BOX_PTS_B double, POSS_A long, POSS_B long, UNATTRIBUTED_POSS long, UNATTRIBUTED_PTS double"
    good = lambda g, s: (g, s, 4.0, 90.0, 80.0, 90.0, 80.0, 100, 96, 0, 0.0)
    rows = [good("a", "s1"), good("b", "s2"), ("c", "s3", None, *good("c", "s3")[3:]), good("d", "s4"), good("e", "s4"), good("f", "s5")]
    expected = [("a", "s1"), ("b", "s2"), ("x", "s2"), ("c", "s3"), ("d", "s4"), ("f", "s5"), ("y", "s5")]
    declared = [("x", "link_empty", "link_empty"), ("y", "link_empty", "scoring")]
    got = gate.season_release(spark.createDataFrame(rows, columns), spark.createDataFrame(expected, "GAME_ID string, SEASON_ID string"), spark.createDataFrame(declared, "GAME_ID string, DECLARED string, ACTUAL string"))
    assert {r.SEASON_ID: (r.status, r.missing_games, r.unexpected_games, r.excluded_games, r.invalid_games) for r in got.collect()} == {
        "s1": ("PASS", 0, 0, 0, 0), "s2": ("PASS_WITH_EXCLUSIONS", 0, 0, 1, 0), "s3": ("FAIL", 0, 0, 0, 1), "s4": ("FAIL", 0, 1, 0, 0), "s5": ("FAIL", 1, 0, 0, 0),
    }
