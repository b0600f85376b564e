"""Runs that are bound to their inputs: a graph of stages whose names are hashes of what they read.

A stage's inputs are hashed before it works and once more after; if they differ, nothing is kept.
Its run is named by those hashes, its parameters and its code, so that equal work is found and not
done again, and a changed input makes another run, and stales what was made of the old one.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import file_hashes, store_of, verify_run, write_run


@dataclass
class Stage:
    """work(spark, inputs) gives tables by name; inputs: a path, or another stage's name, by a name of the stage's own."""

    name: str
    inputs: dict[str, str]
    work: Callable[[SparkSession, dict[str, str]], dict[str, DataFrame]]
    parameters: dict = field(default_factory=dict)


def content(spark: SparkSession, path: str) -> str | None:
    """A hash of a path's bytes: of a file, or of all parts of a folder by their names; null if there is nothing. Bytes are
    hashed where they are read; only names and hashes come together."""
    store, there = store_of(spark, path)
    if not store.exists(there):
        return None
    pattern = path if store.getFileStatus(there).isFile() else f"{path}/*"
    rows = file_hashes(spark, pattern).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    if store.getFileStatus(there).isFile():
        return rows.first()["sha256"]
    joined = rows.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", "name", "sha256")))), 256).alias("all")).first()  # a line a part
    return joined["all"]


def hashes(spark: SparkSession, inputs: dict[str, str]) -> dict[str, str]:
    """Hashes of inputs that must all be there. A run is known by its manifest, which has those of its files."""
    out = {}
    for name, path in sorted(inputs.items()):
        manifest = f"{path}/manifest.json"
        if store_of(spark, manifest)[0].exists(store_of(spark, manifest)[1]):
            verify_run(spark, path)
            out[name] = content(spark, manifest)
        else:
            out[name] = content(spark, path)
        if out[name] is None:
            raise FileNotFoundError(f"input {name}: nothing at {path}")
    return out


def code_of(work: Callable) -> str:
    return hashlib.sha256(inspect.getsource(work).encode()).hexdigest()


def run_stage(spark: SparkSession, stage: Stage, root: str, made: dict[str, str] | None = None) -> str:
    """The folder of the stage's run, made if it isn't there. made: folders of earlier stages by name."""
    paths = {name: (made or {}).get(path, path) for name, path in stage.inputs.items()}
    before = hashes(spark, paths)
    tables = stage.work(spark, paths)

    def unchanged() -> None:
        after = hashes(spark, paths)
        changed = sorted(name for name in before if before[name] != after[name])
        if changed:
            raise OSError(f"{stage.name}: inputs changed while it worked: {changed}")

    parameters = {"stage": stage.name, "code": code_of(stage.work), "paths": paths, **stage.parameters}
    return write_run(tables, f"{root}/{stage.name}", before, parameters, last=unchanged)


def run_all(spark: SparkSession, stages: list[Stage], root: str) -> dict[str, str]:
    """The stages in an order in which each comes after its inputs; folders of their runs by name."""
    names, made = {s.name for s in stages}, {}
    left = list(stages)
    while left:
        ready = [s for s in left if all(x not in names or x in made for x in s.inputs.values())]
        if not ready:
            raise ValueError(f"stages wait for each other: {[s.name for s in left]}")
        for stage in ready:
            made[stage.name] = run_stage(spark, stage, root, made)
        left = [s for s in left if s.name not in made]
    return made


def stale(spark: SparkSession, run: str) -> list[str]:
    """What of a run's ancestry isn't as it was: the names of inputs, nearest first, as stage/input. A run
    whose own files were changed is an error."""
    manifest = verify_run(spark, run)
    out, stage = [], manifest["parameters"]["stage"]
    for name, path in sorted(manifest["parameters"]["paths"].items()):
        is_run = store_of(spark, f"{path}/manifest.json")[0].exists(store_of(spark, f"{path}/manifest.json")[1])
        try:
            now = content(spark, f"{path}/manifest.json" if is_run else path)
            if now != manifest["inputs"][name]:
                out.append(f"{stage}/{name}")
            elif is_run:
                out += stale(spark, path)
        except OSError:
            out.append(f"{stage}/{name}")
    return out


def ancestry(spark: SparkSession, run: str, depth: int = 0) -> list[tuple[int, str, str, str, str]]:
    """(depth, stage, input, path, hash) of a run and of all runs that it was made of."""
    manifest = verify_run(spark, run)
    out = []
    for name, path in sorted(manifest["parameters"]["paths"].items()):
        out.append((depth, manifest["parameters"]["stage"], name, path, manifest["inputs"][name]))
        if store_of(spark, f"{path}/manifest.json")[0].exists(store_of(spark, f"{path}/manifest.json")[1]):
            out += ancestry(spark, path, depth + 1)
    return out


#: Release states of a season that may be loaded (fixed values).
RELEASED = {"PASS", "PASS_WITH_EXCLUSIONS"}


def load_season(spark: SparkSession, run: str, season: str, dates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From a verified run of that season whose release passed: its stints, the games (game, rows, home_pts, away_pts, target = 100
    times the margin by the rows, home_team, away_team, day), and the games that have no stints, which can't be rated.
    Refused: another season, a run that isn't released, a game with two home or away teams, an offence
    team outside of the game's pair, stints of a game without possessions, a game without a date. dates: game, day."""
    manifest = verify_run(spark, run)
    said = manifest["parameters"]
    if said.get("season") != season or said.get("release") not in RELEASED:
        raise ValueError(f"{run}: season {said.get('season')} with release {said.get('release')} isn't a released {season}")
    stints, poss = (spark.read.parquet(f"{run}/{name}.parquet") for name in ("stints", "possessions"))
    sides = stints.groupBy("game").agg(F.min("home_team").alias("home_team"), F.max("home_team").alias("_h"), F.min("away_team").alias("away_team"), F.max("away_team").alias("_a"))
    games = poss.groupBy("game").agg(F.count("*").alias("rows"), F.sum("home_pts").alias("home_pts"), F.sum("away_pts").alias("away_pts"), F.collect_set("offense_team").alias("_teams"))  # a game has few teams
    both = games.join(sides, "game", "full").join(dates.groupBy("game").agg(F.min("day").alias("day")), "game", "left")
    other = F.size(F.array_except("_teams", F.array("home_team", "away_team"))) > 0
    rated = F.col("home_team").isNotNull()
    reasons = F.when(F.col("rows").isNull(), "stints without possessions").when(rated & ((F.col("home_team") != F.col("_h")) | (F.col("away_team") != F.col("_a"))), "more than one pair of teams")
    reasons = reasons.when(rated & other, "offence outside of the pair").when(rated & F.col("day").isNull(), "no date")
    bad = both.select("game", reasons.alias("reason")).where("reason is not null").orderBy("game").limit(5).collect()
    if bad:
        raise ValueError(f"{run}: {[(r['game'], r['reason']) for r in bad]}")
    target = (100.0 * (F.col("home_pts") - F.col("away_pts")) / F.col("rows")).alias("target")
    return stints, both.where(rated).select("game", "rows", "home_pts", "away_pts", target, "home_team", "away_team", "day"), both.where(~rated).select("game")
