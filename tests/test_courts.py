"""Line-ups from a log of substitutions, against a plain replay."""

import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.operators import lineups as lu

TEAM = ("game", "team")
ACTIONS = "game long, team long, period long, at long, action_id long, kind string, player long, text string"
ROSTER = "game long, team long, player long, name string, official double"
NAMES = {i: f"P{chr(97 + i % 26)} Last{chr(97 + i)}" for i in range(20)}


def played(seed, games=4, periods=3, wrong=0.0):
    """A log in which every starter acts before the first substitution, and official minutes that fit; wrong: share of faulty substitutions."""
    r = random.Random(seed)
    actions, official, ids = [], defaultdict(float), itertools.count()
    for game in range(games):
        for team in range(2):
            squad = [team * 10 + i for i in range(8)]
            for period in range(1, periods + 1):
                on, since = set(r.sample(squad, 5)), {}
                since = dict.fromkeys(on, 0)
                for p in on:
                    actions.append((game, team, period, r.randrange(10), next(ids), "shot", p, ""))
                actions.append((game, team, period, 5, next(ids), "timeout", None, ""))
                for t in sorted(r.sample(range(20, 700), 6)):
                    out, come = r.choice(sorted(on)), r.choice(sorted(set(squad) - on))
                    if r.random() < wrong:
                        out, come = r.choice([(None, come), (come, out), (out, None), (out, r.choice(sorted(on)))])
                        actions.append((game, team, period, t, next(ids), "substitution", out, f"SUB: {NAMES[come] if come is not None else 'Nobody'} FOR x"))
                        continue
                    text = NAMES[come] if r.random() < 0.5 else NAMES[come].split()[1].upper()
                    actions.append((game, team, period, t, next(ids), "substitution", out, f"sub: {text}  for {NAMES[out]} "))
                    official[game, out] += t - since.pop(out)
                    on = on - {out} | {come}
                    since[come] = t
                for p, t in since.items():
                    official[game, p] += 720 - t
    roster = [(g, t, p, NAMES[p], official[g, p] / 60) for g in range(games) for t in range(2) for p in range(t * 10, t * 10 + 8)]
    return actions, roster


def test_sound_games_pass(spark):
    actions, roster = played(1)
    a, r = spark.createDataFrame(actions, ACTIONS).repartition(3), spark.createDataFrame(roster, ROSTER)
    periods = lu.rebuilt(a, r, TEAM, "period", 5, F.lit(720))
    got = lu.truth(periods, r, TEAM, "period", 5).collect()
    assert len(got) == 4 and all(x.passed and x.n_errors == 0 and x.max_error < 1e-9 and x.team_gap < 1e-9 and x.game_minutes == 36 for x in got)
    late = r.withColumn("official", F.when(F.col("game") == 2, F.col("official") + F.when(F.col("player") == 3, 0.5).otherwise(0)).otherwise(F.col("official")))
    assert {x.game: x.passed for x in lu.truth(periods, late, TEAM, "period", 5).collect()} == {0: True, 1: True, 2: False, 3: True}


def replay(actions, names, length):
    """Seconds and errors by a loop over the rows."""
    out, errors = defaultdict(int), []
    for key in sorted({a[:3] for a in actions}):
        rows = sorted((a for a in actions if a[:3] == key), key=lambda a: (a[3], a[4]))
        subs = [a for a in rows if a[5] == "substitution"]
        first = min((a[3] for a in subs), default=10**9)
        on = {a[6] for a in rows if a[3] <= first and a[6] is not None and a[5] not in lu.OFF_COURT}
        if len(on) != 5:
            errors.append((key, "STARTER_INFERENCE_FAILED"))
            continue
        last = 0
        for a in subs:
            for p in on:
                out[key, p] += a[3] - last
            last = a[3]
            said = a[7][5:].lower().split(" for ")[0].strip()
            come = [p for p in range(key[1] * 10, key[1] * 10 + 8) if said in (names[p].lower(), names[p].lower().split()[1])]
            wrong = "MISSING_OUTGOING_ID" if a[6] is None else "OUTGOING_NOT_ON_COURT" if a[6] not in on else "INCOMING_UNRESOLVED" if len(come) != 1 else "INCOMING_ALREADY_ON_COURT" if come[0] in on else None
            if wrong:
                errors.append((key, wrong))
            else:
                on = on - {a[6]} | {come[0]}
        for p in on:
            out[key, p] += length - last
    return dict(out), sorted(errors)


def test_faulty_games_match_a_replay(spark):
    actions, roster = played(7, wrong=0.3)
    actions = [a for a in actions if not (a[0] == 3 and a[5] == "shot" and a[2] == 2)]
    a, r = spark.createDataFrame(actions, ACTIONS).repartition(3), spark.createDataFrame(roster, ROSTER)
    rows = lu.rebuilt(a, r, TEAM, "period", 5, F.lit(720)).collect()
    seconds, errors = defaultdict(int), []
    for x in rows:
        for s in x.stints or []:
            seconds[(x.game, x.team, x.period), s.player] += s.end - s.begin
        assert not x.stints or sum(s.end - s.begin for s in x.stints) == 5 * 720
        errors += [((x.game, x.team, x.period), e.type) for e in x.errors]
    want, wrong = replay(actions, NAMES, 720)
    assert {k: v for k, v in seconds.items() if v} == {k: v for k, v in want.items() if v} and sorted(errors) == wrong
    assert {e for _, e in wrong} == {"MISSING_OUTGOING_ID", "OUTGOING_NOT_ON_COURT", "INCOMING_UNRESOLVED", "INCOMING_ALREADY_ON_COURT", "STARTER_INFERENCE_FAILED"}


def test_periods_without_events_are_told(spark):
    actions, roster = played(2, games=1)
    a = spark.createDataFrame([x for x in actions if not (x[1] == 1 and x[2] == 2)], ACTIONS)
    got = {(x.team, x.period): x.status for x in lu.starters(a, spark.createDataFrame(roster, ROSTER), TEAM, "period", 5).collect()}
    assert got[1, 2] == "NO_TEAM_EVENTS" and sum(s == "UNIQUE" for s in got.values()) == 5


def test_sets_are_listed_for_many_free_players(spark):
    """Two must have started, 25 may have: all ways to fill three places, in rows of their own."""
    acts = [(1, 1, p, t, k) for t, (p, k) in enumerate([(0, "act"), (1, "out"), (2, "in"), (2, "out")])] + [(1, 2, 0, 0, "in"), (1, 2, 0, 1, "in")]
    a = spark.createDataFrame(acts, "game long, day long, player long, at long, kind string").withColumn("tie", F.col("at"))
    squad = spark.createDataFrame([(1, p) for p in range(28)], "game long, player long")
    got = lu.start_sets(a, squad, ["game"], ["day"], 5, "tie").collect()
    want = {tuple(sorted((0, 1, *c))) for c in itertools.combinations(range(3, 28), 3)}
    assert {tuple(x.members) for x in got} == want and len(got) == len(want) == 2300
    told = {x.day: x for x in lu.starts(a, squad, ["game"], ["day"], 5, "tie").collect()}
    assert (told[1].n_sets, told[1].n_free, told[1].status) == (2300, 25, "AMBIGUOUS") and told[2].status == "IMPOSSIBLE"


def test_choices_are_exact(spark):
    import math

    rows = spark.createDataFrame([(n, k) for n in (0, 1, 5, 21, 40, 60) for k in (-1, 0, 1, 2, 5, 61)], "n long, k long")
    for x in rows.select("n", "k", lu.choices(F.col("n"), F.col("k")).alias("ways")).collect():
        assert x.ways == (math.comb(x.n, x.k) if 0 <= x.k else 0)
