"""Ordered journey work against plain Python, with one very long journey."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import timedelta
from statistics import median

import pytest
from conftest import START, records
from pyspark.sql import functions as F

from footfall.operators import features, funnel, sequences, snapshots, spread, timeline
from footfall.operators import outcomes as oc
from footfall.plans import journeys

DAY = 86_400
NAMES = ["x", "y", "z"]


def random_rows(seed=3, hot=900, others=60):
    """A third of all events in one journey, ties in time, single-event journeys."""
    rng = random.Random(seed)
    rows = [("hot 1", rng.choice(NAMES), rng.randrange(40 * DAY) // 60 * 60) for _ in range(hot)]
    for i in range(others):
        start = rng.randrange(30 * DAY)
        for _ in range(rng.choice([1, 2, 5, 30, 80])):
            rows.append((f"j {i}", rng.choice(NAMES), start + rng.randrange(9 * DAY) // 3600 * 3600))
    rng.shuffle(rows)
    return rows


def by_journey(rows):
    groups = defaultdict(list)
    for k, (i, n, s) in enumerate(rows):
        groups[i].append((s, k, n))
    return {i: sorted(g) for i, g in groups.items()}


@pytest.fixture(scope="module")
def rows():
    return random_rows()


def test_gaps(log, rows):
    got = {r["event_id"]: r["gap_s"] for r in features.with_gaps(log(rows)).collect()}
    want = {}
    for g in by_journey(rows).values():
        for before, now in zip([None, *g], g):
            want[now[1]] = None if before is None else now[0] - before[0]
    assert got == want


def test_previous_value_of_any_column(log, rows):
    got = {r["event_id"]: r["before"] for r in spread.with_previous(log(rows), {"before": "event_name"}).collect()}
    want = {}
    for g in by_journey(rows).values():
        for before, now in zip([None, *g], g):
            want[now[1]] = None if before is None else before[2]
    assert got == want


def test_timeline(log, rows):
    got = records(timeline.timeline_features(log(rows), NAMES), "event_id")
    want = {}
    for g in by_journey(rows).values():
        seen = []
        for s, k, n in g:
            seen.append(n)
            want[k] = (len(seen), len(set(seen)), (s - g[0][0]) / DAY, *[seen.count(x) for x in NAMES])
    for r in got:
        assert (r["n_events"], r["n_unique_events"], *[r[f"n_{x}"] for x in NAMES]) == want[r["event_id"]][:2] + want[r["event_id"]][3:]
        assert r["journey_duration_days"] == pytest.approx(want[r["event_id"]][2])
        assert sum(r[f"n_{x}"] for x in NAMES) == r["n_events"]


def test_flat_features(log, rows):
    df = log(rows).withColumn("cutoff_time", F.lit("2024-02-20").cast("timestamp"))
    got = {r["id"]: r for r in features.flatten_journeys(df, NAMES).collect()}
    for i, g in by_journey(rows).items():
        gaps = [b[0] - a[0] for a, b in zip(g, g[1:])]
        r = got[i]
        assert r["total_actions"] == len(g) == sum(r[f"n_{x}"] for x in NAMES)
        assert r["journey_length_s"] == g[-1][0] - g[0][0]
        assert r["median_gap_sec"] == (median(gaps) if gaps else None)
        assert r["max_gap_sec"] == (max(gaps) if gaps else None)
        assert r["mean_gap_sec"] == (pytest.approx(sum(gaps) / len(gaps)) if gaps else None)


def test_baseline_features(log, rows):
    got = {r["id"]: r for r in features.baseline_features(log(rows), NAMES).collect()}
    for i, g in by_journey(rows).items():
        assert got[i]["n_unique_events"] == len({n for *_, n in g})
        assert [got[i][f"last_is_{x}"] for x in NAMES] == [int(g[-1][2] == x) for x in NAMES]


def test_lists_come_in_bounded_pages(log, rows):
    pages = records(features.journey_lists(log(rows), page_size=100), "id", "page")
    assert max(p["n_events"] for p in pages) == 100
    joined = defaultdict(list)
    for p in pages:
        joined[p["id"]] += p["event_names"]
    assert joined == {i: [n for *_, n in g] for i, g in by_journey(rows).items()}


def test_last_events_and_sequences(log, rows):
    df = log(rows)
    got = records(sequences.sequence_long(df, sequences.build_vocab(df), 10), "id", "seq_idx")
    want = []
    for i, g in sorted(by_journey(rows).items()):
        start = max(len(g) - 10, 0)
        for j, (s, _, n) in enumerate(g[start:]):
            before = g[start + j - 1][0] if start + j > 0 else s
            want.append((i, j + 1, NAMES.index(n) + 1, s - before))
    assert [(r["id"], r["seq_idx"], r["event_idx"]) for r in got] == [w[:3] for w in want]
    for r, w in zip(got, want):
        assert r["log_gap"] == pytest.approx(__import__("math").log1p(w[3]))


def test_paths(spark, log, rows):
    df = log(rows)
    defs = spark.createDataFrame([("x", None, "A"), ("y", 1, "B")], "event_name string, milestone_number int, stage string").withColumn(
        "event_definition_id", F.lit(1)
    )
    outcomes = df.select("id").distinct().withColumn("final_outcome", F.lit("failure"))
    stage = {"x": "A", "y": "B", "z": "NA"}
    counts = defaultdict(int)
    for g in by_journey(rows).values():
        counts[" > ".join(stage[n] for *_, n in g)] += 1
    got = records(funnel.stage_paths(df, defs, outcomes, 100, page_steps=7), "rank", "page")
    paths, n = defaultdict(list), {}
    for r in got:
        assert r["path"].count(" > ") < 7
        paths[r["rank"]].append(r["path"])
        n[r["rank"]] = r["n"]
    assert {" > ".join(p): n[k] for k, p in paths.items()} == dict(counts)
    assert sum(n.values()) == len(by_journey(rows))


def test_paths_over_a_thousand_stages_are_whole(spark, log):
    df = log([("long", "xy"[i % 2], i) for i in range(2500)])
    defs = spark.createDataFrame(
        [("x", None, "A", 1), ("y", 1, "B", 2)],
        "event_name string, milestone_number int, stage string, event_definition_id int",
    )
    outcomes = spark.createDataFrame([("long", "failure")], "id string, final_outcome string")
    got = records(funnel.stage_paths(df, defs, outcomes), "page")
    assert [r["page"] for r in got] == [0, 1, 2] and {r["n_steps"] for r in got} == {2500}
    assert " > ".join(r["path"] for r in got) == " > ".join("AB"[i % 2] for i in range(2500))


def test_list_features_cover_all_pages(log):
    df = log([("a", n, s) for s, n in enumerate("xxyxzy")] + [("b", "z", 3)])
    got = records(features.list_row_features(features.journey_lists(df, page_size=4), "y", "x"), "id")
    assert [tuple(r.values()) for r in got] == [("a", 6, 3, 1, 3, True), ("b", 1, 1, 0, 0, False)]


def test_previous_event_of_a_journey_without_id(spark, log):
    from footfall.operators.spread import with_event_number, with_previous

    df = log([("a", "x", 0), ("a", "y", 200_000)]).withColumn("id", F.lit(None).cast("string"))
    got = records(with_event_number(with_previous(df, {"before": "event_name"})), "event_number")
    assert [(r["before"], r["event_number"]) for r in got] == [(None, 1), ("x", 2)]


def test_snapshots_never_look_ahead(log, rows):
    df = log(rows)
    bounds = snapshots.snapshot_k(snapshots.journey_bounds(df))
    ks = {r["id"]: r["K"] for r in bounds.collect()}
    sizes = {i: len(g) for i, g in by_journey(rows).items()}
    for i, n in sizes.items():
        rank = 1 + sum(m < n for m in sizes.values())
        assert ks[i] == -(-5 * rank // len(sizes))
    cuts = snapshots.k_cutoffs(bounds)
    seen = snapshots.expand_snapshots(df, cuts)
    assert seen.where("event_timestamp > cutoff_time").count() == 0
    # A cutoff never lies before the first event, so no snapshot is empty.
    assert seen.select("snapshot_id").distinct().count() == cuts.count() == sum(ks.values())


def test_features_from_day_states_equal_those_of_expanded_events(spark, log):
    day = 86_400
    rows = [("busy", NAMES[k % len(NAMES)], day + k // 3) for k in range(600)]
    rows += [("busy", NAMES[0], 5 * day + 60 * k) for k in range(50)]
    rows += [("lone", NAMES[1], 0), (None, NAMES[0], 10), (None, NAMES[1], 2 * day)]
    df = log(rows).unionByName(
        spark.createDataFrame([("busy", NAMES[0], None, 9000)], "id string, event_name string, event_timestamp timestamp, event_id long")
    )
    cuts = spark.createDataFrame(
        [("busy", f"busy_{k}", START + timedelta(seconds=s)) for k, s in enumerate((day, day + 100, 4 * day, 5 * day + 90, 9 * day))]
        + [("lone", "lone_1", START), (None, "1", START + timedelta(seconds=3 * day)), ("gone", "gone_1", START)],
        "id string, snapshot_id string, cutoff_time timestamp",
    )
    states = snapshots.day_states(df, NAMES)
    by = ("id", "snapshot_id")
    got = records(snapshots.features_at(df, states, snapshots.days_of_states(states), cuts, NAMES, by), "snapshot_id")
    timed = features.with_gaps(df.where("event_timestamp IS NOT NULL"))
    want = records(features.flatten_journeys(snapshots.expand_snapshots(timed, cuts), NAMES, by=by), "snapshot_id")
    assert got == want and [r["snapshot_id"] for r in got] == ["1", *[f"busy_{k}" for k in range(5)], "lone_1"]
    # Rows of the busy day are its distinct gaps, not its events.
    assert states.where("id = 'busy'").count() < 10
    assert spark.createDataFrame([], df.schema).transform(
        lambda e: snapshots.features_at(e, snapshots.day_states(e, NAMES), snapshots.days_of_states(snapshots.day_states(e, NAMES)), cuts, NAMES, by)
    ).isEmpty()


def test_snapshot_features_match_recomputed_rows(log, rows):
    df = log(rows + [("won", "z", 5), ("won", "order_shipped", 9)])
    got = journeys.snapshot_features(df, NAMES, inactivity_days=10)
    flat = {r["snapshot_id"]: r for r in got.collect()}
    assert {r["final_outcome"] for r in flat.values()} <= {"success", "failure"}
    closed = oc.label_outcomes(oc.journey_status(df), 10).where("final_outcome <> 'incomplete'")
    bounds = snapshots.journey_bounds(df).join(closed, "id", "left_semi")
    cuts = snapshots.k_cutoffs(snapshots.snapshot_k(bounds)).select(
        "snapshot_id", "id", F.unix_micros("cutoff_time").alias("us")
    )
    start = 1_704_067_200_000_000
    groups = by_journey(rows + [("won", "z", 5), ("won", "order_shipped", 9)])
    found = cuts.collect()
    assert len(found) == len(flat)
    for c in found:
        visible = [e for e in groups[c["id"]] if start + e[0] * 1_000_000 <= c["us"]]
        gaps = [b[0] - a[0] for a, b in zip(visible, visible[1:])]
        r = flat[c["snapshot_id"]]
        assert r["total_actions"] == len(visible)
        assert r["median_gap_sec"] == (median(gaps) if gaps else None)


def test_restrict_and_exclude_split_the_log(log, rows):
    df = log(rows)
    ids = df.where("id in ('hot 1', 'j 3')").select("id")
    inside, outside = oc.restrict_events(df, ids), oc.exclude_events(df, ids)
    assert inside.count() + outside.count() == df.count()
    assert {r["id"] for r in inside.select("id").distinct().collect()} == {"hot 1", "j 3"}


def test_events_without_a_time_are_kept(log):
    df = log([("a", "x", 0), ("a", "y", 5), ("b", "x", 9)])
    df = df.withColumn("event_timestamp", F.when(F.col("event_name") != "y", F.col("event_timestamp")))
    assert oc.restrict_events(df, df.where("id = 'a'").select("id")).count() == 2
    assert features.with_gaps(df).count() == 3
    assert timeline.timeline_features(df, NAMES).count() == 3


def test_training_rows_drop_journeys_that_start_with_the_target(log):
    df = log(
        [("a", "order_shipped", 0), ("b", "x", 0), ("b", "order_shipped", 5), ("c", "x", 3), ("d", "x", 100 * DAY)]
    )
    got = records(journeys.training_snapshots(df, NAMES), "id")
    assert [(r["id"], r["label"], r["n_events"]) for r in got] == [("b", 1, 1), ("c", 0, 1)]


def test_padded_arrays(spark, log):
    df = log([("a", "x", 0), ("a", "y", 3600), ("a", "z", 7200), ("b", "x", 9)])
    snaps = spark.createDataFrame(
        [("a_1", "a", "2024-01-01 01:00:00", "success"), ("b_1", "b", "2024-01-01 00:00:09", "failure"), ("c_1", "c", "2024-01-01 00:00:00", "failure")],
        "snapshot_id string, id string, t string, final_outcome string",
    ).withColumn("last_action_ts", F.col("t").cast("timestamp"))
    vocab = sequences.build_vocab(df)
    right = records(sequences.sequence_arrays(snaps, df, vocab, 3), "snapshot_id")
    left = records(sequences.sequence_arrays(snaps, df, vocab, 3, side="left"), "snapshot_id")
    assert [r["event_ids"] for r in right] == [[1, 2, 0], [1, 0, 0], [0, 0, 0]]
    assert [r["event_ids"] for r in left] == [[0, 1, 2], [0, 0, 1], [0, 0, 0]]
    assert [(r["length"], r["label"]) for r in right] == [(2, 1), (1, 0), (1, 0)]
    assert right[0]["delta"] == pytest.approx([0.0, 0.6931472, 0.0])
    assert right[0]["to_cutoff"] == pytest.approx([0.6931472, 0.0, 0.0])
    assert all(len(r["event_ids"]) == len(r["delta"]) == len(r["to_cutoff"]) == 3 for r in left)


def test_unknown_names(log):
    df = log([("a", "x", 0), ("a", "new", 1)])
    vocab = sequences.build_vocab(df.where("event_name = 'x'"))
    assert [r["event_idx"] for r in records(sequences.encode_events(df, vocab), "event_id")] == [1, 0]
    assert [r["event_idx"] for r in records(sequences.encode_events(df, vocab, None), "event_id")] == [1, None]
