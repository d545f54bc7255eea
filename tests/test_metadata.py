"""Metadata kept up by changes against metadata made anew."""

import random

import pytest

from gridspan.operators import cells as grid
from gridspan.streaming import metadata

CELLS = "district_id long, school_year string, period string, education string, credits int, step int"


def cells_of(rng, district):
    return [(district, f"{y}-{y + 1}", rng.choice(["Full Year", "10-month"]), rng.choice("BMD"), 15 * rng.randrange(3), s) for y in rng.sample(range(2018, 2024), rng.randint(1, 3)) for s in range(1, rng.randint(2, 9))]


def changes(spark, batch):
    rows = [(d, seq, [c[1:] for c in cells]) for seq, (d, cells) in enumerate(batch)]
    return spark.createDataFrame(rows, metadata.CHANGE)


def same(spark, root, state):
    rows = spark.createDataFrame([c for cells in state.values() for c in cells], CELLS)
    want = grid.availability_rows(rows)
    assert sorted(map(tuple, metadata.availability_now(spark, root).collect())) == sorted(map(tuple, want.collect()))
    districts = {}
    for d, cells in state.items():
        for c in cells:
            districts.setdefault((c[1], c[2]), set()).add(d)
    assert {(r.school_year, r.period): r.n_districts for r in metadata.catalogue_now(spark, root).collect()} == {k: len(v) for k, v in districts.items()}
    got, made = metadata.maxima_now(spark, root).first(), grid.global_maxima(rows).first()
    assert (got.max_step, got.combos) == (made.max_step, made.combos)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes(spark, tmp_path, seed):
    rng, root, state = random.Random(seed), str(tmp_path / "m"), {}
    for version in range(5):
        batch = [(d, [] if rng.random() < 0.25 else cells_of(rng, d)) for d in rng.choices(range(12), k=6)]
        assert metadata.apply_changes(changes(spark, batch), version, root, 5)
        state.update(batch)  # the last change of a district counts
        same(spark, root, state)
    assert not metadata.apply_changes(changes(spark, [(0, cells_of(rng, 0))]), 2, root, 5)
    same(spark, root, state)


def test_only_changed_buckets_are_written(spark, tmp_path):
    rng, root = random.Random(3), str(tmp_path / "m")
    metadata.apply_changes(changes(spark, [(d, cells_of(rng, d)) for d in range(40)]), 0, root, 16)
    metadata.apply_changes(changes(spark, [(7, cells_of(rng, 7))]), 1, root, 16)
    assert len(list((tmp_path / "m/facts/version=1").glob("bucket=*"))) == 1
    held = metadata._map(spark, root, 1)
    assert sorted(held.values()).count(1) == 1 and set(held.values()) == {0, 1}


def test_a_broken_change_is_made_again(spark, tmp_path):
    """What was written before the map is no change; the same batch writes it over."""
    rng, root = random.Random(4), str(tmp_path / "m")
    first = {d: cells_of(rng, d) for d in range(9)}
    metadata.apply_changes(changes(spark, list(first.items())), 0, root, 4)
    second = {d: cells_of(rng, d) for d in (2, 3)}
    metadata.apply_changes(changes(spark, list(second.items())), 1, root, 4)
    for f in (tmp_path / "m/map/version=1").iterdir():
        f.unlink()
    (tmp_path / "m/map/version=1").rmdir()
    same(spark, root, first)
    assert metadata.apply_changes(changes(spark, list(second.items())), 1, root, 4)
    same(spark, root, first | second)


def test_stream_of_changes(spark, tmp_path):
    """Files of changes as a stream that is stopped and goes on; each batch is a version."""
    rng, state = random.Random(5), {}
    root, place = str(tmp_path / "m"), str(tmp_path / "in")
    for _ in range(2):
        for _ in range(2):
            batch = [(d, cells_of(rng, d) if rng.random() < 0.8 else []) for d in rng.sample(range(8), 3)]
            state.update(batch)
            changes(spark, batch).coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(metadata.CHANGE).option("maxFilesPerTrigger", 1).parquet(place)
        query = metadata.keep_up(stream, root, str(tmp_path / "checkpoint"), 4)
        assert query.awaitTermination(120)
        same(spark, root, state)
    assert metadata.versions(spark, root) == [0, 1, 2, 3]


def test_a_change_groups_its_cells_once(spark, tmp_path, monkeypatch):
    """Facts are grouped for the write alone: counts are of what was written before and now, not of cells grouped again."""
    seen, counted = [], metadata.counted
    monkeypatch.setattr(metadata, "counted", lambda facts: seen.append(facts._jdf.queryExecution().optimizedPlan().toString()) or counted(facts))
    rng, root = random.Random(6), str(tmp_path / "m")
    state = {d: cells_of(rng, d) for d in range(30)}
    metadata.apply_changes(changes(spark, list(state.items())), 0, root, 4)
    second = {d: cells_of(rng, d) for d in range(0, 30, 2)}
    metadata.apply_changes(changes(spark, list(second.items())), 1, root, 4)
    assert len(seen) == 4 and not any("Aggregate" in x or "Join" in x for x in seen), seen
    same(spark, root, state | second)
