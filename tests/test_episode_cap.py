from datetime import datetime, timedelta

import pytest

from mnemora.queries.registry import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A user's run of 60 events, and a project's of 60 memories, a minute apart."""
    path = str(tmp_path_factory.mktemp("episodes"))
    rows = [(n, datetime(2024, 1, 1) + timedelta(minutes=n), 1, "purchase" if n == 20 else "view", 1.0, "{}") for n in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    notes = [(f"{n:02d}", "p", n * 60_000, 1.0 if n == 20 else 0.5) for n in range(60)]
    spark.createDataFrame(notes, "id string, project_id string, created_at bigint, emotional_weight double").write.parquet(f"{path}/memories.parquet")
    return path


def test_episodes_end_after_50_events(spark, folder):
    assert sorted((r.part, r.n) for r in QUERIES["episode_sizes"](spark, folder).collect()) == [(0, 50), (1, 10)]
    assert sorted(r.n for r in QUERIES["stream_episodes"](spark, folder).collect()) == [10, 50]


def test_links_reach_10_events(spark, folder):
    got = {(int(r.src), int(r.dst), r.distance) for r in QUERIES["episode_links"](spark, folder).collect()}
    assert got == {(a, b, b - a) for a in range(60) for b in range(a + 1, min(60, a + 11)) if (a < 50) == (b < 50)}
    assert {int(r.id) for r in QUERIES["temporal_spread"](spark, folder).collect()} == set(range(10, 31))
    assert {(int(r.anchor), int(r.id)) for r in QUERIES["temporal_neighbors"](spark, folder).collect()} == {(a, a + d) for a in range(60) for d in (1, 2, 3) if a + d < 60 and (a < 50) == (a + d < 50)}
