import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from checker import make_session

    session = make_session(4)
    yield session
    session.stop()


@pytest.fixture
def make_log(spark):
    """Flat log from (user, date[, event, screen, user_id, time]) tuples."""

    def build(rows):
        full = []
        for row in rows:
            user, day, event, screen, uid, clock = (*row, *(None, "screen_view", "home", 1, "12:00:00")[len(row) - 1:])
            full.append((user, uid, event, screen, f"{day} {clock}"))
        raw = spark.createDataFrame(
            full, "user_pseudo_id string, user_id bigint, event_name string, firebase_screen string, t string"
        )
        return raw.selectExpr(
            "cast(t as timestamp_ntz) event_datetime", "cast(t as date) event_date",
            "trunc(cast(t as date), 'WEEK') event_week", "weekday(cast(t as date)) + 1 event_dow",
            "user_pseudo_id", "user_id", "event_name", "firebase_screen",
        )

    return build
