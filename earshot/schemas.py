"""Table schemas, keys and value domains of the listening star schema."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, LongType, StringType,
    StructField, StructType, TimestampType,
)


def _table(required: str, **columns) -> StructType:
    must = set(required.split())
    return StructType([StructField(n, t, n not in must) for n, t in columns.items()])


_S, _D, _I, _L, _B = StringType(), DoubleType(), IntegerType(), LongType(), BooleanType()
_TS, _DATE = TimestampType(), DateType()

#: The nine audio measures of a track.
AUDIO = ["tempo", "energy", "danceability", "valence", "acousticness",
         "instrumentalness", "liveness", "speechiness", "loudness"]

USERS = _table("user_id signup_date tier", user_id=_S, signup_date=_TS, tier=_S, country=_S,
               age_group=_S, gender=_S, preferred_genre=_S, created_at=_TS, updated_at=_TS)

TRACKS = _table("track_id", track_id=_S, **{name: _D for name in AUDIO}, duration_ms=_I,
                popularity=_D, release_year=_I, genre=_S, artist_id=_S)

SESSIONS = _table("session_id user_id track_id timestamp listen_duration_ms",
                  session_id=_S, user_id=_S, track_id=_S, timestamp=_TS,
                  listen_duration_ms=_L, track_duration_ms=_L, skipped=_B, skip_time_ms=_L,
                  context=_S, device=_S)

PLAYLISTS = _table("playlist_id", playlist_id=_S, user_id=_S, name=_S, created_date=_TS,
                   num_tracks=_I, is_public=_B)

PLAYLIST_TRACKS = _table("playlist_id track_id", playlist_id=_S, track_id=_S, position=_I)

AB_ASSIGNMENTS = _table("user_id test_name variant", user_id=_S, test_name=_S, variant=_S,
                        assignment_date=_TS)

AB_RESULTS = _table("user_id test_name metric_name", user_id=_S, test_name=_S, metric_name=_S,
                    metric_value=_D, recorded_at=_TS)

USER_METRICS = _table("user_id", user_id=_S, total_sessions=_L, total_listen_time_ms=_L,
                      skip_rate=_D, avg_session_duration_ms=_D, unique_tracks_played=_L,
                      unique_genres=_L, last_active_date=_DATE, engagement_score=_D)

TABLES = {
    "users": USERS, "tracks": TRACKS, "sessions": SESSIONS, "playlists": PLAYLISTS,
    "playlist_tracks": PLAYLIST_TRACKS, "ab_test_assignments": AB_ASSIGNMENTS,
    "ab_test_results": AB_RESULTS, "user_metrics": USER_METRICS,
}

# The allowed values of the checked columns.
DOMAINS = {
    "users": {"tier": ["free", "premium", "family", "student"]},
    "sessions": {
        "context": ["playlist", "album", "radio", "search", "recommendation"],
        "device": ["mobile", "desktop", "tablet", "smart_speaker"],
    },
    "ab_test_assignments": {"variant": ["control", "treatment"]},
}

#: Columns whose values identify a row.
KEYS = {
    "users": ["user_id"],
    "tracks": ["track_id"],
    "sessions": ["session_id"],
    "playlists": ["playlist_id"],
    "playlist_tracks": ["playlist_id", "track_id"],
    "ab_test_assignments": ["user_id", "test_name"],
    "user_metrics": ["user_id"],
}

#: (child table, child column, parent table, parent column).
REFERENCES = [
    ("sessions", "user_id", "users", "user_id"),
    ("sessions", "track_id", "tracks", "track_id"),
    ("playlists", "user_id", "users", "user_id"),
    ("playlist_tracks", "playlist_id", "playlists", "playlist_id"),
    ("playlist_tracks", "track_id", "tracks", "track_id"),
    ("ab_test_assignments", "user_id", "users", "user_id"),
    ("ab_test_results", "user_id", "users", "user_id"),
]


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]
