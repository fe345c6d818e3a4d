"""Domain schemas and fixed values of the scoring rules."""

from __future__ import annotations

# Thresholds and weights of the scores.
EFFECTIVE_EDGE = 4
WINDOW_HOURS = 24
EPISODE_ON, EPISODE_OFF = 60.0, 40.0
EXTRA_PAIR_WEIGHT = 0.25
LIVE_WINDOWS = {"5m": 300, "1h": 3600, "24h": 86400}
LIVE_FACTORS = {"5m": 5.0, "1h": 2.0, "24h": 1.0}
SEVERITIES = (("major", 90.0), ("war", 75.0), ("skirmish", 60.0), ("watch", 40.0))

# Columns of a history row (zero-based), of at least HISTORY_WIDTH.
HISTORY_WIDTH = 78
HISTORY = {
    "wiki": 0, "entity": 2, "type": 3, "timestamp": 4, "comment": 5, "user_historical": 8, "user": 9,
    "bot_by_historical": 14, "bot_by": 15, "bot": 22, "page_id": 28, "title_historical": 29, "title": 30,
    "namespace": 31, "rev_id": 60, "bytes": 65, "bytes_diff": 66, "is_reverted": 72, "first_reverting": 73, "is_revert": 75,
}

EVENT_SCHEMA = (
    "server_name string, wiki string, type string, title string, user string, comment string, namespace int, page_id long, user_id long, "
    "bot boolean, minor boolean, rev_id long, old_revid long, revision struct<new:long,old:long>, length struct<old:long,new:long>, timestamp string, "
    "tags array<string>, meta struct<id:string>"
)
EDIT_SCHEMA = (
    "wiki string, page_id long, page_title string, namespace int, rev_id long, parent_rev_id long, ts timestamp, user_id long, user_text string, "
    "user_is_bot boolean, user_is_anonymous boolean, comment string, tags array<string>, minor boolean, old_len long, new_len long, stream_id string"
)
