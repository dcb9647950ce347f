"""Schemas of the model's tables. Flags are integers 0, 1 or null; epochs are seconds as long."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"L": T.LongType(), "I": T.IntegerType(), "S": T.StringType(), "D": T.DoubleType()}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split(":") for x in spec.split())])


MATCHES = _schema(
    "match_id:L league_id:L league_name:S series_id:L series_type:I start_time:L duration:I pre_game_duration:I patch:I radiant_team_id:L "
    "radiant_name:S dire_team_id:L dire_name:S radiant_win:I radiant_score:I dire_score:I detail_fetched_at:L"
)
DRAFT_EVENTS = _schema("match_id:L ord:I is_pick:I hero_id:I team:I")
MATCH_PLAYERS = _schema("match_id:L player_slot:I account_id:L player_name:S hero_id:I is_radiant:I lane_role:I kills:I deaths:I assists:I gold_per_min:I xp_per_min:I")
MATCH_TIMESERIES = _schema("match_id:L minute:I radiant_gold_adv:I radiant_xp_adv:I")
TEAMS = _schema("team_id:L name:S last_seen:L")
ROSTERS = _schema("team_id:L account_id:L player_name:S observed_at:L")
QUOTES = _schema(
    "source:S line_key:S event_id:S league:S home:S away:S start_time:S market_type:S period:I units:S selection:S points:D price_american:D "
    "price_decimal:D limit_amount:D is_live:I status:S cutoff_at:S captured_at:L"
)
ODDS_SNAPSHOTS = T.StructType([T.StructField("id", T.LongType()), *QUOTES.fields])
EVENT_SERIES_MAP = _schema("source:S event_id:S units:S is_kills:I parent_event_id:S home_team_id:L away_team_id:L series_id:L start_skew_s:L resolved_at:L")
PREDICTIONS = _schema("series_id:L period:I selection:S prob:D market_type:S price_taken:D stake:D placed_at:L")

#: Primary keys, by table.
KEYS = {
    "matches": ["match_id"], "draft_events": ["match_id", "ord"], "match_players": ["match_id", "player_slot"], "match_timeseries": ["match_id", "minute"],
    "teams": ["team_id"], "rosters": ["team_id", "account_id", "observed_at"], "odds_snapshots": ["id"], "event_series_map": ["source", "event_id"],
}
TABLES = {
    "matches": MATCHES, "draft_events": DRAFT_EVENTS, "match_players": MATCH_PLAYERS, "match_timeseries": MATCH_TIMESERIES, "teams": TEAMS,
    "rosters": ROSTERS, "odds_snapshots": ODDS_SNAPSHOTS, "odds_latest": ODDS_SNAPSHOTS, "event_series_map": EVENT_SERIES_MAP,
}
#: Columns whose change makes a new row of a line's history.
TRACKED = ["price_american", "points", "limit_amount", "status", "is_live", "cutoff_at"]
