"""Session operators: rollup, user join, filters, statistics, sampling, detail."""

from tidewater.operators.filters import SessionFilter
from tidewater.operators.sampling import sample_quota, sample_sessions, session_detail, session_random_extract, sessions_per_day, sessions_per_hour
from tidewater.operators.sessions import session_count, session_rollup, session_user_join
from tidewater.operators.stats import STEP_BUCKETS, VISIT_BUCKETS, session_aggr_stat, step_length_histogram, visit_length_histogram

__all__ = [
    "STEP_BUCKETS", "VISIT_BUCKETS", "SessionFilter", "sample_quota", "sample_sessions", "session_aggr_stat", "session_count", "session_detail",
    "session_random_extract", "session_rollup", "session_user_join", "sessions_per_day", "sessions_per_hour", "step_length_histogram", "visit_length_histogram",
]
