"""Table contracts as DDL. Instants are ``timestamp_ntz`` holding UTC."""


def columns(ddl: str) -> list[str]:
    """Column names of one of the schemas below (none has a comma inside a struct type)."""
    flat = ddl.replace("map<string,string>", "map")
    return [part.split()[0] for part in flat.split(",")]


REGISTRY = ("source_id string, event_type string, name string, ord int")

SNAPSHOTS = (
    "snapshot_id long, run_id string, source_id string, requested_url string, final_url string,"
    " fetched_at timestamp_ntz, http_status int, fetch_mode string, error string, body string"
)

OBSERVATIONS = (
    "run_id string, source_id string, event_type string, title string, ok boolean,"
    " event_at timestamp_ntz, source_url string, confidence string, notes string, http_status int,"
    " fetch_mode string, failure_type string, explanation string, fetched_at timestamp_ntz,"
    " extras map<string,string>"
)

LIVE = (
    "run_id string, source_id string, event_type string, title string, status string,"
    " event_at timestamp_ntz, source_url string, confidence string, notes string, http_status int,"
    " fetch_mode string, failure_type string, explanation string, fetched_at timestamp_ntz,"
    " last_success_at timestamp_ntz, reason string, extras map<string,string>"
)

KEY = ["source_id", "event_type"]

# What a stale row takes over from the last good record of its source.
CARRIED = ["event_at", "source_url", "confidence", "notes", "http_status", "fetch_mode", "extras"]

# The vocabularies of the result records.
FAILURE_TYPES = ["blocked", "unavailable", "parse_failed"]
CONFIDENCES = ["high", "medium", "low", "none"]
STATUSES = ["fresh", "stale", "unavailable"]
FETCH_MODES = ["http", "browser"]
