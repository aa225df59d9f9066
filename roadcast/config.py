"""Thresholds, weights, lookup tables and fixed wording.

FIXED VALUES — these must equal the behaviour being reproduced, so they are
stated plainly, in natural order, in one place.
"""

# --- Baseline / match -------------------------------------------------------
MIN_EVENTS = 5                  # fine rows kept / coarse rows matched at >= 5 durations
RELIABLE_SAMPLE_THRESHOLD = 5   # duration_count >= 5 -> duration reliability "high"
HIGH_CONFIDENCE_MIN_COUNT = 10  # fine/coarse evidence >= 10 -> "High confidence"

# Hour bands [start, end) -> label; anything else -> "evening".
HOUR_BANDS = [(0, 6, "night"), (6, 12, "morning"), (12, 18, "afternoon"), (18, 24, "evening")]

# --- Cleaning -----------------------------------------------------------------
NULL_TOKENS = ["NULL", "null", ""]
UNPLANNED_MAX_MINUTES = 1440.0
PLANNED_MAX_MINUTES = 43200.0
LOCAL_TZ = "Asia/Kolkata"
GEO_LAT_RANGE = (12.7, 13.3)
GEO_LON_RANGE = (77.3, 77.9)

# --- Severity -----------------------------------------------------------------
SEVERITY_DURATION_CUTS = [(50.0, "Low"), (120.0, "Medium")]  # else "High"
CLOSURE_WEIGHT = 0.7
PRIORITY_WEIGHT = 0.3
CLOSURE_SCORE_CUTS = [(0.35, "Low"), (0.65, "Medium"), (1.01, "High")]  # else "Unknown"
PRIORITY_SCORE = {"High": 1.0, "Low": 0.2, "Unknown": 0.5}
PRIORITY_SCORE_OTHER = 0.5
TIER_ORDER = ["Low", "Medium", "High"]

# --- Deployment ---------------------------------------------------------------
PERSONNEL_TABLE = {
    ("Low", False): 2, ("Low", True): 4,
    ("Medium", False): 4, ("Medium", True): 6,
    ("High", False): 6, ("High", True): 10,
    ("Unknown", False): 4, ("Unknown", True): 6,
}
CLOSURE_PROB_SOFT_THRESHOLD = 0.40
CLOSURE_PROB_SOFT_EXTRA = 2
BARRICADE_PROBABILITY_THRESHOLD = 0.25
BARRICADE_SEVERITY_TIERS = ["Medium", "High"]
ADDRESS_HINT_CHARS = 80
VMS_MAX_CHARS = 100

# --- Command queue ------------------------------------------------------------
QUEUE_SEVERITY_WEIGHT = 0.50
QUEUE_CLOSURE_WEIGHT = 0.35
QUEUE_CONFIDENCE_WEIGHT = 0.15
QUEUE_SEVERITY_SCORE = {"Low": 1.0, "Medium": 2.0, "High": 3.0, "Unknown": 0.5}
QUEUE_CONFIDENCE_SCORE = {"high": 1.00, "moderate": 0.80, "low": 0.55,
                          "insufficient": 0.35, "unknown": 0.50}
QUEUE_DEFAULT_OFFICERS = 40
QUEUE_DEFAULT_BARRICADES = 6

# --- Feedback -----------------------------------------------------------------
VALID_VERIFICATION_STATUSES = ["verified", "unverified", "disputed"]
TRUE_TOKENS = ["true", "1", "yes", "y", "closed"]
FEEDBACK_EVENT_TYPE = "verified_feedback"

# --- Evidence / map -----------------------------------------------------------
EVIDENCE_TOP_K = 20
BRIEF_TOP_K = 8
MARKER_CAP = 300
TOP_CORRIDORS = 5
TOP_K_CORRIDORS_MODEL = 15
INCIDENT_ID_PREFIX = "BTP"

# --- Fixed wording ------------------------------------------------------------
CONFIDENCE_NO_DATA = "Insufficient data — defer to officer judgment"
CONFIDENCE_CAUSE_ONLY = ("Low confidence — cause-only match "
                         "(%d historical events; duration reliability: %s)")
CONFIDENCE_HIGH = "High confidence"
CONFIDENCE_MODERATE = "Moderate confidence"
NOTE_NO_HISTORY = "Event cause has no historical records. Officer judgment required."
NOTE_THIN_SAMPLE = ("Duration estimate is based on only %d historical record(s) and may be "
                    "unreliable due to administrative-lag closures. Severity is based primarily "
                    "on road-closure likelihood and event priority for this reason.")
NOTE_CLOSURE_DEFAULT = "Road closure confirmed by operator — defaulting to Medium."
NOTE_SCORE = "Closure/priority score: %s (closure_rate=%s, priority=%s)"
NOTE_BUMP = "Severity bumped %s -> %s because requires_road_closure=True was specified."

DIVERSION_DISCLAIMER = (
    "A precise diversion route requires a live road-network graph with "
    "current traffic volumes, which is not available in this system. "
    "The recommended approach is to consult BTP's Standard Diversion Plan "
    "for the identified corridor and coordinate with the nearest traffic "
    "police station for real-time alternatives."
)
ADVISORY_DIVERSION_LINE = (
    "Diversion Route: No specific alternate route can be derived from the "
    "available data. Commuters should follow on-ground BTP diversion signage "
    "and expect delays; officers should consult the BTP Standard Diversion "
    "Plan for this corridor."
)
GENERIC_LOCATION_HINT = "near event start location (coordinates available in ASTRAM record)"
DEFAULT_STATION = "local Traffic Police Station"
DRAFT_MARK = "*** DRAFT — officer review and sign-off required ***"
SEVERITY_CAPTIONS = {
    "duration": "Based on duration history",
    "closure_priority": "Based on closure rate & priority (limited duration data)",
}
SEVERITY_CAPTION_OTHER = "Insufficient historical data for duration or closure prediction"

# Fixed sentences of the officer's rationale, with named slots.
RATIONALE_OPENING = "This recommendation is for a reported {cause} event{place}. "
RATIONALE_PLACE = " on {corridor}"
RATIONALE_BY_DURATION = (
    "Based on {evidence} similar historical events ({timed} with recorded resolution times), "
    "the typical event of this type lasts approximately {length}. "
    "This duration estimate drove the {tier} severity classification. "
)
RATIONALE_LENGTH = "{minutes} minutes"
RATIONALE_NO_LENGTH = "an unknown duration"
RATIONALE_BY_CLOSURE = (
    "Severity was assessed from historical road closure rate ({rate}) and event priority, rather than from "
    "duration, because only {timed} historical record(s) with timing data exist for this event type — too few "
    "to produce a reliable duration estimate at this sample size.{figure} "
)
RATIONALE_FIGURE = (
    " A raw duration figure of {minutes} minutes is on record but is based on only {timed} historical records "
    "and is likely distorted by administrative-lag closures (events marked closed days after the road actually "
    "cleared). It has NOT been used to determine severity."
)
RATIONALE_NO_RATE = "unknown"
RATIONALE_CONFIDENCE = "Overall data confidence for this prediction: '{confidence}'. "
RATIONALE_CLOSURE_CONFIRMED = (
    "Road closure has been confirmed for this event, which increases both staffing and barricade requirements. "
)
RATIONALE_CLOSURE_LIKELY = (
    "Historical data shows a {rate} chance of road closure for similar events, so a precautionary staffing "
    "uplift has been applied. "
)
RATIONALE_OFFICERS = "A minimum of {officers} officers is recommended. "
RATIONALE_BARRICADE = "Physical barricading is recommended. "
RATIONALE_NO_BARRICADE = (
    "Barricading is not indicated at this severity level, but can be escalated if conditions change on site. "
)
SOFT_BUMP_NOTE = (
    "Personnel count increased by {extra} because historical road closure rate ({rate}) exceeds the "
    "{threshold}% soft threshold."
)

# Fixed lines of the advisory and the sign board, with named slots.
ADVISORY_TITLE = "Traffic Advisory: {event} at {place} — {date}"
ADVISORY_CLOSED = (
    "Vehicular movement on {place} between {window} is expected to be restricted. "
    "A full road closure/diversion is recommended based on historical pattern."
)
ADVISORY_OPEN = (
    "Vehicular movement on {place} between {window} is expected to be slow-moving but unrestricted. "
    "Slow down and expect minor delays."
)
ADVISORY_STAFF = "Recommend coordinating with {station} beat officers; estimated additional personnel: {officers}."
ADVISORY_STATION = "{name} Traffic Police Station"
ADVISORY_STARS = "*" * 52
ADVISORY_LAYOUT = "\n".join([
    "{title}", "{rule}", "", "{movement}", "", ADVISORY_DIVERSION_LINE, "", "VMS SIGNBOARD MESSAGE:", "[ {sign} ]", "",
    "{staff}", "", ADVISORY_STARS, DRAFT_MARK, ADVISORY_STARS,
])
SIGN_CLOSED = "DIVERSION: {road} CLOSED {span}. SEEK ALTERNATE ROUTE"
SIGN_OPEN = "ALERT: {event} ON {road} {span}. EXPECT DELAYS."

# Columns whose values stand for "no value" in the cleaned log, and the columns of the quality summary.
DQ_KEY_COLUMNS = ["event_type", "event_cause", "requires_road_closure", "start_datetime",
                  "effective_end_datetime", "priority", "corridor", "zone",
                  "police_station", "junction", "latitude", "longitude"]
