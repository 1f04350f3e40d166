"""Fixed values.

These must equal the values the original pipeline uses for the results to
match; they are domain constants (codes, thresholds, labels, colours), kept
together here in their natural order.
"""

# --- fixed values -----------------------------------------------------------
VIRTUAL_ARS = "00000"                     # unified ARS of every virtual stop
EXEMPT_ARS = "06137"                      # real stop whose name contains a virtual keyword
TERMINAL_VIRTUAL_CODE = "277102436"       # standard code of the terminal virtual stop
VIRTUAL_NAME_KEYWORDS = ["가상", "기점가상", "경유"]
BIDIRECTIONAL_MAX_SEQ = 100               # route max boarding seq above this is suspicious
CASE_C1_SEQ_RANGE = (1, 10)               # boarding seq range copied onto the alighting end
CASE_C2_MIN_SEQ = 11                      # boarding seq from which a short trip is an anomaly
CASE_C2_MAX_PCT = 48                      # boarding seq below 48 % of the route max
SEQ_SPREAD_MAX = 2                        # alighting seqs within 2 collapse to the minimum
SERVICE_HOURS = 19                        # 04..23 h: load is the hourly mean over 19 hours
DEFAULT_DATE = "20231017"
FIRST_FILL_YEAR_PREFIX = "2025"           # first donor year for code fill from other dates

# congestion grade bands: upper bound (exclusive) -> label; last label has no bound
GRADE_BANDS = [(20, "쾌적"), (40, "여유"), (60, "보통"), (80, "혼잡")]
GRADE_TOP = "매우혼잡"

# colour ramp anchors (R, G, B) at 0, 25, 50, 75, 100 %
COLOR_ANCHORS = [(0, 255, 0), (128, 255, 0), (255, 255, 0), (255, 128, 0), (255, 0, 0)]

# map legend: grade, range label, legend colour
LEGEND = [
    ("쾌적", "0~20%", "#00CC00"),
    ("여유", "20~40%", "#80CC00"),
    ("보통", "40~60%", "#CCCC00"),
    ("혼잡", "60~80%", "#CC6600"),
    ("매우혼잡", "80~100%", "#CC0000"),
]

# transaction report: peak hours (inclusive) and distance bands (upper bound in m, exclusive)
MORNING_PEAK = (7, 9)
EVENING_PEAK = (18, 20)
DISTANCE_BANDS = [(3000, "3km 미만"), (5000, "3~5km"), (10000, "5~10km"), (20000, "10~20km")]
DISTANCE_TOP = "20km 이상"

# stop-location bounding box
LAT_RANGE = (37.0, 38.5)
LON_RANGE = (126.0, 128.0)

# density marker radius: max(4, int(pct / 8) + 4)
MARKER_MIN_RADIUS = 4
MARKER_PCT_STEP = 8
TEXT_WHITE_ABOVE_PCT = 50
# --- end of fixed values ----------------------------------------------------

OD_COLUMNS = [
    "service_date", "route_name", "route_id",
    "board_seq", "board_ars", "board_code", "board_name",
    "alight_seq", "alight_ars", "alight_code", "alight_name",
    "riders",
]
