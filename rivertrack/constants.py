"""Lookup tables, patches, exclusions and thresholds of the study.

They must keep these exact values for results to agree; none of them grows with the data.
"""

# --- fixed values: thresholds ------------------------------------------------------------
PULSE_SECONDS = 5.0  # a tag's pulse rate; closer detections are noise
LOST_GAP_SECONDS = 13.0  # gap signalled by a lost tag or dead fish
MAX_DISTANCE_RKM = 100.0  # a move is impossible beyond this distance ...
MAX_RATE_RKM_PER_DAY = 100.0  # ... if it is also faster than this
ERROR_CODE = 999
DEPLOY_START = "2023-07-04"  # receivers: first day kept
STUDY_START = "2024-07-04"  # combined fixed stations: first day kept
TERMINAL_ZONES = ("Nanika River", "Atna River")
DETECTION_STATIONS = ("1", "2", "4", "5", "6", "Mobile")
FIXED_STATIONS = ("1", "2", "4", "5", "6")

# --- fixed values: stations (station, zone, rkm, lat, long) ------------------------------
STATIONS = [
    ("1", "Bulkley River", -0.7, 55.01835, -127.3189),
    ("2", "Bulkley River", 42.0, 54.78871, -127.1463),
    ("4", "Nanika River", 214.0, 54.04742, -127.4264),
    ("5", "Atna River", 226.5, 54.014545, -127.74321),
    ("6", "Morice Lake", 201.0, 54.10783, -127.4250),
]

# --- fixed values: receiver channels (channel, frequency code) ---------------------------
CHANNELS = [(1, "149.500"), (2, "149.320"), (3, "149.340")]
OTHER_CHANNEL = "other"

# --- fixed values: test tags --------------------------------------------------------------
TEST_TAGS = ["149.500 212", "149.500 211"]

# --- fixed values: missing metadata, by tag number (code, frequency) ----------------------
FREQUENCY_OVERRIDES = [
    ("19", "500"),
    ("88", "500"),
    ("199", "320"),
    ("193", "320"),
    ("192", "320"),
    ("191", "320"),
    ("197", "320"),
    ("194", "320"),
]
# (code, frequency, date)
DATE_OVERRIDES = [("13", "500", "2024-07-12")]

# --- fixed values: recaptured fish (tagging time, tag) and tags with missing codes --------
RECAPTURES = [
    ("2023-07-10 09:15:00", "149.48 41"),
    ("2023-07-10 09:15:00", "149.48 42"),
    ("2023-07-10 09:15:00", "149.48 45"),
    ("2023-07-10 09:15:00", "149.48 46"),
    ("2023-07-10 10:56:00", "149.48 50"),
]
BAD_TAGS = ["149.42 NA", "149.48 3?", "149.48 49?", "149.48 NA"]
BAD_LAST_DETECTION_TAGS = BAD_TAGS + ["149.42 14"]
NOT_UPPER_BULKLEY_TAGS = ["149.42 08"]

# --- fixed values: NA spellings in the metadata files -------------------------------------
NA_TOKENS_2024 = ["", "unkn", "NA"]
NA_TOKENS_2023 = ["", "unknown", "NA"]

# --- fixed values: mobile survey days -----------------------------------------------------
SURVEY_DATES = [
    "2023-08-30",
    "2023-09-06",
    "2023-09-13",
    "2023-09-20",
    "2023-09-22",
    "2023-09-25",
    "2023-09-26",
    "2023-09-27",
    "2023-09-28",
    "2023-10-04",
]

# --- fixed values: metres that positions are jittered by on maps, and the survey that differs
SURVEY_JITTER = 500.0
SURVEY_JITTERS = {"2023-09-26": 2000.0}
LAST_DETECTION_JITTER = 3000.0

# --- fixed values: map extents in UTM zone 9 metres (name, x0, x1, y0, y1) ----------------
MAP_EXTENTS = [
    ("Study area", 580000.0, 660000.0, 5950000.0, 6120000.0),
    ("Study area zoom", 575000.0, 590000.0, 5965000.0, 5990000.0),
    ("Atna Lake", 576500.0, 583500.0, 5984000.0, 5991000.0),
    ("SW Morice Lake", 576500.0, 584000.0, 5966000.0, 5973500.0),
    ("Nanika River", 598500.0, 603500.0, 5976000.0, 5981000.0),
    ("Morice-Bulkley Confluence, September 22", 638000.0, 653000.0, 6023380.0, 6038380.0),
    ("Morice-Bulkley Confluence, September 26", 645000.0, 660000.0, 6023380.0, 6038380.0),
    ("SW Morice Lake, October 4", 575500.0, 589000.0, 5963000.0, 5976500.0),
    ("Bulkley River", 605700.0, 655000.0, 6020000.0, 6100900.0),
    ("Morice River", 603000.0, 655000.0, 5998000.0, 6031000.0),
    ("Morice Lake", 575000.0, 607000.0, 5962000.0, 5999000.0),
]

# --- fixed values: layer subsets for maps -------------------------------------------------
MIN_STREAM_ORDER = 3
MAP_ROAD_CLASSES = ["highway", "arterial"]

# --- fixed values: detection-history panels -----------------------------------------------
PANELS_PER_PAGE = 9
PANEL_RKM_RANGE = (-5.0, 250.0)
LAKE_ZONE, LAKE_RKM = "Morice Lake", 201.0
FALLBACK_RKM = -0.7
# (zone, label)
HISTORY_LOCATIONS = [
    ("Tagging", "Tagging"),
    ("Bulkley River", "Bulkley River"),
    ("Upper Bulkley River", "Upper Bulkley\nRiver"),
    ("Morice River", "Morice River"),
    ("Atna River", "Atna River"),
    ("Morice Lake", "Morice Lake"),
    ("Nanika River", "Nanika River"),
]

# --- fixed values: length histogram -------------------------------------------------------
HISTOGRAM_RANGE = (46.0, 66.0)
HISTOGRAM_BIN = 1.0

# --- fixed values: arrival targets (name, column, value, unit) ----------------------------
ARRIVALS = [
    ("fallback", "station", "1", "hours"),
    ("bulkley", "station", "2", "days"),
    ("upper_bulkley", "zone", "Upper Bulkley River", "days"),
    ("morice_lake", "zone", "Morice Lake", "days"),
    ("nanika", "zone", "Nanika River", "days"),
    ("atna", "zone", "Atna River", "days"),
]

# --- fixed values: stations in the efficiency table (station, rkm, zone or None) ----------
EFFICIENCY_STATIONS = [
    ("2", 42.0, None),
    ("6", 201.0, None),
    ("4", 214.0, "Nanika River"),
    ("5", 226.5, "Atna River"),
]
