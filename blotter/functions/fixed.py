"""Fixed values that results depend on.

These must stay exactly as listed: category names, their order and the
numbers attached to them define the output of the lookups and encodings.
"""

# --- fixed values: day names in week order (Monday = 0) -------------------
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: season names in encoding order (Winter = 0) ------------
SEASON_ORDER = ["Winter", "Spring", "Summer", "Fall"]

# --- fixed values: month -> season -----------------------------------------
SEASON_OF_MONTH = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Fall", 10: "Fall", 11: "Fall",
}

# --- fixed values: short month names, January first ------------------------
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- fixed values: incident type -> severity score, unlisted types get 2 ----
SEVERITY_OF_TYPE = {
    "HOMICIDE": 10,
    "CRIM SEXUAL ASSAULT": 9,
    "KIDNAPPING": 9,
    "ARSON": 8,
    "ROBBERY": 8,
    "ASSAULT": 7,
    "BATTERY": 7,
    "WEAPONS VIOLATION": 7,
    "BURGLARY": 6,
    "MOTOR VEHICLE THEFT": 6,
    "STALKING": 6,
    "INTIMIDATION": 5,
    "THEFT": 5,
    "CRIMINAL DAMAGE": 4,
    "SEX OFFENSE": 4,
    "DECEPTIVE PRACTICE": 4,
    "NARCOTICS": 4,
    "OFFENSE INVOLVING CHILDREN": 4,
    "CRIMINAL TRESPASS": 3,
    "PUBLIC PEACE VIOLATION": 3,
    "INTERFERENCE WITH PUBLIC OFFICER": 3,
    "LIQUOR LAW VIOLATION": 2,
    "GAMBLING": 2,
    "OBSCENITY": 2,
    "OTHER OFFENSE": 2,
}
DEFAULT_SEVERITY = 2.0

# --- fixed values: raw timestamp text format (month/day/year 12-hour clock) -
RAW_TIMESTAMP_FORMAT = "M/d/yyyy h:mm:ss a"

# --- fixed values: text read as missing by the CSV scan ---------------------
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                  "n/a", "nan", "null"]

# --- fixed values: day-part labels by rounded mean hour --------------------
# (< 6 Late Night, < 12 Morning, < 17 Afternoon, else Evening)
PERIOD_BOUNDS = [(6, "Late Night"), (12, "Morning"), (17, "Afternoon")]
PERIOD_ELSE = "Evening"

# --- fixed values: sentinel metrics when fewer than two clusters exist -----
SENTINEL_SILHOUETTE = -1.0
SENTINEL_DAVIES_BOULDIN = 99.0
SENTINEL_CALINSKI_HARABASZ = 0.0

# --- fixed values: default parameters of the pipeline -----------------------
GEO_SAMPLE = 20_000
SILHOUETTE_SAMPLE = 3_000
REDUCE_SAMPLE = 8_000
RANDOM_STATE = 42
DBSCAN_EPS = 0.02
DBSCAN_MIN_SAMPLES = 20
KNN_NEIGHBOURS = 30
GRID_BINS = 20
TOP_CATEGORIES = 8
