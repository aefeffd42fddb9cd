"""Observation schema and the fixed values that results must agree on.

Everything under "Fixed values" is data semantics (cut points, labels, messages,
weights) that an observation table is scored against; the operators build Spark
expressions from these tables, they never loop over rows.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Observation table
# ---------------------------------------------------------------------------

TIME = "timestamp"
SERIES = "series_id"
OBS_ID = "event_id"

FLOAT_COLUMNS = [
    "sunspot_number",
    "f107_solar_flux",
    "solar_wind_speed",
    "solar_wind_density",
    "imf_bz",
    "xray_flux",
    "proton_flux",
    "kp_index",
    "dst_index",
    "flare_intensity",
    "satellite_disruption_risk",
    "gps_blackout_prob",
    "solar_cycle_phase",
]
FLAG_COLUMNS = ["storm_flag", "cme_flag"]
LABEL_COLUMNS = ["flare_class", "severity"]

# The 15 numeric columns of an observation (13 measurements + 2 flags), the
# space of KNN imputation and of "numeric columns" in summaries.
NUMERIC_COLUMNS = FLOAT_COLUMNS + FLAG_COLUMNS

# Identifier / helper columns that are never features.
HELPER_COLUMNS = [OBS_ID, SERIES, "kp_raw"]

OBSERVATION_SCHEMA = T.StructType(
    [T.StructField(TIME, T.TimestampNTZType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in FLOAT_COLUMNS[:10]]
    + [T.StructField("flare_class", T.StringType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in FLOAT_COLUMNS[10:12]]
    + [T.StructField("storm_flag", T.IntegerType(), True),
       T.StructField("cme_flag", T.IntegerType(), True),
       T.StructField("severity", T.StringType(), True),
       T.StructField("solar_cycle_phase", T.DoubleType(), True)]
)

# Observation table as derived from ``events``: identifiers first, Kp helper last.
FULL_OBSERVATION_SCHEMA = T.StructType(
    [T.StructField(OBS_ID, T.LongType(), True), T.StructField(SERIES, T.LongType(), True)]
    + OBSERVATION_SCHEMA.fields + [T.StructField("kp_raw", T.DoubleType(), True)])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------

# Alert thresholds: metric -> (threshold, level, message), most severe first.
THRESHOLDS = {
    "kp_index": [
        (9.0, "EXTREME", "Extreme geomagnetic storm — G5 event!"),
        (7.0, "CRITICAL", "Severe geomagnetic storm — G4 event"),
        (5.0, "WARNING", "Moderate geomagnetic storm — G3 event"),
        (3.0, "INFO", "Minor geomagnetic activity — G1/G2"),
    ],
    "satellite_disruption_risk": [
        (90.0, "EXTREME", "Extreme satellite disruption risk"),
        (70.0, "CRITICAL", "High satellite disruption risk"),
        (50.0, "WARNING", "Elevated satellite disruption risk"),
        (25.0, "INFO", "Low satellite disruption risk"),
    ],
    "gps_blackout_prob": [
        (85.0, "EXTREME", "GPS blackout imminent"),
        (65.0, "CRITICAL", "Severe GPS interference expected"),
        (40.0, "WARNING", "GPS accuracy degradation possible"),
        (20.0, "INFO", "Minor GPS scintillation possible"),
    ],
    "solar_wind_speed": [
        (800.0, "EXTREME", "Extreme solar wind speed — CME arrival likely"),
        (600.0, "CRITICAL", "Very high solar wind speed"),
        (500.0, "WARNING", "Elevated solar wind speed"),
        (450.0, "INFO", "Slightly elevated solar wind"),
    ],
    "flare_intensity": [
        (4.5, "EXTREME", "X-class solar flare — major radio blackout"),
        (3.5, "CRITICAL", "M-class flare — possible radio blackout"),
        (2.5, "WARNING", "C-class flare — minor radio interference"),
        (1.5, "INFO", "B-class flare activity"),
    ],
}
# Metrics in the order the dashboard builds its metric map.
ALERT_METRICS = ["kp_index", "satellite_disruption_risk", "gps_blackout_prob",
                 "solar_wind_speed", "flare_intensity"]
LEVEL_RANK = {"INFO": 0, "WARNING": 1, "CRITICAL": 2, "EXTREME": 3}
LEVEL_TO_SEVERITY = {"INFO": "Low", "WARNING": "Moderate", "CRITICAL": "High",
                     "EXTREME": "Extreme"}

# Categorical codes.
FLARE_CLASS_CODES = {"A": 0, "B": 1, "C": 2, "M": 3, "X": 4}
SEVERITY_CODES = {"Low": 0, "Moderate": 1, "High": 2, "Extreme": 3}
FLARE_CLASSES = ["A", "B", "C", "M", "X"]
SEVERITY_LABELS = ["Low", "Moderate", "High", "Extreme"]

# Flare class cuts on intensity (<1 A, <2 B, <3 C, <4 M, else X) and
# severity cuts on Kp (<3 Low, <5 Moderate, <7 High, else Extreme).
FLARE_CUTS = [(1.0, "A"), (2.0, "B"), (3.0, "C"), (4.0, "M")]
FLARE_TOP = "X"
SEVERITY_CUTS = [(3.0, "Low"), (5.0, "Moderate"), (7.0, "High")]
SEVERITY_TOP = "Extreme"
STORM_KP = 5.0

# Composite risk weights for kp/9*100, satellite, gps, (wind-280)/620*100, flare/5*100.
COMPOSITE_WEIGHTS = [0.30, 0.25, 0.20, 0.15, 0.10]

# Mission risk: score = kp*8 + wind/30 + gps*0.9 + sat*1.1, capped at 100.
MISSION_LEVELS = [(80.0, "EXTREME", "red"), (60.0, "HIGH", "orange"),
                  (40.0, "MODERATE", "yellow")]
MISSION_BOTTOM = ("LOW", "green")
MISSION_SYSTEMS = ["ISS Operations", "GPS Navigation", "Satellite Communications",
                   "Polar Aviation", "Deep Space Missions"]

# Satellite failure probability levels.
FAILURE_LEVELS = [(30.0, "Low"), (55.0, "Moderate"), (75.0, "High")]
FAILURE_TOP = "Extreme"

# Aurora regions, in display order.
AURORA_REGIONS = ["Alaska", "Northern Canada", "Iceland", "Norway", "Sweden",
                  "Finland", "Greenland", "Scotland"]

# Insight sentences.
INSIGHT_EXTREME = ("Extreme geomagnetic activity detected. Satellite and GPS systems "
                   "may experience severe disruption.")
INSIGHT_STORM = ("Moderate to strong geomagnetic storm conditions are active. "
                 "Communication systems should be monitored.")
INSIGHT_CALM = "Current geomagnetic activity is relatively stable."
INSIGHT_WIND = ("Solar wind speed is elevated, increasing the probability of "
                "geomagnetic disturbances.")
INSIGHT_GPS = ("GPS interference probability is high, especially in polar and "
               "high-latitude regions.")
INSIGHT_SAT = ("Satellite disruption risk is elevated. Communication and navigation "
               "satellites may be affected.")
INSIGHT_SEVERITY_PREFIX = "Overall system severity is currently classified as "

# Forecast peak labels: (cut, label) most severe first; below all cuts -> "Low".
PEAK_KP_CUTS = [(7.0, "Extreme"), (5.0, "High"), (3.0, "Moderate"), (0.0, "Low")]
PEAK_SAT_CUTS = [(80.0, "Extreme"), (60.0, "High"), (40.0, "Moderate"), (0.0, "Low")]

# Tracked objects: live position row and the three fixed risk zones.
ISS_NAME = "International Space Station"
ISS_ALTITUDE_KM = 420
ISS_FALLBACK = (20.5, 78.9)
RISK_ZONES = [
    ("Polar Orbit Risk Zone", 75.0, 0.0, "Extreme", 800),
    ("GPS Interference Zone", 60.0, -100.0, "High", 20200),
    ("Auroral Disruption Zone", -65.0, 120.0, "Moderate", 1000),
]

# Default alert text for agency alerts without a message.
DEFAULT_ALERT_MESSAGE = "NOAA alert received"

# Feature preparation: columns with lag/rolling features, winsorised columns,
# columns given a log1p feature, and the columns never used as features.
LAG_COLUMNS = ["kp_index", "solar_wind_speed", "imf_bz", "sunspot_number"]
WINSOR_COLUMNS = ["solar_wind_speed", "proton_flux", "xray_flux"]
WINSOR_PROBS = (0.01, 0.99)
LOG_COLUMNS = ["xray_flux", "proton_flux"]
NON_FEATURES = ["timestamp", "flare_class", "severity", "satellite_disruption_risk",
                "gps_blackout_prob", "storm_flag", "severity_enc", "year"]
TARGETS = ["kp_index", "satellite_disruption_risk", "gps_blackout_prob"]

# Columns of the correlation matrix, in display order.
CORR_COLUMNS = ["sunspot_number", "f107_solar_flux", "solar_wind_speed", "imf_bz",
                "kp_index", "dst_index", "satellite_disruption_risk", "gps_blackout_prob",
                "flare_intensity", "proton_flux", "solar_cycle_phase"]
