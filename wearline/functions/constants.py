"""Fixed values that must equal the reference's for equal results.

Kept together, in natural order, as plain text.
"""

# --- fixed values: failure modes, in the reference's column order ---------------
FAILURE_CODES = ["TWF", "HDF", "PWF", "OSF", "RNF"]
FAILURE_LABELS = {
    "TWF": "Tool wear failure",
    "HDF": "Heat dissipation failure",
    "PWF": "Power failure",
    "OSF": "Overstrain failure",
    "RNF": "Random failure",
}

# --- fixed values: per-mode cost assumptions (unplanned, preventive) -------------
FAILURE_MODE_COSTS = {
    "TWF": {"unplanned_cost": 1500, "preventive_cost": 300},
    "HDF": {"unplanned_cost": 4000, "preventive_cost": 600},
    "PWF": {"unplanned_cost": 5000, "preventive_cost": 500},
    "OSF": {"unplanned_cost": 2500, "preventive_cost": 400},
    "RNF": {"unplanned_cost": 8000, "preventive_cost": 1000},
}
REVIEW_COST_PER_ASSET = 35
PREVENTIVE_MAINTENANCE_COST = 500
UNPLANNED_FAILURE_COST = 3500

# --- fixed values: queue budgets and decision threshold ---------------------------
REVIEW_FRACTIONS = [0.05, 0.10, 0.15]
PRIMARY_REVIEW_FRACTION = 0.10
DECISION_THRESHOLD = 0.5
TOP_QUEUE_ASSETS = 12
TOP_RISK_ROWS = 10
TOP_FEATURES_PER_ROW = 5
MIN_MODE_POSITIVES = 5

# --- fixed values: drift -----------------------------------------------------------
PSI_MODERATE_THRESHOLD = 0.1
PSI_SIGNIFICANT_THRESHOLD = 0.2
PSI_BUCKETS = 10
PSI_EPS = 1e-4
VERDICT_NONE = "no_significant_drift"
VERDICT_MODERATE = "moderate_drift"
VERDICT_SIGNIFICANT = "significant_drift"
SHIFT_MINUTES = 80.0
LIVE_BATCH_SIZE = 1000

# --- fixed values: run-to-failure ---------------------------------------------------
RUL_CAP = 125
ROLLING_WINDOW = 5
SENSOR_STD_THRESHOLD = 1e-5
PHM08_EARLY_DIVISOR = 13.0
PHM08_LATE_DIVISOR = 10.0

# --- fixed values: live telemetry ----------------------------------------------------
MAX_RUL_HOURS = 48
IDEAL_CYCLE_TIME_SECONDS = 12.0
RECENT_READINGS = 8
RECENT_EVENTS = 10
CHART_POINTS = 21
RISK_BANDS = [(30.0, "LOW"), (60.0, "MEDIUM")]  # below 30 % LOW, below 60 % MEDIUM, else HIGH
RISK_BAND_TOP = "HIGH"
SPINDLE_BANDS = (75.0, 90.0)     # strict >: warning above 75, danger above 90
PRESSURE_BANDS = (120.0, 140.0)  # strict >: warning above 120, danger above 140
SHIFT_START_HOUR = 8
SHIFT_END_HOUR = 20
SHIFT_DAY, SHIFT_NIGHT = "SHIFT-A", "SHIFT-B"
OPERATOR_DAY, OPERATOR_NIGHT = "John Doe", "Jane Smith"
KELVIN_OFFSET = 273.15
ENERGY_TARIFF = 0.12

# --- fixed values: validation ---------------------------------------------------------
RANDOM_SEED = 42
ROBUSTNESS_SEEDS = [42, 7, 13, 99, 2024]
TEST_SIZE = 0.20
CV_FOLDS = 5
PERMUTATION_REPEATS = 8
BACKGROUND_SIZE = 200
WEAR_CLIP_FLOOR = 1e-6

# --- fixed values: boosting search grid ------------------------------------------------
SEARCH_GRID = {
    "max_depth": [3, 4, 5, 6, None],
    "learning_rate": [0.03, 0.05, 0.1, 0.15, 0.2],
    "l2_regularization": [0.0, 0.1, 0.5, 1.0],
    "max_leaf_nodes": [15, 31, 63],
}

__all__ = [n for n in dir() if n.isupper()]
