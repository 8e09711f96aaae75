"""Fixed values of the audit contract: names, tokens and thresholds.

Nothing here is tunable behaviour of ours; every value is part of the input
format or of a verdict rule and must stay as it is for results to agree.
"""

# --- fixed values: column names that announce a role, most telling first -----
ROLE_ALIASES = {
    "id": "id sample_id example_id uid index idx row_id image_id filename file".split(),
    "split": "split partition fold subset set dataset_split".split(),
    "label": "label target y class ground_truth gt y_true actual true_label".split(),
    "prediction": (
        "prediction pred y_pred predicted predicted_label model_prediction output".split()
    ),
    "group": (
        "group doc_id document_id video_id subject_id patient_id user_id source_id "
        "session_id identity".split()
    ),
}

# --- fixed values: spellings of the three split names ------------------------
SPLIT_SPELLINGS = {
    "train": "train training tr fit 0".split(),
    "val": "val valid validation dev 1".split(),
    "test": "test testing te eval evaluation holdout hold-out 2".split(),
}
UNLABELLED = "unlabelled"

# --- fixed values: cell texts a CSV scan reads as missing --------------------
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
MISSING_TEXT = "nan"

# --- fixed values: statuses and their severity -------------------------------
SKIP, PASS, WARN, FAIL = "skip", "pass", "warn", "fail"
SEVERITY = {SKIP: 0, PASS: 1, WARN: 2, FAIL: 3}

# --- fixed values: feature encoding ------------------------------------------
MAX_CATEGORY_LEVELS = 50
NUMERIC_PARSE_SHARE = 0.9
NGRAM_SIZES = (3, 4, 5)
MAX_VOCABULARY = 20_000
FINGERPRINT_DECIMALS = 6

# --- fixed values: leakage ---------------------------------------------------
DEFAULT_SIMILARITY = 0.95
LOWEST_SIMILARITY, HIGHEST_SIMILARITY = 0.5, 1.0
LEAK_FAIL_SHARE = 0.05
MIN_SIMILARITY_WIDTH = 16
PAIRS_SHOWN = 25
BACKGROUND_PAIRS = 40_000
BACKGROUND_QUANTILE = 0.995
BACKGROUND_MIN_ROWS = 32
REPORTABLE_DROP_POINTS = 0.5

# --- fixed values: baseline --------------------------------------------------
GAIN_FAIL_POINTS, GAIN_WARN_POINTS = 2.0, 10.0
IMBALANCE_SHARE = 0.80
COLLAPSE_SHARE = 0.95
WILSON_Z = 1.96

# --- fixed values: variance --------------------------------------------------
SCORE_PATTERN = r"-?\d+\.?\d*"
SPREAD_WARN_POINTS, SPREAD_FAIL_POINTS = 2.0, 5.0
NOISE_RATIO_FAIL = 3.0
MIN_RUNS = 3

# --- fixed values: split integrity -------------------------------------------
SMALL_HOLDOUT_FAIL, SMALL_HOLDOUT_WARN = 50, 200
DRIFT_WARN, DRIFT_FAIL = 0.10, 0.25
ROWS_SHOWN = 20
NAMES_SHOWN = 5
WORST_CASE_HALF_WIDTH = 0.98

# --- fixed values: metric regression -----------------------------------------
REGRESSION_TOLERANCE = 0.02
PROJECTION_WIDTH = 64
PROJECTION_DECIMALS = 4

#: Characters taken off the ends of splits and of compared texts.
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008" \
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
