"""Fixed dimension tables. All are small constants, so they may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: print-readiness thresholds (id, warn, fail, weight, direction) ---
QA_THRESHOLDS = [
    ("dpi", 300.0, 150.0, 8, "low"),
    ("semi_alpha", 4.0, 12.0, 10, "high"),
    ("halo", 1.5, 5.0, 9, "high"),
    ("soft_edges", 35.0, 60.0, 6, "high"),
    ("colours", 64.0, 200.0, 3, "high"),
    ("black", 40.0, 70.0, 5, "high"),
    ("min_stroke", 0.8, 0.4, 10, "low"),
    ("min_feature", 3.0, 2.0, 7, "low"),
    ("gradients", 25.0, 50.0, 4, "high"),
    ("margins", 2.0, 0.5, 4, "low"),
    ("print_size", 22.0, 24.0, 6, "high"),
]
INFO_WEIGHTS = {"transparency": 2, "aspect": 1}
QA_LABELS = {
    "dpi": "Resolution (DPI)",
    "transparency": "Transparency",
    "semi_alpha": "Semi-transparent pixels",
    "halo": "Halo / edge fringe",
    "soft_edges": "Edge sharpness",
    "colours": "Distinct colours",
    "black": "Pure black",
    "min_stroke": "Minimum stroke width",
    "min_feature": "Smallest feature height",
    "gradients": "Gradient coverage",
    "margins": "Edge margin",
    "aspect": "Aspect ratio",
    "print_size": "DTF transfer size",
}
DEFAULT_DPI = 300
SEMI_ALPHA = (10, 245)
BLACK_MIN_LUM = 80
BLACK_MIN_SHARE_PCT = 2.0
EDGE_ALPHA = (10, 245)
EDGE_SOFT_PX = 3.0
ANALYSIS_LONG_SIDE = 1024
STROKE_LONG_SIDE = 2048
STROKE_MIN_COMP_MM = 0.5
FEATURE_SPECK_MM = 1.0
BAND_READY, BAND_FIXABLE = 90, 70

# --- Fixed values: nearest standard placements (ratio, label) ---
PLACEMENTS = [
    (1.0, "square (pocket / centre)"),
    (0.77, "A4 portrait (full front)"),
    (1.29, "A4 landscape"),
    (0.5, "tall left-chest / sleeve"),
    (2.0, "wide banner / back strip"),
]

# --- Fixed values: geometry profile ---
GEOMETRY_DEFAULTS = {
    "reconstruction_mode": "EXACT_RECONSTRUCTION",
    "print_location": "Full Back",
    "target_print_width_in": 12.5,
    "target_dpi": 300,
    "aspect_ratio_policy": "LOCKED",
    "background_requirement": "Transparent",
    "distress_policy": "Preserve",
}
PRINT_METHOD = "DTF"
MAX_RATIO_VARIANCE_PCT = 0.5
MAX_TRANSPARENT_MARGIN_IN = 0.10
BORDER_FRAC = 0.03
BG_SOLID_STDDEV_MAX = 10.0
BG_WHITE_MIN = 245
COMPONENT_MIN_AREA = 50
MICRO_COMPONENT_AREA = 10
ISOLATED_COMPONENT_AREA = 50
STRAY_ALPHA_MAX = 50
SOLID_ALPHA_MIN = 200
INTENT_DILATE_PX = 3
EDGE_BAND_PX = 2
HALO_LIGHT_MIN = 200
HALO_DARK_MAX = 55
STRAY_FAIL_COUNT = 500
GEOMETRY_THRESHOLDS = {
    "edge_contamination_pct": (2.0, 5.0),
    "minimum_line_width_px": (3.0, 1.5),
    "geometry_similarity_pct": (90.0, 75.0),
    "dpi_fraction": (0.90, 0.75),
}
GEOMETRY_WEIGHTS = {
    "bbox_similarity_pct": 0.40,
    "object_position_similarity_pct": 0.25,
    "object_scale_similarity_pct": 0.25,
    "source_ratio_match_pct": 0.10,
}

# --- Fixed values: pair comparison ---
OVERALL_WEIGHTS = {"detail": 0.40, "shape": 0.20, "edges": 0.20, "colour": 0.20}
NEUTRAL_GREY = 128
COMPARE_LONG_SIDE = 512
COMPARE_MAX_PX = 1024
EDGE_TOLERANCE_PX = 3
COMPARE_PAD = 6
COLOUR_TOLERANCE = 32
MAX_RGB_DISTANCE = 441.67

# --- Fixed values: garment colour names (name, hex), first match wins on a tie ---
GARMENT_COLOURS = [
    ("white", "#FFFFFF"), ("black", "#111111"), ("navy", "#1F2A44"),
    ("navy blue", "#1F2A44"), ("royal", "#1E3FA0"), ("royal blue", "#1E3FA0"),
    ("blue", "#2A4B9B"), ("light blue", "#8FB3D9"), ("sky blue", "#8FC7E8"),
    ("red", "#B02A2A"), ("cardinal red", "#8E2436"), ("maroon", "#5A2333"),
    ("burgundy", "#5A2333"), ("orange", "#D2622A"), ("gold", "#C79A3B"),
    ("yellow", "#E6C233"), ("green", "#2F7A44"), ("kelly green", "#2F8F4E"),
    ("forest green", "#22432C"), ("olive", "#5A5A32"), ("military green", "#4A503A"),
    ("purple", "#5A3B8C"), ("pink", "#E39BB5"), ("light pink", "#F2C6D6"),
    ("hot pink", "#E24E8A"), ("grey", "#8C8C8C"), ("gray", "#8C8C8C"),
    ("sport grey", "#B6B6B6"), ("sport gray", "#B6B6B6"), ("heather grey", "#B9BCC0"),
    ("heather gray", "#B9BCC0"), ("athletic heather", "#B9BCC0"), ("dark grey", "#4A4A4A"),
    ("dark gray", "#4A4A4A"), ("charcoal", "#36393B"), ("graphite", "#3A3D42"),
    ("sand", "#D8C6A8"), ("natural", "#E7DEC8"), ("cream", "#F1E9D2"),
    ("tan", "#C8AD82"), ("khaki", "#B7A579"), ("brown", "#5C4433"),
    ("chocolate", "#4A362A"), ("teal", "#2C6E6E"), ("turquoise", "#3FB0A5"),
    ("mint", "#A8D5BA"),
]
GARMENT_NOISE = r"\b(t-?shirt|tee|garment|fabric|marl|melange|solid)\b"

# --- Fixed values: stall limits in seconds, first needle found in the step wins ---
STEP_LIMITS = [
    ("reading text", 90), ("read wording", 90), ("detect", 120), ("aspect", 150),
    ("upload", 120), ("variation", 420), ("colour", 420), ("style", 420),
    ("final", 420), ("collage", 420), ("regenerat", 420), ("extract", 420),
    ("step", 420),
]
DEFAULT_STEP_LIMIT = 300

# --- Fixed values: worker presence and job life cycle ---
ONLINE_WINDOW_S = 90
PROGRESS_TIMEOUT_S = 300
RUNNING_GRACE_S = 300
BUSY_STATUSES = [
    "running", "awaiting_selection", "awaiting_text_confirmation",
    "awaiting_crop_review", "awaiting_multi_selection", "awaiting_number_selection",
    "awaiting_object_selection", "awaiting_ratio_selection",
    "awaiting_object_instructions", "awaiting_colour_selection",
    "awaiting_adapt_selection", "awaiting_signin",
]
TERMINAL_STATUSES = ["done", "done_with_errors", "failed", "cancelled"]
RUN_STATUS = {
    "done": "success", "done_with_errors": "success",
    "failed": "failed", "cancelled": "cancelled",
}
RATE_LIMIT, RATE_WINDOW_S = 60, 60
LOCKOUT_FAILURES, LOCKOUT_SECONDS = 5, 300

# --- Fixed values: required request fields (workflow, field, message) in order ---
WORKFLOW_RULES = [
    ("mockup", "mockup_image", "Upload a mockup image first."),
    ("artwork", "artwork_files", "Upload at least one artwork file."),
    ("identify", "artwork_files", "Upload an artwork file."),
    ("printready", "artwork_files", "Upload an artwork file."),
    ("colorway", "artwork_files", "Upload an artwork file."),
    ("similarity", "artwork_files", "Upload both images to compare."),
    ("objectsim", "artwork_files", "Upload both images to compare object by object."),
    ("custom", "artwork_files", "Upload an artwork file."),
    ("custom", "custom_operations", "Select at least one operation."),
    ("", "files", "Select at least one image."),
    ("", "options", "Select at least one option."),
]
OPERATION_ORDER = [
    "reconstruct", "remove_background", "halo_removal", "black_out", "half_tone",
    "change_object_color", "aspect_ratio", "print_ready",
]

# --- Fixed values: templates each workflow, text mode or operation can use ---
WORKFLOW_TEMPLATES = {
    "text": ["TEXT_TURN_0", "TEXT_TURN_1", "TEXT_TURN_2", "TEXT_TURN_3",
             "TEXT_REPLACE_COLLAGE", "TEXT_REPLACE_FINAL",
             "TEXT_IMAGE_ELEMENT_COLLAGE", "TEXT_IMAGE_STYLE_COLLAGE"],
    "mockup": ["EXTRACT_CONTACT_SHEET", "EXTRACT_SINGLE"],
    "artwork": ["ARTWORK_REGENERATE"],
    "identify": ["IDENTIFY_OBJECTS", "IDENTIFY_COLOR_GROUPS", "IDENTIFY_REGENERATE"],
    "printready": ["PRINT_READY_PHOTOCRAFT", "PRINTREADY_REVIEW"],
    "colorway": ["COLORWAY_SUGGEST", "COLORWAY_MOCKUP", "COLORWAY_ADAPT"],
    "geometry": ["GEOMETRY_GENERATE"],
    "similarity": ["SIMILARITY_REVIEW"],
    "objectsim": ["OBJECT_SIMILARITY_DETECT"],
}
TEXT_MODE_TEMPLATES = {
    "typed": ["TEXT_TURN_1", "TEXT_TURN_2", "TEXT_TURN_3"],
    "from_image": ["TEXT_TURN_0", "TEXT_TURN_1", "TEXT_TURN_2", "TEXT_TURN_3"],
    "replace": ["TEXT_REPLACE_COLLAGE", "TEXT_REPLACE_FINAL"],
    "image_element": ["TEXT_IMAGE_ELEMENT_COLLAGE", "TEXT_TURN_2", "TEXT_TURN_3"],
    "image_style": ["TEXT_IMAGE_STYLE_COLLAGE", "TEXT_TURN_2", "TEXT_TURN_3"],
}
OPERATION_TEMPLATES = {
    "reconstruct": ["CUSTOM_RECONSTRUCT"],
    "remove_background": ["CUSTOM_REMOVE_BACKGROUND"],
    "halo_removal": ["CUSTOM_HALO_REMOVAL"],
    "change_object_color": ["CUSTOM_DETECT_OBJECTS", "CUSTOM_CHANGE_COLOR"],
    "aspect_ratio": ["CUSTOM_ASPECT_ADVICE", "CUSTOM_ASPECT_BASELINE",
                     "CUSTOM_ASPECT_REGENERATE"],
}
SHARED_TAIL = ["PHOTOCRAFT_LINE", "PHOTOCRAFT_FOLLOWUP"]
SHARED_TAIL_WORKFLOWS = ["text", "artwork", "custom", "identify", "geometry",
                         "mockup", "colorway", "printready"]
DYNAMIC_PREFIX = "AIS.CUSTOM_OPERATIONS."
DYNAMIC_OP_PREFIX = "pm_"

# --- Fixed values: upload limits and accepted formats ---
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp"]
IMAGE_MAX_BYTES = 25 * 1024 * 1024
IMAGE_MAX_SIDE = 12000

# --- Fixed values: address ranges that must not be fetched (cidr text) ---
BLOCKED_RANGES = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
    "240.0.0.0/4",
]


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    """A constant list as a relation."""
    return spark.createDataFrame(data, schema)


def values_sql(data: list[tuple]) -> str:
    """The same constant list as a SQL VALUES body."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in data)
