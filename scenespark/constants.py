"""Results only agree with other tools when these are equal."""

# Class dictionary (id, name, threat level).
CLASSES = [
    (0, "person", "medium"),
    (1, "vehicle", "low"),
    (2, "crowd", "high"),
    (3, "military_vehicle", "critical"),
    (4, "aircraft", "high"),
    (5, "ship", "medium"),
    (6, "suspicious_object", "critical"),
]
CLASS_NAMES = {i: name for i, name, _ in CLASSES}
CLASS_THREAT = {i: threat for i, _, threat in CLASSES}
NUM_CLASSES = 7
FRAME_SIZE = 640

# Threat class sets.
HIGH_THREAT_CLASSES = ["aircraft", "crowd"]
CRITICAL_THREAT_CLASSES = ["military_vehicle", "suspicious_object"]
THREAT_CLASSES = HIGH_THREAT_CLASSES + CRITICAL_THREAT_CLASSES
ZONE_THREAT_CLASSES = ["crowd", "military_vehicle", "person", "suspicious_object"]
APPROACH_CRITICAL_CLASSES = ["military_vehicle", "person", "suspicious_object"]

# Zone levels, their alert priority, rank and base risk.
ZONE_LEVELS = {
    # level: (priority, severity rank, risk per violation)
    "RESTRICTED": ("CRITICAL", 3, 0.30),
    "BUFFER": ("HIGH", 2, 0.15),
    "OBSERVATION": ("MEDIUM", 1, 0.05),
    "SAFE": ("LOW", 0, 0.0),
}
ZONE_HIGH_THREAT_RISK = 0.15
ZONE_CROWDING_RISK = 0.10
NIGHT_FACTOR = 1.3
NIGHT_START_HOUR = 21
NIGHT_END_HOUR = 5

# Default zones, first match wins.
DEFAULT_ZONES = [
    {
        "name": "border_zone",
        "polygon": [(0.0, 0.0), (1.0, 0.0), (1.0, 0.25), (0.0, 0.25)],
        "level": "RESTRICTED",
        "label": "Border Zone (Restricted)",
        "color": "#e63946",
    },
    {
        "name": "buffer_zone",
        "polygon": [(0.0, 0.25), (1.0, 0.25), (1.0, 0.45), (0.0, 0.45)],
        "level": "BUFFER",
        "label": "Buffer Zone (Proximity)",
        "color": "#f4a261",
    },
    {
        "name": "observation_zone",
        "polygon": [(0.0, 0.45), (1.0, 0.45), (1.0, 1.0), (0.0, 1.0)],
        "level": "OBSERVATION",
        "label": "Observation Zone (General)",
        "color": "#2ec4b6",
    },
]

# Temporal thresholds.
WINDOW_SIZE = 30
SUDDEN_INCREASE = 5
SUDDEN_QUIET_BELOW = 2
BUILDUP_RATE = 0.3
LOITER_OBSERVATIONS = 10
LOITER_RANGE = 0.08
APPROACH_DISPLACEMENT = 0.05
COORDINATED_MIN = 3
COORDINATED_COSINE = 0.5
MOVING_MIN = 0.01
IOU_MATCH = 0.3
TRACK_MAX_GAP = 5
TRACK_POSITIONS = 50
TEMPORAL_ALERT_TYPES = [
    "sudden_appearance",
    "crowd_buildup",
    "loitering",
    "approach_trajectory",
    "coordinated_movement",
]

# Anomaly model and scoring.
BASELINE_FRAMES = 30
CONTAMINATION = 0.08
FOREST_TREES = 200
FOREST_SAMPLE = 256
SCORE_HIGH = -0.08
SCORE_CRITICAL = -0.18
SCORE_MEDIUM_LABEL = 0.05
FEATURES = [
    "detection_count",
    "class_diversity",
    "avg_confidence",
    "max_confidence",
    "critical_count",
    "avg_center_x",
    "avg_center_y",
    "avg_width_norm",
    "motion",
    "suspicious_flag",
]

# Alert handling.
MOTION_MEDIUM = 8.0
COOLDOWN_SECONDS = 45
MAX_LOG_SIZE = 500
PRIORITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
COOLDOWN_CLASSES = ["aircraft", "crowd", "military_vehicle", "suspicious_object"]

# Report bands and display settings.
CHART_CRITICAL = -0.15
CHART_HIGH = -0.05
DISPLAY_ZONE = "Asia/Kolkata"
EMAIL_PATTERN = r"^[\w.+-]+@[\w-]+\.[\w.]+$"

# Label corpus.
IMG_SIZE = 640
TILE_STRIDE = 480
TILE_TRIGGER = 960
TILE_MAX_SIDE = 6000
MIN_BOX_PX = 3
MAX_IMAGE_MB = 150
RARE_CLASSES = [3, 4, 5, 6]
KEEP_RATIO = {"vehicle_only": 0.12, "crowd_vehicle": 0.25}
RARE_AUGMENT_BELOW = 500
MAX_VEHICLE_BOXES = 10
VEHICLE_ONLY_REMOVE = 0.50
SPLITS = ["train", "val", "test"]
SEED = 42

# Raw class codes per source. The two preparation versions
# differ for bicycle, harbor, container-crane, airport and helipad, and only
# v1 lower-cases the name. Codes that map to no class are left out.
XVIEW_CODES = {
    0: [77],
    1: [18, 19, 20, 21, 23, 24, 50, 53, 56, 57, 59, 60, 61, 64, 65, 66, 72, 73, 74, 76],
    2: [79],
    3: [17, 26, 28, 62, 63, 71],
    4: [11, 12, 15, 47, 49],
    5: [32, 33, 34, 35, 36, 37, 40, 41, 42, 44],
    6: [83, 84, 86, 89, 91],
}
VISDRONE_CODES = {
    "v1": {0: [1, 2], 1: [3, 4, 5, 6, 7, 8, 9, 10]},
    "v2": {0: [1, 2], 1: [4, 5, 6, 7, 8, 9, 10]},
}
DOTA_CODES = {
    "v1": {
        1: ["large-vehicle", "small-vehicle"],
        3: ["container-crane"],
        4: ["plane", "helicopter", "airport", "helipad"],
        5: ["ship"],
        6: ["storage-tank", "harbor"],
    },
    "v2": {
        1: ["small-vehicle", "large-vehicle"],
        4: ["plane", "helicopter"],
        5: ["ship", "harbor"],
        6: ["storage-tank"],
    },
}
