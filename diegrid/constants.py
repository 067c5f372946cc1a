"""They must equal the published data conventions for right results."""

# --- fixed values: die states of the WM-811K encoding
OFF, PASS, FAIL = 0, 1, 2

# --- fixed values: the nine failure patterns, in the order array columns are indexed by
CLASSES = ["Center", "Donut", "Edge-Loc", "Edge-Ring", "Loc", "Near-full", "Random", "Scratch", "None"]
BASELINE_CLASS = "None"
WHOLE_WAFER_CLASSES = ["Near-full", "Random"]

# --- fixed values: label spellings after trim, lower case and space -> hyphen
LABEL_ALIASES = {
    "center": "Center",
    "donut": "Donut",
    "edge-loc": "Edge-Loc",
    "edgeloc": "Edge-Loc",
    "edge-ring": "Edge-Ring",
    "edgering": "Edge-Ring",
    "loc": "Loc",
    "local": "Loc",
    "near-full": "Near-full",
    "near_full": "Near-full",
    "nearfull": "Near-full",
    "none": "None",
    "normal": "None",
    "random": "Random",
    "scratch": "Scratch",
}

# --- fixed value: export suffix of renamed image copies
EXPORT_SUFFIX = r"(?i)(_(png|jpe?g|bmp))*\.rf\.[0-9a-f]+\.\w+$"

# --- fixed values: request limits
MAX_DIM = 512
MAX_BATCH_WAFERS = 256
MAX_BATCH_DIES = 2_000_000

# --- fixed values: wafer geometry defaults in mm
WAFER_DIAMETER_MM = 300.0
EDGE_EXCLUSION_MM = 3.0

# --- fixed values: model input and fingerprint resolution
INPUT_SIZE = 64
FINGERPRINT_SIZE = 32

# --- fixed values: colours of the standard render (viridis at 0, 0.5 and 1)
STATE_COLOURS = [(68, 1, 84), (33, 145, 140), (253, 231, 37)]

# --- fixed values: feature columns, in order
FEATURES = (
    ["fail_frac"]
    + [f"radial_{i}" for i in range(8)]
    + ["center_contrast", "donut_contrast", "edge_contrast", "region_center"]
    + [f"region_mid_{i}" for i in range(4)]
    + [f"region_out_{i}" for i in range(8)]
    + ["edge_coverage", "edge_max_sector", "clustered_frac", "n_clusters", "salient_area", "salient_r",
       "salient_elong", "salient_solidity", "radon_peak", "moran_i"]
)

# --- fixed values: wording of the features in verification reasons
FEATURE_LABELS = {
    "fail_frac": "share of dies failed",
    "center_contrast": "centre fail density minus the rest",
    "donut_contrast": "mid-radius fail density minus centre/edge",
    "edge_contrast": "outer-ring fail density minus inner wafer",
    "edge_coverage": "fraction of the wafer edge (by angle) that is failing",
    "edge_max_sector": "worst edge sector fail density",
    "salient_area": "largest defect cluster (share of wafer)",
    "salient_r": "largest cluster's distance from centre (0 centre, 1 edge)",
    "salient_elong": "largest cluster elongation (length/width)",
    "salient_solidity": "largest cluster solidity (1 = convex blob)",
    "radon_peak": "straight-line strength (Radon projection peak)",
    "moran_i": "spatial clustering of fails (Moran's I)",
    "clustered_frac": "share of failed dies inside large clusters",
    "n_clusters": "number of large clusters",
}

# --- fixed values: root-cause knowledge base (cause, label, process parameters, equipment factors)
CAUSES = [
    ("etch_edge_nonuniformity", "Etch edge non-uniformity (focus/edge ring wear)", ["etch_time_s"], ["chamber"]),
    ("ebr_misalignment", "Resist edge-bead removal (EBR) misalignment", ["pr_thickness_nm"], []),
    ("deposition_temperature", "Deposition temperature profile non-uniformity", ["dep_temp_c"], []),
    ("cmp_pad_wear", "CMP pad / conditioner wear (consumable)", ["cmp_pad_cycles"], []),
    ("cmp_zone_pressure", "CMP carrier zone-pressure imbalance", ["cmp_pad_cycles"], []),
    ("resist_thickness", "Photoresist thickness variation (spin coat)", ["pr_thickness_nm"], []),
    ("implant_dose", "Ion-implant dose drift", ["implant_dose"], []),
    ("particles", "Particle contamination (chamber / handling)", [], ["chamber"]),
    ("handling", "Wafer handling / robot or clamp contact", [], ["chamber"]),
    ("litho_focus_spot", "Lithography focus spot (chuck contamination)", [], []),
    ("gross_excursion", "Gross process excursion / mis-processing", [], []),
]

# --- fixed values: prior probability of each cause given the defect class
PRIORS = [
    ("Center", "deposition_temperature", 0.35),
    ("Center", "cmp_zone_pressure", 0.25),
    ("Center", "resist_thickness", 0.25),
    ("Center", "etch_edge_nonuniformity", 0.15),
    ("Donut", "cmp_zone_pressure", 0.40),
    ("Donut", "deposition_temperature", 0.35),
    ("Donut", "resist_thickness", 0.25),
    ("Edge-Ring", "etch_edge_nonuniformity", 0.45),
    ("Edge-Ring", "ebr_misalignment", 0.25),
    ("Edge-Ring", "deposition_temperature", 0.20),
    ("Edge-Ring", "cmp_zone_pressure", 0.10),
    ("Edge-Loc", "handling", 0.40),
    ("Edge-Loc", "ebr_misalignment", 0.30),
    ("Edge-Loc", "particles", 0.30),
    ("Loc", "particles", 0.45),
    ("Loc", "litho_focus_spot", 0.35),
    ("Loc", "handling", 0.20),
    ("Random", "particles", 0.60),
    ("Random", "implant_dose", 0.20),
    ("Random", "resist_thickness", 0.20),
    ("Scratch", "cmp_pad_wear", 0.60),
    ("Scratch", "handling", 0.40),
    ("Near-full", "gross_excursion", 0.50),
    ("Near-full", "implant_dose", 0.30),
    ("Near-full", "resist_thickness", 0.20),
]

# --- fixed values: name parts that mark a process column as a consumable counter
COUNTER_MARKS = ["cycle", "count", "hours", "wafers_since"]
