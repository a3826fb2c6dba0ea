"""Names, codes and cut points that results depend on."""

# fixed values: missing-label answer of the point lookup
NO_DATA_ANSWER = "we don't have data for your area yet, please check back in a few months."

# fixed values: location name -> code
LOCATION_CODES = {
    "Los Angeles (SoCAB)": "la",
    "Delhi": "dl",
    "Taipei": "tpe",
}

# fixed values: city spelling -> code
CITY_CODES = {
    "Delhi": "dl",
    "Los Angeles-Long Beach-Santa Ana": "la",
    "LOS ANGELES": "la",
    "臺北市": "tpe",
}

# fixed values: aerosol bands
AOD_BANDS = [
    "Optical_Depth_047",
    "Optical_Depth_055",
    "AOD_Uncertainty",
    "FineModeFraction",
    "Column_WV",
    "Injection_Height",
]

# fixed values: bands summarised per grid and day
SUMMARY_BANDS = ["Optical_Depth_047", "Optical_Depth_055", "AOD_Uncertainty", "Column_WV"]

# bands that clouds make unusable
DEPTH_BANDS = ["Optical_Depth_047", "Optical_Depth_055"]

# fixed values: quality-word fields as (name, first character counted from 0, length)
QA_FIELDS = [
    ("AOD_QA_Cloud_Mask", 0, 3),
    ("AOD_QA_LWS_Mask", 3, 2),
    ("AOD_QA_Adj_Mask", 5, 3),
    ("AOD_Level", 8, 1),
    ("Algo_init", 9, 1),
    ("BRF_over_snow", 10, 1),
    ("BRF_climatology", 11, 1),
    ("AOD_QA_SC_Mask", 12, 3),
]

# fixed values: quality words worth keeping
QA_KEEP_CLOUD = ["000", "001", "010"]
QA_KEEP_ADJACENCY = ["000", "011"]

# fixed values: sinusoidal sphere radius in metres
SPHERE_RADIUS_M = 6371007.181

# fixed values: corner patterns of the granule metadata text
UPPER_LEFT_PATTERN = r"UpperLeftPointMtrs=\(([+-]?\d+\.\d+),([+-]?\d+\.\d+)\)"
LOWER_RIGHT_PATTERN = r"LowerRightMtrs=\(([+-]?\d+\.\d+),([+-]?\d+\.\d+)\)"

# fixed values: multi-angle product variables
MISR_VARIABLES = [
    "Latitude", "Longitude", "Elevation", "Year", "Day_Of_Year", "Month", "Day", "Hour", "Minute",
    "Land_Water_Retrieval_Type", "Aerosol_Optical_Depth", "Aerosol_Optical_Depth_Uncertainty",
    "Angstrom_Exponent_550_860nm", "Absorption_Aerosol_Optical_Depth",
    "Nonspherical_Aerosol_Optical_Depth", "Small_Mode_Aerosol_Optical_Depth",
    "Medium_Mode_Aerosol_Optical_Depth", "Large_Mode_Aerosol_Optical_Depth",
]
MISR_FILL_VARIABLES = ["Latitude", "Longitude", "Year", "Day_Of_Year", "Month", "Day", "Hour", "Minute"]

# fixed values: forecast variables and slots
GFS_VARIABLES = [
    "t_surface", "pbl_surface", "hindex_surface", "gust_surface", "r_atmosphere",
    "pwat_atmosphere", "u_pbl", "v_pbl", "vrate_pbl",
]
SLOTS = ["00", "06", "12", "18"]

# fixed values: variables with an intra-day change feature
CHANGE_VARIABLES = ["pbl_surface", "t_surface", "v_pbl", "vrate_pbl"]

# fixed values: aerosol to particulate scaling
AOD_SLOPE = 46.759
AOD_INTERCEPT = 7.1333

# fixed values: label range
LABEL_MIN_EXCLUSIVE = 0.0
LABEL_MAX_INCLUSIVE = 600.0

# fixed values: AQI classes as (upper bound, name); above the last bound: Severe
AQI_BOUNDS = [
    (30.0, "Good"),
    (60.0, "Satisfactory"),
    (90.0, "Moderately Polluted"),
    (120.0, "Poor"),
    (250.0, "Very Poor"),
]
AQI_TOP = "Severe"

# fixed values: trailing window lengths in days
TRAILING_DAYS = [1, 2, 3, 7, 15, 30, 45, 90]
TRAILING_DAYS_WIDE = [1, 3, 5, 7, 15, 30, 60, 90]

# fixed values: rank cut points
SIX_FOLD_CUTS = [0.12, 0.17, 0.28, 0.33, 0.45, 0.50, 0.62, 0.67, 0.78, 0.83, 0.95]
OUTER_EDGE_CUTS = [(0.08, "test"), (0.16, "valid"), (0.90, "train"), (0.95, "valid")]

# fixed values: features of the deployed model, label and date last
DEPLOYED_FEATURES = [
    "trailing1d_min_Optical_Depth_047_scaled",
    "trailing1d_max_Optical_Depth_047_scaled",
    "trailing1d_median_Optical_Depth_047_scaled",
    "day_of_year",
    "month",
    "week_of_year",
    "Aerosol_Optical_Depth_scaled",
    "min_Optical_Depth_047_scaled",
    "max_Optical_Depth_047_scaled",
    "median_Optical_Depth_047_scaled",
    "min_Optical_Depth_055_scaled",
    "max_Optical_Depth_055_scaled",
    "median_Optical_Depth_055_scaled",
    "Angstrom_Exponent_550_860nm",
    "min_elevation",
    "max_elevation",
    "avg_elevation",
    "t_surface",
    "pbl_surface",
    "hindex_surface",
    "gust_surface",
    "r_atmosphere",
    "pwat_atmosphere",
    "vrate_pbl",
    "wind_speed",
    "value",
    "pm25_date_d",
]

# fixed values: statistics of one band that must not predict one another
SIBLING_STATISTICS = ["min", "max", "median"]

# fixed values: text used for a missing category
MISSING_TEXT = "VV_likely"

# fixed values: model choice
SIGNIFICANCE = 0.05
RUNTIME_FACTOR = 2.0
COMPARISON_RUNS = 6
