"""Survey, histogram and period-search constants that results depend on."""

DM_EDGES = (
    -8.0, -4.5, -3.0, -2.5, -2.0, -1.5, -1.25, -0.75, -0.5, -0.3, -0.2, -0.1, -0.05, 0.0,
    0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.25, 1.5, 2.0, 2.5, 3.0, 4.5, 8.0,
)
DT_EDGES = (
    0.0, 0.02759, 0.04, 0.08, 0.12, 0.3, 0.75, 1.0, 1.5, 2.5, 3.5, 4.5, 5.5, 7.0,
    10.0, 20.0, 30.0, 45.0, 60.0, 90.0, 120.0, 180.0, 240.0, 360.0, 500.0, 650.0, 2000.0,
)
FILTER_BANDS = {1: "g", 2: "r", 3: "i"}
KNOWN_ALGORITHMS = ("CE", "AOV", "LS", "MHF", "FPW", "BLS")
HARMONICS = (1.0, 0.5, 2.0, 1 / 3, 3.0)
ALIAS_HARMONICS = (1.0, 0.5, 2.0)
SIDEREAL_FREQUENCY = 24.0 / 23.9345
MATCH_TOLERANCE, LEAST_PERIOD = 0.05, 0.007
ALIAS_TOLERANCE, MAX_ALIAS_ORDER = 0.03, 15
MATCH_RADIUS_ARCSEC = 2.0
N_BUCKET_EDGES = (50, 100, 200, 500, 1000, 2000)
