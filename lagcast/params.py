"""Fixed values that define the results (not tuning knobs)."""

# Delay range kept in histories and in the backtest, minutes.
DELAY_MIN, DELAY_MAX = -30, 360
# Delay range fed to the bucket model, minutes.
BUCKET_MIN, BUCKET_MAX = -15, 240
# A service day starts at this hour.
SERVICE_DAY_SHIFT_HOURS = 4

# Recency weighting.
HALF_LIFE_DAYS = 30.0
WEEKDAY_BOOST = 2.0
# Conditioning on a live delay.
KERNEL_FLOOR = 0.15
KERNEL_FACTOR = 0.3
KERNEL_MIN_BANDWIDTH = 3.0
KERNEL_UNKNOWN = 0.05
# Same-connection window around a planned time of day, minutes.
TOD_WINDOW = 20
MIN_EFFECTIVE_N = 8.0

# Typical timetable.
BOARD_LOOKBACK_DAYS = 42
BOARD_MIN_RUNS = 3
BOARD_MAX_AGE_DAYS = 60
BOARD_MAX_STOPS = 40
ROUTE_WINDOW_MIN = 600

# Transfers.
FEEDER_SAMPLES = 80
MAX_CANDIDATES = 6
MIN_JOINT_RUNS = 5
LOOKBACK_BEFORE_FEEDER_MIN = 30
TRANSFER_BOARD_HOURS = 4
DEFAULT_TRANSFER_MIN = 5

# Journeys.
JOURNEY_BOARD_HOURS = 3
MAX_DIRECT = 3
MAX_FEEDERS = 15
MAX_TRANSFER_RESULTS = 3
MAX_ATTEMPTS = 6
TRANSFERS_PER_FEEDER = 2
MAX_ITINERARIES = 5
MIN_TRANSFER_WEIGHT = 40
PREFIX_BONUS = 1_000_000

# Bucket model with live anchor.
LIVE_SHRINKAGE = 0.4
MIN_LIVE_SCALE = 1.2
# train class -> (mu0, kappa0, alpha0, beta0)
PRIORS = {
    "LONG_DISTANCE": (4.0, 4.0, 3.0, 128.0),
    "REGIONAL": (1.5, 4.0, 3.0, 32.0),
    "SBAHN": (1.0, 4.0, 3.0, 18.0),
    "OTHER": (2.0, 4.0, 3.0, 50.0),
}

# Categories counted as long distance by the forecast model; the backtest leaves
# out the last one.
LONG_DISTANCE = ("ICE", "IC", "EC", "ECE", "RJ", "RJX", "NJ", "EN", "FLX", "TGV", "D", "IR", "WB")
LONG_DISTANCE_BACKTEST = LONG_DISTANCE[:-1]
REGIONAL = ("RE", "RB", "IRE", "MEX", "TER", "BRB", "AG")

# Backtest gates.
MIN_RUNS_PER_CONNECTION = 15
MIN_HISTORY = 10

# Timetable check tolerance, minutes.
CHECK_TOLERANCE = 3

# Copies of one run in a block; further copies stand in blocks that are numbered so far on.
SLICE_RUNS = 8192
SLICE_STEP = 100_000
# Previous-stop computation: numbers of the tie-breaker in a chunk.
CHUNK_SPAN = 65536
