"""Names, codes and constants that results depend on."""

# --- fixed values: entity aliases and display names -------------------------
TEAM_ALIASES = {
    "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU", "JAC": "JAX",
    "LAR": "LA", "OAK": "LV", "SD": "LAC", "STL": "LA", "WSH": "WAS",
}
TEAM_NAMES = {
    "Arizona Cardinals": "ARI", "Atlanta Falcons": "ATL", "Baltimore Ravens": "BAL",
    "Buffalo Bills": "BUF", "Carolina Panthers": "CAR", "Chicago Bears": "CHI",
    "Cincinnati Bengals": "CIN", "Cleveland Browns": "CLE", "Dallas Cowboys": "DAL",
    "Denver Broncos": "DEN", "Detroit Lions": "DET", "Green Bay Packers": "GB",
    "Houston Texans": "HOU", "Indianapolis Colts": "IND", "Jacksonville Jaguars": "JAX",
    "Kansas City Chiefs": "KC", "Las Vegas Raiders": "LV", "Los Angeles Chargers": "LAC",
    "Los Angeles Rams": "LA", "Miami Dolphins": "MIA", "Minnesota Vikings": "MIN",
    "New England Patriots": "NE", "New Orleans Saints": "NO", "New York Giants": "NYG",
    "New York Jets": "NYJ", "Philadelphia Eagles": "PHI", "Pittsburgh Steelers": "PIT",
    "San Francisco 49ers": "SF", "Seattle Seahawks": "SEA", "Tampa Bay Buccaneers": "TB",
    "Tennessee Titans": "TEN", "Washington Commanders": "WAS",
}

# --- fixed values: market structure ------------------------------------------
ANCHOR_BOOK = "pinnacle"
RETAIL_BOOKS = ("draftkings", "fanduel", "betmgm", "williamhill_us")
MARKETS = ("spreads", "totals")
ORIENTATION = {"spreads": "HOME", "totals": "OVER"}
OPPOSITE = {"spreads": "AWAY", "totals": "UNDER"}
ANCHOR_LINE_SHARE = 0.60
RETAIL_LINE_SHARE = 0.40
DISLOCATION_POINTS = 0.5
KEY_NUMBERS = (3, 6, 7, 10, 14)
PRIMARY_KEY_NUMBERS = (3, 7)
FRESHNESS_MINUTES = 30
CLOSE_WINDOW_EARLIEST = 90.0
CLOSE_WINDOW_LATEST = 5.0
MATCH_TOLERANCE_HOURS = 8

# --- fixed values: grids, guards and tolerances -------------------------------
LAG_COUNT = 4
HALF_LIFE_GRID = (1.0, 2.0, 4.0)
PRIOR_STRENGTH_GRID = (0.25, 0.5, 0.75, 1.0)
RIDGE_GRID = (0.1, 1.0, 10.0, 100.0)
SHRINKAGE = 200.0
MIN_STRATUM_ROWS = 30
PROBABILITY_CLIP = 1e-8
CALIBRATOR_CLIP = 1e-6
CALIBRATOR_C = 1_000_000.0
BOOTSTRAP_SAMPLES = 1_000
BOOTSTRAP_SEED = 20_260_913
MIN_EDGE = 0.02

# --- fixed values: status ladders --------------------------------------------
SNAPSHOT_PURPOSES = ("DECISION", "CLOSE", "DIAGNOSTIC")
ELIGIBLE_CLOSE_STATUS = "ELIGIBLE_CLOSE_PROXY"
SEVERE_STATUSES = ("Out", "Doubtful")
QUESTIONABLE_STATUS = "Questionable"
POSITION_GROUPS = {
    "qb_out_doubtful": ("QB",),
    "ol_out_doubtful": ("C", "G", "T"),
    "defensive_front_out_doubtful": ("DE", "DT", "LB"),
    "secondary_out_doubtful": ("CB", "S"),
}
