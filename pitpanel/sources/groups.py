"""The fixed dimension of the 32 groups, and code canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitpanel.functions.schedule import lookup

# Canonical code -> full name, conference, division.
GROUPS = {
    "ARI": ("Arizona Cardinals", "NFC", "West"),
    "ATL": ("Atlanta Falcons", "NFC", "South"),
    "BAL": ("Baltimore Ravens", "AFC", "North"),
    "BUF": ("Buffalo Bills", "AFC", "East"),
    "CAR": ("Carolina Panthers", "NFC", "South"),
    "CHI": ("Chicago Bears", "NFC", "North"),
    "CIN": ("Cincinnati Bengals", "AFC", "North"),
    "CLE": ("Cleveland Browns", "AFC", "North"),
    "DAL": ("Dallas Cowboys", "NFC", "East"),
    "DEN": ("Denver Broncos", "AFC", "West"),
    "DET": ("Detroit Lions", "NFC", "North"),
    "GB": ("Green Bay Packers", "NFC", "North"),
    "HOU": ("Houston Texans", "AFC", "South"),
    "IND": ("Indianapolis Colts", "AFC", "South"),
    "JAX": ("Jacksonville Jaguars", "AFC", "South"),
    "KC": ("Kansas City Chiefs", "AFC", "West"),
    "LA": ("Los Angeles Rams", "NFC", "West"),
    "LAC": ("Los Angeles Chargers", "AFC", "West"),
    "LV": ("Las Vegas Raiders", "AFC", "West"),
    "MIA": ("Miami Dolphins", "AFC", "East"),
    "MIN": ("Minnesota Vikings", "NFC", "North"),
    "NE": ("New England Patriots", "AFC", "East"),
    "NO": ("New Orleans Saints", "NFC", "South"),
    "NYG": ("New York Giants", "NFC", "East"),
    "NYJ": ("New York Jets", "AFC", "East"),
    "PHI": ("Philadelphia Eagles", "NFC", "East"),
    "PIT": ("Pittsburgh Steelers", "AFC", "North"),
    "SEA": ("Seattle Seahawks", "NFC", "West"),
    "SF": ("San Francisco 49ers", "NFC", "West"),
    "TB": ("Tampa Bay Buccaneers", "NFC", "South"),
    "TEN": ("Tennessee Titans", "AFC", "South"),
    "WAS": ("Washington Commanders", "NFC", "East"),
}

# Older and alternative spellings -> canonical code.
ALIASES = {
    "LAR": "LA", "STL": "LA", "RAM": "LA", "SL": "LA",
    "OAK": "LV", "RAI": "LV",
    "SD": "LAC", "SDG": "LAC",
    "JAC": "JAX",
    "WSH": "WAS", "WFT": "WAS",
    "GNB": "GB", "KAN": "KC", "NWE": "NE", "NOR": "NO", "SFO": "SF", "TAM": "TB",
    "ARZ": "ARI", "BLT": "BAL", "CLV": "CLE", "HST": "HOU",
}


def canonical(code: Column) -> Column:
    """Trimmed upper-case code through the aliases; unknown codes pass, empty gives null."""
    key = F.nullif(F.upper(F.trim(code)), F.lit(""))
    return F.coalesce(lookup(key, ALIASES), key)


def groups_table(spark: SparkSession) -> DataFrame:
    rows = [(k, n, c, d) for k, (n, c, d) in GROUPS.items()]
    return spark.createDataFrame(rows, "team string, full_name string, conference string, division string")
