"""Names, bounds and breaks that must hold exactly for results to agree."""

# Season of each calendar month.
SEASON_OF_MONTH = {
    1: "winter", 2: "winter",
    3: "spring", 4: "spring", 5: "spring",
    6: "summer", 7: "summer", 8: "summer",
    9: "fall", 10: "fall", 11: "fall", 12: "fall",
}

# Right-closed salinity breaks.
SALINITY_BREAKS = [0, 1, 2, 3, 4, 5, 6, 7, 10, 12, 15, 17, 18, 20, 25, 30, 35]

# Region boxes; a later rule wins. Bounds are (column, comparison, limit).
REGION_BOXES = [
    ("SBP", [("lat", "<", 38.084), ("lon", "<", -122.194)]),
    ("Napa", [("lat", ">=", 38.084), ("lon", "<", -122.194)]),
    ("Suisun", [("lon", ">=", -122.194), ("lon", "<=", -121.875)]),
    ("Confluence", [("lon", "<", -121.699), ("lon", ">", -121.875), ("lat", "<", 38.127), ("lat", ">", 37.996)]),
    ("SCDelta", [("lon", ">=", -121.699), ("lat", "<", 38.127)]),
    ("Cache", [("lon", ">", -121.807), ("lat", ">", 38.127)]),
]

# Display order and label of each analysis group with its life stage.
CATCH_GROUP_LABELS = {
    "Cladocera Adult": "Cladocera",
    "Cyclopoida Adult": "Cyclopoids",
    "Cyclopoida Juvenile": "Cyclo Juv",
    "Calanoida Adult": "Calanoids",
    "Calanoida Juvenile": "Cala Juv",
    "Calanoida Larva": "Cala Naup",
    "Copepoda Adult": "Other copepods",
    "Copepoda Larva": "Copepod Naup",
    "Harpacticoida Undifferentiated": "Harpacticoids",
    "Rotifera Adult": "Rotifers",
    "Cumacea Adult": "Cumaceans",
    "Barnacle Nauplii Larva": "Barnacle Naup",
    "Decapoda Larva": "Crab zoea",
}

# The sites compared by the three-survey study, in display order.
STUDY_SITES = [
    "Wings", "Little Honker Bay", "Grizzly Bay", "Browns", "Winter",
    "Sherman Lake", "Stacys", "Horseshoe Bend", "Prospect", "Lindsey",
]

# The regions of the spring study, in display order.
SPRING_REGIONS = ["Suisun Marsh", "Suisun Bay", "Confluence", "Sac SanJ", "Cache"]

# Months and years studied, and their short labels.
SPRING_MONTHS = [3, 4, 5, 6]
MONTH_LABELS = {3: "Mar", 4: "Apr", 5: "May", 6: "Jun"}
STUDY_YEARS = [2017, 2018, 2019]

# Share of total catch under which a group is lumped, and its new name.
RARE_SHARE = 0.00015
RARE_NAME = "other"

# Fixed value: marker that the synthesis extract appends to unidentified taxa.
UNIDENTIFIED_TOKEN = "_UnID"
