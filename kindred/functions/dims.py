"""Reference dimensions: cities, given-name genders, place abbreviations.

All three are defaults. Operators that use them take a replacement as a plain
mapping (folded into the expression) or, for ``geocode``, as a DataFrame.
"""

from __future__ import annotations

# Coordinates the travel estimate must use (name -> latitude, longitude).
CITY_COORDS: dict[str, tuple[float, float]] = {
    "boston": (42.36, -71.06),
    "new york": (40.71, -74.01),
    "new york city": (40.71, -74.01),
    "nyc": (40.71, -74.01),
    "philadelphia": (39.95, -75.17),
    "baltimore": (39.29, -76.61),
    "washington dc": (38.91, -77.04),
    "richmond": (37.54, -77.43),
    "charleston": (32.78, -79.94),
    "new orleans": (29.95, -90.07),
    "chicago": (41.88, -87.63),
    "st. louis": (38.63, -90.20),
    "cincinnati": (39.10, -84.51),
    "pittsburgh": (40.44, -79.99),
    "detroit": (42.33, -83.05),
    "cleveland": (41.50, -81.69),
    "indianapolis": (39.77, -86.16),
    "atlanta": (33.75, -84.39),
    "houston": (29.76, -95.37),
    "san francisco": (37.77, -122.42),
    "los angeles": (34.05, -118.24),
    "portland": (45.52, -122.68),
    "seattle": (47.61, -122.33),
    "denver": (39.74, -104.98),
    "salt lake city": (40.76, -111.89),
    "omaha": (41.26, -95.94),
    "kansas city": (39.10, -94.58),
    "memphis": (35.15, -90.05),
    "nashville": (36.17, -86.78),
    "louisville": (38.25, -85.76),
    "buffalo": (42.89, -78.88),
    "albany": (42.65, -73.75),
    "providence": (41.82, -71.42),
    "hartford": (41.76, -72.68),
    "portland me": (43.66, -70.26),
}

# Fixed value: where an unknown place is put (central United States).
DEFAULT_COORDS: tuple[float, float] = (39.5, -98.35)

# Gender suggested by a given name.
NAME_GENDER: dict[str, str] = {
    "john": "MALE",
    "jon": "MALE",
    "johnny": "MALE",
    "james": "MALE",
    "william": "MALE",
    "george": "MALE",
    "charles": "MALE",
    "henry": "MALE",
    "thomas": "MALE",
    "robert": "MALE",
    "joseph": "MALE",
    "samuel": "MALE",
    "edward": "MALE",
    "richard": "MALE",
    "david": "MALE",
    "mary": "FEMALE",
    "elizabeth": "FEMALE",
    "sarah": "FEMALE",
    "margaret": "FEMALE",
    "anna": "FEMALE",
    "emma": "FEMALE",
    "alice": "FEMALE",
    "helen": "FEMALE",
    "catherine": "FEMALE",
    "ruth": "FEMALE",
    "leslie": "AMBIGUOUS",
    "marion": "AMBIGUOUS",
    "lee": "AMBIGUOUS",
    "willie": "AMBIGUOUS",
}

# Short forms of places and what they stand for.
PLACE_ABBREVIATIONS: dict[str, str] = {
    "philly": "Philadelphia",
    "nyc": "New York City",
    "ny": "New York",
    "la": "Los Angeles",
    "sf": "San Francisco",
    "chi": "Chicago",
    "bos": "Boston",
    "dc": "Washington DC",
    "atl": "Atlanta",
    "hou": "Houston",
    "phl": "Philadelphia",
    "stl": "St. Louis",
    "nola": "New Orleans",
    "cincy": "Cincinnati",
    "indy": "Indianapolis",
}

# Given names that count as spellings of each other (both ways).
GIVEN_VARIANTS: dict[str, str] = {"jon": "john", "john": "jon"}
