"""Values that have to equal the established ones for results to agree.

Everything in this file is data: patterns, word lists, column names, formats.
Nothing here is logic, so it is kept together and spelled out plainly.
"""

from __future__ import annotations

# --- characters str.strip() removes (29 of them) ---------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- default masks -----------------------------------------------------------
EMAIL_MASK = "[email]"
URL_MASK = "[url]"

# --- text settings per language ----------------------------------------------
SECTION_HEADER = {"en": "References", "fr": "Références"}
SYMBOL_WORDS = {
    "en": [("-->", " then "), ("°", " degrees "), ("\\n", "\n")],
    "fr": [("->", " puis "), ("°", " degrés "), ("\\n", "\n")],
}
KEYWORD_PREFIX = {"en": "keywords:", "fr": "mots-clés associés:"}

# --- openings removed from a generated question, tried in this order ---------
QUESTION_OPENINGS = ["What is a ", "What is the ", "What is ", "What are ", "What are the "]

# --- punctuation whose repeats collapse to one -------------------------------
COLLAPSIBLE = ",!?;:-><#*+=|\""

# --- placeholders that mean "no value" ---------------------------------------
NOT_AVAILABLE = "Not Available; Indisponible"
STILL_RUNNING = "Present"

# --- source system naming ----------------------------------------------------
LEGACY_SOURCE = "cgp"
DEFAULT_SOURCE = "geo-ca"

# --- topic -> theme ----------------------------------------------------------
THEME_OF_TOPIC = {
    "boundaries": "administration",
    "planningcadastre": "administration",
    "location": "administration",
    "transportation": "administration",
    "economy": "economy",
    "farming": "economy",
    "biota": "environment",
    "environment": "environment",
    "elevation": "environment",
    "inlandwaters": "environment",
    "oceans": "environment",
    "climatologymeteorologyatmosphere": "environment",
    "imagerybasemapsearthcover": "imagery",
    "earthobservation;syntheticaperatureradar": "imagery",
    "structure": "infrastructure",
    "transport": "infrastructure",
    "utilitiescommunication": "infrastructure",
    "geoscientificinformation": "science",
    "health": "society",
    "society": "society",
    "intelligencemilitary": "society",
}
THEME_TAGS_ALLOWED = ["emergency", "legal"]
FOUNDATIONAL = "foundational"
MAPPABLE_PROTOCOLS = ["esri", "ogc"]

# --- column names ------------------------------------------------------------
P = "features_properties_"
ID = P + "id"
EO_COLLECTION = P + "eoCollection"
TEXT_COLUMNS = [
    P + "id",
    P + "title_en",
    P + "title_fr",
    P + "description_en",
    P + "description_fr",
    P + "keywords_en",
    P + "keywords_fr",
    P + "eoCollection",
]
FULL_COLUMNS = [
    P + "id",
    "features_geometry_coordinates",
    P + "title_en",
    P + "title_fr",
    P + "description_en",
    P + "description_fr",
    P + "date_published_date",
    P + "keywords_en",
    P + "keywords_fr",
    P + "options",
    P + "contact",
    P + "cited",
    P + "topicCategory",
    P + "date_created_date",
    P + "spatialRepresentation",
    P + "type",
    P + "temporalExtent_begin",
    P + "temporalExtent_end",
    P + "graphicOverview",
    P + "language",
    "features_popularity",
    P + "sourceSystemName",
    P + "eoCollection",
    P + "eoFilters",
]

# --- strings a CSV cell may hold to say "missing" (public pandas default) ----
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
