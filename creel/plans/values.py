"""Values of the freshwater-fish atlas that the analyses are usually run with.

Fixed values: code lists, patterns and labels that results depend on. All are
arguments of the operators; nothing reads them implicitly.
"""

from __future__ import annotations

# species codes removed from every source
DROPPED_SPECIES = [
    "PCC", "ASL", "OCI", "ECR", "MAH", "PCF", "OCV", "ASA",
    "APP", "APT", "OCL", "GOX", "VAL", "POB", "CRE", "CRC",
    "GRV", "GRT", "GRI", "LOU", "MUP", "PLI", "ALF", "BRX",
    "CYP", "GAX", "HBG", "HYC", "LPX", "PFL",
]

# sea trout counts as trout in the diversity indices
TROUT_RECODE = {"TRM": "TRF"}

# corrected common names
COMMON_NAMES = {
    "GRE": "Grémille",
    "CAG": "Carassin argenté",
    "LPP": "Lamproie de Planer",
    "TRF": "Truite de rivière",
    "PCH": "Poisson-chat",
    "PES": "Perche-soleil",
}

# first year of the period
FIRST_YEAR = 2014

# four readings of "full inventory"; each analysis uses its own
ENVIRONMENT_PATTERN = "Pêche"
ATLAS_PATTERN = "WAMA|Suivi|Stratifiée|partielle|ambiances|complète|Inventaire|Complète|Atlas"
DIVERSITY_PATTERN = "partielle|ambiances|complète"
RICHNESS_PROTOCOLS = [
    "Atlas",
    "WAMA",
    "Complète",
    "Stratifiée par Points (grand milieu)",
    "Pêche partielle par points (grand milieu)",
    "Pêche complète à un ou plusieurs passages",
    " Pêche par ambiances",
    "partiel",
    "complet",
]

# environment variables whose zeros mean "not measured"
ZERO_IS_MISSING = [
    "odp_longueur",
    "odp_largeur_lame_eau",
    "surface_bv",
    "distance_source",
    "largeur",
    "pente",
    "profondeur",
    "temp_juillet",
    "temp_janvier",
]

# regional status added for a species the regional list leaves out
EXTRA_REGIONAL_STATUS = [("TRM", "LC")]

# link to a species page, before its code
SPECIES_PAGE = "https://inpn.mnhn.fr/espece/cd_nom/"
SPECIES_PAGE_LABEL = "Fiche espèce INPN"

# thresholds
MIN_OPERATIONS_FOR_CURVE = 30
MIN_POINTS_PER_BASIN = 4
SERIES_END = 30
