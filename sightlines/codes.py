"""Fixed values of the occurrence data model.

Everything in this file is data that stored tables and results depend on; it
holds no logic.
"""

from __future__ import annotations

# Entity types of the observation-to-entity index. Types 1-6 equal the area types.
MUNICIPALITY = 1
COUNTY = 2
RESTRICTED_AREA = 3
OCEAN_AREA = 4
POLAR_ISLANDS = 6
INSTITUTION = 101

# Organisation type of an institution (the index stores it as 100 + type).
INSTITUTION_ORGANIZATION_TYPE = 1

# Tags that decide the registration status.
TAG_ABSENT = 5
TAG_NOT_RECOVERED = 6

# Registration status.
STATUS_FOUND = 1
STATUS_ABSENT = 2
STATUS_NOT_RECOVERED = 3

# An index row that still waits for its filter columns carries this taxon group.
UNFILLED_TAXON_GROUP = 0

RESTRICTED_FID_PREFIX = "Naturbase VV"

# Display order of category codes; a code outside the list sorts last.
CATEGORY_ORDER = (
    "SE", "HI", "PH", "LO", "NK", "NR", "RE", "CR", "EN", "VU", "NT", "DD", "LC", "NA", "NE",
)

# Rows appended to the basis-of-record lookup: (id, name, description, variants).
DNA_BASIS_ROWS = (
    (16, "dna", "DNA", "dna,DNA"),
    (17, "edna", "eDNA", "edna,eDNA,environmental dna,environmental DNA"),
    (18, "edna_barcoding", "eDNA Barcoding", "edna_barcoding,eDNA Barcoding,eDAN Barcoding"),
)

# Limits of requests.
MAX_LIST_ITEMS = 500
DEFAULT_TAXA, MAX_TAXA = 20, 1000
DEFAULT_ORGANIZATIONS, MAX_ORGANIZATIONS = 10, 50
DEFAULT_LOCATIONS, MAX_LOCATIONS = 100_000, 100_000
DEFAULT_POLYGONS, MAX_POLYGONS = 2_000, 5_000
DEFAULT_OBSERVATIONS, MAX_OBSERVATIONS = 20, 10_000
LOOKAHEAD_PAGES = 4
DEFAULT_EPSG = 25833

# Export settings.
EXPORT_SOFT_LIMIT = 300_000
EXPORT_HARD_LIMIT = 500_000
EXPORT_BYTES_PER_FULL_ROW = 500
EXPORT_DEFAULT_NAME = "eksport"
EXPORT_HISTORY_ROWS = 50

# Slow-request log.
SLOW_REQUEST_MS = 1_000
LOGGED_BODY_CHARS = 4_000

# Export job status, as stored, of jobs that have ended.
JOB_COMPLETE, JOB_FAILED, JOB_CANCELLED = "Complete", "Failed", "Cancelled"
