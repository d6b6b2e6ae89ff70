"""Requests as rows, judged by the rules of O-39b: what ``ObservationFilter.validate*`` does for one request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightlines import codes

#: Columns of a request row. A list has its number of items, a value that was not given is null.
SCHEMA = (
    "request_id bigint, kind string, list_items int, precision_from int, precision_to int, page_number int,"
    " results_per_page int, zoom_level int, max_results int, min_x double, min_y double, max_x double, max_y double"
)
# Rule -> (kinds of request it holds for, the condition that breaks it). Nulls break nothing.
_EVERY = ("search", "page", "counts", "locations")
RULES = {
    "list_items": (_EVERY, f"list_items > {codes.MAX_LIST_ITEMS}"),
    "precision_order": (_EVERY, "precision_from > precision_to AND precision_from > 0 AND precision_to > 0"),
    "page_together": (("page",), "(page_number IS NULL) <> (results_per_page IS NULL)"),
    "page_number": (("page",), "page_number < 1"),
    "results_per_page": (("page",), f"results_per_page NOT BETWEEN 1 AND {codes.MAX_OBSERVATIONS}"),
    "zoom_level": (("counts",), "zoom_level NOT BETWEEN 1 AND 2"),
    "max_results": (("locations",), f"max_results NOT BETWEEN 1 AND {codes.MAX_LOCATIONS}"),
    "envelope": (("locations",), "NOT (min_x < max_x AND min_y < max_y)"),
}


def _broken() -> str:
    """The names of the rules a row breaks, as an SQL array."""
    tests = []
    for rule, (kinds, broken) in RULES.items():
        listed = ", ".join(f"'{kind}'" for kind in kinds)
        tests.append(f"IF(kind IN ({listed}) AND ({broken}), '{rule}', NULL)")
    return f"sort_array(array_compact(array({', '.join(tests)})))"


def broken_rules(requests: DataFrame) -> DataFrame:
    """(request_id, rule) for every rule that a request breaks, in one pass over the requests."""
    return requests.select("request_id", F.explode(F.expr(_broken())).alias("rule"))


def verdicts(requests: DataFrame) -> DataFrame:
    """(request_id, accepted, rules): every request with the names of the rules it breaks, joined by commas."""
    judged = requests.selectExpr("request_id", f"array_join({_broken()}, ',') AS rules")
    return judged.selectExpr("request_id", "rules = '' AS accepted", "rules")
