"""Requests as rows get the verdict of the request object."""

from __future__ import annotations

import itertools

from sightlines import codes
from sightlines.operators import verdicts as V
from sightlines.operators.filters import Envelope, ObservationFilter

_NONE = dict.fromkeys((c.split()[0] for c in V.SCHEMA.split(", ")), None)


def _accepts(row) -> bool:
    f = ObservationFilter(
        taxon_group_ids=range(row["list_items"] or 0), precision_from=row["precision_from"], precision_to=row["precision_to"],
        page_number=row["page_number"], results_per_page=row["results_per_page"], max_results=row["max_results"] or 5,
        envelope=None if row["min_x"] is None else Envelope(*(row[c] for c in ("min_x", "min_y", "max_x", "max_y"))),
    )
    if row["kind"] == "locations" and row["max_results"] is not None:
        f = f.but(max_results=row["max_results"])
    judge = {"search": f.validate, "page": f.validate_page, "locations": f.validate_locations,
             "counts": lambda: f.validate_counts(row["zoom_level"])}
    try:
        judge[row["kind"]]()
        return True
    except ValueError:
        return False


def test_rows_and_objects_agree(spark):
    rows = []
    for kind in ("search", "page", "counts", "locations"):
        for items, (low, high), (page, per) in itertools.product(
            (None, codes.MAX_LIST_ITEMS, codes.MAX_LIST_ITEMS + 1), ((None, 3), (5, 3), (5, 0), (-1, -3), (3, 5)),
            ((None, None), (1, 10), (0, 10), (1, None), (None, 5), (2, 0), (2, codes.MAX_OBSERVATIONS + 1)),
        ):
            rows.append({"kind": kind, "list_items": items, "precision_from": low, "precision_to": high, "page_number": page,
                         "results_per_page": per, "zoom_level": 1 + len(rows) % 2})
    rows += [{"kind": "counts", "zoom_level": z} for z in (0, 1, 2, 3)]
    rows += [{"kind": "locations", "max_results": m} for m in (0, 1, codes.MAX_LOCATIONS, codes.MAX_LOCATIONS + 1)]
    boxes = [(0, 0, 1, 1), (1, 0, 1, 1), (0, 2, 1, 1), (2, 2, 1, 1)]
    rows += [{"kind": k, **dict(zip(("min_x", "min_y", "max_x", "max_y"), map(float, b)))} for b in boxes for k in ("locations", "search")]
    rows = [_NONE | r | {"request_id": i} for i, r in enumerate(rows)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], V.SCHEMA)
    found = {r.request_id: r for r in V.verdicts(frame).collect()}
    assert {i: r.accepted for i, r in found.items()} == {r["request_id"]: _accepts(r) for r in rows}
    listed = V.broken_rules(frame).collect()
    assert {(r.request_id, r.rule) for r in listed} == {(i, x) for i, r in found.items() for x in r.rules.split(",") if x}
    assert {r.rule for r in listed} == set(V.RULES)
