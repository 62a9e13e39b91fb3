"""Queries on nested records, units and drifting schemas (p1, p2, p4)."""

from __future__ import annotations

from discloom.operators import drift, nested, units
from discloom.session import table

QUERIES = {
    "p1_found": lambda s, d: nested.child_rows(table(s, d, "raw_extractions")),
    "p1_filings": lambda s, d: nested.filings_table(table(s, d, "raw_extractions")),
    "p1_item19_records": lambda s, d: nested.item19_table(table(s, d, "raw_extractions")),
    "p1_item20_rows": lambda s, d: nested.item20_table(table(s, d, "raw_extractions")),
    "p1_item20_states": lambda s, d: nested.parents_table(table(s, d, "raw_extractions")),
    "p2_found": lambda s, d: units.foreign_units(table(s, d, "item19_records")),
    "p2_common_units": lambda s, d: units.common_units(table(s, d, "item19_records")),
    "p2_text_figures": lambda s, d: units.text_figures(table(s, d, "item19_records")),
    "p4_found": lambda s, d: drift.changes(table(s, d, "feed_rows")),
    "p4_item7_table": lambda s, d: drift.consistent_table(table(s, d, "feed_rows"), "item7_investment"),
    "p4_item6_table": lambda s, d: drift.consistent_table(table(s, d, "feed_rows"), "item6_ongoing_fees"),
    "p4_item19_table": lambda s, d: drift.consistent_table(table(s, d, "feed_rows"), "item19_fpr"),
    "p4_item19_records": lambda s, d: drift.records_table(table(s, d, "feed_rows"), "item19_fpr"),
    "p4_failed_casts": lambda s, d: drift.failed_casts(table(s, d, "feed_rows")),
}
ORACLE = {
    "p2_found": units.foreign_units_sql(),
    "p2_common_units": units.common_units_sql(),
    "p2_text_figures": """SELECT id, f AS figure, coalesce(abs(f - value_median) < 0.01, false) AS is_median FROM (SELECT id, value_median,
        TRY_CAST(replace(list_last(regexp_extract_all(raw_text, '-?[0-9][0-9,]*(?:[.][0-9]+)?')), ',', '') AS DOUBLE) AS f FROM item19_records)""",
}
