"""Queries p3 and p5 to p9."""

from __future__ import annotations

from discloom.llm import crossmatch, leaks, packing, subjects, survivor, variants
from discloom.session import table


def _subject_tables(s, d):
    return table(s, d, "documents"), table(s, d, "subjects"), table(s, d, "doc_labels")


QUERIES = {
    "p3_found": lambda s, d: crossmatch.found(table(s, d, "wi_filings"), table(s, d, "mn_filings")),
    "p3_matches": lambda s, d: crossmatch.confident(table(s, d, "wi_filings"), table(s, d, "mn_filings")),
    "p3_filings": lambda s, d: crossmatch.filings(table(s, d, "wi_filings"), table(s, d, "mn_filings")),
    "p5_found": lambda s, d: variants.links(table(s, d, "franchisors"), table(s, d, "filing_metadata")),
    "p5_members": lambda s, d: variants.members(table(s, d, "franchisors"), table(s, d, "filing_metadata")),
    "p6_found": lambda s, d: survivor.survivors(table(s, d, "fdds")),
    "p6_untimed_latest": lambda s, d: survivor.untimed_survivors(table(s, d, "fdds")),
    "p8_found": lambda s, d: leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
    "p7_packed": lambda s, d: packing.pack(table(s, d, "documents")),
    "p9_found": lambda s, d: subjects.subjects_of(*_subject_tables(s, d)),
    "p9_composition": lambda s, d: subjects.composition(*_subject_tables(s, d)),
}
ORACLE = {"p6_found": survivor.survivors_sql(), "p6_untimed_latest": survivor.untimed_sql()}
