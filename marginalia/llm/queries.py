"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import boilerplate, language, leakage, neardup, packing, pii, repeated, residue, spam, splitting


def queries() -> dict:
    """Name → callable(spark, sf_dir)."""
    found = (
        pii.p1_found, pii.p1_redacted, language.p2_found, language.p2_records, language.p2_segments, residue.p3_found, repeated.p4_found, repeated.p4_clean, repeated.p4_blocks, neardup.p5_found, neardup.p5_links,
        boilerplate.p6_found, boilerplate.p6_main, splitting.p7_found, splitting.p7_pieces, splitting.p7_checks, packing.p8_containers, packing.p8_checks, leakage.p9_found, leakage.p9_near, spam.p10_found,
    )
    return {f.__name__: f for f in found}


def oracles() -> dict:
    """Name → DuckDB SQL."""
    return {"p4_found": repeated.P4_SQL, "p4_clean": repeated.P4_CLEAN_SQL, "p7_found": splitting.P7_SQL, "p7_checks": splitting.P7_CHECKS_SQL, "p8_checks": packing.P8_CHECKS_SQL}
