"""The queries of the training-data operators: columns, and rows against SQL where there is SQL."""

import pytest

from marginalia.llm import queries

from ..compare import connect, same

COLUMNS = {
    "p1_found": ["src", "rec_id", "pii_type", "start_pos"], "p2_found": ["src", "rec_id", "lang"], "p3_found": ["page_id"], "p4_found": ["page_id", "line_no"], "p5_found": ["page_a", "page_b"], "p6_found": ["page_id", "line_no"],
    "p7_found": ["page_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data_dir, name):
    df = queries.queries()[name](spark, data_dir)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in queries.oracles():
        got, want = same(df, connect(data_dir), queries.oracles()[name])
        assert got == want
    else:
        assert df.count() == df.distinct().count()
