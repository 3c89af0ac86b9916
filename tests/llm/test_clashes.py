"""Filters keep columns whose names they use themselves."""

import pytest
from pyspark.sql import functions as F

from vigil.llm import decontaminate, line_dedup, minmax_dedup, quality_bt

NAMES = ["_id", "_th", "_gone", "_bad", "_bad_th", "text_hash", "_doc", "_d", "_t", "N_Lines", "n_removed_lines"]


@pytest.fixture(scope="module")
def clashing(spark):
    lines = ["the first line of this text is long enough to count", "a second line that only one of them holds for itself"]
    rows = [(1, "\n".join(lines)), (2, lines[0]), (3, "\n".join(lines)), (4, None), (None, "a row that has no id of its own at all"),
            (5, "what is the sum of four and five in the old book of rules")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(0))).alias(c) for c in NAMES])


def kept(df, out):
    assert out.columns == df.columns
    rows = out.collect()
    for r in rows:
        assert [r[c] for c in NAMES] == [f"{c}-{r.doc_id or 0}" for c in NAMES]
    return sorted(r.doc_id or 0 for r in rows)


def test_names_in_use_stay(spark, clashing):
    assert kept(clashing, line_dedup.keep_lines(clashing)) == [0, 1, 4, 5]
    assert kept(clashing, minmax_dedup.keep_first(clashing, width=2)) == [0, 1, 2, 4, 5]
    item = spark.createDataFrame([(1, "what is the sum of four and five in the old book of rules")], "item_id long, text string")
    assert kept(clashing, decontaminate.remove_contaminated(clashing, item)) == [0, 1, 2, 3, 4]
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    good = kept(clashing, quality_bt.keep_good(clashing, labels))
    assert set(good) <= {0, 1, 2, 3, 4, 5}
    out = line_dedup.dedup_lines(clashing)
    assert [c for c in out.columns if c.lower() == "n_lines"] == ["n_lines"]
    assert {r.doc_id: (r.n_lines, r.n_removed_lines) for r in out.where("doc_id < 4").collect()} == {1: (2, 0), 2: (1, 1), 3: (2, 2)}
