"""Substring search over alerts by trigram postings (VW5).

The index is a table of postings (three-character piece, ``seq``) of the four
searched columns in lower case, dealt by ranges of the piece and written in
that order, so that a lookup reads the row groups of its pieces only; beside it
stands how many alerts hold each piece.  A query is answered from its three
rarest pieces: alerts that hold them all are candidates, and the candidates'
texts are then compared as the scan does, so the rows are those of
``views.search_alerts``.  Queries of fewer than three characters have no piece
and are answered by the scan.

Several queries are one job.  The index belongs to the alerts it was built
from; ``seq`` is unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.prefix import in_ranges
from vigil.operators.sizing import written_table

COLUMNS = ("node_id", "node_name", "region", "log_id")
RAREST = 3


@dataclass(frozen=True)
class SearchIndex:
    postings: DataFrame   # gram, seq
    counts: DataFrame     # gram, n


def _text(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _pieces(text: Column) -> Column:
    last = F.greatest(F.length(text) - 2, F.lit(0))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, 3))).otherwise(
        F.array().cast("array<string>"))


def build_search_index(alerts: DataFrame) -> SearchIndex:
    grams = F.array_distinct(F.flatten(F.array(*[_pieces(_text(c)) for c in COLUMNS])))
    postings = in_ranges(alerts.select("seq", F.explode(grams).alias("gram")), ["gram", "seq"], "search/postings").select("gram", "seq")
    return SearchIndex(postings, written_table(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "search/counts"))


def _holds(query: Column) -> Column:
    hit = F.lit(False)
    for c in COLUMNS:
        hit = hit | F.contains(_text(c), query)
    return hit


def search_indexed(alerts: DataFrame, index: SearchIndex, queries: list[str]) -> DataFrame:
    """(query, *alerts): the alerts that hold each query, case-insensitive, in any of the searched columns."""
    spark = alerts.sparkSession
    wanted = [(q, q.lower()) for q in dict.fromkeys(queries)]
    short = [F.struct(F.lit(q).alias("query"), F.lit(low).alias("low")) for q, low in wanted if len(low) < 3]
    pieces = [(q, low, low[k:k + 3]) for q, low in wanted for k in range(len(low) - 2)]
    asked = spark.createDataFrame(sorted(set(pieces)), "query string, _q string, gram string")
    known = asked.join(index.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = (known.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("n", "gram"))).where(F.col("_r") <= RAREST)
              .withColumn("_need", F.count(F.lit(1)).over(Window.partitionBy("query"))).select("query", "_q", "gram", "_need"))
    grams = [r["gram"] for r in rarest.select("gram").distinct().collect()]  # at most three a query
    hits = index.postings.where(F.col("gram").isin(grams)).join(rarest, "gram")
    candidates = written_table(hits.groupBy("query", "_q", F.col("seq").alias("_seq"), "_need").agg(F.count(F.lit(1)).alias("_n"))
                               .where("_n = _need").select("query", "_q", "_seq"), "search/candidates")
    low, high = candidates.agg(F.min("_seq"), F.max("_seq")).first()
    near = alerts.where(F.col("seq").between(low, high)) if low is not None else alerts.limit(0)
    found = near.join(candidates, F.col("seq") == F.col("_seq")).where(_holds(F.col("_q"))).select("query", *alerts.columns)
    if not short:
        return found
    scanned = alerts.withColumn("_w", F.explode(F.array(*short))).where(_holds(F.col("_w.low")))
    return found.unionByName(scanned.select("_w.query", *alerts.columns))
