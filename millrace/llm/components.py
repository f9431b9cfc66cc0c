"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a join and an aggregate over the links, so no task or driver holds a component; each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import discard, release, save


def _mark(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: (a long, b long). Returns (node long, root long), one row per node that has a link; root is the least node.

    Loops and repeated links don't matter; links with a null end are ignored; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = save(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = _mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(b.alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        last, now = now, save(small.where(a != b).distinct(), "links")
        discard(last)
        release(links.sparkSession)  # else each round's shuffles lie on disk until the last
        before, seen = seen, _mark(now)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(a.alias("node"), b.alias("root"))
    return stars.unionByName(now.select(b.alias("node"), b.alias("root")).distinct())
