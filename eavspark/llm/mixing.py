"""Mixing sources to target weights: weighted fair queueing over shuffled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eavspark.llm.shared import running_total, stage

#: A word of the size: a run of anything but the blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """Per source: its size and its target, by filling to the weights under the caps.

    ``sizes`` has ``source`` and ``size``. Sources take the weights in turn, by code
    point and null last. The total is ``share`` of all sizes; no target passes ``most``
    times its source's size, and what one can't take goes to the others by weight. With
    sources in the order of cap over weight, the level that the first uncapped one
    reaches is a sum over those before it, so this is two windows over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(share),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the level at the first source that isn't capped; without one all are at their caps
    level = F.first(fits, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select(
        "source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double")).alias("target")
    )


def mix(documents: DataFrame, weights: list[int] = [5, 2, 1], share: float = 1.5, most: int = 2) -> DataFrame:
    """Take words of every document so that the sources come to their target weights.

    Documents of a source are shuffled by a hash of their id and queued ``most`` times
    over. A place in the queue has a virtual finish time, the words of its source up to
    and with it over the source's target. All places are sorted by that time, and words
    are taken in this order up to the total of the targets; the place at the edge gives
    only the words that are left.

    Returns doc_id, size, source_size, target, taken. A null text or one without words
    has size 0 and gives 0; a null source is one of its own, last; repeated rows are
    queued one by one; ids may be null; an empty table gives an empty result. Other
    columns of ``documents`` are ignored.
    """
    rows = documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumns({
        "_src": F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")),
        "_shuffle": F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")),
    })
    queued = running_total(rows, ["_shuffle", "doc_id", "size"], "size", ["_src"], "_before")
    queued = queued.withColumn("_row", F.monotonically_increasing_id())
    queued = stage(queued, "queued", narrow=True)
    goal = targets(queued, weights, share, most)
    goal = goal.withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    places = queued.join(goal, "_src").withColumn("_copy", F.explode(F.array(*[F.lit(k) for k in range(most)])))
    finish = (F.col("_before") + F.col("size") + F.col("_copy") * F.col("source_size")).cast("double") / F.col("target")
    places = places.withColumn("_finish", F.when(F.col("target") > 0, finish).otherwise(0.0))
    places = running_total(
        places.select("_row", "doc_id", "size", "source_size", "target", "_src", "_shuffle", "_copy", "_finish"),
        ["_finish", "_src", "_copy", "_shuffle", "doc_id", "_row"], "size", [], "_sent",
    )
    budget = goal.agg(F.floor(F.sum("target") + F.lit(1e-6)).cast("long")).first()[0] or 0
    given = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("_sent"))).cast("long")
    return (
        places.groupBy("_row")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum(given).alias("taken"))
        .drop("_row")
    )
