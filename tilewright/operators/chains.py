"""Links put in order: which chain each belongs to and how far along it, by pointer jumping.

Each round every link that is not done jumps as far again as it did before, so a chain of n links takes
log2(n) joins of rows of a few numbers, and no chain is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written


def ranked(links: DataFrame) -> DataFrame:
    """``(id, chain, before, closed)`` of ``links (id, prev, step)``, written.

    ``prev`` is the id of the link before, null for a chain's first, and ``step`` how far that is away. A chain is
    named after its first link and ``before`` is the distance from there. Links that form a circle are
    ``closed``: their chain is named after its smallest id and starts there. More than one link may have the same
    link before it; then the links form trees that are named after their roots. Ids are distinct, of any
    type with an order, and every ``prev`` is among them.
    """
    first = F.col("prev").isNull()
    state = written(
        links.select(
            "id",
            F.coalesce("prev", "id").alias("jump"),
            F.when(first, 0).otherwise(F.col("step")).cast("long").alias("steps"),
            F.col("id").alias("low"),
            F.lit(0).cast("long").alias("low_steps"),
            first.alias("done"),
            F.lit(False).alias("moved"),
        )
    )
    open_ = state.where("NOT done").count()
    while open_:
        to = state.select("id", *[F.col(c).alias(f"to_{c}") for c in ("jump", "steps", "low", "low_steps", "done")]).withColumnRenamed("id", "jump")
        lower = F.col("to_low") < F.col("low")
        jumped = (
            state.where("NOT done")
            .join(to, "jump")
            .select(
                "id",
                F.col("to_jump").alias("jump"),
                (F.col("steps") + F.col("to_steps")).alias("steps"),
                F.when(lower, F.col("to_low")).otherwise(F.col("low")).alias("low"),
                F.when(lower, F.col("steps") + F.col("to_low_steps")).otherwise(F.col("low_steps")).alias("low_steps"),
                F.col("to_done").alias("done"),
                (lower | F.col("to_done")).alias("moved"),
            )
        )
        before, state = state, written(state.where("done").withColumn("moved", F.lit(False)).unionByName(jumped))
        drop_written(before)
        # Where nothing was done only circles are left; where none of their links found a lower id either,
        # jumping twice as far, each has seen the whole of its circle.
        open_, moved = state.agg(F.count_if(~F.col("done")), F.count_if("moved")).first()
        if not moved:
            break
    done = F.col("done")
    return state.select("id", F.when(done, F.col("jump")).otherwise(F.col("low")).alias("chain"), F.when(done, F.col("steps")).otherwise(F.col("low_steps")).alias("before"), (~done).alias("closed"))

