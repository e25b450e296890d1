"""Mixing sources to target weights by iterative proportional fitting, in
DataFrame functions only.

Tokens (words) are summed per cell of source, language and topic, combined
before the shuffle.  The sample has a token budget, ``budget`` of the corpus's
tokens.  A level's goal is ``c`` times its target share, or all its tokens where
it has fewer; one ``c`` a column makes the goals add up to the budget, so what a
small level lacks goes to the others in proportion.  The cells' factors are then
raked to one marginal's goals after the other, with ``p = min(1, factor)``, until
every marginal is met within ``tol`` of the budget (or ``rounds`` are over).  A
rare cell is thus kept whole and doesn't scale the rest.  A document is kept with
probability ``p``, decided by a hash of its id (null ids: of the text), so a
recomputed task decides alike.

Targets: per column a table (level, share), which is met in full: where a level
has too few tokens for it, the budget is smaller.  Or None for the column's own
token shares to the power ``flatten``, scaled to 1 (large levels give way to
small).

Defined cases: null levels form a level of their own; texts that are null or
empty have no tokens, and their cell's factor is that of its marginals; levels
without a target share are dropped (factor 0), unless no target is given, and
their tokens don't count for the budget;
targets for absent levels are ignored and the others scaled to 1; repeated rows
share one decision; an empty table gives an empty result.  Extra columns stay,
but for those named as the results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnguard.llm.common import stash

NONE = "(none)"


def topic_of(text: str = "text") -> Column:
    """Content class of a text: contact data, links, figures or prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("@"), "contact").when(t.contains("://"), "links")
            .when(t.rlike("[0-9]{4}"), "figures").otherwise("prose"))


def words_in(text: str = "text") -> Column:
    """Number of words: runs of other than blank, tab ... return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def level(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NONE))


def water_level(need: Column, room: Column, weight: Column, by: list[str], ties: list[str]) -> Column:
    """The ``c`` for which ``least(room, c * weight)`` adds up to ``need`` over
    the rows with the same ``by``: the largest of ``(need - room before) /
    weight from here on``, rows by ascending room a weight."""
    order = Window.partitionBy(*by).orderBy(F.when(weight > 0, room / weight).asc_nulls_last(), *ties)
    here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum(weight).over(left)
    return F.when((weight > 0) & (rest > 0), (need - (F.sum(room).over(here) - room)) / rest)


def rake(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame | None], flatten: float = 0.7,
         budget: float = 0.5, rounds: int = 40, tol: float = 1e-4, step: int = 4) -> DataFrame:
    """``cells (*dims, mass)`` plus ``factor``; ``least(1, factor)`` of a cell's
    tokens are to be kept.  Cells are few: one per combination of levels, so
    their windows are small."""
    def shared(c, dim):
        return F.sum(c).over(Window.partitionBy(dim))
    every = Window.partitionBy(F.lit(0))
    given = [d for d in dims if targets.get(d) is not None]
    for d in given:
        t = targets[d].groupBy(level(F.col("level")).alias(d)).agg(F.sum("share").alias(f"goal_{d}"))
        cells = cells.join(t, d, "left").fillna(0.0, [f"goal_{d}"])
    open_ = reduce(lambda a, b: a & b, [F.col(f"goal_{d}") > 0 for d in given], F.lit(True))
    cells = cells.withColumn("room", F.when(open_, F.col("mass")).otherwise(0.0))
    cells = cells.withColumn("budget", F.lit(budget) * F.sum("room").over(every))
    for d in dims:
        own = F.col(f"goal_{d}") if d in given else F.pow(shared("mass", d), F.lit(flatten))
        # one row of each level speaks for it; goals of the levels that have tokens, scaled to 1
        first = F.row_number().over(Window.partitionBy(d).orderBy(*[k for k in dims if k != d])) == 1
        cells = cells.withColumn("in_level", shared("room", d))
        cells = cells.withColumn(f"goal_{d}", F.when(F.col("in_level") > 0, own).otherwise(0.0))
        cells = cells.withColumn("one", F.when(first, F.col(f"goal_{d}")).otherwise(0.0))
        cells = cells.withColumn(f"goal_{d}", F.col(f"goal_{d}") / F.sum("one").over(every))
        cells = cells.withColumn(f"room_{d}", F.when(first, F.col("in_level")).otherwise(0.0)).drop("one", "in_level")
        if d in given:
            most = F.when((F.col(f"goal_{d}") > 0) & (F.col(f"room_{d}") > 0), F.col(f"room_{d}") / F.col(f"goal_{d}"))
            cells = cells.withColumn("budget", F.least("budget", F.min(most).over(every)))
    for d in dims:
        weight = F.when(F.col(f"room_{d}") > 0, F.col(f"goal_{d}")).otherwise(0.0)
        cells = cells.withColumn("c", water_level(F.col("budget"), F.col(f"room_{d}"), weight, [], dims))
        cells = cells.withColumn("c", F.max("c").over(every))
        cells = cells.withColumn(f"goal_{d}", F.coalesce(F.least(shared("room", d), F.col("c") * F.col(f"goal_{d}")), F.lit(0.0))).drop("c", f"room_{d}")
    cells = stash(cells.withColumn("factor", F.when(open_, 1.0).otherwise(0.0)), "op10-cells")
    kept = F.least(F.lit(1.0), F.col("factor")) * F.col("room")
    for _ in range(0, rounds, step):
        for _ in range(step):
            for d in dims:
                goal = F.col(f"goal_{d}")
                cells = cells.withColumn("c", water_level(goal, F.col("room"), F.col("factor") * F.col("room"), [d], dims))
                cells = cells.withColumn("c", F.max("c").over(Window.partitionBy(d)))
                cells = cells.withColumn("factor", F.when(goal > 0, F.col("factor") * F.coalesce("c", F.lit(1.0))).otherwise(0.0)).drop("c")
        off = reduce(F.greatest, [F.abs(shared(kept, d) - F.col(f"goal_{d}")) for d in dims]) / F.col("budget")
        cells = stash(cells.withColumn("off", F.when(F.col("room") > 0, off).otherwise(0.0)), "op10-cells")
        if (cells.agg(F.max("off")).first()[0] or 0) < tol:
            break
        cells = cells.drop("off")
    return cells.select(*dims, "mass", "factor")


def probabilities(docs: DataFrame, dims: dict[str, Column], targets: dict[str, DataFrame | None] | None = None,
                  seed: int = 11, **how) -> DataFrame:
    """``docs`` plus ``mix_cell`` (struct of levels), ``mix_factor``, ``mix_p``
    (probability to be kept) and ``mix_kept``."""
    docs = docs.drop("mix_cell", "mix_factor", "mix_p", "mix_kept")
    names = list(dims)
    cols = [level(c).alias(d) for d, c in dims.items()]
    cells = docs.select(*cols, words_in().alias("n")).groupBy(*names).agg(F.sum("n").cast("double").alias("mass"))
    raked = rake(cells, names, targets or {}, **how)
    raked = raked.select(F.struct(*names).alias("mix_key"), F.col("factor").alias("mix_factor"), F.least(F.lit(1.0), F.col("factor")).alias("mix_p"))
    d = docs.withColumn("mix_cell", F.struct(*cols))
    d = d.join(raked, d["mix_cell"] == raked["mix_key"], "left").drop(raked["mix_key"])
    # 53 bits of the hash: a number in [0, 1) that depends on the id alone (null is skipped)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), 11) / F.lit(float(1 << 53))
    return d.withColumn("mix_kept", u < F.col("mix_p"))


def by_source_language_topic() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of()}
