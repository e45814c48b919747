"""Recurrences over all rows in an order, in parallel: blocks folded from guessed states, and again only where a guess was wrong.

Rows are cut into blocks by ranges of the order. Every block is folded from a
guess of the state at its start; the state at its end is what the next block
should have started from. Blocks that started from another one are folded again,
until all agree. A recurrence that forgets its start (a sliding limit, a counter
that is set back) needs a round or two; one that never does needs as many rounds
as there are blocks, and is right then, too.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.plan import stored
from corvane.operators.ordering import ranges

#: fold(state, rows of a block in order) gives the state behind them and what comes out for each; states are strings.
Fold = Callable[[str, pd.DataFrame], tuple[str, list]]


def fold_all(rows: DataFrame, order: list[str], fold: Fold, start: str, out: str, kind: str, guess: Callable[[DataFrame], DataFrame] | None = None, parts: int | None = None, report: list | None = None) -> DataFrame:
    """rows with a column `out` of type `kind`, as one fold over all of them in order gives it.

    `order` has to tell rows apart. guess(blocks) may give (__part, guess) for
    blocks that are likely to start from another state than `start`. `report`
    gets the number of blocks that were folded in each round.
    """
    cut = ranges(rows, [], order, parts)
    starts = cut.select("__part").distinct()
    if guess:
        starts = starts.join(guess(cut), "__part", "left").select("__part", F.coalesce("guess", F.lit(start)).alias("__state"))
    else:
        starts = starts.select("__part", F.lit(start).alias("__state"))
    columns = cut.columns

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({"__part": pdf["__part"].iloc[:1].to_numpy(), "started": [pdf["__state"].iloc[0]], "ended": [fold(pdf["__state"].iloc[0], pdf[columns])[0]]})

    def ends(of: DataFrame) -> DataFrame:
        return cut.join(of, "__part").groupBy("__part").applyInPandas(last, "__part int, started string, ended string")

    known = stored(ends(starts), "states")
    if report is not None:
        report.append(known.count())
    while True:  # one row a block
        right = known.withColumn("should", F.coalesce(F.lag("ended").over(Window.orderBy("__part")), F.lit(start)))
        wrong = stored(right.filter("should <> started").select("__part", F.col("should").alias("__state")), "wrong")
        n = wrong.count()
        if not n:
            break
        if report is not None:
            report.append(n)
        known = stored(known.join(wrong, "__part", "left_anti").unionByName(ends(wrong)), "states")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf[columns].assign(**{out: fold(pdf["__state"].iloc[0], pdf[columns])[1]})

    settled = known.select("__part", F.col("started").alias("__state"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return cut.join(settled, "__part").groupBy("__part").applyInPandas(whole, f"{schema}, `{out}` {kind}").drop("__part")
