"""Carry-forward over ordered lists: repetition marks resolved from the last head above, within a gap.

One sort per page does it all; no state is kept in Python. A conditional head (a mark before a whole name) depends
on what was carried so far, which comes down to two facts that windows have: the gap to the last reading, and
whether any head stood above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewood.functions.text import after_mark, is_mark, squeeze

#: Fixed values.
MAX_GAP = 2
INDENT_FLOOR = 0.18


def run_ids(rows: DataFrame, group: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Number of the run of equal consecutive values, from 1, in each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    starts = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(w).cast("long")).drop("_starts")


def gap_before(rows: DataFrame, group: list[str], order: list[str], filled: Column, name: str = "gap") -> DataFrame:
    """Rows that aren't filled between each row and the last filled one above; null if there is none."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = rows.withColumn("_pos", F.row_number().over(w)).withColumn("_seen", F.when(filled, F.col("_pos")))
    above = F.last("_seen", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, (F.col("_pos") - above - 1).cast("long")).drop("_pos", "_seen")


def carry_forward(rows: DataFrame, group: list[str], order: list[str], raw: str = "name_raw", surname: str = "surname", given: str = "given", indent: str | None = None) -> DataFrame:
    """``rows`` with surname and given resolved, ``ditto`` (inherited fields) and ``ditto_source`` (mark, indent, position).

    The reading itself is never changed, and blank rows pass through.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    text = squeeze(F.coalesce(F.col(raw), F.lit("")))
    words = F.split(F.col("_text"), " ")
    rows = rows.withColumn("_text", text).withColumn("_n", F.when(F.col("_text") == "", F.lit(0)).otherwise(F.size(words)))
    rows = rows.withColumn("_pos", F.row_number().over(w)).withColumn("_filled", F.when(F.col("_n") > 0, F.col("_pos")))
    rows = rows.withColumn("_since", F.col("_pos") - F.coalesce(F.last("_filled", ignorenulls=True).over(above), F.lit(0)) - 1)
    lead = F.element_at(words, 1)
    rows = rows.withColumn("_mark", is_mark(F.col("_text")) & (F.col("_n") > 0))
    rows = rows.withColumn("_lead", (F.col("_n") > 0) & ~F.col("_mark") & (is_mark(lead) | after_mark(F.col("_text")).isNotNull()))
    fine = F.coalesce(~is_mark(F.col(surname)), F.lit(False)) & (F.coalesce(F.col(surname), F.lit("")) != "")
    always = (F.col("_n") >= 2) & ~F.col("_lead") & ~F.col("_mark") & fine
    perhaps = (F.col("_n") >= 2) & F.col("_lead") & fine
    rows = rows.withColumn("_first", F.min(F.when(always | perhaps, F.col("_pos"))).over(Window.partitionBy(*group)))
    head = always | (perhaps & ((F.col("_since") > MAX_GAP) | (F.col("_pos") == F.col("_first"))))
    rows = rows.withColumn("_head", F.when(head, F.col(surname)))
    rows = rows.withColumn("_last", F.last("_head", ignorenulls=True).over(above))
    near = F.col("_last").isNotNull() & (F.col("_since") <= MAX_GAP) & (F.col("_n") > 0)
    single = (F.col("_n") == 1) & ~F.col("_mark")
    by_indent = single & (F.coalesce(F.col(indent), F.lit(0.0)) >= INDENT_FLOOR) if indent else F.lit(False)
    source = (
        F.when(~near, None).when(by_indent & ~F.col("_lead"), F.lit("indent")).when(F.col("_lead") | F.col("_mark"), F.lit("mark"))
        .when(single, F.lit("position"))
    )
    rows = rows.withColumn("ditto_source", source)
    rest = F.when(F.col("_mark"), F.lit(None)).when(
        F.col("_lead"), F.when(is_mark(lead), F.array_join(F.slice(words, 2, F.size(words)), " ")).otherwise(after_mark(F.col("_text")))
    ).otherwise(F.col("_text"))
    got = F.col("ditto_source").isNotNull()
    return rows.withColumns(
        {
            given: F.when(got, rest).otherwise(F.col(given)),
            surname: F.when(got, F.col("_last")).otherwise(F.col(surname)),
            "ditto": F.when(got, F.array(F.lit("surname"))),
        }
    ).drop("_text", "_n", "_pos", "_filled", "_since", "_mark", "_lead", "_first", "_head", "_last")


def list_breaks(rows: DataFrame, group: list[str], order: list[str], ordinal: str, lookback: int = 3) -> DataFrame:
    """Rows where a list's numbering starts again. The rule's state resets at each break, so lists go to Python one by one."""
    import pandas as pd

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seen = [(i, int(d)) for i, raw in zip(pdf.index, pdf[ordinal], strict=True) if (d := "".join(c for c in str(raw or "") if c.isdigit())) and len(d) <= 3]
        run: list[int] = []
        hits = []
        for k, (i, v) in enumerate(seen):
            top = max(run[-lookback:], default=None)
            after = [x for _, x in seen[k + 1 : k + 1 + lookback]]
            falls = top is not None and v < top and v % 10 and top % 10
            if falls and (not after or (min(after) > v and after[0] - v <= lookback)):
                hits.append(i)
                run = []
            run.append(v)
        return pdf.loc[hits]

    return rows.groupBy(*group).applyInPandas(of, rows.schema)
