"""Sample uploads of the registered CSV queries: customer rows as text with rule-chosen dirty cells and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ID

# Dirty-cell rules used to exercise the CSV path: (source header, key modulus, cell text).
DIRT = [
    ("Age", 97, "abc"),
    ("Total_Purchases", 89, "NaN"),
    ("Credit_Balance", 83, ""),
    ("Churned", 79, "x"),
    ("Email_Open_Rate", 73, " 5 "),
    ("Lifetime_Value", 71, "1e3"),
    ("Gender", 67, "NA"),
]


def with_dirty_cells(text: DataFrame) -> DataFrame:
    """Replace a rule-chosen cell per column with unparsable / special text (all rows kept)."""
    return text.withColumns({
        c: F.when(F.col(ID).cast("long") % m == 0, F.lit(cell)).otherwise(F.col(c)) for c, m, cell in DIRT
    })


def write_csv_lines(text: DataFrame, path: str, short_every: int | None = None, long_every: int | None = None,
                    quoted: str | None = None) -> None:
    """Headerless CSV lines; rows whose key is a multiple of ``short_every`` keep only 3 fields, of ``long_every`` get
    one too many; column ``quoted`` is written in quotes with a doubled quote inside."""
    cells = {c: F.coalesce(F.col(c), F.lit("")) for c in text.columns}
    if quoted:
        cells[quoted] = F.concat(F.lit('"""'), cells[quoted], F.lit('"""'))
    line, key = F.concat_ws(",", *cells.values()), F.col(ID).cast("long")
    if long_every:
        line = F.when(key % long_every == 0, F.concat(line, F.lit(",surplus"))).otherwise(line)
    if short_every:
        line = F.when(key % short_every == 0, F.concat_ws(",", *list(cells.values())[:3])).otherwise(line)
    text.select(line.alias("value")).write.mode("overwrite").text(path)
