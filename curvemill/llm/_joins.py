"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast, at most: those that hold more than one in so many of all rows.
MAX_HOT = 10_000


def spread(rows: DataFrame, table: DataFrame, on: list[str], *, weight: str = "members", total: int | None = None) -> DataFrame:
    """Inner join of rows with a table of one row for each key; ``weight``: the table's column of how many rows have that key.

    No more than MAX_HOT keys can hold more than one in MAX_HOT of all rows each, so these are broadcast and their rows stay where they are;
    the others are joined by shuffle, none of which can be larger than that. A row is told from its key's hash, so that no join passes on
    rows without a match; a key with the hash of a hot one is broadcast with it. Both inputs should be tables that are cheap to read twice,
    with keys of the same types. Null keys match nothing. The weight is not in the result.
    """
    if [rows.schema[c].dataType for c in on] != [table.schema[c].dataType for c in on]:
        raise ValueError(f"the keys {on} of rows and table must be of the same types")
    total = rows.count() if total is None else total
    names = ", ".join("`" + c.replace("`", "``") + "`" for c in on)
    hashes = {x[0] for x in table.where(F.col(weight) * MAX_HOT > total).selectExpr(f"xxhash64({names})").collect()}
    if not hashes:
        return rows.join(table.drop(weight).hint("merge"), on)
    is_hot = F.expr(f"xxhash64({names}) IN ({', '.join(map(str, hashes))})")
    hot = F.broadcast(table.sparkSession.createDataFrame(table.where(is_hot).collect(), table.schema))
    return rows.join(hot.drop(weight), on).unionByName(rows.where(~is_hot).join(table.where(~is_hot).drop(weight).hint("merge"), on))
