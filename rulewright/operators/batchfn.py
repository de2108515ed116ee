"""User functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def batch_score(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Add a user model's columns, and ``status`` and ``error``, to every row.

    ``make`` builds the model once per task. A batch that raises is halved again
    and again, so that only the rows at fault get the status ``failed``.
    """
    added = T._parse_datatype_string(schema)
    out = T.StructType([*df.schema.fields, *added.fields, T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def scored(rows: pd.DataFrame) -> pd.DataFrame:
            got = model(rows)
            return rows.assign(**{n: got[n].to_numpy() for n in names}, status="success", error=None)

        for batch in batches:
            open_ = [batch]
            while open_:
                rows = open_.pop()
                try:
                    yield scored(rows)
                except Exception as e:  # noqa: BLE001
                    half = len(rows) // 2
                    if half:
                        open_ += [rows.iloc[half:], rows.iloc[:half]]
                    else:
                        yield rows.assign(**dict.fromkeys(names), status="failed", error=str(e)[:500])

    return df.mapInPandas(run, out)


def route_by_status(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful and failed rows, for two sinks. Pass a written table: each side reads it, and an unwritten one would run the model twice."""
    return scored.where("status = 'success'"), scored.where("status != 'success'")
