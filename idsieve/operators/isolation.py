"""Steps in Python that some rows make fail: the others go on, and those come out as rows with the reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

ERROR_SIZE = 500  # characters of a reason that are kept


def _attempted(part: pd.DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, str | None]]:
    """(result of a part, None), or (a single row that fails, its reason); a part that fails is halved and tried again."""
    try:
        yield step(part), None
        return
    except MemoryError:
        if len(part) == 1:
            raise  # the task is tried again elsewhere
    except Exception as e:  # noqa: BLE001  whatever a row brings about is that row's
        if len(part) == 1:
            yield part, (f"{e}" or type(e).__name__)[:ERROR_SIZE]
            return
    half = len(part) // 2
    for lo, hi in ((0, half), (half, len(part))):
        yield from _attempted(part.iloc[lo:hi], step)


def isolated(rows: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, uses: list[str], keep: list[str], error: str = "error") -> DataFrame:
    """The columns ``keep`` of ``rows``, those that ``step`` makes and ``error``.

    ``step`` gets the columns ``uses`` of a batch and gives a frame with the columns of ``schema``, whose index says to which input
    row each of its rows belongs; an input row may have none or several. A row by which it fails comes out once, with nulls
    and the reason; all others come out as if that row were not there. A frame is halved until failing rows are
    alone, so n rows of which k fail take at most about 2 k log2(n) further calls.
    """
    made = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, needed = made.names, list(dict.fromkeys([*keep, *uses]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch.columns = needed
            batch = batch.reset_index(drop=True)
            for out, why in _attempted(batch[uses], step):
                own = batch.loc[out.index, keep].reset_index(drop=True)
                if why is None:
                    new = out[names].reset_index(drop=True).astype(object)
                    new = new.where(new.notna(), None)
                    new[error] = None
                else:
                    new = pd.DataFrame({**dict.fromkeys(names), error: [why]}, dtype=object)
                yield pd.concat([own, new], axis=1)

    chosen = rows.select(*(f"`{c}`" for c in needed))
    out = StructType([chosen.schema[c] for c in keep] + list(made.fields)).add(error, StringType())
    return chosen.mapInPandas(run, out)
