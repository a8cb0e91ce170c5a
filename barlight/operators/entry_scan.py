"""Which entry signals open a position when exits refer to the entry.

The state at a bar depends on the bar at which the open position was entered,
so this one step runs over each instrument's bars in Python. An exit is looked
for in numpy over stretches of doubling length with the entry's values pinned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Col, Condition, Custom, Frame, collect_entry_refs, walk
from ..functions.windows import BarOrder


def realized(entry: np.ndarray, forced: np.ndarray, exit_: Condition, arrays: dict[str, np.ndarray], refs: list[str]) -> np.ndarray:
    """True where an entry opens a position; a forced bar opens nothing and closes whatever is open."""
    n, out = len(entry), np.zeros(len(entry), dtype=bool)
    opens = np.flatnonzero(entry & ~forced)
    at = 0
    while True:
        k = np.searchsorted(opens, at)
        if k == len(opens):
            return out
        j = int(opens[k])
        out[j] = True
        pinned = {r: float(arrays[r][j]) for r in refs}
        low, step, end = j + 1, 64, n
        while low < n:
            high = min(n, low + step)
            true, sure = exit_.truth(Frame(arrays, low, high, pinned))
            closes = np.flatnonzero((true & sure & ~entry[low:high]) | forced[low:high])
            if len(closes):
                end = low + int(closes[0])
                break
            low, step = high, step * 2
        at = end + 1


def with_realized(df: DataFrame, exit_: Condition, order: BarOrder, entry: str, forced: str | None, name: str) -> DataFrame:
    """df with a boolean column of realized entries."""
    refs = collect_entry_refs(exit_)
    customs = [c for c in walk(exit_) if isinstance(c, Custom)]
    for i, c in enumerate(customs):
        c.name = f"_custom_{i}"
    used = sorted({c.name for c in walk(exit_) if isinstance(c, Col)} | set(refs))
    sort = [order.date, *([order.seq] if order.seq else [])]
    lean = df.withColumns({c.name: c.column(order.w).cast("double") for c in customs}) if customs else df
    names = [*used, *[c.name for c in customs]]
    lean = lean.select(*order.keys, *sort, F.coalesce(F.col(entry), F.lit(False)).alias("_e"), (F.col(forced) if forced else F.lit(False)).alias("_f"), *[F.col(n).cast("double").alias(f"_v{i}") for i, n in enumerate(names)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(sort, kind="stable")
        arrays = {n: frame[f"_v{i}"].to_numpy(dtype=float) for i, n in enumerate(names)}
        frame[name] = realized(frame["_e"].to_numpy(bool), frame["_f"].to_numpy(bool), exit_, arrays, refs)
        return frame[[*order.keys, *sort, name]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.select(*order.keys, *sort).schema) + f", `{name}` boolean"
    flags = lean.groupBy(*order.keys).applyInPandas(run, schema)
    return df.join(flags, [*order.keys, *sort])
