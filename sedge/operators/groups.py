"""Many small groups in Python without a call of the worker for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_group(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``function`` over each group of equal keys, in order of the keys.

    Rows are partitioned and sorted by Spark, which spills; a worker goes through them as they come and holds no more than
    a batch and the group that runs on into the next. Frames without rows aren't sent: an empty column of text has no type of
    its own, which Arrow refuses."""

    def groups(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        new = np.zeros(len(pdf), bool)
        for k in keys:
            c = pdf[k]
            new[1:] |= ((c != c.shift()) & ~(c.isna() & c.shift().isna())).to_numpy()[1:]
        edges = [0, *np.flatnonzero(new), len(pdf)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield pdf.iloc[a:b]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            own = list(groups(pdf))
            rest = own.pop().reset_index(drop=True)
            out = [x for x in map(function, own) if len(x)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) and len(out := function(rest)):
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
