"""Runs of rows with one key in a partition sorted by that key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Each run of equal keys whole, also where it goes on in the next batch."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        own = batch[key].to_numpy()
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        if kept and kept[-1][key].iloc[-1] != own[0]:
            yield kept[0] if len(kept) == 1 else pd.concat(kept, ignore_index=True)
            kept = []
        for start, end in zip([0, *cut], [*cut, len(batch)], strict=True):
            kept.append(batch.iloc[start:end])
            if end < len(batch):
                yield kept[0] if len(kept) == 1 else pd.concat(kept, ignore_index=True)
                kept = []
    if kept:
        yield kept[0] if len(kept) == 1 else pd.concat(kept, ignore_index=True)
