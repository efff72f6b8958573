"""Facts and turns from streams: one state for each key, and ids that are taken once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions.text import fact_key
from recollect.operators.facts import KEY, Versions, normalised
from recollect.operators.store import blank

_OUT = "subject string, attribute string, id bigint, value string, valid_from timestamp_ntz"
_STATE = "valid_from array<bigint>, id array<bigint>, same array<string>"


def stored_turns(turns: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A stream of turns (id, arrived, text, ...) without blank ones, each id once within the watermark."""
    return turns.where(~blank(F.col("text"))).withWatermark("arrived", watermark).dropDuplicatesWithinWatermark(["id"])


def filed(arrivals: DataFrame) -> DataFrame:
    """The versions that a stream of arrivals files, as ``operators.facts.filed`` does for a table.

    A key's state is its versions; within a batch its arrivals are taken in order of id. The
    state stays, as a version may be superseded at any time: it grows with keys and versions.
    """
    keyed = normalised(arrivals).select(*KEY, "id", "value", "valid_from", fact_key(F.col("value")).alias("same"))

    def fold(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        versions = Versions(zip(*state.get, strict=True) if state.exists else ())
        rows = pd.concat(list(parts)).sort_values("id", kind="stable")
        new = [versions.file(int(pd.Timestamp(at).value), int(number), same) for at, number, same in zip(rows["valid_from"], rows["id"], rows["same"], strict=True)]
        state.update(([at for at, _ in versions.places], [number for _, number in versions.places], versions.values))
        yield rows.loc[new, ["subject", "attribute", "id", "value", "valid_from"]]

    return keyed.groupBy(*KEY).applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
