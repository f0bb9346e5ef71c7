"""A stream of puts and lookups of cards, answered as it comes: each card's two instants are the state of its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from geoloom.operators.cards import MAX_AGE, TTL

SCHEMA, STATE = "seq bigint, index_id string, status string", "put double, stop double"


def answers(log: DataFrame, ttl: float = TTL, max_age: float = MAX_AGE) -> DataFrame:
    """seq, index_id, status of the lookups in a streaming log (seq, t, op, index_id); rows of one card come in order of
    seq from batch to batch, and are put in order within one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        put, stop = state.get if state.exists else (None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if r.op == "put":
                put, stop = r.t, min(r.t + ttl, r.t + max_age)
            elif put is None:
                out.append((r.seq, key[0], "missing"))
            elif r.t < stop:
                stop = min(r.t + ttl, put + max_age)
                out.append((r.seq, key[0], "found"))
            else:
                out.append((r.seq, key[0], "expired"))
        if put is not None:
            state.update((float(put), float(stop)))
        yield pd.DataFrame(out, columns=["seq", "index_id", "status"])

    return log.select("seq", "t", "op", "index_id").groupBy("index_id").applyInPandasWithState(run, SCHEMA, STATE, "append", "NoTimeout")
