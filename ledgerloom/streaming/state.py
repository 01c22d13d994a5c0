"""Keyed state of streams: a cache of registry answers with negative entries and expiry, and a ring of the last samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Samples that a ring holds, and seconds for which an answer of the registry stands.
RING, STANDS = 180, 86_400


def cached_answers(requests: DataFrame, registry: DataFrame, stands: int = STANDS) -> DataFrame:
    """request_id, cui, at, name, answered_by of a stream of requests (request_id, cui, at in seconds).

    The first request of an id is answered by the registry (cui, name), with null if it is unknown there; so are those from
    `stands` seconds after the last such answer on. All others are answered by the cache, unknown ids too. Within a
    micro-batch requests count in order of time, then of request_id. Requests without an id are left out. The state is one small
    row per id that was ever asked for; an expired one is overwritten, never trusted. (A timeout by the clock would keep a
    stream that stops at the end of its input from stopping; one by a watermark would drop late requests.) The rows of one id
    in one micro-batch are one task's work: files per trigger bound them.
    """

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"], kind="stable")
        name, until = state.get if state.exists else (None, None)
        names, by = [], []
        for at, found in zip(rows["at"], rows["name"], strict=True):
            fresh = until is None or at >= until
            if fresh:
                name, until = None if pd.isna(found) else found, int(at) + stands
            names.append(name)
            by.append("registry" if fresh else "cache")
        state.update((name, until))
        yield pd.DataFrame({"request_id": rows["request_id"], "cui": key[0], "at": rows["at"], "name": names, "answered_by": by})

    known = registry.dropDuplicates(["cui"]).select("cui", "name")
    asked = requests.where("cui IS NOT NULL").select("request_id", "cui", "at").join(known, "cui", "left")
    return asked.groupBy("cui").applyInPandasWithState(answer, "request_id long, cui string, at long, name string, answered_by string", "name string, until long", "append", GroupStateTimeout.NoTimeout)


def _last(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    return rows.sort_values(["at", "id"], kind="stable").tail(keep)


def rings(samples: DataFrame, keep: int = RING) -> DataFrame:
    """k, seen, id, at, value: after each micro-batch the ring of each key that had samples (k, id, at, value).

    A ring holds the last `keep` samples by time, then id; older ones are evicted. `seen` counts the key's samples so far, so
    the rows of the largest seen are the ring as it stands (`latest`). Each task sends on no more than `keep` samples of a key
    that had at most `keep` of its rows left, and how many it saw: a hot key is no task's burden.
    """

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        seen: dict = {}
        for rows in batches:
            for k, n in rows["k"].value_counts(dropna=False).items():
                seen[k] = seen.get(k, 0) + int(n)
            both = rows if held is None else pd.concat([held, rows])
            held = both.sort_values(["at", "id"], kind="stable").groupby("k", dropna=False).tail(keep)
        if held is not None and len(held):
            first = ~held.duplicated("k")
            yield held.assign(n=[seen[k] if f else 0 for k, f in zip(held["k"], first, strict=True)])[["k", "id", "at", "value", "n"]]

    def push(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, ats, values, seen = state.get if state.exists else ([], [], [], 0)
        ring = pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "at": pd.Series(ats, dtype="int64"), "value": pd.Series(values, dtype="float64")})
        for rows in batches:
            seen += int(rows["n"].sum())
            ring = _last(pd.concat([ring, rows[["id", "at", "value"]]]) if len(ring) else rows[["id", "at", "value"]], keep)
        state.update((ring["id"].tolist(), ring["at"].tolist(), ring["value"].tolist(), seen))
        yield ring.assign(k=key[0], seen=seen)[["k", "seen", "id", "at", "value"]]

    few = samples.select("k", "id", "at", "value").mapInPandas(trim, "k string, id long, at long, value double, n long")
    return few.groupBy("k").applyInPandasWithState(push, "k string, seen long, id long, at long, value double", "ids array<long>, ats array<long>, values array<double>, seen long", "append", GroupStateTimeout.NoTimeout)


def latest(written: DataFrame) -> DataFrame:
    """The rings as they stand after the last micro-batch, of all that `rings` wrote."""
    return written.join(written.groupBy("k").agg({"seen": "max"}).withColumnRenamed("max(seen)", "seen"), ["k", "seen"], "left_semi").select("k", "id", "at", "value")
