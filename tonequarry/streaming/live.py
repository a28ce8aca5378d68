"""Live sessions as streams with state by key and timers.

``in_order`` holds what a key was sent until the watermark has passed it, then hands it on in the order of time and
sequence: results don't depend on how rows came in, in which batches, or on restarts from the checkpoint. A fold may set a deadline in
event time. State is kept by bucket of keys (``BUCKETS``, fixed for a checkpoint's life): a call costs milliseconds, so many small keys share one.
``polled`` asks on processing-time timers until an answer holds or the time is over. State is what is
open: rows above the watermark and one small record a key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "held string, own string"
#: Buckets of keys that ``in_order`` keeps its state by.
BUCKETS = 512


def in_order(
    events: DataFrame,
    key: str,
    values: list[str],
    late: str,
    start: dict,
    step: Callable[[dict, int, tuple], list[tuple]],
    out: str,
    deadline: Callable[[dict], int | None] = lambda own: None,
    expire: Callable[[dict], list[tuple]] = lambda own: [],
) -> DataFrame:
    """Fold a stream's rows (key, ts, seq, ``values``) by key in the order of ts and seq, as the watermark (``late``) passes them.

    ``step(own, t, row)`` changes the key's record ``own`` (JSON values; at first a copy of ``start``) and returns result rows (``out`` without the
    key, which comes first); t is in microseconds. Rows without a time go, a null sequence comes first. Where ``deadline(own)`` passes before the next row, ``expire(own)`` is asked instead.
    """
    key_type = events.schema[key].dataType.simpleString()
    names = [key, *(c.strip().split()[0] for c in out.split(", "))]
    # pandas has no whole numbers beside nulls, so long values travel as text
    longs = [events.schema[v].dataType.simpleString() == "bigint" for v in values]
    plain = [key, "_us", "seq", *values]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, told = (json.loads(x) for x in state.get) if state.exists else ([[] for _ in plain], [])
        owns = {k: own for k, own in told}
        if not state.hasTimedOut:
            for b in batches:
                for c, more in zip(held, plain, strict=True):
                    c += _plain(b[more])
        mark = state.getCurrentWatermarkMs() * 1000
        us = np.array(held[1], np.int64)
        past = us <= mark
        rows: list[tuple] = []

        def over(k, own: dict, upto: int) -> None:
            while (d := deadline(own)) is not None and d <= upto:
                rows.extend((k, *r) for r in expire(own))

        if past.any():
            at = np.flatnonzero(past)
            for i in at[np.lexsort((np.array(held[2], np.int64)[at], us[at]))].tolist():
                k, t, _, *row = (c[i] for c in held)
                if k not in owns:
                    owns[k] = dict(start)
                over(k, owns[k], t)
                row = tuple(int(x) if whole and x is not None else x for x, whole in zip(row, longs, strict=True))
                rows.extend((k, *r) for r in step(owns[k], t, row))
            rest = np.flatnonzero(~past).tolist()
            held = [[c[i] for i in rest] for c in held]
            us = us[rest]
        for k, own in owns.items():
            over(k, own, mark)
        state.update((json.dumps(held), json.dumps(list(owns.items()))))
        due = [x for x in map(deadline, owns.values()) if x is not None] + ([int(us.min())] if len(us) else [])
        if due:
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), mark // 1000 + 1))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    rows = events.withWatermark("ts", late).filter("ts is not null").select(
        # null keys have a bucket of their own, so that whole numbers stay whole beside them
        F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int").alias("_bucket"), key, "ts", F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"),
        *[F.col(v).cast("string").alias(v) if whole else F.col(v) for v, whole in zip(values, longs, strict=True)], F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
    )
    return rows.groupBy("_bucket").applyInPandasWithState(run, f"{key} {key_type}, {out}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _plain(c: pd.Series) -> list:
    """A column's JSON values; null for what pandas has for it."""
    return (c.astype(object).where(c.notna(), None) if c.hasnans else c).tolist()


# --- takes ----------------------------------------------------------------------


def _take(own: dict, t: int, row: tuple) -> list[tuple]:
    state, path = row
    if state == "started":
        own.update(began=t, marks=0, first=None)
    elif own["began"] is not None:
        if state != "stopped":
            own["marks"] += 1
            own["first"] = t - own["began"] if own["first"] is None else own["first"]
            return []
        own["take"] += 1
        done = (own["take"], own["began"] / 1e6, t / 1e6, path, own["marks"], None if own["first"] is None else own["first"] / 1e6)
        own["began"] = None
        return [done]
    return []


def live_takes(events: DataFrame, late: str = "1 minute", key: str = "recorder") -> DataFrame:
    """``recorder.takes_with_marks`` of a stream (recorder, ts, seq, state, path): a start opens a take (another one begins it anew), other states
    are its marks, a stop ends it. A take comes out when the watermark has passed its stop."""
    return in_order(events, key, ["state", "path"], late, {"began": None, "marks": 0, "first": None, "take": 0}, _take, "take long, started double, stopped double, path string, n_marks long, first_mark double")


# --- waiting --------------------------------------------------------------------


def live_stable_files(polls: DataFrame, timeout_s: float, late: str = "1 minute", key: str = "path") -> DataFrame:
    """``takes.stable_files`` of a stream of polls (path, ts, seq, size): one row a file, at the first poll with the size of the one before it and above 0,
    or when the watermark is ``timeout_s`` past its first poll."""
    limit = int(timeout_s * 1_000_000)

    def step(own: dict, t: int, row: tuple) -> list[tuple]:
        if own["told"]:
            return []
        own["first"] = t if own["first"] is None else own["first"]
        same = own["size"] is not None and row[0] is not None and own["size"] == row[0] > 0
        own.update(size=row[0], last=t, told=same)
        return [(t / 1e6, True, True)] if same else []

    def expire(own: dict) -> list[tuple]:
        own["told"] = True
        return [(own["last"] / 1e6, (own["size"] or 0) > 0, False)]

    start = {"first": None, "size": None, "last": None, "told": False}
    return in_order(polls, key, ["size"], late, start, step, "ready_at double, ready boolean, settled boolean", lambda own: None if own["told"] or own["first"] is None else own["first"] + limit, expire)


def polled(requests: DataFrame, key: str, probe: Callable[[str, str | None], tuple[bool, str | None]], every_s: float = 1.0, timeout_s: float = 25.0) -> DataFrame:
    """Ask ``probe(key, last answer)`` for each new key of a stream, at once and again each ``every_s``, until it says (True, answer) or
    ``timeout_s`` is over: key, met, answer, tries, elapsed. Each key comes out once. A probe that fails doesn't hold; it is asked again.

    Timers are in processing time and live in the checkpoint: after a restart waiting goes on, with the time it has left.
    """
    kind = requests.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for _ in batches:  # rows of a key are one request
            pass
        now = state.getCurrentProcessingTimeMs()
        began, tries, answer, told = state.get if state.exists else (now, 0, None, False)
        rows = []
        if not told:
            try:
                met, answer = probe(k[0], answer)
            except Exception:  # noqa: BLE001  what can't be asked now may be asked later
                met = False
            tries += 1
            told = bool(met) or now - began >= timeout_s * 1000
            if told:
                rows = [(k[0], bool(met), answer, tries, (now - began) / 1000)]
            else:
                state.setTimeoutDuration(max(1, int(min(every_s * 1000, began + timeout_s * 1000 - now))))
        state.update((began, tries, answer, told))
        yield pd.DataFrame(rows, columns=[key, "met", "answer", "tries", "elapsed"])

    return requests.select(key).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, met boolean, answer string, tries long, elapsed double", "began long, tries long, answer string, told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def file_size(path: str) -> int:
    """The size of a file that executors can reach; -1 if it isn't there."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.get_file_info(name).size if store.get_file_info(name).is_file else -1


def settled_files(files: DataFrame, settle_s: float = 3.0, timeout_s: float = 25.0, size: Callable[[str], int] = file_size) -> DataFrame:
    """Each new file of ``files`` (path, as ``recorder.watch_files`` gives them) once: path, settled, length, elapsed. It is looked at each ``settle_s``
    until two sizes are equal and above 0; a file that never settles comes at ``timeout_s`` with its last size."""

    def probe(path: str, last: str | None) -> tuple[bool, str]:
        now = size(path)
        return last is not None and int(last) == now > 0, str(now)

    return polled(files, "path", probe, settle_s, timeout_s).select("path", F.col("met").alias("settled"), F.col("answer").cast("long").alias("length"), "elapsed")
