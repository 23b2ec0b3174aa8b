"""Windows that the first event of a block opens and that close a fixed time later.

Everything that happens to the block until then belongs to the window; the next event after it opens another. This is
not a session: an event never prolongs the window it falls into.

Most blocks have few events. Those are folded in one aggregation inside the JVM. A block with more than `limit` events
is cut along time instead, so that none of its tasks sees more than `span` window lengths of it: each piece first tells
how any window reaching into it would leave it, the pieces are chained, and each piece is then resolved on its own.

The chain is a tree. What `FAN` pieces in a row do to a window that reaches into the first is again such a passage, so
passages are composed level by level until a block has few left; the entries then come down the same way. No task sees
more than `FAN` passages, and a passage has no more steps than a window has instants.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockledger.functions.columns import interval_micros, micros, time_slot
from blockledger.operators.joins import split_heavy
from blockledger.schema import BACKUP_AGE, ID, KEY, RESTORE_TTL
from blockledger.session import materialize

LIGHT_EVENTS = 2_000
SPAN = 8
FAN = 64
NEVER = np.iinfo(np.int64).min // 2


def anchored_windows(
    events: DataFrame, age: str, on=tuple(ID), inclusive=True, limit=LIGHT_EVENTS, span=SPAN, fan=FAN
) -> DataFrame:
    """One row per window: block, opening time, longest version, number of events.

    Of versions of one length the earliest is taken, and of those of one instant the highest generation.

    `inclusive` says whether an event exactly `age` after the opening still belongs to the window.
    """
    on = list(on)
    rest = [c for c in KEY if c not in on and c != "length"]
    rows = events.select(
        *on, micros("ts").alias("_ts"), F.col("length").alias("_len"), *[F.col(c).alias(f"_{c}") for c in rest]
    )
    light, heavy = split_heavy(rows, on, limit)
    width = interval_micros(age)
    windows = _fold(light, on, rest, width, inclusive)
    if heavy is not None:
        windows = windows.unionByName(_pieces(heavy, on, rest, width, inclusive, span, fan))
    opened = F.timestamp_micros("_t0")
    return windows.select(
        *[F.col(c if c in on else "_len" if c == "length" else f"_{c}").alias(c) for c in KEY],
        opened.alias("opened_ts"),
        F.timestamp_micros(F.col("_t0") + F.lit(width)).alias("due_ts"),
        "n_events",
    )


def _fold(rows, on, rest, width, inclusive):
    """Sorted list of one block's events, at most `limit` of them, folded into windows."""
    types = dict(rows.dtypes)
    versions = "".join(f", _{c} {types[f'_{c}']}" for c in rest)
    window = f"struct<_t0: bigint, _len: bigint, n_events: bigint{versions.replace(' ', ': ').replace(',: ', ', ')}>"
    fields = ["_t0", "_len", "n_events", *[f"_{c}" for c in rest]]
    # Events of one instant: the longer version first, the higher generation among equals, as everywhere else.
    event = F.struct("_ts", (-F.col("_len")).alias("_neg"), *[(-F.col(f"_{c}")).alias(f"_{c}") for c in rest])
    start = F.struct(
        F.lit(None).cast(window).alias("open"), F.array().cast(f"array<{window}>").alias("closed")
    )

    def opened_by(e):
        values = [e["_ts"], -e["_neg"], F.lit(1).cast("bigint"), *[-e[f"_{c}"] for c in rest]]
        return F.struct(*[v.alias(f) for v, f in zip(values, fields)])

    def joined(w, e):
        longer = -e["_neg"] > w["_len"]
        values = [
            w["_t0"],
            F.greatest(w["_len"], -e["_neg"]),
            w["n_events"] + 1,
            *[F.when(longer, -e[f"_{c}"]).otherwise(w[f"_{c}"]) for c in rest],
        ]
        return F.struct(*[v.alias(f) for v, f in zip(values, fields)])

    def step(acc, e):
        w = acc["open"]
        end = w["_t0"] + F.lit(width)
        inside = (e["_ts"] <= end) if inclusive else (e["_ts"] < end)
        return (
            F.when(w.isNull(), F.struct(opened_by(e).alias("open"), acc["closed"].alias("closed")))
            .when(inside, F.struct(joined(w, e).alias("open"), acc["closed"].alias("closed")))
            .otherwise(
                F.struct(opened_by(e).alias("open"), F.concat(acc["closed"], F.array(w)).alias("closed"))
            )
        )

    folded = F.aggregate(
        F.array_sort(F.collect_list(event)), start, step, lambda acc: F.concat(acc["closed"], F.array(acc["open"]))
    )
    lists = rows.groupBy(*on).agg(folded.alias("w"))
    return lists.select(*on, F.inline("w"))


def _next_start(ts, width, side):
    """For each event, the position of the event that would open the next window."""
    return np.searchsorted(ts, ts + width, side=side)


def _passed(upto, leave, busy, side):
    """When a window that is open until `busy` on entering, or its followers, will have closed on leaving."""
    if not len(upto):
        return busy
    at = np.searchsorted(upto, busy, side=side)
    return np.where(at < len(upto), leave[np.minimum(at, len(upto) - 1)], busy)


def _composed(first, then, reach, side):
    """The passage through two stretches in a row, for entries up to `reach`: steps of (last entry, leaving time)."""
    (upto, leave), (later, later_leave) = first, then
    leave = _passed(later, later_leave, leave, side)
    if not len(upto) or np.searchsorted(upto, reach, side=side) == len(upto):
        upto, leave = np.concatenate([upto, later]), np.concatenate([leave, later_leave])
        end = np.searchsorted(upto, reach, side=side) + 1
        upto, leave = upto[:end], leave[:end]
    last = np.append(np.flatnonzero(np.diff(leave)), len(leave) - 1)
    return upto[last], leave[last]


def _steps(pdf: pd.DataFrame):
    """The passages of a frame in order of time."""
    longs = [pdf[c].map(lambda x: np.asarray(x, dtype="int64")) for c in ("_upto", "_leave")]
    return list(zip(*longs, strict=True))


def _entries(passages: DataFrame, on, side, fan) -> DataFrame:
    """For each piece, until when the windows that begin before it are open."""
    spot = [passages.schema[c] for c in on] + [T.StructField("_cut", T.LongType())]
    row = T.StructType(passages.schema.fields)
    above = F.expr(f"(_cut - pmod(_cut, {fan}L)) div {fan}L")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_cut")
        steps, out = _steps(pdf), pdf.iloc[:1].copy()
        reach, made = int(out["_reach"].iloc[0]), steps[0]
        for step in steps[1:]:
            made = _composed(made, step, reach, side)
        out["_cut"], out["_upto"], out["_leave"] = out["_above"], [made[0].tolist()], [made[1].tolist()]
        return out[row.names]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_cut")
        busy, entries = int(pdf["_from"].iloc[0]), []
        for upto, leave in _steps(pdf):
            entries.append(busy)
            busy = int(_passed(upto, leave, np.int64(busy), side))
        return pdf[[*on, "_cut"]].assign(_entry=np.asarray(entries, dtype="int64"))

    chained = T.StructType(spot + [T.StructField("_entry", T.LongType())])
    levels = [materialize(passages)]
    low, high = levels[0].agg(F.min("_cut"), F.max("_cut")).first()
    while high // fan > low // fan:
        below = levels[-1].withColumn("_above", above)
        levels.append(materialize(below.groupBy(*on, "_above").applyInPandas(compose, row)))
        low, high = low // fan, high // fan
    top = levels.pop().withColumn("_from", F.lit(NEVER).cast("long"))
    entries = top.groupBy(*on).applyInPandas(chain, chained)
    while levels:
        given = levels.pop().withColumn("_above", above)
        with_entry = _at_piece(given, entries, on, "_above").withColumnRenamed("_entry", "_from")
        entries = with_entry.groupBy(*on, "_above").applyInPandas(chain, chained)
    return entries


def _at_piece(rows: DataFrame, entries: DataFrame, on, cut) -> DataFrame:
    """`rows` with the `_entry` of their piece, whose number is in the column `cut`; nulls are a block like others."""
    entries = entries.select(*[F.col(c).alias(f"_of_{c}") for c in on], F.col("_cut").alias("_of_cut"), "_entry")
    met = F.col(cut) == F.col("_of_cut")
    for c in on:
        met = met & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(entries, met).select(*rows.columns, "_entry")


def _pieces(rows, on, rest, width, inclusive, span, fan):
    side = "right" if inclusive else "left"
    key_fields = [rows.schema[c] for c in on]
    cut = time_slot("_ts", width * span)
    # Events of one instant collapse first, on the map side: a piece holds at most one point per clock tick.
    best = F.max(F.struct("_len", *[F.col(f"_{c}") for c in rest])).alias("b")
    points = (
        rows.groupBy(*on, "_ts")
        .agg(F.count("*").alias("_n"), best)
        .select(*on, cut.alias("_cut"), "_ts", "_n", "b._len", *[f"b._{c}" for c in rest])
    )

    def passage(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["_ts"].to_numpy())
        nxt = _next_start(ts, width, side)
        last = np.where(nxt < len(ts), nxt, np.arange(len(ts)))
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        begin = int(pdf["_cut"].iloc[0]) * width * span
        reach = min(np.searchsorted(ts, begin + width, side=side) + 1, len(ts))
        leave = ts[last[:reach]] + width
        change = np.append(np.flatnonzero(np.diff(leave)), reach - 1)
        out = pdf[[*on, "_cut"]].iloc[:1].copy()
        out["_upto"], out["_leave"], out["_reach"] = [ts[change].tolist()], [leave[change].tolist()], begin + width
        return out

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_ts")
        ts, entry = pdf["_ts"].to_numpy(), int(pdf["_entry"].iloc[0])
        nxt = _next_start(ts, width, side)
        starts, i = [], int(np.searchsorted(ts, entry, side=side))
        while i < len(ts):
            starts.append(int(ts[i]))
            i = int(nxt[i])
        where = np.searchsorted(np.asarray(starts, dtype="int64"), ts, side="right") - 1
        opened = np.append(np.asarray(starts, dtype="int64"), entry - width)[where]
        pdf = pdf.assign(_t0=opened)
        total = pdf.groupby("_t0")["_n"].sum()
        first = pdf.sort_values(["_len", "_ts"], ascending=[False, True], kind="stable").drop_duplicates("_t0")
        return first.assign(_n=first["_t0"].map(total))[[*on, "_t0", "_ts", "_n", "_len", *[f"_{c}" for c in rest]]]

    longs = T.ArrayType(T.LongType())
    spot = key_fields + [T.StructField("_cut", T.LongType())]
    passages = points.groupBy(*on, "_cut").applyInPandas(
        passage,
        T.StructType(
            spot
            + [T.StructField("_upto", longs), T.StructField("_leave", longs), T.StructField("_reach", T.LongType())]
        ),
    )
    entries = _entries(passages, on, side, fan)
    parts = (
        _at_piece(points, entries, on, "_cut")
        .groupBy(*on, "_cut")
        .applyInPandas(
            resolve,
            T.StructType(
                key_fields
                + [T.StructField(c, T.LongType()) for c in ("_t0", "_ts", "_n", "_len")]
                + [points.schema[f"_{c}"] for c in rest]
            ),
        )
    )
    pick = F.max(F.struct("_len", (-F.col("_ts")).alias("_when"), *[F.col(f"_{c}") for c in rest])).alias("b")
    return (
        parts.groupBy(*on, "_t0")
        .agg(F.sum("_n").alias("n_events"), pick)
        .select(*on, "_t0", "b._len", "n_events", *[f"b._{c}" for c in rest])
    )


def coalesce_requests(events: DataFrame, age=BACKUP_AGE, on=tuple(ID), **tuning) -> DataFrame:
    """One delayed backup request per window; the longest version seen in it is the one to copy."""
    return anchored_windows(events, age, on, inclusive=True, **tuning)


def ttl_dedupe(requests: DataFrame, ttl=RESTORE_TTL, **tuning) -> DataFrame:
    """Accepted requests: a repeat is ignored until `ttl` has passed since the last accepted one."""
    windows = anchored_windows(requests, ttl, KEY, inclusive=False, **tuning)
    return windows.select(*KEY, F.col("opened_ts").alias("ts"), (F.col("n_events") - 1).alias("n_ignored"))
