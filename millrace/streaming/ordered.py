"""Keyed streams in order of event time.

Rows that come late, or out of order, wait in state until the watermark has passed them; then they leave in order and
meet what their key remembers. Keys share lots; a lot's rows wait in short stretches of time, and a few stretches at a time are
read, so a key may hold many rows and a stream many keys. What still waits when the input ends leaves when the stream is closed (``closable``).
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.columns import col
from millrace.session import scratch_folder
from millrace.skew import micros

#: A row of this time closes a stream.
END = "9000-01-01 00:00:00"
#: A delay is cut into this many stretches, in each of which rows wait together.
STRETCHES = 16

#: Keys share this many lots. The rows and the memories of a lot are kept together, so that calls and reads of state follow
#: the lots and stretches, not the keys.
LOTS = 64
#: Rows of a lot that come in one batch are put away about this many at a time; stretches that are due are read
#: together up to this many bytes.
AT_ONCE, BYTES = 100_000, 8_000_000

#: ``step(rows, memory) -> (rows out, what the keys of these rows remember)``: rows of many keys in order of ``__key`` and, in a key,
#: of time; ``memory`` holds what each key remembers so far
Step = Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, pd.Series]]


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpacked(data: bytes) -> pd.DataFrame:
    source, found = io.BytesIO(data), []
    while source.tell() < len(data):
        found.append(pa.ipc.open_stream(source).read_all())
    return pa.concat_tables(found, promote_options="permissive").to_pandas()


class InOrder(StatefulProcessor):
    """Hold a lot's rows by stretches of time; hand stretches to ``step`` once the watermark has passed them."""

    def __init__(self, step: Step, columns: Sequence[str], order: Sequence[str], names: Sequence[str], stretch_ms: int):
        self.step, self.columns, self.order, self.names = step, list(columns), list(order), list(names)
        self.stretch_ms = stretch_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "held binary")
        self.timer = handle.getValueState("timer", "stretch long")  # the earliest that a timer is set for
        self.waiting = handle.getMapState("waiting", "stretch long, part int", "rows binary")

    def _wake_after(self, stretch: int) -> None:
        self.handle.registerTimer((stretch + 1) * self.stretch_ms)
        self.timer.update((stretch,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts: dict[int, int] | None = None
        gathered: list[pd.DataFrame] = []

        def put_away() -> None:
            nonlocal parts
            if parts is None:
                parts = {}
                for number, part in self.waiting.keys():
                    parts[number] = max(parts.get(number, 0), part + 1)
            table = pd.concat(gathered, ignore_index=True)
            gathered.clear()
            stretch = (table["__us"] // (self.stretch_ms * 1000)).to_numpy()
            for number, part in table.groupby(stretch):
                place = (int(number), parts.get(int(number), 0))
                parts[place[0]] = place[1] + 1
                self.waiting.updateValue(place, (_packed(part),))

        for chunk in rows:
            if chunk.empty:  # Spark also calls with no rows
                continue
            chunk.columns = self.columns  # names that open with an underscore get lost on the way
            gathered.append(chunk)
            if sum(map(len, gathered)) >= AT_ONCE:
                put_away()
        if gathered:
            put_away()
        if parts and (not self.timer.exists() or min(parts) < self.timer.get()[0]):
            self._wake_after(min(parts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // self.stretch_ms
        parts: dict[int, list[int]] = {}
        for number, part in self.waiting.keys():
            parts.setdefault(number, []).append(part)
        due = sorted(number for number in parts if number < passed)
        if not due:  # an earlier timer has seen to it
            return
        held = _unpacked(bytes(self.memory.get()[0])) if self.memory.exists() else None
        memory = dict(zip(held["key"], held["held"])) if held is not None else {}
        together: list[bytes] = []
        for number in due:
            for place in ((number, part) for part in parts.pop(number)):
                together.append(bytes(self.waiting.getValue(place)[0]))
                self.waiting.removeKey(place)
            if number != due[-1] and sum(map(len, together)) < BYTES:
                continue
            rows = _unpacked(b"".join(together)).sort_values(["__key", *self.order], ignore_index=True)
            together.clear()
            out, new = self.step(rows, memory)
            memory.update(zip(new.index, new))
            yield out[self.names]
        self.memory.update((_packed(pd.DataFrame({"key": list(memory), "held": list(memory.values())})),))
        if parts:
            self._wake_after(min(parts))
        else:
            self.timer.clear()

    def close(self) -> None:
        pass


def _key(df: DataFrame, keys: Sequence[str]) -> Column:
    """The keys as one text that differs where they do; nulls are equal, as in any grouping."""
    parts = []
    for k in keys:
        kind, c = df.schema[k].dataType, col(k)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # -0.0 is 0.0
        plain = F.hex(c) if isinstance(kind, T.BinaryType) else F.to_json(F.struct(c)) if isinstance(kind, (T.ArrayType, T.StructType)) else c.cast("string")
        parts.append(plain)
    return F.to_json(F.array(*parts)) if parts else F.lit("")


def in_order(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], step: Step, schema: T.StructType, delay: str
) -> DataFrame:
    """``step`` over each key's rows in order of time and ties, whatever the order they come in.

    Rows may come up to ``delay`` after newer ones; later ones, and rows without a time, are left out. State is kept by
    RocksDB; ``run.start_table`` and ``run.drain`` see to it.
    """
    millis = df.sparkSession.sql(f"select timestampdiff(MILLISECOND, timestamp'2001-01-01', timestamp'2001-01-01' + interval {delay})").first()[0]
    stretch = max(1, millis // STRETCHES)
    rows = df.withWatermark(ts, delay)
    # the row that closes the stream moves the watermark and goes no further
    rows = rows.where(col(ts) < F.lit(END).cast("timestamp")).withColumn("__us", micros(col(ts))).withColumn("__key", _key(df, keys))
    rows = rows.withColumn("__lot", F.pmod(F.xxhash64("__key"), F.lit(LOTS)).cast("int"))
    names = [f.name for f in schema]
    work = InOrder(step, rows.columns, ["__us", *ties], names, stretch)
    return rows.groupBy("__lot").transformWithStateInPandas(work, schema, "append", "eventTime")


def ordered_gaps(df: DataFrame, keys: Sequence[str], ts: str, value: str, ties: Sequence[str] = (), delay: str = "10 minutes") -> DataFrame:
    """Add ``gap``: change since the key's row before in time, as ``rate_gap`` has it on the stored table."""

    def step(rows: pd.DataFrame, memory: dict) -> tuple[pd.DataFrame, pd.Series]:
        x, key = rows[value].astype(float), rows["__key"]
        opens = ~key.duplicated()
        before = x.shift(1)
        before[opens] = [memory.get(k, np.nan) for k in key[opens]]
        last = ~key.duplicated(keep="last")
        return rows.assign(gap=x - before), x[last].set_axis(key[last])

    schema = T.StructType([*df.schema.fields, T.StructField("gap", T.DoubleType())])
    return in_order(df, keys, ts, ties, step, schema, delay)


def ordered_cooldown(
    df: DataFrame, keys: Sequence[str], ts: str, period_seconds: int = 120, ties: Sequence[str] = (), delay: str = "10 minutes"
) -> DataFrame:
    """Rows that fire under a cool-down, as ``cooldown`` has it on the stored table, whatever the order they come in."""
    period = period_seconds * 1_000_000

    def step(rows: pd.DataFrame, memory: dict) -> tuple[pd.DataFrame, pd.Series]:
        first = rows.drop_duplicates(["__key", "__us"], keep="first", ignore_index=True)
        code, names = pd.factorize(first["__key"])  # rows of a key stand together
        us = first["__us"].to_numpy(np.int64)
        start, span = int(us.min()), int(us.max() - us.min()) + 1
        place = code * span + (us - start)  # rises from row to row
        ends = np.searchsorted(code, np.arange(len(names)), side="right")
        last = np.array([memory.get(k, -(1 << 62)) for k in names], dtype=np.int64)
        fires, open_keys = np.zeros(len(us), bool), np.arange(len(names))
        while len(open_keys):  # each key's next row after its silence
            free = np.clip(last[open_keys] + period - start, -1, span - 1)
            at = np.searchsorted(place, open_keys * span + free, side="right")
            more = at < ends[open_keys]
            open_keys, at = open_keys[more], at[more]
            fires[at] = True
            last[open_keys] = us[at]
        return first[fires], pd.Series(last, index=names)

    return in_order(df, keys, ts, ties, step, df.schema, delay)


def closable(stream: DataFrame, ts: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream, and a function that ends it: once called, the next run of the query hands out all that waits.

    The end is a row of the time ``END`` (all else null) in a folder that the stream reads too; it moves the watermark past
    all rows. Set watermarks on the result, not before.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, "end")
    spark.createDataFrame([], stream.schema).write.parquet(folder)
    marks = spark.readStream.schema(stream.schema).parquet(folder)

    def close() -> None:
        kind = stream.schema[ts].dataType
        row = [F.lit(END).cast(kind).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
        spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(folder)

    return stream.unionByName(marks), close
