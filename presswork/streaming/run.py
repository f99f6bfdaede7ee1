"""Running a stream over what is available now, and reading what it has put out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's spark.checkpoint.dir; where none is set a local session gets a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='presswork-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def open_stream(spark: SparkSession, path: str, schema: StructType, batch: int = 256 << 20) -> DataFrame:
    """A stream of Parquet files; path may be a pattern. A micro-batch takes files of about `batch` bytes, which bounds what
    a stateful operator holds of one key at a time; files come in the order of their times."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch)).parquet(path)


def drain(stream: DataFrame, mode: str, state: str | None = None) -> DataFrame:
    """Runs the stream on all that is there. append: every row put out; complete: the last state of the result.

    state: the folder in which a stream remembers what it has read; with that of an earlier run only what is new is put out.
    """
    spark, out = stream.sparkSession, work_folder(stream.sparkSession)
    last = []

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        last.append(epoch)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", state or f"{out}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    epochs = last[-1:] if mode == "complete" else sorted(set(last))
    return spark.read.schema(stream.schema).parquet(*(f"{out}/rows/epoch={e}" for e in epochs))


def changes_only(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, value of the rows whose value is not that of the row before, for each key.

    The state of a key is its last value. A micro-batch's rows are taken in order; a row that comes in a later batch
    than its successors is held against the last value seen.
    """
    import pandas as pd

    kinds = dict(stream.dtypes)

    def run(_, frames, state):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before = rows[value].shift(1)
        if len(rows):
            before.iloc[0] = last
        state.update((rows[value].iloc[-1],))
        yield rows[rows[value] != before][[key, order, value]]

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"
    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, out, f"last {kinds[value]}", "append", "NoTimeout")


def cache_hits(stream: DataFrame, key: str, order: str, seconds: int) -> DataFrame:
    """key, order, hit: whether an entry for the key was stored less than `seconds` before (X6); a miss stores one."""
    import pandas as pd

    kinds = dict(stream.dtypes)

    def run(_, frames, state):
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        hits = []
        for at in rows[order]:
            hits.append(stored is not None and (at.timestamp() - stored) < seconds)
            stored = stored if hits[-1] else at.timestamp()
        state.update((stored,))
        yield rows.assign(hit=hits)[[key, order, "hit"]]

    return stream.select(key, order).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, hit boolean", "stored double", "append", "NoTimeout")


def gated_flush(stream: DataFrame, key: str, order: str, text: str, seconds: int, least: int) -> DataFrame:
    """key, at, flushed: every `seconds` a key's buffer of texts is put out and cleared if it has `least` characters or more.

    A tick is told by the first row at or after it; the state of a key is its buffer and the tick that comes next. What
    is left in a buffer when the stream ends stays in the state.
    """
    import pandas as pd

    kinds = dict(stream.dtypes)

    def run(_, frames, state):
        buffer, tick = state.get if state.exists else ("", None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for _, row in rows.iterrows():
            now = int(row[order].timestamp())
            if tick is not None and now >= tick and len(buffer) >= least:
                out.append((row[key], tick, buffer))
                buffer = ""
            if tick is None or now >= tick:
                tick = now // seconds * seconds + seconds
            buffer += row[text] or ""
        state.update((buffer, tick))
        yield pd.DataFrame(out, columns=[key, "at", "flushed"])

    return stream.select(key, order, text).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, at long, flushed string", "buffer string, tick long", "append", "NoTimeout")
