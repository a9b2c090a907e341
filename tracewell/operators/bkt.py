"""Knowledge tracing over (learner, skill) sequences.

Sequences are stored in pieces of bounded length, so a sequence of any length is spread
over many rows and tasks. A sequence that fits one piece is filtered directly. For a longer
one each piece is first reduced to its effect on the start state (three numbers), the
effects are chained by prefix doubling, and every piece is then filtered from its own exact
start state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import recursion as R
from tracewell.functions.cleaning import DAY_MS
from tracewell.operators.skew import lookup_join, materialise

PIECE_CONF = "spark.tracewell.pieceEvents"
PIECE_DEFAULT = 1024
MODEL_COLUMNS = ["p_init", "p_learn", "slip", "guess", "lambda_per_day"]


def piece_events(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(PIECE_CONF, str(PIECE_DEFAULT)))


def sequence_pieces(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per piece: ``events`` is an ordered array of at most ``piece_events`` structs.

    Needs ``within_skill_index`` (dense, from 0), ``gap_ms`` and ``is_correct``."""
    size = piece_events(events)
    event = F.struct(
        F.col("within_skill_index").alias("i"), F.col("gap_ms").alias("gap_ms"), F.col("is_correct").cast("int").alias("y")
    )
    piece = F.floor(F.col("within_skill_index") / size).cast("int").alias("piece")
    return events.groupBy(*keys, piece).agg(F.array_sort(F.collect_list(event)).alias("events"))


def is_long(df: DataFrame) -> Column:
    """Pieces of sequences that may continue: later pieces, and full first pieces."""
    return (F.col("piece") > 0) | (F.size("events") >= piece_events(df))


def _flat(batch: pa.RecordBatch):
    """Ragged event arrays of a batch, longest sequence first."""
    lists = batch.column("events")
    offsets = np.asarray(lists.offsets)
    # offsets are relative to the list's child array, which ``values`` exposes whole
    events = lists.values
    length = np.diff(offsets)
    days = np.asarray(events.field("gap_ms")).astype(float) / DAY_MS
    y = np.asarray(events.field("y"))
    order = R.longest_first(length)
    return events, offsets[:-1], length, days, y, order


def _parameters(batch: pa.RecordBatch, order: np.ndarray, names: Sequence[str]) -> list[np.ndarray]:
    return [np.asarray(batch.column(n)).astype(float)[order] for n in names]


def _score_batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        events, first, length, _, y, order = _flat(batch)
        gap_ms = np.asarray(events.field("gap_ms")).astype(float)
        start, *rest = _parameters(batch, order, ["entry", *MODEL_COLUMNS[1:]])
        prediction, after, _, _ = R.forward(start, first[order], length[order], gap_ms, y, *rest)
        low, high = int(first[0]), int(first[-1] + length[-1])
        rows = pa.array(np.repeat(np.arange(batch.num_rows), length))
        columns = [batch.column(k).take(rows) for k in keys]
        part = events.slice(low, high - low)
        columns += [part.field("i"), part.field("gap_ms"), part.field("y")]
        columns += [pa.array(prediction[low:high]), pa.array(after[low:high])]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "within_skill_index", "gap_ms", "y", "prediction", "state"])


def _effect_batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        events, first, length, _, y, order = _flat(batch)
        gap_ms = np.asarray(events.field("gap_ms")).astype(float)
        rest = _parameters(batch, order, MODEL_COLUMNS[1:])
        n = batch.num_rows
        back = np.argsort(order)
        ends, totals = [], []
        for start in (1.0, 0.0):
            _, _, end, total = R.forward(np.full(n, start), first[order], length[order], gap_ms, y, *rest)
            ends.append(end[back])
            totals.append(total[back])
        columns = [batch.column(k) for k in keys]
        columns += [pa.array(ends[0]), pa.array(ends[1]), pa.array(totals[1] - totals[0])]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, "end_1", "end_0", "log_ratio"])


def _mix(state: Column, end_1: Column, end_0: Column, ratio: Column) -> tuple[Column, Column]:
    """(end state, log-likelihood relative to a start state of 1) when entering at ``state``."""
    zero = F.lit(0.0)
    w1 = state * F.exp(-F.greatest(ratio, zero))
    w0 = (F.lit(1.0) - state) * F.exp(F.least(ratio, zero))
    total = F.greatest(w1 + w0, F.lit(1e-300))
    return (w1 * end_1 + w0 * end_0) / total, F.greatest(ratio, zero) + F.ln(total)


def _chain_effects(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Effect of pieces 0..k for every k, by prefix doubling: log2(pieces) rounds of an
    evenly spread equi-join, each written out so the plan does not grow."""
    current = materialise(effects)
    last = current.agg(F.max("piece")).first()[0] or 0
    step = 1
    while step <= last:
        earlier = current.select(
            *keys, (F.col("piece") + step).alias("piece"),
            *[F.col(c).alias(f"e_{c}") for c in ("end_1", "end_0", "log_ratio")],
        )
        joined = current.join(earlier, [*keys, "piece"], "left")
        end_1, gain_1 = _mix(F.col("e_end_1"), F.col("end_1"), F.col("end_0"), F.col("log_ratio"))
        end_0, gain_0 = _mix(F.col("e_end_0"), F.col("end_1"), F.col("end_0"), F.col("log_ratio"))
        fresh = F.col("e_end_1").isNull()
        current = materialise(
            joined.select(
                *keys, "piece",
                F.when(fresh, F.col("end_1")).otherwise(end_1).alias("end_1"),
                F.when(fresh, F.col("end_0")).otherwise(end_0).alias("end_0"),
                F.when(fresh, F.col("log_ratio")).otherwise(F.col("e_log_ratio") + gain_0 - gain_1).alias("log_ratio"),
            )
        )
        step *= 2
    return current


def filter_sequences(pieces: DataFrame, parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prediction before and state after every event, for each model in ``parameters``.

    ``parameters``: one row per (skill_id, model) with MODEL_COLUMNS. ``keys`` must contain
    ``skill_id`` and identify a sequence. For long sequences slip and guess must lie in
    [1e-12, 1 - 1e-12], where the recursion is linear in the start state."""
    models = parameters.groupBy("skill_id").agg(F.collect_list(F.struct("model", *MODEL_COLUMNS)).alias("models"))
    joined = lookup_join(pieces, models, ["skill_id"], "inner")
    rows = joined.withColumn("m", F.explode("models")).select(*keys, "piece", "events", "m.*")
    out_keys = [*keys, "model"]
    key_fields = [rows.schema[k] for k in out_keys]
    double = T.DoubleType()

    long = is_long(rows)
    entry = rows.withColumn("entry", F.col("p_init"))
    if not pieces.where(is_long(pieces)).isEmpty():
        effect_schema = T.StructType(
            [*key_fields, T.StructField("piece", T.IntegerType()), *[T.StructField(c, double) for c in ("end_1", "end_0", "log_ratio")]]
        )
        effect_keys = [*out_keys, "piece"]
        effects = rows.where(long).mapInArrow(lambda it: _effect_batches(it, effect_keys), effect_schema)
        chained = _chain_effects(effects, out_keys).withColumn("piece", F.col("piece") + 1)
        joined = rows.where(long).join(chained, [*out_keys, "piece"], "left")
        state, _ = _mix(F.col("p_init"), F.col("end_1"), F.col("end_0"), F.col("log_ratio"))
        started = joined.withColumn("entry", F.when(F.col("piece") == 0, F.col("p_init")).otherwise(state))
        entry = entry.where(~long).unionByName(started.select(*entry.columns))

    schema = T.StructType(
        [*key_fields, T.StructField("within_skill_index", T.LongType()), T.StructField("gap_ms", T.LongType()),
         T.StructField("y", T.IntegerType()), T.StructField("prediction", double), T.StructField("state", double)]
    )
    return entry.mapInArrow(lambda it: _score_batches(it, out_keys), schema)


def final_states(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after the last event and the log-likelihood of each sequence."""
    likelihood = F.when(F.col("y") == 1, F.ln("prediction")).otherwise(F.log1p(-F.col("prediction")))
    return scored.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by("state", "within_skill_index").alias("state"),
        F.sum(likelihood).alias("log_likelihood"),
    )
