"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed hash and queue up, up to ``REPEATS`` times
over. A copy's virtual finish time is the cumulative length of its source's queue up to its
end, divided by the source's target. Copies of all sources are sorted by that time over the
whole table, and the mix takes them until the total budget is reached. As the order is cut
at one place, a document's copies are those whose key isn't above the key at the cut, so the
documents are never joined with their copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, Scratch, one, running_total

REPEATS = 3
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(scratch: Scratch, sizes: DataFrame) -> DataFrame:
    """(source, source_size, place, weight, target) from (source, source_size).

    Sources in code point order, null last, have the weights 1, 2, 3 in turn and share the
    sum of all sizes. A target stops at ``REPEATS`` times its source's size, and what lies
    above goes to the others by weight, until none is above. Every source is a row of a
    distributed table; each round is one aggregate.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = running_total(scratch, sizes, order, F.lit(1), "place")
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    ranked = scratch.save(ranked.withColumn("weight", weights).withColumn("cap", (F.col("source_size") * REPEATS).cast("double")))
    budget = one(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))))[0]
    level, capped = 0.0, -1
    while True:
        stopped = F.col("cap") <= F.col("weight") * level
        row = one(ranked.agg(F.count(F.when(stopped, 1)).alias("n"), F.sum(F.when(stopped, F.col("cap"))).alias("held"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight")))
        if row["n"] == capped or not row["weight"]:
            break
        capped, level = row["n"], (budget - (row["held"] or 0.0)) / row["weight"]
    return ranked.select("source", "source_size", "place", "weight", F.least("cap", F.col("weight") * level).alias("target"))


def mix(scratch: Scratch, docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, source, size, source_size, target, copies, taken.

    A null text and one without words have size 0 and aren't taken; a null source is a
    source of its own; equal rows count one by one; an empty table gives no row. Ties in
    the shuffle go to the smaller doc_id, then text hash. Other columns are not read.
    """
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    docs = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash"), shuffled.alias("h")))
    goals = scratch.save(targets(scratch, docs.groupBy("source").agg(F.sum("size").alias("source_size"))))
    # What lies before a source in the order of all rows by source.
    goals = scratch.save(running_total(scratch, goals, [F.col("place")], F.col("source_size"), "through"))
    rows = docs.alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source")).select("d.*", "g.source_size", "g.target", "g.place", F.expr("g.through - g.source_size").alias("before"))
    queue = [F.col("place"), F.col("h"), F.col("doc_id"), F.col("text_hash"), F.col("size")]
    rows = running_total(scratch, rows, queue, F.col("size"), "through")
    rows = scratch.save(rows.withColumn("through", F.col("through") - F.col("before")).drop("before"))

    def finish(turn: Column) -> Column:
        return (turn * F.col("source_size") + F.col("through")) / F.col("target")

    def key(turn: Column) -> list[Column]:
        return [finish(turn), F.col("h"), F.col("place"), F.col("doc_id"), F.col("text_hash"), turn]

    copies = rows.filter("size > 0 and target > 0").withColumn("turn", F.explode(F.expr(f"sequence(0, {REPEATS - 1})")))
    names = ["k_finish", "k_h", "k_place", "k_id", "k_text", "k_turn"]
    copies = copies.select(*[c.alias(n) for c, n in zip(key(F.col("turn")), names)], "size")
    copies = running_total(scratch, copies, [F.col(n) for n in names], F.col("size"), "through")
    budget = one(goals.agg(F.sum("source_size")))[0] or 0
    cut = one(copies.filter(F.col("through") <= budget).agg(F.max(F.struct(*names)).alias("cut")))["cut"]
    if cut is None:
        taken = F.lit(0)
    else:
        types = dict(copies.dtypes)
        last = F.struct(*[F.lit(cut[n]).cast(types[n]).alias(n) for n in names])
        taken = sum((F.when(F.struct(*[c.alias(n) for c, n in zip(key(F.lit(t)), names)]) <= last, 1).otherwise(0) for t in range(REPEATS)), F.lit(0))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0)
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("int").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(scratch: Scratch, docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them.

    Rows that agree in doc_id, source and text are told apart by nothing, so together they
    come as often as the mix takes them.
    """
    taken = mix(scratch, docs, seed).filter("copies > 0")
    taken = taken.groupBy("doc_id", "source", "text_hash").agg(F.sum("copies").alias("__mix_copies"))
    taken = scratch.save(taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__text"), "__mix_copies"), keep=True)
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    numbered = docs.withColumn("__mix_hash", text)
    same = numbered["doc_id"].eqNullSafe(taken["__id"]) & numbered["source"].eqNullSafe(taken["__source"]) & (numbered["__mix_hash"] == taken["__text"])
    # What is taken grows with the documents, so the join is a shuffle at every size.
    joined = numbered.join(taken.hint("merge"), same)
    if _repeated(docs):
        joined = joined.dropDuplicates(["doc_id", "source", "__mix_hash"])
    return joined.withColumn("__mix_turn", F.explode(F.expr("sequence(1, int(__mix_copies))"))).select(*docs.columns)


def _repeated(docs: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    return (one(ids.agg(F.max("n")))[0] or 0) > 1
