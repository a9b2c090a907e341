"""Learning-event views over the shared star-schema tables.

``events`` becomes response logs, ``lineitem`` joined to ``part`` becomes an item bank, and
``lineitem`` becomes a table of experiment replicates. Each view is whole-table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import bayes, bkt, experiments, prepare, reference
from tracewell.operators.skew import hot_groups, materialise, prefix, task_rows

EXTREME_ELAPSED_MS = 300_000
DEPLOYED_MS = 1_704_500_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """events with the JSON key and millisecond time decoded."""
    events = table(spark, sf, "events")
    epoch = "timestamp_ntz'1970-01-01 00:00:00'"
    millis = F.expr(f"(cast(ts as timestamp_ntz) - {epoch}) div interval '0.001' second")
    return events.select(
        F.col("user_id").alias("learner_id"),
        millis.cast("long").alias("ts_ms"),
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )


def hot_learners(spark: SparkSession, sf: str) -> tuple[list, int]:
    """Learners too large for one task. The row count of ``events`` comes from file footers;
    the log has at most two rows per event, so small tables need no further pass."""
    events = event_rows(spark, sf)
    rows, limit = task_rows(events)
    if 2 * rows <= limit:
        return [], limit
    return hot_groups(events.select("learner_id"), ["learner_id"])


def hot_pairs(spark: SparkSession, sf: str) -> tuple[list, int] | None:
    """No (learner, skill) pair can be hot when no learner is; otherwise not yet known."""
    hot = hot_learners(spark, sf)
    return None if hot[0] else hot


def raw_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Question metadata as strings, one per distinct key below 99."""
    k = F.col("k")
    keys = event_rows(spark, sf).select("k").where(k < 99).distinct()
    tags = (
        F.when(k % 10 == 0, "")
        .when(k % 10 == 1, F.concat_ws(";", (k % 5).cast("string"), ((k + 1) % 5).cast("string")))
        .otherwise((k % 5).cast("string"))
    )
    return keys.select(
        F.concat(F.lit("q"), k).alias("question_id"),
        F.concat(F.lit("b"), F.floor(k / 3)).alias("bundle_id"),
        F.lit("").alias("explanation_id"),
        F.substring(F.lit("abcd"), 1 + k % 4, 1).alias("correct_answer"),
        (1 + k % 7).cast("string").alias("part"),
        tags.alias("tags"),
        F.when(k % 7 == 0, str(DEPLOYED_MS)).otherwise("-1").alias("deployed_at"),
    )


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Response log as strings, with repeats, gaps and disorder derived from event ids."""
    e = event_rows(spark, sf)
    copies = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = e.withColumn("dup", F.explode(copies))
    shifted = F.col("ts_ms") + F.when(F.col("event_id") % 41 == 0, 259_200_000).otherwise(0)
    placed = prefix(
        rows.withColumn("file_ms", shifted), ["learner_id"], ["file_ms", "event_id", "dup"], count="__position",
        hot=hot_learners(spark, sf),
    )
    k, event = F.col("k"), F.col("event_id")
    letter = lambda n: F.substring(F.lit("abcd"), 1 + n % 4, 1)
    answer = F.when(event % 97 == 0, "z").when(F.col("value") > 35, letter(k)).otherwise(letter(k + 1))
    elapsed = F.when(event % 89 == 0, F.lit(-1).cast("long")).otherwise(F.floor(F.col("value") * 1000))
    return placed.select(
        "learner_id",
        F.concat(F.lit("u"), "learner_id", F.lit(".csv")).alias("source_file"),
        (F.col("__position") + 2).alias("source_row"),
        F.when(event % 211 != 0, F.col("ts_ms")).cast("string").alias("timestamp"),
        F.floor(event / 3).cast("string").alias("solving_id"),
        F.concat(F.lit("q"), k).alias("question_id"),
        answer.alias("user_answer"),
        elapsed.cast("string").alias("elapsed_time"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised question metadata. Stored, as the table would be in production: otherwise
    filters on it are pushed through the distinct and parse the tags of every event."""
    return materialise(prepare.normalize_questions(raw_questions(spark, sf)))


def cleaned(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """The cleaned log; ``known`` questions that are stored already are not read from the events again."""
    raw, known = raw_responses(spark, sf), questions(spark, sf) if known is None else known
    return prepare.interactions(raw, known, EXTREME_ELAPSED_MS, hot=hot_learners(spark, sf))


def sequenced(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.sequence_responses(prepare.parse_responses(raw_responses(spark, sf)), hot_learners(spark, sf))


def usable(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    return reference.usable(cleaned(spark, sf, known))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate-item events with position and gap per (learner, skill)."""
    build = Build(spark, sf)
    return reference.event_sequences(build.events, build.hot_pairs)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return reference.pair_groups(sequences(spark, sf))


class Build:
    """Tables of one reference build. The usable rows are written once to the shared folder
    and every later pass reads that table, as the passes of a production build would."""

    def __init__(self, spark: SparkSession, sf: str):
        self.questions = questions(spark, sf)
        self.usable = materialise(usable(spark, sf, self.questions))
        self.hot_pairs = hot_pairs(spark, sf)

    @cached_property
    def counts(self) -> DataFrame:
        return materialise(reference.item_counts(self.usable))

    @cached_property
    def config(self) -> reference.BuildConfig:
        return reference.small_config(self.counts)

    @cached_property
    def items(self) -> DataFrame:
        return reference.candidate_items(reference.eligible_items(self.counts, self.questions, self.config), self.config)

    @cached_property
    def events(self) -> DataFrame:
        """Usable rows of candidate items; everything after the item screen reads these."""
        return reference.candidate_events(self.usable, self.items)

    @cached_property
    def sequences(self) -> DataFrame:
        return materialise(reference.event_sequences(self.events, self.hot_pairs))

    @cached_property
    def groups(self) -> DataFrame:
        return reference.pair_groups(self.sequences)

    @cached_property
    def tiers(self) -> DataFrame:
        stats = reference.skill_statistics(self.groups).join(reference.item_distribution(self.items), "skill_id")
        return materialise(reference.skill_tiers(stats, self.config))

    @cached_property
    def scored(self) -> DataFrame:
        return reference.score_skills(self.tiers, self.config)

    @cached_property
    def selected(self) -> DataFrame:
        return reference.top_skills(self.scored, self.config)

    @cached_property
    def pairs(self) -> DataFrame:
        return reference.select_pairs(self.groups, self.selected, self.config)

    @cached_property
    def selected_items(self) -> DataFrame:
        return reference.selected_items(self.items, self.selected)

    @cached_property
    def selected_questions(self) -> DataFrame:
        return reference.selected_questions(self.questions, self.selected_items)

    @cached_property
    def reference_interactions(self) -> DataFrame:
        kept = reference.selected_questions(self.sequences, self.selected_items)
        return reference.reference_interactions(kept, materialise(self.pairs))


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """Item bank: one row per part that was sold, with skill = brand number."""
    sold = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("interaction_rows"), F.count_if(F.col("l_quantity") > 25).alias("correct_rows")
    )
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.substring_index("p_brand", "#", -1).cast("int").alias("skill_id"),
        (F.col("p_size") % 7).alias("part"),
    )
    joined = sold.join(parts, "l_partkey")
    return joined.select(
        F.concat(F.lit("q"), "l_partkey").alias("question_id"),
        "skill_id",
        "part",
        "interaction_rows",
        "correct_rows",
        (F.col("correct_rows") / F.col("interaction_rows")).alias("accuracy"),
    )


def learner_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per simulated learner outcome: world, policy, replicate, order and scores."""
    value = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e5
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("world_model"),
        F.concat(F.lit("p"), "l_linenumber").alias("policy"),
        (F.col("l_orderkey") % 10).alias("replicate"),
        (F.col("l_suppkey") % 3).alias("order_id"),
        (F.col("l_quantity") / 50).alias("initial_latent"),
        value.alias("delayed_latent"),
        (F.col("l_quantity") * 0.02).alias("delayed_expected"),
        (F.col("l_discount") * 10).alias("delayed_observed"),
        F.col("l_tax").alias("practice_accuracy"),
    )


def fits(spark: SparkSession, sf: str) -> DataFrame:
    """A model-fit table: one BKT-F row per brand, parameters and errors from its sales."""
    sold = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(
            F.col("p_partkey").alias("l_partkey"), F.substring_index("p_brand", "#", -1).cast("int").alias("skill_id")
        ),
        "l_partkey",
    )
    s = F.col("skill_id")
    per_skill = sold.groupBy("skill_id").agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"),
        (F.stddev_samp(F.col("l_quantity") / 50) / F.sqrt(F.count(F.lit(1)))).alias("e"),
    )
    return per_skill.select(
        "skill_id",
        F.lit("BKT-F").alias("model"),
        (F.lit(0.15) + s * 0.02 + F.col("q") / 500).alias("p_init"),
        (F.lit(0.02) + s * 0.004 + F.col("d") / 5).alias("p_learn"),
        (F.lit(0.10) + s * 0.006 + F.col("t") / 4).alias("slip"),
        (F.lit(0.25) + s * 0.01 + F.col("q") / 1000).alias("guess"),
        (F.lit(0.0005) + s * 0.00004 + F.col("d") / 200).alias("lambda_per_day"),
        F.col("e").alias("se_p_init_approx"),
        (F.col("e") / 5).alias("se_p_learn_approx"),
        (F.col("e") / 2).alias("se_slip_approx"),
        (F.col("e") / 2).alias("se_guess_approx"),
        (F.col("e") / 500).alias("se_lambda_per_day_approx"),
    )


def bank_skills(spark: SparkSession, sf: str) -> DataFrame:
    skills = bank(spark, sf).select("skill_id").distinct()
    return skills.select("skill_id", F.lit(0.2).alias("guess"), F.lit(0.3).alias("slip"))


def effects(spark: SparkSession, sf: str) -> DataFrame:
    """Item effects of the bank, written once for the passes over them."""
    return materialise(bayes.item_effects(materialise(bank(spark, sf)), bank_skills(spark, sf)))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Order-replicate metrics of the experiment table."""
    metrics = ["initial_latent", "delayed_latent", "delayed_observed", "delayed_expected", "practice_accuracy"]
    return materialise(experiments.aggregate_learners(learner_outcomes(spark, sf), metrics))


def beliefs(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered belief, last practice and count per learner and skill."""
    seq = materialise(sequences(spark, sf))
    keys = ["learner_id", "skill_id"]
    models = seq.select("skill_id").distinct().select(
        "skill_id", F.lit("BKT-F").alias("model"), F.lit(0.3).alias("p_init"), F.lit(0.1).alias("p_learn"),
        F.lit(0.1).alias("slip"), F.lit(0.2).alias("guess"), F.lit(0.02).alias("lambda_per_day"),
    )
    states = bkt.final_states(bkt.filter_sequences(bkt.sequence_pieces(seq, keys), models, keys), keys)
    last = seq.groupBy(*keys).agg(F.max("timestamp_ms").alias("last_practised_ms"))
    return states.join(last, keys).select(
        *keys, F.col("state").alias("belief"), "last_practised_ms", F.col("events").alias("practice_count"),
        F.lit(0.02).alias("lambda_per_day"),
    )


NOW_MS = 1_735_689_600_000


def item_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Nine bins per skill of the response log, shifts -1 to 1 plus a small skill offset."""
    skills = questions(spark, sf).where(F.col("skill_count") == 1).select(F.col("primary_skill_id").alias("skill_id")).distinct()
    rows = skills.withColumn("item_bin", F.explode(F.sequence(F.lit(0), F.lit(8))))
    shift = (F.col("item_bin") - 4) / 4.0 + F.col("skill_id") * 0.01
    return rows.select("skill_id", "item_bin", shift.alias("shift"), F.lit(0.2).alias("guess"), F.lit(0.1).alias("slip"))
