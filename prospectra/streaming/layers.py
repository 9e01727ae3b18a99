"""Verification as a state machine: each business goes through layers in order, batch by batch.

What a business is due for follows from what was observed of it, in whatever order that came. A
batch adds its observations to a table by business and works out anew the state of the businesses
that it touches, by a fold over what is known of each; a batch that runs again, after a restart from
the stream's checkpoint, leaves the tables as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prospectra.sources.buckets import BucketTable

OBSERVATION = "business_id bigint, layer string, at timestamp_ntz, result string, website string"
EVIDENCE = "business_id bigint, source string, result string, website string, checked_at timestamp_ntz"
HISTORY = "business_id bigint, seen array<struct<layer: int, at: timestamp_ntz, result: string, website: string>>"
STATE = "business_id bigint, due_layer string, due_at timestamp_ntz, tries int, done boolean, website string"
#: Failed tries of a layer, after which the next one's turn comes.
MOST_TRIES = 3


class LayerMachine:
    """Tables under ``path``: ``observations``, and the ``evidence`` and ``state`` that follow from them.

    A layer that gives a result is passed; one that finds a website ends the way. An observation
    without a result is a failed try: the layer is due again ``idle_minutes`` later, observations before
    that do not count, and after MOST_TRIES of them the next layer's turn comes. Observations of a
    layer whose turn has not come wait. Repeated observations count once; those of unknown
    layers, without a business or without a time are left out.
    """

    def __init__(self, spark: SparkSession, path: str, layers: list[str], idle_minutes: int = 60, buckets: int = 64):
        self.layers, self.idle = layers, F.make_dt_interval(mins=F.lit(idle_minutes))
        table = lambda name, schema, *keys: BucketTable(spark, f"{path}/{name}", schema, list(keys), buckets)
        self.observations = table("observations", HISTORY, "business_id")
        self.evidence = table("evidence", EVIDENCE, "business_id", "source")
        self.state = table("state", STATE, "business_id")

    def _folded(self, histories: DataFrame) -> DataFrame:
        """(``business_id``, ``m``): the machine of each business after all its observations."""
        used = "array<struct<layer: int, at: timestamp_ntz, result: string, website: string>>"
        start = F.struct(F.lit(0).alias("layer"), F.lit(0).alias("tries"), F.lit(None).cast("timestamp_ntz").alias("last"), F.lit(False).alias("done"), F.array().cast(used).alias("used"))

        def step(m: Column, x: Column) -> Column:
            turn = ~m["done"] & (x["layer"] == m["layer"]) & (m["last"].isNull() | (x["at"] >= m["last"] + self.idle))
            failed = x["result"].isNull()
            passed = ~failed | (m["tries"] + 1 >= MOST_TRIES)
            after = F.struct(
                F.when(passed, m["layer"] + 1).otherwise(m["layer"]).alias("layer"), F.when(passed, 0).otherwise(m["tries"] + 1).alias("tries"), F.when(~passed, x["at"]).alias("last"),
                (~failed & x["website"].isNotNull()).alias("done"), F.when(failed, m["used"]).otherwise(F.concat(m["used"], F.array(x))).alias("used"),
            )
            return F.when(turn, after).otherwise(m)

        return histories.select("business_id", F.aggregate("seen", start, step).alias("m"))

    def step(self, batch: DataFrame) -> None:
        """Take in a batch of observations."""
        number = F.array_position(F.array(*[F.lit(x) for x in self.layers]), F.col("layer")).cast("int") - 1
        known = batch.filter(F.col("layer").isin(self.layers) & F.col("business_id").isNotNull() & F.col("at").isNotNull())
        new = known.groupBy("business_id").agg(F.collect_set(F.struct(number.alias("layer"), "at", "result", "website")).alias("_new"))
        none = F.array().cast(self.observations.schema["seen"].dataType)
        # one row holds what was observed of a business: some observations for each of a few layers
        joined = new.join(self.observations.read_touched(new), "business_id", "left")
        self.observations.upsert(joined.select("business_id", F.sort_array(F.array_union(F.coalesce("seen", none), F.col("_new"))).alias("seen")))
        histories = self.observations.read_touched(new).join(new.select("business_id"), "business_id", "left_semi")
        machines = self._folded(histories)
        names = F.array(*[F.lit(x) for x in self.layers])
        rows = machines.select("business_id", F.explode("m.used").alias("x"))
        self.evidence.upsert(rows.select("business_id", F.get(names, F.col("x.layer")).alias("source"), "x.result", "x.website", F.col("x.at").alias("checked_at")))
        due = F.when(~F.col("m.done"), F.get(names, F.col("m.layer")))
        last = F.get(F.reverse("m.used"), F.lit(0))
        self.state.upsert(machines.select("business_id", due.alias("due_layer"), (F.col("m.last") + self.idle).alias("due_at"), "m.tries", F.col("m.done"), F.when(F.col("m.done"), last["website"]).alias("website")))

    def run(self, observed: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take in what a stream of observations holds, and stop."""
        return observed.writeStream.foreachBatch(lambda batch, _: self.step(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def queue(self, layer: str, at: object) -> DataFrame:
        """Businesses whose turn with a layer has come by a time."""
        return self.state.read().filter((F.col("due_layer") == layer) & (F.col("due_at").isNull() | (F.col("due_at") <= F.lit(at).cast("timestamp_ntz")))).select("business_id")
