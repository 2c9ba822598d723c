"""State folded from clicks that stream in, in the order of the clicks and not of their arrival.

A trigger writes tables under its own number, so a retried one replaces itself:

* `log`: the clicks it brought;
* `upto`: the click number up to which the state is settled, `hold` behind the newest;
* `pending`: clicks above that, held back for later triggers;
* one table per part of the state: the rows that this trigger changed. The newest row of a key counts;
  every COMPACT triggers the whole state is written anew, and older rows are not read any more.

Spark sorts what is due and the fold starts from the stored state. A click that comes later than `hold`
allows is not lost either: its keys are folded again from the log. So any order of arrival and any number of
triggers give the state that one batch over all clicks gives; a larger `hold` costs memory of
what is pending, a smaller one folds more keys again.
"""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from beaconlake.operators import feedback as fb
from beaconlake.operators.skew import broadcast_if_small
from beaconlake.session import checkpointed, scratch_path

c = F.col
COMPACT = 16
TEXT, LONG, WEIGHT = T.StringType(), T.LongType(), T.ArrayType(T.DoubleType())


def _schema(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CARDS = _schema(user_id=TEXT, persona_key=TEXT, opportunity_id=TEXT, status=TEXT, saved=T.BooleanType(), applied=LONG, last_seq=LONG)
WEIGHTS = _schema(user_id=TEXT, persona_key=TEXT, mode=TEXT, n=LONG, weights=WEIGHT)
CLICKS = _schema(user_id=TEXT, persona_key=TEXT, opportunity_id=TEXT, seq=LONG, action=TEXT)
UPTO = _schema(upto=LONG)


class Folded:
    """A stored state and the fold that carries it on.

    clicks: the columns of a click, `seq` its number. scope: the columns by which clicks are folded again.
    parts: {name: (schema, key)} of the tables of the state. step(clicks, {name: rows}) gives the new
    rows of each table for the keys that the clicks touch."""

    def __init__(self, spark: SparkSession, path: str, clicks: T.StructType, scope: list[str], parts: dict, step: Callable, hold: int):
        self.spark, self.path, self.clicks, self.scope, self.parts, self.step, self.hold = spark, path, clicks, scope, parts, step, hold

    def _write(self, name, number, df):
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def _read(self, name, schema, first, last):
        """The rows that the triggers first to last wrote, with their number."""
        numbers = [n for n in range(first, last + 1) if self._exists(f"{self.path}/{name}/batch={n}")]
        if not numbers:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", LONG)]))
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*[f"{self.path}/{name}/batch={n}" for n in numbers]).select(*schema.names, c("batch").cast("long"))

    def _exists(self, path):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _newest(self, name, before):
        """The stored state ahead of a trigger."""
        schema, key = self.parts[name]
        base = before // COMPACT * COMPACT
        rows = self._read(name, schema, max(base - 1, 0), before - 1)
        other = [x for x in schema.names if x not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*other), "batch").alias("_v")).select(*key, "_v.*")

    def _upto(self, number):
        row = self._read("upto", UPTO, number, number).first()
        return row["upto"] if row else None

    def _of(self, rows, keys, how):
        same = [c(k).eqNullSafe(c("_" + k)) for k in self.scope]
        return rows.join(keys.select(*[c(k).alias("_" + k) for k in self.scope]), same, how)

    def trigger(self, batch: DataFrame, number: int):
        """Take in the clicks of one trigger."""
        self._write("log", number, batch.select(*self.clicks.names))
        new = self._read("log", self.clicks, number, number).drop("batch")
        before = self._upto(number - 1)
        newest = new.agg(F.max("seq")).first()[0]
        upto = max((x for x in (before, None if newest is None else newest - self.hold) if x is not None), default=None)
        self._write("upto", number, self.spark.createDataFrame([(upto,)], UPTO))
        waiting = self._read("pending", self.clicks, number - 1, number - 1).drop("batch").unionByName(new)
        self._write("pending", number, waiting.where(F.lit(upto).isNull() | (c("seq") > upto)))
        due = waiting.where(c("seq") <= upto)
        state = {name: self._newest(name, number) for name in self.parts}
        late = checkpointed(new.where(c("seq") <= before).select(*self.scope).distinct())
        if late.limit(1).count():
            late = broadcast_if_small(late)
            again = self._of(self._read("log", self.clicks, 0, number).drop("batch").where(c("seq") <= upto), late, "left_semi")
            due = self._of(due, late, "left_anti").unionByName(again)
            state = {name: self._of(rows, late, "left_anti") for name, rows in state.items()}
        due = checkpointed(due)
        for name, rows in self._carried(due, state).items():
            if number % COMPACT == COMPACT - 1:
                schema, key = self.parts[name]
                whole = self._newest(name, number).join(rows.select(*[c(k).alias("_" + k) for k in key]), [c(k).eqNullSafe(c("_" + k)) for k in key], "left_anti")
                rows = whole.unionByName(rows)
            self._write(name, number, rows)

    def _carried(self, due, state):
        touched = broadcast_if_small(checkpointed(due.select(*self.scope).distinct()))
        return {name: checkpointed(rows.select(*self.parts[name][0].names)) for name, rows in
                self.step(due, {name: checkpointed(self._of(rows, touched, "left_semi")) for name, rows in state.items()}).items()}

    def current(self, name: str, last: int) -> DataFrame:
        """The state with all clicks so far: the settled one carried on by what is held back."""
        waiting = self._read("pending", self.clicks, last, last).drop("batch")
        state = {x: checkpointed(self._newest(x, last + 1)) for x in self.parts}
        key = self.parts[name][1]
        rows = self._carried(waiting, state)[name]
        kept = state[name].join(rows.select(*[c(k).alias("_" + k) for k in key]), [c(k).eqNullSafe(c("_" + k)) for k in key], "left_anti")
        return kept.unionByName(rows)


def run_folded(stream: DataFrame, name: str, make: Callable[[SparkSession, str], Folded], path: str | None = None) -> tuple[Folded, int]:
    """Work off everything that is there now; (the state, the number of the last trigger). State and offsets
    are under `path`; a later run with the same path goes on from there."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    folded, seen = make(spark, path), [-1]

    def store(batch, number):
        folded.trigger(batch, number)
        seen[0] = number
    stream.writeStream.option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).foreachBatch(store).start().awaitTermination()
    if seen[0] < 0:                # nothing new
        while folded._exists(f"{path}/upto/batch={seen[0] + 1}"):
            seen[0] += 1
    return folded, seen[0]


def _cards_step(due, state):
    return {"cards": fb.cards_after(fb.transitions(due, state["cards"]), state["cards"])}


def _learner_step(due, state):
    moves = checkpointed(fb.transitions(due, state["cards"]))
    return {"cards": fb.cards_after(moves, state["cards"]), "weights": fb.learned_weights(fb.training_steps(due, moves), state["weights"])}


def dispositions(hold: int) -> Callable[[SparkSession, str], Folded]:
    """Status, saved flag and number of changes of every card."""
    return lambda spark, path: Folded(spark, path, CLICKS, fb.KEY, {"cards": (CARDS, fb.KEY)}, _cards_step, hold)


def learners(hold: int) -> Callable[[SparkSession, str], Folded]:
    """The cards, and mode, step count and weights of every (user, persona)."""
    clicks = T.StructType([*CLICKS.fields, *_schema(mode=TEXT, signals=WEIGHT).fields])
    user = ["user_id", "persona_key"]
    return lambda spark, path: Folded(spark, path, clicks, user, {"cards": (CARDS, fb.KEY), "weights": (WEIGHTS, user)}, _learner_step, hold)
