"""Feedback folded into state: dispositions, transitions, learned weights, keyed tables.

The log has user_id, persona_key, opportunity_id, action, seq (order), ts, and the context
of each click. Dispositions need only the first and last rows of a key, so they are plain
aggregates; transitions need the row before, found without grouping a key into one task.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconlake import lexicon as lx
from beaconlake.functions import numeric as nm, text as tx
from beaconlake.operators import ordered, skew

c = F.col
KEY = ["user_id", "persona_key", "opportunity_id"]
ACTIONS = ["engage", "dismiss", "undo", "save", "unsave"]
STATUS_OF = {"engage": "interested", "dismiss": "dismissed", "undo": "none"}


def interactions(log: DataFrame) -> DataFrame:
    """Current disposition per card. First-touch columns stay, the last known reason wins."""
    acts = log.where(c("action").isin(*ACTIONS))
    on_status, on_saved = c("action").isin(*STATUS_OF), c("action").isin("save", "unsave")
    first = F.min_by(F.struct("rank", "page", "bucket", "source", "mode"), "seq")
    got = acts.groupBy(*KEY).agg(
        F.max_by(F.when(on_status, c("action")), F.when(on_status, c("seq"))).alias("_status"),
        F.max_by(F.when(on_saved, c("action")), F.when(on_saved, c("seq"))).alias("_saved"),
        F.max_by("reason", F.when(c("reason").isNotNull(), c("seq"))).alias("reason"),
        first.alias("_first"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max("seq").alias("last_seq"))
    return got.select(*KEY, F.coalesce(nm.lookup(c("_status"), STATUS_OF), F.lit("none")).alias("status"),
                      F.coalesce(c("_saved") == "save", F.lit(False)).alias("saved"), "reason", "_first.*", "first_at", "last_at", "last_seq")


def transitions(log: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Every disposition click with `applied`: whether it changed anything. Status clicks and
    save clicks are two tracks that do not touch each other, so the row before in the same
    track decides. `cards` is the state before the log: the clicks that lead to it go first."""
    track = F.when(c("action").isin(*STATUS_OF), "status").when(c("action").isin("save", "unsave"), "saved")
    rows = log.withColumn("track", track).where("track is not null")
    if cards is not None:
        back = {v: k for k, v in STATUS_OF.items()}
        stood = F.array(nm.lookup(c("status"), back), F.when(c("saved"), "save").otherwise("unsave"))
        known = cards.select(*KEY, c("last_seq").alias("seq"), F.explode(stood).alias("action")).withColumn("track", track)
        rows = rows.withColumn("_known", F.lit(False)).unionByName(known.withColumn("_known", F.lit(True)), allowMissingColumns=True)
    rows = ordered.previous_value(rows, KEY + ["track"], ["seq"], "action", "before")
    if cards is not None:
        rows = rows.where(~c("_known")).drop("_known")
    trains = c("action").isin("engage", "dismiss", "save")
    return rows.withColumn("applied", trains & ~c("action").eqNullSafe(c("before")))


def cards_after(moves: DataFrame, cards: DataFrame) -> DataFrame:
    """The state of every card that `moves` (transitions from `cards` on) touch: status, saved flag, number
    of clicks that changed anything, last click."""
    last = lambda track: F.max_by(F.when(c("track") == track, c("action")), F.when(c("track") == track, c("seq")))
    got = moves.groupBy(*KEY).agg(last("status").alias("_status"), last("saved").alias("_saved"), F.count_if(c("applied")).alias("_n"), F.max("seq").alias("_seq"))
    old = cards.select(*[c(k).alias("_" + k) for k in KEY], "status", "saved", "applied")
    got = got.join(old, [c(k).eqNullSafe(c("_" + k)) for k in KEY], "left")
    return got.select(*KEY, F.coalesce(nm.lookup(c("_status"), STATUS_OF), "status", F.lit("none")).alias("status"),
                      F.coalesce(c("_saved") == "save", "saved", F.lit(False)).alias("saved"), (F.coalesce("applied", F.lit(0)) + c("_n")).alias("applied"), c("_seq").alias("last_seq"))


def training_steps(log: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """Clicks the learner trains on: a new disposition with a known, whole signal vector."""
    steps = (transitions(log) if moves is None else moves).where(c("applied") & (F.size("signals") == len(lx.SIGNALS)))
    return steps.select("user_id", "persona_key", "seq", "mode", nm.lookup(c("action"), lx.REWARDS).alias("reward"), "signals")


def last_mode_only(steps: DataFrame) -> DataFrame:
    """A step in another mode restarts learning, so only steps after the last change count."""
    keys = ["user_id", "persona_key"]
    marked = ordered.previous_value(steps, keys, ["seq"], "mode", "mode_before")
    restart = F.when(c("mode_before").isNotNull() & (c("mode_before") != c("mode")), c("seq"))
    since = marked.groupBy(*keys).agg(F.max(restart).alias("since"), F.count(F.lit(1)).alias("_n"))
    got = skew.lookup_join(marked, since, keys, "_n", "seq").drop("_n")
    return got.where(c("since").isNull() | (c("seq") >= c("since"))).drop("mode_before", "since")


def start_weights(mode):
    return np.array([lx.MODE_WEIGHTS[mode].get(s, 0.0) for s in lx.SIGNALS], dtype=np.float64)


def lms_step(w, x, y, rate=lx.LEARNING_RATE):
    """One least-mean-squares step, clipped at zero and scaled to sum 1."""
    w = np.maximum(0.0, w + rate * (y - float(w @ x)) * x)
    total = w.sum()
    return w / total if total > 0 else w


def learned_weights(steps: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Weights per (user, persona) after all steps in order, from none or from those of `start` on.

    The fold depends on its order, so a key's steps run in sequence: rows are spread by key,
    sorted inside each partition (which spills), and folded while batches stream by. A task
    holds one weight vector, never a key's rows."""
    steps = last_mode_only(steps) if start is None else steps
    steps = steps.select("user_id", "persona_key", "seq", "mode", "reward", "signals", F.lit(None).cast("bigint").alias("n"))
    if start is not None:         # a row without a step number: it sorts first, and its signals are the weights
        steps = steps.unionByName(start.select("user_id", "persona_key", F.lit(None).cast("bigint").alias("seq"), "mode", F.lit(None).cast("double").alias("reward"), c("weights").alias("signals"), "n"))
    steps = steps.repartition("user_id", "persona_key").sortWithinPartitions("user_id", "persona_key", "seq")
    names = ["user_id", "persona_key", "mode", "n", "weights"]

    def fold(batches):
        key, mode, n, w = None, None, 0, None
        done = []

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([d[0][0] for d in done], pa.string()), pa.array([d[0][1] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()),
                 pa.array([d[2] for d in done], pa.int64()), pa.array([d[3].tolist() for d in done], pa.list_(pa.float64()))], names)
            done.clear()
            return batch

        for batch in batches:
            users, keys, modes, ys, known = (batch.column(i).to_pylist() for i in ("user_id", "persona_key", "mode", "reward", "n"))
            xs = batch.column("signals")
            xs = xs.flatten().to_numpy(zero_copy_only=False).reshape(len(users), -1) if len(users) else np.zeros((0, len(lx.SIGNALS)))
            for i in range(len(users)):
                here = (users[i], keys[i])
                if here != key or modes[i] != mode:
                    if key is not None and here != key:
                        done.append((key, mode, n, w))
                    key, mode, n, w = here, modes[i], 0, start_weights(modes[i])
                if known[i] is not None:
                    n, w = known[i], xs[i].copy()
                    continue
                w = lms_step(w, xs[i], ys[i])
                n += 1
            if len(done) >= 5000:
                yield flush()
        if key is not None:
            done.append((key, mode, n, w))
        if done:
            yield flush()

    return steps.mapInArrow(fold, "user_id string, persona_key string, mode string, n bigint, weights array<double>")


def valid_weights(learned: DataFrame, current: DataFrame) -> DataFrame:
    """Learned weights where they fit the persona's current mode, else that mode's defaults."""
    got = current.join(learned.select("user_id", "persona_key", c("mode").alias("learned_mode"), "n", "weights"), ["user_id", "persona_key"], "left")
    fits = F.coalesce((c("learned_mode") == c("mode")) & (c("n") > 0), F.lit(False))
    return got.select("user_id", "persona_key", "mode", fits.alias("learned"), F.when(fits, c("n")).otherwise(0).alias("n"),
                      F.when(fits, c("weights")).otherwise(nm.default_weights(c("mode"))).alias("weights"))


def learned_summary(mode, weights):
    """What a user favours against the mode's defaults: two gains and two losses at most."""
    names, labels = F.array(*[F.lit(s) for s in lx.SIGNALS]), F.array(*[F.lit(lx.PRIORITY_LABELS[s]) for s in lx.SIGNALS])
    delta = F.zip_with(weights, nm.default_weights(mode), lambda w, b: w - b)
    rows = F.transform(delta, lambda x, i: F.struct(x.alias("d"), i.alias("i")))
    ups = F.filter(F.reverse(F.array_sort(rows)), lambda r: r.d > 0.02)
    downs = F.filter(F.array_sort(rows), lambda r: r.d < -0.02)
    text = lambda part: F.array_join(F.transform(F.slice(part, 1, 2), lambda r: F.get(labels, r.i)), ", ")
    up, down = text(ups), text(downs)
    said = F.concat_ws(". ", F.when(up != "", F.concat(F.lit("Priority: "), up)), F.when(down != "", F.concat(F.lit("Non-priority: "), down)))
    return F.when(said == "", "Still learning what you respond to.").otherwise(F.concat(said, F.lit(".")))


def explored(states: DataFrame, log: DataFrame) -> DataFrame:
    """Distinct cards per (user, persona) that were judged or opened."""
    judged = states.where(c("status").isin("interested", "dismissed")).select(*KEY)
    opened = log.where((c("action") == "open_detail") & c("opportunity_id").isNotNull()).select(*KEY)
    return judged.union(opened).distinct().groupBy("user_id", "persona_key").agg(F.count(F.lit(1)).alias("explored"))


def upserted(changes: DataFrame, keys: list[str], seq: str, ts: str) -> DataFrame:
    """A keyed table from its change log: first created, last values, last update."""
    other = [x for x in changes.columns if x not in keys + [seq, ts]]
    got = changes.groupBy(*keys).agg(F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"), F.max_by(F.struct(*other), seq).alias("_v"))
    return got.select(*keys, "_v.*", "created_at", "updated_at")


def without_deleted(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def accounts(logins: DataFrame) -> DataFrame:
    """One account per name, whatever its case and spacing; the oldest id wins."""
    named = logins.withColumn("display", tx.display_name(c("name"))).withColumn("name_key", F.lower("display"))
    return named.groupBy("name_key").agg(F.min_by("user_id", "created_at").alias("user_id"), F.max("display").alias("name"), F.max("created_at").alias("last_seen"))
