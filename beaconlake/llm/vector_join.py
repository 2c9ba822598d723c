"""Near copies of vectors: an exact range join in a metric space.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2 t). Equal vectors of
a label are folded into one first. Pivots (a bounded sample, thinned so that none lie close
together) cut each label's vectors into cells, each vector at its nearest pivot. By the triangle
inequality a partner of x lies in cell p only if d(x, p) <= d(x, nearest pivot) + 2 r; x is copied
there and nowhere else. Cells that are still large are cut by pivots of their own, in the same way.
Where vectors lie so evenly that nearly every cell could hold a partner, cutting multiplies rows and
saves nothing; a part of the sample measures that, and such a cell stays whole: with k pivots and c copies a
vector, the square of c has to stay well below k. Cells join independently. One with more than BLOCK vectors is joined block against block; within a task all
distances come from one matrix product, and only counts and a spanning set of links leave it, never
all pairs.

Equal vectors are told by a 64-bit hash, which two different ones share with a chance of 2 ** -64 a pair. Components
are read as single-precision numbers, as the table has them; cosines are computed in double precision.

Defined results: null, zero and non-finite vectors, and vectors without a label, link with nothing;
vectors of different length link with nothing; an id that occurs more than once is one row each,
and its rows link as other vectors do; a null id links like any other and has the least id of its
group as its component, null if there is none; empty tables give empty results; other columns are
not read.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconlake.llm.arrays import rows_of
from beaconlake.llm.components import components
from beaconlake.session import checkpointed

THRESHOLD = 0.98
PER_PIVOT = 256         # vectors a pivot should stand for
MOST_PIVOTS = 4096      # pivots sent to every task
TESTERS = 3             # sampled vectors for each pivot that measure what a cut would cost
GAIN = 2.0              # how many times fewer comparisons a cut must leave; else a cell stays whole
BLOCK = 2048            # vectors a side in one task
LEVELS = 3              # times that cells are cut
SLACK = 1e-6            # added to distances, so that rounding loses no candidate
ROW = "cell string, uid bigint, own boolean, copies bigint, vector array<float>"


def prepared(vectors: DataFrame, identity: str, vector: str, label: str) -> DataFrame:
    """(id, uid, cell, vector): uid names equal vectors of a label; null for those that can't link."""
    value = F.col(vector)
    fit = (F.col(label).isNotNull() & value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
           & F.exists(value, lambda x: x != 0))
    rows = vectors.select(F.col(identity).alias("id"), value.cast("array<float>").alias("vector"), F.coalesce(fit, F.lit(False)).alias("fit"),
                          F.concat_ws(":", F.col(label).cast("string"), F.size(value).cast("string")).alias("cell"))
    return rows.select("id", F.when(F.col("fit"), F.xxhash64("cell", "vector")).alias("uid"), "cell", F.when(F.col("fit"), F.col("vector")).alias("vector"))


def unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def pivots(rows: DataFrame, radius: float) -> dict[str, np.ndarray]:
    """Cell to unit pivots, more than three radii apart, from a bounded sample; only for cells
    that a cut would part well."""
    own = rows.where("own")
    want = min(MOST_PIVOTS, own.count() // PER_PIVOT + 1)
    sample = own.orderBy(F.xxhash64("uid", F.lit("pivot")), "uid").limit(want * (1 + TESTERS)).select("cell", "vector").toArrow()
    found: dict[str, list] = {}
    tests: dict[str, list] = {}
    for i, (cell, vector) in enumerate(zip(sample.column("cell").to_pylist(), sample.column("vector").to_pylist())):
        x = unit([vector])
        kept = found.setdefault(cell, [])
        if i >= want:
            tests.setdefault(cell, []).append(x)
        elif not kept or distances(x, np.concatenate(kept)).min() > 3 * radius:
            kept.append(x)
    out = {}
    for cell, kept in found.items():
        if len(kept) > 1 and cell in tests:
            far = distances(np.concatenate(tests[cell]), np.concatenate(kept))
            copies = (far <= far.min(1, keepdims=True) + 2 * radius + SLACK).sum(1).mean()
            if copies ** 2 * GAIN <= len(kept):          # k cells of c / k of the rows each compare c ** 2 / k of all pairs
                out[cell] = np.concatenate(kept)
    return out


def cut(rows: DataFrame, near: dict[str, np.ndarray], radius: float) -> DataFrame:
    """The rows dealt to finer cells; each own row stays own in one of them."""
    shared = rows.sparkSession.sparkContext.broadcast(near)

    def run(batches):
        for batch in batches:
            cells = np.array(batch.column("cell").to_pylist(), dtype=object)
            take, names, owns = [], [], []
            own = np.array(batch.column("own").to_pylist(), dtype=bool)
            for cell in dict.fromkeys(cells.tolist()):
                at = np.flatnonzero(cells == cell)
                near = shared.value.get(cell)
                if near is None:
                    take.append(at)
                    names += [cell] * len(at)
                    owns.append(own[at])
                    continue
                far = distances(unit(batch.column("vector").take(pa.array(at)).to_pylist()), near)
                best = far.argmin(1)
                row, pivot = np.nonzero(far <= far.min(1, keepdims=True) + 2 * radius + SLACK)
                take.append(at[row])
                names += [f"{cell}/{p}" for p in pivot]
                owns.append(own[at][row] & (best[row] == pivot))
            index = pa.array(np.concatenate(take)) if take else pa.array([], pa.int64())
            yield rows_of({"cell": pa.array(names, pa.string()), "uid": batch.column("uid").take(index), "own": pa.array(np.concatenate(owns)) if owns else pa.array([], pa.bool_()),
                           "copies": batch.column("copies").take(index), "vector": batch.column("vector").take(index)})
    return rows.mapInArrow(run, ROW)


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(table.num_rows, -1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def join_block(table: pa.Table, threshold: float) -> pa.Table:
    """The vectors of two blocks (or of one with itself) of a cell: (a, b, links). Own vectors get
    a row with their linked copies in the other block; b is null there. The other rows are a
    spanning set of the links."""
    uid, copies = table.column("uid").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
    own, second = (np.array(table.column(x).to_pylist(), dtype=bool) for x in ("own", "second"))
    vector = _matrix(table)
    size = np.sqrt((vector * vector).sum(1))
    a = np.flatnonzero(~second)
    b = np.flatnonzero(second) if second.any() else a
    near = np.empty((len(a), len(b)), bool)
    for start in range(0, len(a), 512):
        some = a[start:start + 512]
        near[start:start + 512] = (vector[some] @ vector[b].T) / (size[some][:, None] * size[b][None, :]) >= threshold
    if b is a:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    links = np.bincount(a[i], copies[b[j]], len(uid))
    if b is not a:
        links += np.bincount(b[j], copies[a[i]], len(uid))
    root = _roots(len(uid), a[i], b[j])
    moved = np.flatnonzero(root != np.arange(len(uid)))
    mine = np.flatnonzero(own)
    return pa.table({"a": pa.array(np.concatenate([uid[mine], uid[moved]])),
                     "b": pa.concat_arrays([pa.nulls(len(mine), pa.int64()), pa.array(uid[root[moved]])]),
                     "links": pa.array(np.concatenate([links[mine].astype(np.int64), np.zeros(len(moved), np.int64)]))})


def joined(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) over all cells. A block meets itself and every other block of its cell once."""
    sizes = checkpointed(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks")).withColumnRenamed("cell", "_cell"))
    placed = rows.join(sizes, F.col("cell") == F.col("_cell")).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return (dealt.select("cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                         (F.col("block") > F.col("other")).alias("second"), "uid", "own", "copies", "vector")
            .groupBy("cell", "one", "two").applyInArrow(lambda t: join_block(t, threshold), "a bigint, b bigint, links bigint"))


def near_copies(vectors: DataFrame, identity: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: id, n_links, component_id, kept."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = checkpointed(prepared(vectors, identity, vector, label))
    folded = (rows.where("uid is not null").groupBy("uid").agg(F.first("cell").alias("cell"), F.lit(True).alias("own"), F.count(F.lit(1)).alias("copies"),
                                                             F.first("vector").alias("vector")).select("cell", "uid", "own", "copies", "vector"))
    cells, done = checkpointed(folded), []
    for _ in range(LEVELS):
        near = pivots(cells, radius)
        if not near:
            break
        cells = checkpointed(cut(cells, near, radius))
        big = checkpointed(cells.where("own").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select(F.col("cell").alias("_cell")))
        done.append(cells.join(big, F.col("cell") == F.col("_cell"), "left_anti"))
        cells = checkpointed(cells.join(big, F.col("cell") == F.col("_cell"), "left_semi"))
    for part in done:
        cells = cells.unionByName(part)
    everything = checkpointed(joined(cells, threshold))
    links = everything.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "_uid")
    groups = components(everything.where("b is not null").select("a", "b")).withColumnRenamed("node", "_node")
    least = rows.where("uid is not null").groupBy("uid").agg(F.min("id").alias("id"), (F.count(F.lit(1)) - 1).alias("same"))
    named = checkpointed(least.join(groups, F.col("uid") == F.col("_node"), "left").join(links, F.col("uid") == F.col("_uid"), "left")
                         .select("uid", "id", F.coalesce("component", "uid").alias("component"), (F.col("same") + F.coalesce("links", F.lit(0))).alias("links")))
    names = checkpointed(named.groupBy("component").agg(F.min("id").alias("component_id")).withColumnRenamed("component", "_c"))
    of = checkpointed(named.join(names, F.col("component") == F.col("_c")).select(F.col("uid").alias("_uid"), "links", F.col("component_id").alias("_component")))
    out = rows.select("id", "uid").join(of, F.col("uid") == F.col("_uid"), "left")
    component = F.coalesce("_component", "id")
    return out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
