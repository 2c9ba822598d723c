"""Vector queries over the embedding table."""
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from beaconlake.functions import numeric as nm
from beaconlake.operators import encode as en, ordered, trends as tr, vectors as vx
from beaconlake.plans import testbed as tb
from beaconlake.plans.q_columns import PROTO, Q6, micro, prototypes
from beaconlake.plans.q_trends import N, stratified
from beaconlake.plans.registry import query
from beaconlake.plans.testbed import oracle
from beaconlake.session import checkpointed

c = F.col
NEAR = 0.4          # the given vectors have no pair near 0.97, see the notes on the data


def corpus(spark, d):
    return tb.table(spark, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("vec"), "label")


def facet_rows(spark, d):
    """Persona facets: the first vector of each label a persona looks for."""
    p = tb.personas(spark).select(c("id").alias("persona"), F.explode("facet_labels").alias("label"), c("platforms").alias("strata"))
    return prototypes(spark, d).select("label", c("pv").alias("vec")).join(p, "label")


_FAC = "facet AS (SELECT persona, pv FROM (VALUES " + ", ".join(f"('{p[0]}', {l})" for p in tb.PERSONAS for l in p[9]) + ") t(persona, label) JOIN proto USING (label))"
_VEC = f"WITH {PROTO}, {_FAC} "
DOT = "list_dot_product(e.embedding::DOUBLE[], pv::DOUBLE[])"


def hashed_sql(rel, key, text, dims):
    """The default encoder in SQL: entries of the signed word-hash vector of each text, in millionths."""
    return f"""(SELECT {key}, dims, array_to_string(list_transform(v, lambda x: CAST(floor((x / CASE WHEN len = 0 THEN 1e0 ELSE len END)::FLOAT::DOUBLE * 1e6 + 0.5) AS BIGINT)), ',') AS entries FROM
  (SELECT {key}, {dims}::BIGINT AS dims, sqrt(list_dot_product(s, s)) AS len, CASE WHEN list_dot_product(s, s) = 0 THEN list_transform(s, lambda x, i: CASE WHEN i = 1 THEN 1e0 ELSE 0e0 END) ELSE s END AS v FROM
  (SELECT {key}, list(n ORDER BY i) AS s FROM (SELECT {key}, i, COALESCE(sum(sign), 0)::DOUBLE AS n FROM (SELECT {key}, unnest(range({dims})) AS i FROM {rel}) g LEFT JOIN
   (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dims} AS i, CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT >= 8 THEN 1 ELSE -1 END AS sign FROM
    (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {rel}) t) h USING ({key}, i) GROUP BY ALL) c GROUP BY {key}) z) y)"""


def entries(v):
    return F.array_join(F.transform(v, lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string")), ",")


@query("UDF-01", "SELECT item_id, dims, entries, true AS unit_length FROM " + hashed_sql("benchmark", "item_id", "text", 32))
def encode_hook(spark, d):
    b = tb.table(spark, d, "benchmark")
    v = b.select("item_id", en.encoder(make=lambda: en.HashedWords(32))("text").alias("v"))
    return v.select("item_id", F.size("v").cast("bigint").alias("dims"), entries("v").alias("entries"), (F.abs(nm.norm(c("v")) - 1) < 1e-4).alias("unit_length"))


@query("TOP-01", f"WITH {PROTO} SELECT label AS qid, rank, id, {Q6.format('sim')} AS sim_micro FROM (SELECT p.label, e.vec_id AS id, {DOT} AS sim, row_number() OVER (PARTITION BY p.label ORDER BY {DOT} DESC, e.vec_id) AS rank FROM embeddings e, proto p) t WHERE rank <= 5")
def vector_top_k(spark, d):
    q = prototypes(spark, d).select(c("label").cast("bigint").alias("qid"), c("pv").alias("qvec"))
    return vx.top_k(corpus(spark, d), q, 5).select("qid", "rank", "id", micro(c("sim")).alias("sim_micro"))


@query("JOI-06", _VEC + f"SELECT persona, vec_id AS id, {Q6.format('max(' + DOT + ')')} AS sim_micro FROM embeddings e, facet GROUP BY persona, vec_id")
def best_facet_similarity(spark, d):
    return vx.facet_similarity(corpus(spark, d), facet_rows(spark, d)).select("persona", "id", micro(c("sim")).alias("sim_micro"))


_CENT = """, cs AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) t GROUP BY label, pos),
cn AS (SELECT label, sqrt(sum(m * m)) + 1e-9 AS nrm FROM cs GROUP BY label), cent AS (SELECT label, pos, m / nrm AS v FROM cs JOIN cn USING (label)),
csim AS (SELECT a.label, b.label AS other, sum(a.v * b.v) AS sim FROM cent a JOIN cent b ON a.pos = b.pos AND a.label <> b.label GROUP BY a.label, b.label)"""
_Q5 = "CAST(floor(({}) * 1e5 + 0.5) AS BIGINT)"


def q5(col):
    return F.floor(col * 1e5 + 0.5).cast("bigint")


@query("AGG-11", f"WITH {PROTO}{_CENT} SELECT label, pos, {_Q5.format('v')} AS v FROM cent")
def label_centroids(spark, d):
    cents = vx.centroids(corpus(spark, d), "label", "vec").select("label", F.posexplode("centroid").alias("pos", "v"))
    return cents.select("label", (c("pos") + 1).cast("bigint").alias("pos"), q5(c("v")).alias("v"))


def label_similarity(spark, d):
    return vx.centroid_similarity(vx.centroids(corpus(spark, d), "label", "vec"), "label")


@query("JOI-07", f"WITH {PROTO}{_CENT} SELECT label, other, {_Q5.format('sim')} AS sim FROM csim")
def domain_similarity(spark, d):
    return label_similarity(spark, d).select("label", "other", q5(c("sim")).alias("sim"))


@query("TOP-06", f"WITH {PROTO}{_CENT} SELECT label, other, position FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, other) AS position FROM csim) t WHERE position <= 3")
def related_domains(spark, d):
    return tr.top_n(label_similarity(spark, d), ["label"], [F.desc("sim"), c("other")], 3).select("label", "other", "position")


_BEST = f", sims AS (SELECT e.vec_id AS id, label AS own, plabel, sim, row_number() OVER (PARTITION BY e.vec_id ORDER BY sim DESC, plabel) AS rn FROM (SELECT e.vec_id, e.label, p.label AS plabel, {DOT} AS sim FROM embeddings e, proto p) e)"


def closest(spark, d):
    p = prototypes(spark, d).select(c("label").cast("string").alias("name"), c("pv").alias("vec"))
    return vx.best_prototype(corpus(spark, d), p)


@query("JOI-08", f"WITH {PROTO}{_BEST} SELECT id, CAST(plabel AS VARCHAR) AS name, {Q6.format('sim')} AS sim_micro FROM sims WHERE rn = 1")
def nearest_prototype(spark, d):
    return closest(spark, d).select("id", "name", micro(c("sim")).alias("sim_micro"))


def reclassified(best, q=0.05):
    """Rows with their new domain and whether they stay above the noise floor."""
    floor = ordered.linear_percentile(ordered.value_positions(best, [], "sim"), [], "sim", q, "floor")
    return best.withColumn("floor", floor.scalar()).select("id", "name", "sim", (c("sim") >= c("floor")).alias("kept"))


@query("RNK-07", f"WITH {PROTO}{_BEST} SELECT id, CAST(plabel AS VARCHAR) AS name, sim >= (SELECT quantile_cont(sim, 0.05) FROM sims WHERE rn = 1) AS kept FROM sims WHERE rn = 1")
def zero_shot(spark, d):
    return reclassified(closest(spark, d)).select("id", "name", "kept")


_PAIRS = f"SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query("JOI-09", f"SELECT a, b, {Q6.format('sim')} AS sim_micro FROM ({_PAIRS}) t WHERE sim >= {NEAR}")
def similarity_join(spark, d):
    reps = checkpointed(vx.distinct_vectors(corpus(spark, d)))
    exact = vx.copies(corpus(spark, d), reps).withColumn("sim", F.lit(1.0))
    pairs = vx.similar_pairs(reps, NEAR).unionByName(exact)
    return pairs.select("a", "b", micro(c("sim")).alias("sim_micro"))


@query("SET-07", f"""WITH RECURSIVE p AS (SELECT a, b, row_number() OVER (ORDER BY sim DESC, a, b) AS i FROM ({_PAIRS}) t WHERE sim >= {NEAR}),
  pass AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL
   SELECT p.i, CASE WHEN list_contains(gone, p.a) OR list_contains(gone, p.b) THEN gone ELSE list_append(gone, p.b) END FROM pass JOIN p ON p.i = pass.i + 1)
  SELECT unnest(gone) AS id FROM pass WHERE i = (SELECT max(i) FROM p)""")
def near_duplicates(spark, d):
    """The ids that the pass over all near pairs drops."""
    return vx.near_duplicate_drops(corpus(spark, d), NEAR)


@query("EVL-04", f"""WITH n AS (SELECT e.vec_id AS id, e.label, [x / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) FOR x IN e.embedding::DOUBLE[]] AS v FROM embeddings e),
  d AS (SELECT a.id, a.label AS la, b.label AS lb, 1 - list_dot_product(a.v, b.v) AS dist FROM n a JOIN n b ON a.id <> b.id),
  m AS (SELECT id, la, lb, avg(dist) AS md FROM d GROUP BY ALL), s AS (SELECT id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM m GROUP BY id),
  p AS (SELECT a.label = b.label AS same, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
  SELECT {_Q5.format('avg((b - a) / greatest(a, b))')} AS silhouette, (SELECT {_Q5.format('avg(sim)')} FROM p WHERE same) AS mean_intra, (SELECT {_Q5.format('avg(sim)')} FROM p WHERE NOT same) AS mean_inter FROM s""")
def domain_separation(spark, d):
    """Cluster quality; every figure comes from per-label sums, never from pairs."""
    co = corpus(spark, d)
    rows = co.select(array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"), c("label").cast("double").alias("prediction"))
    sil = ClusteringEvaluator(distanceMeasure="cosine", metricName="silhouette").evaluate(rows)
    return vx.label_separation(co, "label").select(q5(F.lit(sil)).alias("silhouette"), q5(c("mean_intra")).alias("mean_intra"), q5(c("mean_inter")).alias("mean_inter"))


def label_sample(spark, d, n=500):
    """The repeatable sample the neighbour check looks at (a feature of the measure)."""
    co = corpus(spark, d).withColumn("one", F.lit(1))
    return stratified(co, "one", "id", n).select(c("id").alias("qid"), c("vec").alias("qvec"), c("label").alias("own"))


_NN = """SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id || ':7') LIMIT 500"""


@query("EVL-05", f"""WITH q AS ({_NN}), nn AS (SELECT q.vec_id, q.label, e.label AS nl, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) DESC, e.vec_id) AS rn
  FROM q JOIN embeddings x ON x.vec_id = q.vec_id JOIN embeddings e ON e.vec_id <> q.vec_id) SELECT count(*) AS asked, CAST(sum(CASE WHEN label = nl THEN 1 ELSE 0 END) AS BIGINT) AS coherent FROM nn WHERE rn = 1""")
def neighbour_coherence(spark, d):
    co, q = corpus(spark, d), label_sample(spark, d)
    best = vx.top_k(co, q, 1, exclude_same=True)
    j = best.join(q.select("qid", "own"), "qid").join(co.select("id", "label"), "id")
    return j.agg(N().alias("asked"), F.count_if(c("own") == c("label")).alias("coherent"))


_HIT10 = f"""SELECT p.label, e.label AS nl, row_number() OVER (PARTITION BY p.label ORDER BY {DOT} DESC, e.vec_id) AS rn FROM embeddings e, proto p"""


@query("EVL-03", f"WITH {PROTO} SELECT label, CAST(sum(CASE WHEN label = nl THEN 1 ELSE 0 END) AS BIGINT) AS hits, sum(CASE WHEN label = nl THEN 1 ELSE 0 END) / 10e0 AS precision_at_10 FROM ({_HIT10}) t WHERE rn <= 10 GROUP BY label")
def precision_at_k(spark, d):
    co = corpus(spark, d)
    q = prototypes(spark, d).select(c("label").cast("bigint").alias("qid"), c("pv").alias("qvec"))
    hits = vx.top_k(co, q, 10).join(co.select("id", "label"), "id")
    g = hits.groupBy(c("qid")).agg(F.count_if(c("qid") == c("label")).alias("hits"))
    return g.select(c("qid").cast("int").alias("label"), "hits", (c("hits") / 10).alias("precision_at_10"))


_CMB = """cmb AS (SELECT 'd_' || label AS persona, label FROM proto UNION ALL SELECT 'p_' || a.label || '_' || b.label, unnest([a.label, b.label]) FROM proto a JOIN proto b ON a.label < b.label)"""


@query("SET-09", f"""WITH {PROTO}, {_CMB}, best AS (SELECT persona, vec_id, max(sim) AS sim FROM (SELECT cmb.persona, e.vec_id, {DOT} AS sim FROM embeddings e, cmb JOIN proto ON proto.label = cmb.label) t GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY sim DESC, vec_id) AS rn FROM best) SELECT DISTINCT vec_id AS id FROM top WHERE rn <= 20 AND vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def pooled_candidates(spark, d):
    """What any one-domain or two-domain profile would see, less what is cached."""
    p = prototypes(spark, d).select("label", c("pv").alias("vec"))
    names = F.sort_array(p.agg(F.collect_list("label")).scalar())
    combos = p.select("label", "vec").withColumn("other", F.explode(names))
    lo, hi = F.least("label", "other"), F.greatest("label", "other")
    persona = F.when(c("label") == c("other"), F.concat(F.lit("d_"), "label")).otherwise(F.concat_ws("_", F.lit("p"), lo, hi))
    f = combos.select(persona.alias("persona"), "vec", F.array(F.lit("all")).alias("strata"))
    every = corpus(spark, d).select("id", "vec", F.lit("all").alias("stratum"))
    seen = vx.best_facet_top(every, f, 20).select("id").distinct()
    done = tb.table(spark, d, "labels").where("quality = 1").selectExpr("doc_id as id")
    return seen.join(done, "id", "left_anti")


# The covariance of the sample, squared again and again: what remains is its first axis. The second is that
# of the matrix without the first.
def _axis_sql(name, matrix):
    square = "list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q) / list_sum(list_transform(m, lambda z: list_dot_product(z, z)))))"
    return f"""{name}_pow AS (SELECT 0 AS step, m FROM {matrix} UNION ALL SELECT step + 1, {square} FROM {name}_pow WHERE step < 24),
{name}_row AS (SELECT list_reverse_sort(list_transform(m, lambda r, i: {{'d': r[i], 'r': r}}))[1].r AS r FROM {name}_pow WHERE step = 24),
{name}_unit AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM {name}_row),
{name} AS (SELECT list_transform(u, lambda x: x * CASE WHEN list_reverse_sort(list_transform(u, lambda y: {{'s': abs(y), 'y': y}}))[1].y > 0 THEN 1e0 ELSE -1e0 END) AS v FROM {name}_unit)"""


_PCA = """WITH RECURSIVE smp AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':7')) AS rn FROM embeddings) t WHERE rn <= 170),
lng AS (SELECT id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM smp), cen AS (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM lng),
cv AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM smp) - 1) AS v FROM cen a JOIN cen b USING (id) GROUP BY a.i, b.i),
c1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cv GROUP BY i) t), """ + _axis_sql("one", "c1") + """,
l1 AS (SELECT list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM one, c1),
c2 AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS m FROM one, c1, l1), """ + _axis_sql("two", "c2") + """,
l2 AS (SELECT list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM two, c2), spread AS (SELECT sum(v) AS total FROM cv WHERE i = j)"""


@query("TRD-04", _PCA + f" SELECT id, label, {_Q5.format('list_dot_product(e, one.v)')} AS x, {_Q5.format('list_dot_product(e, two.v)')} AS y, {_Q5.format('l1.l / total')} AS share_x, {_Q5.format('l2.l / total')} AS share_y FROM smp, one, two, l1, l2, spread")
def projection(spark, d):
    """Two principal components of a per-label sample, fitted by Spark over the sample, and the share of the
    variance that each explains."""
    s = stratified(corpus(spark, d), "label", "id", 170)
    rows = s.select("id", "label", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(rows)
    axes, shares = model.pc.toArray(), model.explainedVariance.toArray()
    # An axis may point either way; its largest loading points up.
    up = [1.0 if axis[abs(axis).argmax()] > 0 else -1.0 for axis in axes.T]
    xy = model.transform(rows).withColumn("a", vector_to_array("p"))
    return xy.select("id", "label", q5(c("a")[0] * up[0]).alias("x"), q5(c("a")[1] * up[1]).alias("y"), q5(F.lit(float(shares[0]))).alias("share_x"), q5(F.lit(float(shares[1]))).alias("share_y"))
