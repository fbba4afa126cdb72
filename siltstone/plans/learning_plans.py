"""Queries on vectors, labels and votes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import lines
from siltstone.operators import learning as ln
from siltstone.operators.similarity import similar_pairs
from siltstone.plans.fixtures import LINE, RULE, files
from siltstone.plans.registry import query

DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


@query("m9_distances", f"SELECT a.vec_id, b.vec_id AS other, round({DOT} / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m9(t):
    a, b = t.embeddings.select("vec_id", F.col("embedding").alias("x")), t.embeddings.select(F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    j = a.join(b, F.col("other") == F.col("vec_id") + 1)
    return j.select("vec_id", "other", F.round(ln.cosine(F.col("x"), F.col("y")), 5).alias("cosine"), F.round(F.sqrt(ln.squared_distance(F.col("x"), F.col("y"))), 5).alias("distance"))


@query("m3_idf", "WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings), f AS (SELECT dim, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS df FROM d GROUP BY dim) SELECT dim::INTEGER AS dim, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM f, n")
def m3(t):
    return ln.idf(t.embeddings).select("dim", F.round("idf", 6).alias("idf"))


@query("m4_cluster_count", "SELECT label, CASE WHEN count(*) < 2 THEN 1 WHEN count(*) < 6 THEN 2 ELSE least(24, greatest(2, round(sqrt(count(*) / 2))))::INTEGER END AS k FROM embeddings GROUP BY label")
def m4(t):
    return t.embeddings.groupBy("label").agg(ln.k_for(F.count("*")).alias("k"))


@query("j18_similar_pairs", f"WITH s AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({DOT} / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE NOT (a.vec_id % 4 = b.vec_id % 4 AND (a.vec_id % 9 <= b.vec_id % 9 AND b.vec_id % 9 + b.vec_id % 5 <= a.vec_id % 9 + a.vec_id % 5 OR b.vec_id % 9 <= a.vec_id % 9 AND a.vec_id % 9 + a.vec_id % 5 <= b.vec_id % 9 + b.vec_id % 5))) SELECT label, a, b FROM s WHERE cosine >= 0.9")
def j18(t):
    """Units of four files with ranges of lines, of which some lie inside others."""
    k = F.col("id")
    return similar_pairs(vectors(t).withColumn("file", k % 4).withColumn("start", k % 9).withColumn("end", k % 9 + k % 5)).select("label", "a", "b")


@query("j18_pairs_at_least_a_third", f"WITH c AS (SELECT label, min(vec_id) AS vec_id, embedding FROM embeddings WHERE label IS NOT NULL GROUP BY label, embedding) SELECT label, a, b FROM (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({DOT} / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cosine FROM c a JOIN c b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE cosine >= 0.3333")
def j18_low(t):
    """The pairs between classes at a limit that the given vectors reach."""
    return similar_pairs(vectors(t), 0.3333).where("not copy").select("label", "a", "b")


CENTRE = "d AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, dim, avg(x) AS x FROM d GROUP BY ALL), dist AS (SELECT vec_id, d.label, sqrt(sum((d.x - c.x) * (d.x - c.x))) AS distance FROM d JOIN c ON d.label = c.label AND d.dim = c.dim GROUP BY ALL)"


def label_distances(t):
    d = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    c = d.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("c"))
    return d.join(c, ["label", "dim"]).groupBy("vec_id", F.col("label").alias("cluster")).agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("distance"))


@query("w9_cluster_outliers", f"WITH {CENTRE} SELECT vec_id, round(distance / max(distance) OVER (PARTITION BY label), 4) AS outlier FROM dist")
def w9(t):
    return ln.outliers(label_distances(t)).select("vec_id", F.round("outlier", 4).alias("outlier"))


@query("w10_z_scores", f"WITH {CENTRE} SELECT vec_id, (distance - avg(distance) OVER ()) / stddev_pop(distance) OVER () >= 2 AS anomaly FROM dist")
def w10(t):
    return ln.z_scores(label_distances(t), "distance").select("vec_id", "anomaly")


@query("a12_bands", f"WITH {CENTRE}, s AS (SELECT distance / max(distance) OVER (PARTITION BY label) AS o FROM dist) SELECT CASE WHEN o >= 0.7 THEN 'noise' WHEN o >= 0.55 THEN 'weak' WHEN o >= 0.3 THEN 'fair' ELSE 'signal' END AS band, count(*)::BIGINT AS n FROM s GROUP BY 1")
def a12(t):
    s = F.col("outlier")
    band = F.when(s >= 0.7, "noise").when(s >= 0.55, "weak").when(s >= 0.3, "fair").otherwise("signal")
    return ln.outliers(label_distances(t)).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("m6_m10_lloyd")
def m6(t):
    assigned, _ = ln.lloyd(vectors(t), 6)
    return ln.z_scores(ln.outliers(assigned), "distance").select("id", "cluster", F.round("distance", 6).alias("distance"), F.round("outlier", 6).alias("outlier"), "anomaly")


@query("m10_anomalies")
def m10(t):
    """How far every unit is from the established patterns, and which are anomalies (z of 2 and more)."""
    every = ln.anomalies(vectors(t), z_min=float("-inf"))
    return every.select("id", F.round("distance", 6).alias("distance"), F.round("z", 6).alias("z"), (F.col("z") >= 2).alias("anomaly"))


def families(t):
    """Seeded k-means of all vectors; a unit's file is one of a hundred."""
    v = vectors(t)
    k = v.agg(ln.k_for(F.count("*")).alias("k")).first().k
    assigned, centres = ln.kmeans(v, k)
    return assigned.withColumn("file", F.concat(F.lit("f"), (F.col("id") % 100).cast("string"))), len(centres)


@query("m5_m7_kmeans_report")
def m5(t):
    assigned, k = families(t)
    return ln.family_report(assigned, k).select("family", "size", F.round("inertia", 6).alias("inertia"), F.array_join("samples", ",").alias("samples"))


@query("m7_unit_outliers")
def m7(t):
    """Each unit's family, how many are in it, and its distance against the largest there."""
    assigned, k = families(t)
    size = assigned.groupBy(F.col("cluster").alias("_c")).agg(F.count("*").alias("family_size"))
    out = ln.outliers(assigned).join(size, F.col("cluster") == F.col("_c"))
    return out.select("id", F.concat(F.lit(f"fam-{k}-"), F.col("cluster").cast("string")).alias("family"), "family_size", F.round(F.least(F.lit(1.0), "outlier"), 6).alias("outlier"))


#: Power iteration over the matrix of centred products, one step a row.
PCA = """WITH RECURSIVE d AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), mean AS (SELECT i, avg(x) AS m FROM d GROUP BY i), c AS (SELECT vec_id, i, x - m AS x FROM d JOIN mean USING (i)),
g AS (SELECT a.i, list(s ORDER BY j) AS r FROM (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM c a JOIN c b USING (vec_id) GROUP BY ALL) a GROUP BY a.i), m AS (SELECT list(r ORDER BY i) AS g, list(((i * 17 + 3) % 100) / 100 - 0.5 ORDER BY i) AS s FROM g),
p1(k, v) AS (SELECT 0, s FROM m UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, list_transform(g, lambda r: list_dot_product(r, v)) AS w FROM p1, m WHERE k < 25)),
a AS (SELECT v AS a FROM p1 WHERE k = 25),
p2(k, v) AS (SELECT 0, list_transform(s, lambda x, i: x - list_dot_product(s, a) * a[i]) FROM m, a UNION ALL SELECT k + 1, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) FROM (SELECT k, list_transform(w, lambda x, i: x - list_dot_product(w, a) * a[i]) AS u FROM (SELECT k, a, list_transform(g, lambda r: list_dot_product(r, v)) AS w FROM p2, m, a WHERE k < 25)))
SELECT vec_id, round(list_dot_product(x, a), 4) AS x, round(list_dot_product(x, v), 4) AS y FROM (SELECT vec_id, list(x ORDER BY i) AS x FROM c GROUP BY vec_id), a, p2 WHERE k = 25"""


@query("m8_pca", PCA)
def m8(t):
    return ln.power_pca(vectors(t)).select(F.col("id").alias("vec_id"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


HASHED = "c AS (SELECT doc_id, token, count(*) AS n FROM b GROUP BY ALL), v AS (SELECT doc_id, ('0x' || substring(md5(token), 1, 8))::BIGINT % {size} AS bucket, sum(n * {sign}) AS v FROM c GROUP BY ALL), u AS (SELECT doc_id, sqrt(sum(v * v)) AS u FROM v GROUP BY doc_id) SELECT doc_id, bucket, round(v / u, 5) AS value FROM v JOIN u USING (doc_id) WHERE v <> 0"
SIGN = "CASE WHEN ('0x' || substring(md5(token), 9, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END"


@query("m1_hashed_bags", "WITH b AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS token FROM documents), " + HASHED.replace("FROM b GROUP", "FROM b WHERE token <> '' GROUP").format(size=64, sign=SIGN))
def m1(t):
    bags = t.documents.select("doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("token")).where("token != ''")
    return ln.hashed_vectors(bags, "doc_id", "token").withColumn("value", F.round("value", 5))


@query("m2_context_vectors", "WITH w AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^a-z]+') AS w FROM documents), b AS (SELECT doc_id, w[i] || '_' || w[i + 2] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 30)), " + HASHED.format(size=256, sign="1.0"))
def m2(t):
    words = t.documents.select("doc_id", F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+").alias("w")).where(F.size("w") >= 30)
    grams = words.select("doc_id", F.explode(F.zip_with(F.expr("slice(w, 1, size(w) - 2)"), F.expr("slice(w, 3, size(w) - 2)"), lambda a, b: F.concat_ws("_", a, b))).alias("token"))
    return ln.hashed_vectors(grams, "doc_id", "token", 256, signed=False).withColumn("value", F.round("value", 5))


TRUTH = "r AS (SELECT l.doc_id, lang, d.n_chars > 900 AS predicted, toxic = 1 AS truth FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
CONF = "sum(CASE WHEN predicted AND truth THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN predicted AND NOT truth THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT predicted AND truth THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT predicted AND NOT truth THEN 1 ELSE 0 END) AS tn"


def truth(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", (F.col("n_chars") > 900).alias("predicted"), (F.col("toxic") == 1).alias("truth"))


def scored(empty: str) -> str:
    return f"s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE {empty} END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE {empty} END AS r FROM c)"


@query("a27_confusion", f"WITH {TRUTH}, c AS (SELECT {CONF} FROM r), {scored('1.0')} SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END AS f1 FROM s")
def a27(t):
    return ln.confusion(truth(t), [], True)


@query("a28_confusion_by_category", f"WITH {TRUTH}, c AS (SELECT lang, {CONF} FROM r GROUP BY lang), {scored('0.0')} SELECT lang, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END AS f1 FROM s")
def a28(t):
    return ln.confusion(truth(t), ["lang"], False)


@query("a29_regression_gate", f"WITH {TRUTH}, c AS (SELECT lang, {CONF} FROM r GROUP BY lang), b AS (SELECT lang, {CONF} FROM r WHERE doc_id % 2 = 0 GROUP BY lang), x AS (SELECT c.lang, c.tp / greatest(1, c.tp + c.fn) AS now, b.tp / greatest(1, b.tp + b.fn) AS was FROM c JOIN b USING (lang)) SELECT lang, round(was, 6) AS before, round(now, 6) AS after FROM x WHERE round(was, 6) - round(now, 6) > 0.02")
def a29(t):
    r = truth(t)
    return ln.regressions(ln.confusion(r, ["lang"], False), ln.confusion(r.where("doc_id % 2 = 0"), ["lang"], False), "lang", {"recall": 0.02}).select("lang", "before", "after")


SCORES = "p AS (SELECT l.doc_id AS id, toxic AS label, ((l.doc_id * 37 + d.n_chars) % 100) / 100 AS prob FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def scores(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), (((F.col("doc_id") * 37 + F.col("n_chars")) % 100) / 100).alias("prob"))


@query("m13_confident_learning", f"WITH {SCORES}, m AS (SELECT avg(CASE WHEN label = 1 THEN prob END) AS t1, avg(CASE WHEN label = 0 THEN 1 - prob END) AS t0 FROM p), o AS (SELECT id, label, CASE WHEN label = 1 THEN prob ELSE 1 - prob END AS own, CASE WHEN label = 1 THEN t0 ELSE t1 END AS lo, CASE WHEN label = 1 THEN t1 ELSE t0 END AS lw FROM p, m) SELECT id, round(own, 6) AS given, 1 - own >= lo AND (own < lw OR 1 - own > own) AS suspect FROM o")
def m13(t):
    return ln.confident_learning(scores(t)).select("id", "given", "suspect")


@query(
    "m13_confident_joint",
    f"""WITH {SCORES}, m AS (SELECT coalesce(avg(CASE WHEN label = 1 THEN prob END), 0.5) AS t1, coalesce(avg(CASE WHEN label = 0 THEN 1 - prob END), 0.5) AS t0 FROM p),
j AS (SELECT label, CASE WHEN prob >= t1 AND (1 - prob < t0 OR prob >= 0.5) THEN 1 WHEN 1 - prob >= t0 THEN 0 END AS likely FROM p, m),
k AS (SELECT given, likely FROM range(2) g(given), range(2) l(likely)), c AS (SELECT k.*, (SELECT count(*) FROM j WHERE label = given AND j.likely = k.likely) AS n, (SELECT count(*) FROM j WHERE label = given) AS every, (SELECT count(*) FROM j WHERE label = given AND j.likely IS NOT NULL) AS counted FROM k),
s AS (SELECT *, CASE WHEN counted > 0 THEN n * every / counted ELSE 0.0 END AS scaled FROM c)
SELECT given::INTEGER AS given, likely::INTEGER AS likely, n::BIGINT AS counted, round(coalesce(sum(CASE WHEN given <> likely THEN n END) OVER () / nullif(sum(n) OVER (), 0), 0), 6) AS noise, round(coalesce(scaled / nullif(sum(scaled) OVER (), 0), 0), 6) AS share, round(coalesce(sum(CASE WHEN given <> likely THEN scaled END) OVER () / nullif(sum(scaled) OVER (), 0), 0), 6) AS share_noise FROM s""",
)
def m13b(t):
    return ln.confident_joint(scores(t))


@query("a37_precision_at_k", f"WITH {SCORES}, k AS (SELECT * FROM p ORDER BY prob DESC, id LIMIT 50) SELECT (SELECT round(avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) FROM p) AS accuracy, (SELECT round(avg(label), 6) FROM k) AS precision_at_50, (SELECT round(greatest(avg(label), 1 - avg(label)), 6) FROM p) AS majority")
def a37(t):
    p = scores(t)
    top = p.orderBy(F.desc("prob"), "id").limit(50).agg(F.round(F.avg("label"), 6).alias("precision_at_50"))
    share = F.avg("label")
    all_ = p.agg(F.round(F.avg(F.when((F.col("prob") >= 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.greatest(share, 1 - share), 6).alias("majority"))
    return all_.crossJoin(F.broadcast(top))


@query("w7_uncertain", f"WITH {SCORES} SELECT id FROM p WHERE prob > 0.15 AND prob < 0.85 AND id % 10 <> 0 ORDER BY abs(prob - 0.5), id LIMIT 200")
def w7(t):
    p = scores(t).where("prob > 0.15 and prob < 0.85")
    cached = t.labels.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"))
    return p.join(cached, "id", "left_anti").orderBy(F.abs(F.col("prob") - 0.5), "id").limit(200).select("id")


@query("w11_split_search", "WITH x AS (SELECT toxic - (SELECT avg(toxic) FROM labels) AS r, quality AS v FROM labels) SELECT v, sum(n) OVER (ORDER BY v)::BIGINT AS n, round(sum(s) OVER (ORDER BY v), 6) AS running FROM (SELECT v, count(*) AS n, sum(r) AS s FROM x GROUP BY v)")
def w11(t):
    m = t.labels.agg(F.avg("toxic").alias("m"))
    g = t.labels.crossJoin(F.broadcast(m)).groupBy(F.col("quality").alias("v")).agg(F.count("*").alias("n"), F.sum(F.col("toxic") - F.col("m")).alias("s"))
    w = W.partitionBy(F.lit(0)).orderBy("v")
    return g.select("v", F.sum("n").over(w).alias("n"), F.round(F.sum("s").over(w), 6).alias("running"))


def features(t):
    d = t.documents.select("doc_id", "n_chars", (F.length("text") - F.length(F.translate("text", "\n", ""))).alias("n_lines"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("en"), F.col("text").rlike("(idiot|stupid|moron|loser|scum|trash|clown)").cast("double").alias("word"))
    return t.labels.join(d, "doc_id").select("doc_id", F.col("toxic").alias("label"), F.col("n_chars").cast("double").alias("n_chars"), F.col("n_lines").cast("double").alias("n_lines"), "en", "word")


@query("m11_boosted_stumps")
def m11(t):
    from siltstone.functions.quality import sigmoid, stump_score

    f = features(t)
    names = ["n_chars", "n_lines", "en", "word"]
    model = ln.train_stumps(f, names)
    return f.select("doc_id", "label", F.round(sigmoid(stump_score({n: F.col(n) for n in names}, model["stumps"], model["base"], model["rate"])), 6).alias("score"))


@query("m12_out_of_sample")
def m12(t):
    """Five folds; each fold is scored by stumps trained on the other four."""
    from siltstone.functions.quality import sigmoid, stump_score

    f = features(t).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))
    names = ["n_chars", "word"]
    models = ln.train_stumps_many(f.withColumn("_models", others), names, 5)
    score = F.lit(None).cast("double")
    for k, model in enumerate(models):
        score = F.when(F.col("fold") == k, sigmoid(stump_score({n: F.col(n) for n in names}, model["stumps"], model["base"], model["rate"]))).otherwise(score)
    return f.select("doc_id", "label", F.round(score, 6).alias("prob"))


def votes(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "n_chars", "lang", "toxic", "quality", "text")
    by = {
        "length": F.when(F.col("n_chars") < 300, 0).when(F.col("n_chars") > 900, 1),
        "lang": F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 0),
        "word": F.when(F.col("text").rlike("(idiot|stupid|moron|loser)"), 1).otherwise(0),
        "toxic": F.col("toxic"),
        "quality": F.when(F.col("quality") == 0, 1),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("voter"), v.cast("int").alias("vote")) for k, v in by.items())))
    return d.select(F.col("doc_id").alias("candidate"), pairs.alias("x")).select("candidate", "x.voter", "x.vote")


@query("m14_label_model")
def m14(t):
    p, _ = ln.dawid_skene(votes(t))
    return p.select("candidate", F.round("p", 6).alias("p"))


@query("m15_m16_voters")
def m15(t):
    _, c = ln.dawid_skene(votes(t))
    report = ln.voter_report(c).select("voter", F.round("accuracy", 6).alias("accuracy"), F.round("lean", 6).alias("lean"), "biased")
    state = ln.carried_state(c, "toxic").groupBy("voter").agg(F.round(F.sum(F.col("n0") + F.col("n1")), 6).alias("carried"))
    return report.join(state, "voter")


@query("m17_labelling_functions", f"WITH {LINE}, norm AS (SELECT path, ln, lower(regexp_replace(txt, '[ \\t\\r\\n\\f]+', '', 'g')) AS n FROM line), f AS (SELECT n, count(*) AS c FROM norm GROUP BY n), d AS (SELECT path, count(*) AS lines FROM line GROUP BY path) SELECT path, ln::BIGINT AS ln, CASE WHEN c >= 100 THEN 0 WHEN c = 1 THEN 1 END AS rarity, CASE WHEN lines < 4 THEN NULL WHEN lines > 12 THEN 1 ELSE 0 END AS density FROM norm JOIN f USING (n) JOIN d USING (path)")
def m17(t):
    rows = lines(files(t)).select("path", "ln", F.lower(F.regexp_replace("txt", r"[ \t\r\n\f]+", "")).alias("n"))
    freq = rows.groupBy("n").agg(F.count("*").alias("c"))
    size = rows.groupBy("path").agg(F.count("*").alias("lines"))
    j = rows.join(freq, "n").join(size, "path")
    return j.select("path", F.col("ln").cast("long").alias("ln"), F.when(F.col("c") >= 100, 0).when(F.col("c") == 1, 1).alias("rarity"), F.when(F.col("lines") < 4, None).when(F.col("lines") > 12, 1).otherwise(0).alias("density"))


@query("a39_m18_induction", f"WITH {SCORES}, d AS (SELECT source, prob AS p FROM p JOIN documents ON doc_id = id), g AS (SELECT source, sum(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN p <= 0.1 THEN 1 ELSE 0 END) AS r, sum(CASE WHEN p > 0.1 AND p < 0.9 THEN 1 ELSE 0 END) AS u FROM d GROUP BY source) SELECT source, c::BIGINT AS confirmed, r::BIGINT AS refuted, u::BIGINT AS uncertain, CASE WHEN c + r < 5 THEN 'no-evidence' WHEN c / (c + r) >= 0.85 THEN 'approve' WHEN c / (c + r) >= 0.5 THEN 'review' ELSE 'quarantine' END AS verdict FROM g")
def a39(t):
    cases = scores(t).join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id").select("source", F.col("prob").alias("p"))
    return ln.verdicts(cases, "source")


@query("j23_m24_evidence", f"WITH {SCORES} SELECT CASE WHEN doc_id IS NULL THEN 'pending' WHEN (prob >= 0.5) = (quality = 1) THEN 'corroborated' WHEN prob >= 0.9 THEN 'guard' ELSE 'discarded' END AS evidence, count(*)::BIGINT AS n FROM p LEFT JOIN (SELECT * FROM labels WHERE doc_id % 3 = 0) l ON l.doc_id = id GROUP BY 1")
def j23(t):
    known = t.labels.where("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), "quality")
    j = scores(t).join(known, F.col("id") == F.col("k"), "left")
    e = F.when(F.col("k").isNull(), "pending").when((F.col("prob") >= 0.5) == (F.col("quality") == 1), "corroborated").when(F.col("prob") >= 0.9, "guard").otherwise("discarded")
    return j.groupBy(e.alias("evidence")).agg(F.count("*").alias("n"))


#: Rules and their pattern variants, as data.
VARIANTS = (("R1", "base", "the "), ("R1", "word", "(^| )the "), ("R1", "both", "(^| )the .*and"), ("R2", "base", "de"), ("R2", "word", "(^| )de( |$)"))
GRID = "spec AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in VARIANTS) + ") s(rule_id, variant, regex)), c0 AS (SELECT 'R1' AS rule_id, text, item_id % 3 <> 0 AS truth FROM benchmark UNION ALL SELECT 'R2', text, item_id % 3 = 0 FROM benchmark), r AS (SELECT c0.rule_id, variant, truth, regexp_matches(text, regex) AS predicted FROM c0 JOIN spec ON c0.rule_id = spec.rule_id), c AS (SELECT rule_id, variant, " + CONF + " FROM r GROUP BY ALL), " + scored("1.0") + ", f AS (SELECT rule_id, variant, round(p, 6) AS precision, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0.0 END AS f1 FROM s)"


def grid(t):
    spec = t.spark.createDataFrame(list(VARIANTS), "rule_id string, variant string, regex string")
    b = t.benchmark
    cases = b.select(F.lit("R1").alias("rule_id"), "text", (F.col("item_id") % 3 != 0).alias("truth")).unionByName(b.select(F.lit("R2").alias("rule_id"), "text", (F.col("item_id") % 3 == 0).alias("truth")))
    return ln.variant_grid(spec, cases)


@query("m19_variant_grid", f"WITH {GRID} SELECT rule_id, variant, precision, f1 FROM f")
def m19(t):
    return grid(t).select("rule_id", "variant", "precision", "f1")


@query("m20_promotion", f"WITH {GRID}, b AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY f1 DESC, precision DESC, variant DESC) AS k FROM f) SELECT b.rule_id, b.variant, b.f1, o.f1 AS base_f1, b.f1 > o.f1 AND b.precision >= 0.85 AS promoted FROM b JOIN f o ON o.rule_id = b.rule_id AND o.variant = 'base' WHERE k = 1")
def m20(t):
    return ln.promote(grid(t), "base")


@query("m21_proposal_hits", "SELECT regexp_matches(text, '(^| )the ') AS hit, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def m21(t):
    return t.documents.groupBy(F.col("text").rlike("(^| )the ").alias("hit")).agg(F.count("*").alias("n"))


@query("u3_regressions", f"WITH {TRUTH} SELECT doc_id FROM r WHERE predicted <> truth EXCEPT SELECT doc_id FROM r WHERE predicted <> truth AND doc_id % 2 = 0")
def u3(t):
    r = truth(t).where("predicted != truth").select("doc_id")
    return r.exceptAll(r.where("doc_id % 2 = 0"))


@query("m23_token_rules", "WITH tok AS (SELECT DISTINCT d.doc_id, toxic, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents d JOIN labels USING (doc_id)), n AS (SELECT w, sum(toxic) AS tp, sum(1 - toxic) AS fp FROM tok WHERE w <> '' GROUP BY w), p AS (SELECT sum(toxic) AS pos FROM labels) SELECT w AS token, tp::BIGINT AS tp, fp::BIGINT AS fp, round(2 * tp / (2 * tp + fp + (pos - tp)), 6) AS f1 FROM n, p WHERE tp >= 4 AND tp / (tp + fp) >= 0.85")
def m23(t):
    tok = t.documents.join(t.labels, "doc_id").select("doc_id", "toxic", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("token")).where("token != ''")
    n = tok.groupBy("token").agg(F.sum("toxic").alias("tp"), F.sum(1 - F.col("toxic")).alias("fp"))
    pos = t.labels.agg(F.sum("toxic").alias("pos"))
    ok = n.where((F.col("tp") >= 4) & (F.col("tp") / (F.col("tp") + F.col("fp")) >= 0.85)).crossJoin(F.broadcast(pos))
    return ok.select("token", "tp", "fp", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("pos") - F.col("tp")), 6).alias("f1"))


#: Mutations as data: of each part a spec for one of the rules, some of them broken.
SPEC_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'append_regex_alt' WHEN 1 THEN 'replace_in_regex' WHEN 2 THEN 'set_unless' WHEN 3 THEN 'append_unless_alt' ELSE 'other' END"
SPEC_VALUE = "CASE WHEN p_partkey % 7 = 0 THEN p_brand || '(' WHEN p_partkey % 5 = 1 THEN '{12,}=>{16,}' ELSE p_brand END"
MUTATED = "CASE kind WHEN 'append_regex_alt' THEN regex || '|' || value WHEN 'replace_in_regex' THEN CASE WHEN strpos(value, '=>') > 0 AND strpos(regex, '{12,}') > 0 THEN replace(regex, '{12,}', '{16,}') ELSE regex END ELSE regex END"
UNLESS = "CASE kind WHEN 'set_unless' THEN value WHEN 'append_unless_alt' THEN CASE WHEN unless IS NULL THEN value ELSE unless || '|' || value END ELSE unless END"


@query("x3_x4_mutations", f"WITH {RULE}, spec AS (SELECT p_partkey AS id, p_partkey % 10 AS seq, {SPEC_KIND} AS kind, {SPEC_VALUE} AS value FROM part), m AS (SELECT rule_id, id, {MUTATED} AS regex, {UNLESS} AS unless, kind, value FROM spec JOIN rule USING (seq) WHERE regex <> '') SELECT rule_id, id::VARCHAR AS id, regex, unless, strpos(value, '(') = 0 OR kind IN ('replace_in_regex', 'other') AS safe FROM m")
def x4(t):
    from siltstone.operators.matching import PACK, rule_table

    rules = rule_table(t.spark, PACK).where("regex != ''")
    specs = t.part.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 10).cast("int").alias("seq"), F.expr(SPEC_KIND).alias("kind"), F.expr(SPEC_VALUE).alias("value"))
    return ln.mutate(rules, specs.join(rules.select("seq", "rule_id"), "seq").drop("seq"))


@query("x1_failing_voter", "SELECT doc_id, CASE WHEN len(w) >= 40 THEN (len(w[40]) > 4)::INTEGER END AS vote FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), ' ') AS w FROM documents)")
def x1(t):
    """A labelling function that fails on short texts, which is an abstention."""
    long_word = ln.voter(lambda text: len((text or "").split(" ")[39]) > 4)
    return t.documents.select("doc_id", long_word("text").alias("vote"))


@query("x2_recorded_votes", "SELECT d.doc_id AS candidate, 'outside' AS voter, toxic::INTEGER AS vote FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def x2(t):
    return ln.recorded_votes(t.documents.select(F.col("doc_id").alias("candidate")), t.labels.select(F.col("doc_id").alias("candidate"), F.col("toxic").alias("vote")), "outside")
