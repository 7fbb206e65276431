"""T01-T18, J14, S03-S09 on text tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import rules
from tideline.operators import text
from tideline.plans import views as v
from tideline.plans.registry import query, rnd, rsql
from tideline.plans.scalars import CLEAN, TOPIC
from tideline.plans.storage import fresh
from tideline.session import cut_lineage

WEIGHTS = {"src0": 1.0, "src1": 0.7, "src2": 0.6, "src3": 0.6}
W_SQL = "CASE source WHEN 'src0' THEN 1.0e0 WHEN 'src1' THEN 0.7e0 WHEN 'src2' THEN 0.6e0 WHEN 'src3' THEN 0.6e0 ELSE 0.5e0 END"
COS = 0.35
NB = f"""sim AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {COS}),
nb AS (SELECT vec_id, count(sim.b) AS neighbours FROM embeddings LEFT JOIN sim ON sim.a = vec_id GROUP BY 1)"""
TRUST = f"tr AS (SELECT d.doc_id, d.source, d.lang, d.text, nb.neighbours, e.label, round(least(1, {W_SQL} * (1 + 0.2e0 * least(nb.neighbours, 4))), 4) AS trust FROM documents d JOIN nb ON d.doc_id = nb.vec_id JOIN embeddings e ON e.vec_id = d.doc_id)"


@query("T01_html_text", f"SELECT page_id, {CLEAN} AS body FROM pages")
def _(t):
    return text.clean(t.pages, "html", "body").select("page_id", "body")


S_SQL = "round(least(1, " + " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {w!r}e0 ELSE 0 END" for p, w in text.SUSPICIOUS) + "), 4)"


@query("T02_suspicious_text_scan", f"SELECT doc_id, {S_SQL} AS injection_score, {S_SQL} >= 0.5 AS injection_flag FROM documents")
def _(t):
    return text.scan_text(t.documents, "text").select("doc_id", "injection_score", "injection_flag")


@query("T03_unit_vectors", f"SELECT vec_id, {rsql('list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))', 4)} AS norm2 FROM embeddings")
def _(t):
    n2 = F.aggregate(text.unit(F.col("embedding")), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return t.embeddings.select("vec_id", rnd(n2, 4).alias("norm2"))


@query("J14_similarity_join", f"WITH {NB} SELECT a, b, {rsql('cosine', 5)} AS cosine FROM sim WHERE a < b")
def _(t):
    return text.similar(t.embeddings, "vec_id", "embedding", COS).select("a", "b", rnd("cosine", 5).alias("cosine"))


@query("T04_corroboration_count", f"WITH {NB} SELECT vec_id, neighbours FROM nb")
def _(t):
    return text.similar(t.embeddings, "vec_id", "embedding", COS, counts=True)


def trusted(t):
    nb = text.similar(t.embeddings, "vec_id", "embedding", COS, counts=True)
    d = t.documents.join(nb.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id")
    return d.withColumn("trust", text.trust(d, WEIGHTS))


@query("T05_trust_score", f"WITH {NB}, {TRUST} SELECT doc_id, source, {rsql('trust', 4)} AS trust FROM tr")
def _(t):
    return trusted(t).select("doc_id", "source", rnd("trust", 4).alias("trust"))


@query("T06_content_dedup", "SELECT left(sha1(concat_ws('|', source, text)), 16) AS id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy(rules.stable_id(F.col("source"), F.col("text")).alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("T07_kmeans")
def _(t):
    n = t.embeddings.count()
    return text.kmeans(t.embeddings, "embedding", max(2, int((n / 2) ** 0.5))).select("vec_id", "cluster_id")


@query("T08_hierarchical_clusters")
def _(t):
    n = t.embeddings.count()
    return text.kmeans(t.embeddings, "embedding", max(2, int((n / 2) ** 0.5)), bisecting=True).select("vec_id", "cluster_id")


DENSE = f"""WITH RECURSIVE {NB}, core AS (SELECT vec_id FROM nb WHERE neighbours + 1 >= 3), ce AS (SELECT a, b FROM sim WHERE a IN (FROM core) AND b IN (FROM core)),
reach(id, r) AS (SELECT vec_id, vec_id FROM core UNION SELECT reach.id, ce.b FROM reach JOIN ce ON reach.r = ce.a), lab AS (SELECT id, min(r) AS label FROM reach GROUP BY 1),
bord AS (SELECT sim.a AS id, min(lab.label) AS label FROM sim JOIN lab ON lab.id = sim.b GROUP BY 1), cl AS (SELECT vec_id, coalesce(lab.label, bord.label, -1) AS cluster_id FROM embeddings LEFT JOIN lab ON lab.id = vec_id LEFT JOIN bord ON bord.id = vec_id)"""


@query("T09_density_clusters", f"{DENSE} SELECT vec_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM cl")
def _(t):
    return text.dbscan(t.embeddings, "vec_id", "embedding", COS, 3)


QUAL = """lx AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x, vec_id FROM embeddings), cen AS (SELECT label, i, avg(x) AS c, count(*) AS n FROM lx GROUP BY 1, 2), gl AS (SELECT i, avg(x) AS g FROM lx GROUP BY 1),
w AS (SELECT sum(power(x - c, 2)) AS within FROM lx JOIN cen USING (label, i)), bt AS (SELECT sum(n * power(c - g, 2)) AS between_ FROM cen JOIN gl USING (i)), sp AS (SELECT label, avg(d) AS s FROM (SELECT label, vec_id, sqrt(sum(power(x - c, 2))) AS d FROM lx JOIN cen USING (label, i) GROUP BY 1, 2) GROUP BY 1),
gp AS (SELECT a.label AS l1, b.label AS l2, sqrt(sum(power(a.c - b.c, 2))) AS d FROM cen a JOIN cen b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2), db AS (SELECT avg(r) AS db FROM (SELECT l1, max((s1.s + s2.s) / d) AS r FROM gp JOIN sp s1 ON s1.label = l1 JOIN sp s2 ON s2.label = l2 GROUP BY 1)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings)"""


@query("T10_cluster_quality", f"WITH {QUAL} SELECT k AS n_clusters, n AS n_clustered, {rsql('(between_ / (k - 1)) / (within / (n - k))', 4)} AS calinski_harabasz, {rsql('db', 4)} AS davies_bouldin, CAST(0 AS BIGINT) AS n_noise FROM w, bt, db, k")
def _(t):
    d = text.cluster_quality(t.embeddings, "embedding", "label")
    return d.select("n_clusters", "n_clustered", rnd("calinski_harabasz", 4).alias("calinski_harabasz"), rnd("davies_bouldin", 4).alias("davies_bouldin"), "n_noise")


@query("T10_silhouette", f"""WITH p AS (SELECT a.vec_id, a.label, b.label AS of, avg(power(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)) AS d, count(*) AS n FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3),
s AS (SELECT label, max(CASE WHEN of = label THEN n END) AS n, max(CASE WHEN of = label THEN d * n END) / nullif(max(CASE WHEN of = label THEN n END) - 1, 0) AS a, min(CASE WHEN of <> label THEN d END) AS b FROM p GROUP BY vec_id, label)
SELECT label, count(*) AS n, {rsql('avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 4)} AS silhouette FROM s GROUP BY 1""")
def _(t):
    d = text.silhouettes(t.embeddings, "embedding", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))
    return d.select("label", "n", rnd("silhouette", 4).alias("silhouette"))


@query("T11_clusterings_ranked")
def _(t):
    k = max(2, int((t.embeddings.count() / 2) ** 0.5))
    found = {"kmeans": text.kmeans(t.embeddings, "embedding", k), "bisecting": text.kmeans(t.embeddings, "embedding", k, bisecting=True), "labels": t.embeddings.withColumn("cluster_id", F.col("label"))}
    d = text.rank_clusterings({m: cut_lineage(c.select("embedding", "cluster_id")) for m, c in found.items()}, "embedding")
    return d.orderBy(F.desc("score"))


@query("T11_method_ranking", f"""WITH m AS (SELECT source AS method, avg(quality) AS sil, avg(toxic) AS db, count(*) * 1e0 AS ch, count(*) FILTER (lang <> 'en') AS nn, count(DISTINCT lang) AS nc FROM documents JOIN labels USING (doc_id) GROUP BY 1),
s AS (SELECT method, sil - 0.5 * db + ch / 1000 - CASE WHEN nn / greatest(nn + nc, 1) > 0.5 THEN 2 * nn / greatest(nn + nc, 1) ELSE nn / greatest(nn + nc, 1) END AS score FROM m) SELECT method, {rsql('score')} AS score FROM s""")
def _(t):
    m = t.documents.join(t.labels, "doc_id").groupBy(F.col("source").alias("method")).agg(
        F.avg("quality").alias("sil"), F.avg("toxic").alias("db"), (F.count(F.lit(1)) * 1.0).alias("ch"), F.count_if(F.col("lang") != "en").alias("nn"), F.count_distinct("lang").alias("nc"))
    return m.select("method", rnd(text.method_score(*[F.col(x) for x in ("sil", "db", "ch", "nn", "nc")])).alias("score"))


TOPIC_H = TOPIC.replace("text", "h")


@query("T12_cluster_labels", f"WITH {NB}, {TRUST}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY trust DESC, doc_id) AS k FROM tr), c AS (SELECT label, string_agg('- ' || text, chr(10) ORDER BY k) AS h FROM r WHERE k <= 5 GROUP BY 1) SELECT label, {TOPIC_H} AS cluster_label FROM c")
def _(t):
    return text.label_clusters(trusted(t), ["label"], "text", "trust", "doc_id")


@query("T13_noise_share_alert", f"SELECT source, {rsql('avg(CAST(lang = \'fr\' AS INT))')} AS noise_share, avg(CAST(lang = 'fr' AS INT)) > 0.3 AS drift_alert FROM documents GROUP BY 1")
def _(t):
    d = t.documents.withColumn("cluster_id", F.when(F.col("lang") == "fr", -1).otherwise(1))
    return text.noise_share(d, ["source"]).select("source", rnd("noise_share").alias("noise_share"), "drift_alert")


@query("T14_news_pipeline")
def _(t):
    d = trusted(t).where(~F.col("text").ilike("%ignore previous%") & (F.length("text") > 0))
    d = cut_lineage(d)
    cl = text.dbscan(d, "doc_id", "embedding", COS, 3)
    d = d.join(cl, "doc_id")
    lab = text.label_clusters(d.where("cluster_id <> -1"), ["cluster_id"], "text", "trust", "doc_id")
    noise = F.col("cluster_id") == -1
    return d.join(lab, "cluster_id", "left").select("doc_id", "source", "cluster_id", "cluster_label", noise.alias("is_noise"), F.when(noise, 0.0).otherwise(F.col("trust")).alias("trust_score"))


SYM = "CASE WHEN doc_id % 5 = 0 THEN 'click' WHEN doc_id % 5 = 1 THEN 'error' ELSE 'view' END"
NEWS = f"""nw AS (SELECT {SYM} AS symbol, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id * 43 % 43200) AS published_at, {TOPIC} AS cluster_label, lang = 'fr' AS is_noise, (doc_id % 10) / 10e0 AS trust FROM documents),
pb AS (SELECT symbol, as_of FROM (SELECT unnest(['click', 'error', 'view']) AS symbol), (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS TIMESTAMP) AS as_of))"""


def news(t):
    i = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + (i * 43 % 43200) * 60).cast("timestamp_ntz")
    return t.documents.select(F.when(i % 5 == 0, "click").when(i % 5 == 1, "error").otherwise("view").alias("symbol"), at.alias("published_at"),
                              rules.topic(F.col("text")).alias("cluster_label"), (F.col("lang") == "fr").alias("is_noise"), (i % 10 / F.lit(10.0)).alias("trust"))


def probes(t):
    days = F.sequence(F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-30").cast("timestamp_ntz"), F.expr("interval 1 day"))
    return news(t).select("symbol").distinct().select("symbol", F.explode(days).alias("as_of"))


SENT = "CASE WHEN cluster_label IN ('protocol_upgrade', 'listing', 'adoption', 'partnership') THEN 0.6e0 WHEN cluster_label IN ('regulatory', 'hack') THEN -0.4e0 ELSE 0e0 END"
VEC = f"""fv AS (SELECT pb.symbol, pb.as_of, count(nw.published_at) AS n_news, CASE WHEN count(nw.published_at) = 0 THEN 0 ELSE 1 - count(*) FILTER (NOT is_noise) / count(nw.published_at) END AS novelty,
  coalesce(sum({SENT} * trust) FILTER (NOT is_noise) / nullif(sum(trust) FILTER (NOT is_noise), 0), 0) AS sentiment FROM pb LEFT JOIN nw ON nw.symbol = pb.symbol AND published_at > as_of - INTERVAL 24 HOUR AND published_at <= as_of GROUP BY 1, 2)"""


@query("T15_forward_news_vector", f"WITH {NEWS}, {VEC} SELECT symbol, as_of, n_news, {rsql('novelty')} AS novelty, {rsql('sentiment')} AS sentiment FROM fv")
def _(t):
    return text.forward_vectors(news(t), probes(t)).select("symbol", "as_of", "n_news", rnd("novelty").alias("novelty"), rnd("sentiment").alias("sentiment"))


OUT = """oc AS (SELECT pb.symbol, pb.as_of, CASE WHEN e >= as_of + INTERVAL 24 HOUR THEN h24.close / h0.close - 1 END AS r24, CASE WHEN e >= as_of + INTERVAL 168 HOUR THEN h168.close / h0.close - 1 END AS r168 FROM (SELECT *, as_of + INTERVAL 24 HOUR AS a1, as_of + INTERVAL 168 HOUR AS a2 FROM pb) pb
 ASOF LEFT JOIN hourly h0 ON pb.symbol = h0.symbol AND as_of >= h0.ts ASOF LEFT JOIN hourly h24 ON pb.symbol = h24.symbol AND a1 >= h24.ts ASOF LEFT JOIN hourly h168 ON pb.symbol = h168.symbol AND a2 >= h168.ts LEFT JOIN (SELECT symbol, max(ts) AS e FROM hourly GROUP BY 1) m ON m.symbol = pb.symbol)"""


def outcomes(t):
    return text.fill_outcomes(probes(t), v.hourly(t))


@query("T16_late_outcome_fill", f"WITH {v.HOURLY}, {NEWS}, {OUT} SELECT symbol, as_of, {rsql('r24')} AS ret_24h, {rsql('r168')} AS ret_168h, r24 IS NOT NULL AND r168 IS NOT NULL AS sealed FROM oc")
def _(t):
    return outcomes(t).select("symbol", "as_of", rnd("ret_24h").alias("ret_24h"), rnd("ret_168h").alias("ret_168h"), "sealed")


@query("T17_forward_status", f"WITH {v.HOURLY}, {NEWS}, {OUT} SELECT count(DISTINCT CAST(as_of AS DATE)) AS days, count(DISTINCT symbol) AS symbols, count(*) AS rows, count(*) FILTER (r24 IS NOT NULL AND r168 IS NOT NULL) AS sealed, max(as_of) AS latest, count(DISTINCT CAST(as_of AS DATE)) >= 90 AS gate_open FROM oc")
def _(t):
    return text.forward_status(outcomes(t))


@query("T18_forward_log_write", f"WITH {v.HOURLY}, {NEWS}, {VEC}, {OUT} SELECT symbol, as_of, n_news, {rsql('sentiment')} AS sentiment, {rsql("CASE WHEN as_of < TIMESTAMP '2024-01-16' THEN r24 END")} AS ret_24h, as_of < TIMESTAMP '2024-01-16' AND r24 IS NOT NULL AND r168 IS NOT NULL AS scored FROM fv JOIN oc USING (symbol, as_of)")
def _(t):
    path, n, p = fresh(t, "forward"), cut_lineage(news(t)), cut_lineage(probes(t))
    prices, mid = cut_lineage(v.hourly(t).select("symbol", "ts", "close")), F.lit("2024-01-16").cast("timestamp_ntz")
    text.log_forward(path, n, p.where(F.col("as_of") < mid), prices.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")), "2024-01-16")
    for stamp in ("2024-02-10", "2024-02-11"):  # the second run and its repetition
        text.log_forward(path, n, p.where(F.col("as_of") >= mid), prices, stamp)
    return t.spark.read.parquet(path).select("symbol", "as_of", "n_news", rnd("sentiment").alias("sentiment"), rnd("ret_24h").alias("ret_24h"), F.col("scored_at").isNotNull().alias("scored"))
