"""Queries of connectors, sinks, streams and models: inputs are written to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features
from ..operators import models, policy, sampling
from ..sources import dated, feeds, sinks
from ..streaming import incremental
from . import adapters as A
from .registry import query


def _text(spark, df, name: str) -> str:
    folder = incremental.shared_folder(spark, "feeds")
    df.write.option("lineSep", "\n").text(f"{folder}/{name}")
    return f"{folder}/{name}"


@query("src_text", "SELECT url, count(*) AS n FROM v_urls WHERE ord % 10 <> 0 GROUP BY 1")
def src_text(spark, sf):
    line = F.when(F.col("ord") % 10 == 0, "# comment").when(F.col("ord") % 2 == 0, F.concat(F.col("ord").cast("string"), F.lit(","), F.col("url"))).otherwise(F.concat(F.lit("  "), F.col("url")))
    path = _text(spark, A.urls(spark, sf).select(line.alias("value")), "lines.txt")
    return feeds.read_any(spark, path).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query("src_csv_generic", "SELECT ord, url, label FROM v_urls")
def src_csv_generic(spark, sf):
    folder = incremental.shared_folder(spark, "feeds") + "/rows.csv"
    sinks.export_csv(A.urls(spark, sf), folder)
    return feeds.read_any(spark, folder).select(F.col("ord").cast("long").alias("ord"), "url", "label")


@query("src_jsonl", "SELECT CAST(ord AS VARCHAR) AS ord, url FROM v_urls")
def src_jsonl(spark, sf):
    path = _text(spark, A.urls(spark, sf).select(F.to_json(F.struct("ord", "url")).alias("value")), "rows.jsonl")
    return feeds.read_any(spark, path).select("ord", "url")


@query("src_json", "SELECT CAST(ord AS BIGINT) AS ord, url FROM v_urls")
def src_json(spark, sf):
    """Files of one JSON array each, of up to 500 records."""
    folder = incremental.shared_folder(spark, "feeds") + "/rows.json"
    arrays = A.urls(spark, sf).groupBy(F.floor(F.col("ord") / 500)).agg(F.to_json(F.collect_list(F.struct("ord", "url"))).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(folder)
    return feeds.read_any(spark, folder).select(F.col("ord").cast("long").alias("ord"), "url")


@query("snk_csv", "SELECT ord, url, label, source, collected_at FROM v_raw")
def snk_csv(spark, sf):
    """What an export holds, read again with the engine's own reader; blanks and quotes survive."""
    folder = incremental.shared_folder(spark, "sinks") + "/raw.csv"
    rows = A.raw(spark, sf)
    sinks.export_csv(rows, folder)
    return spark.read.csv(folder, header=True, schema=rows.schema, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, multiLine=True)


@query("src_tranco", "SELECT 'https://' || hostname AS url, 'BENIGN' AS label, 'tranco' AS source, min(ord) AS rank FROM v_hosts GROUP BY hostname")
def src_tranco(spark, sf):
    rows = A.hosts(spark, sf).groupBy("hostname").agg(F.min("ord").alias("rank"))
    path = _text(spark, rows.select(F.concat_ws(",", F.col("rank").cast("string"), "hostname").alias("value")), "top.csv")
    return feeds.parse(spark, "tranco", path, collected_at="2026-09-01").select("url", "label", "source", "rank")


@query("src_openphish", "SELECT url, 'PHISHING' AS label, 'openphish' AS source, '2026-09-01' AS collected_at FROM v_urls")
def src_openphish(spark, sf):
    path = _text(spark, A.urls(spark, sf).select(F.concat("url", F.lit("  ")).alias("value")), "feed.txt")
    return feeds.parse(spark, "openphish", path, collected_at="2026-09-01").select("url", "label", "source", "collected_at")


@query("src_phish_db", "SELECT DISTINCT 'https://' || hostname || '/' AS url, 'phishing_database' AS source FROM v_hosts")
def src_phish_db(spark, sf):
    path = _text(spark, A.hosts(spark, sf).select(F.concat("hostname", F.lit(".")).alias("value")).distinct(), "domains.txt")
    return feeds.parse(spark, "phishing_database", path, collected_at="2026-09-01").select("url", "source")


@query("src_commoncrawl", "SELECT url, 'commoncrawl_tranco_candidate' AS source FROM v_urls")
def src_commoncrawl(spark, sf):
    path = _text(spark, A.urls(spark, sf).select(F.to_json(F.struct("url", "ord")).alias("value")), "index.jsonl")
    return feeds.parse(spark, "commoncrawl", path, collected_at="2026-09-01").select("url", "source")


@query("src_phishtank", "SELECT url, collected_at, 'phishtank' AS source FROM v_urls WHERE ord % 3 = 0 AND ord % 2 = 0")
def src_phishtank(spark, sf):
    folder = incremental.shared_folder(spark, "feeds") + "/verified.csv"
    yes = lambda n: F.when(F.col("ord") % n == 0, "Yes").otherwise("no")
    sinks.export_csv(A.urls(spark, sf).select(F.col("ord").alias("phish_id"), "url", F.col("collected_at").alias("submission_time"), yes(3).alias("verified"), yes(2).alias("online")), folder)
    return feeds.parse(spark, "phishtank", folder).select("url", "collected_at", "source")


@query("src_cert_pl", "SELECT DISTINCT 'https://' || hostname || '/' AS url, 'PHISHING' AS label, 'cert_polska' AS source FROM v_hosts")
def src_cert_pl(spark, sf):
    rows = A.hosts(spark, sf).groupBy("hostname").agg(F.min("ord").alias("ord"))
    listed = F.collect_list(F.struct(F.concat(F.lit(" "), "hostname", F.lit(".")).alias("DomainAddress"), F.col("ord").alias("RegisterPositionId")))
    folder = incremental.shared_folder(spark, "feeds") + "/hole.json"
    rows.groupBy(F.floor(F.col("ord") / 500)).agg(F.to_json(listed).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return feeds.parse(spark, "cert_polska", folder, collected_at="2026-09-01").select("url", "label", "source")


@query("src_threatfox", "SELECT 'https://' || hostname || '/' AS url, 'MALWARE' AS label, 'botnet_cc' AS threat_type, min(ord) % 3 AS kind FROM v_hosts GROUP BY hostname HAVING min(ord) % 3 <> 1")
def src_threatfox(spark, sf):
    """Documents of up to 500 indicators; those of other kinds and threats go."""
    folder = incremental.shared_folder(spark, "feeds") + "/iocs.json"
    rows = A.hosts(spark, sf).groupBy("hostname").agg((F.min("ord") % 3).alias("kind"), F.min("ord").alias("ord"))
    listed = rows.select("ord", F.struct(F.concat(F.lit("."), "hostname", F.lit(".")).alias("ioc"), F.when(F.col("kind") == 1, "url").otherwise("domain").alias("ioc_type"), F.lit("botnet_cc").alias("threat_type"), F.array(F.col("kind").cast("string")).alias("tags")).alias("d"))
    docs = listed.groupBy(F.floor(F.col("ord") / 500)).agg(F.to_json(F.struct(F.lit("ok").alias("query_status"), F.collect_list("d").alias("data"))).alias("value")).select("value")
    docs.write.option("maxRecordsPerFile", 1).text(folder)
    return feeds.parse(spark, "threatfox", folder, collected_at="2026-09-01").select("url", "label", "threat_type", F.col("tags").cast("long").alias("kind"))


@query("src_urlhaus", "SELECT url, collected_at, 'MALWARE' AS label FROM v_urls")
def src_urlhaus(spark, sf):
    rows = A.urls(spark, sf)
    body = rows.select(F.concat_ws(",", F.col("ord").cast("string"), "collected_at", "url").alias("value"))
    head = spark.createDataFrame([("# id,dateadded,url",)], "value string")
    return feeds.parse(spark, "urlhaus", _text(spark, head.unionByName(body), "listed.csv"), collected_at="").select("url", "collected_at", "label")


@query("src_union_raw", "SELECT label, source, count(*) AS n FROM (SELECT 'BENIGN' AS label, 'a' AS source FROM v_urls UNION ALL SELECT 'PHISHING', 'b' FROM v_urls WHERE ord % 2 = 0) GROUP BY 1, 2")
def src_union_raw(spark, sf):
    root = incremental.shared_folder(spark, "raw")
    rows = A.urls(spark, sf)
    sinks.export_csv(rows.select(F.concat_ws("", F.lit("d"), F.col("ord").cast("string"), F.lit(".example")).alias("Domain"), F.col("ord").alias("extra")), f"{root}/benign/a.csv")
    rows.where("ord % 2 = 0").select("url").write.text(f"{root}/phishing/b.txt")
    return feeds.load_raw(spark, root, {"benign": ["a.csv"], "phishing": ["b.txt"]}).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"))


def _write_days(rows, root):
    """A file of urls a day, in one job."""
    days = rows.where("collected_at is not null").select("url", F.col("collected_at").alias("day"), "ord")
    days.repartition("day").sortWithinPartitions("day", "ord").select("url", "day").write.mode("append").partitionBy("day").text(root)


@query("src_snapshot_discover", "SELECT collected_at AS snapshot_date, CAST(count(*) AS INTEGER) AS records, sha256(string_agg(url || chr(10), '' ORDER BY ord)) AS sha256 FROM v_urls GROUP BY 1")
def src_snapshot_discover(spark, sf):
    root = incremental.shared_folder(spark, "snapshots")
    _write_days(A.urls(spark, sf), root)
    return feeds.discover_snapshots(spark, root).where("path like '%.txt'").select("snapshot_date", "records", "sha256")


@query("st_accumulate", "SELECT 'https://u' || user_id || '.example.org/' AS normalized_url, strftime(min(ts), '%Y-%m-%d') AS first_snapshot_date FROM events GROUP BY 1")
def st_accumulate(spark, sf):
    folder = incremental.shared_folder(spark, "stream")
    schema = A.read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    rows = stream.select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.org/")).alias("url"), F.date_format("ts", "yyyy-MM-dd").alias("snapshot_date"))
    incremental.accumulate_into(rows, f"{folder}/table", f"{folder}/state").awaitTermination()
    return incremental.read_accumulated(spark, f"{folder}/table")


@query("st_first_seen", "SELECT DISTINCT 'https://u' || user_id || '.example.org/' AS normalized_url FROM events")
def st_first_seen(spark, sf):
    folder = incremental.shared_folder(spark, "stream")
    stream = spark.readStream.schema(A.read(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    rows = stream.select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.org/")).alias("url"))
    incremental.run_to_table(incremental.first_seen(rows).select("normalized_url"), folder)
    return spark.read.parquet(f"{folder}/out")


@query("st_history", "SELECT DISTINCT user_id AS snapshot_id FROM events")
def st_history(spark, sf):
    folder = incremental.shared_folder(spark, "stream")
    stream = spark.readStream.schema(A.read(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")
    incremental.register_into(stream.select(F.col("user_id").alias("snapshot_id")), f"{folder}/table", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/table").select("snapshot_id")


@query("st_resume", "SELECT collected_at AS snapshot_date, count(*) AS n, count(DISTINCT url) AS urls, CAST(sum(length(url)) AS BIGINT) AS chars FROM v_urls GROUP BY 1")
def st_resume(spark, sf):
    """Days of urls through the resumable source: the stream stops after the first two days and goes on when there are more."""
    folder = incremental.shared_folder(spark, "resume")
    rows = A.urls(spark, sf)
    for half in ("collected_at < '2026-09-03'", "collected_at >= '2026-09-03'"):
        _write_days(rows.where(half), f"{folder}/in")
        incremental.run_to_table(dated.read_dated(spark, f"{folder}/in", f"{folder}/finished"), folder)
    found = spark.read.parquet(f"{folder}/out")
    return found.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line").alias("urls"), F.sum(F.length("line")).alias("chars"))


@query("st_rates", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def st_rates(spark, sf):
    """A stream's daily counts, in complete mode so that the last days are there too."""
    folder = incremental.shared_folder(spark, "stream")
    stream = spark.readStream.schema(A.read(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    running = incremental.daily_rates(stream.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def _examples(spark, sf):
    rows = A.scored3(spark, sf)
    return rows.select("id", "y", *[F.get("p", F.lit(k)).alias(f"x{k}") for k in range(3)], (F.col("id") % 37).alias("grp"))


@query("mdl_logistic")
def mdl_logistic(spark, sf):
    rows = _examples(spark, sf)
    return models.predict(models.fit_logistic(rows, ["x0", "x1", "x2"]), rows, ["x0", "x1", "x2"]).select("id", "predicted")


@query("mdl_gbm3")
def mdl_gbm3(spark, sf):
    rows = _examples(spark, sf)
    return models.predict(models.fit_trees(rows, ["x0", "x1", "x2"], 3, rounds=5), rows, ["x0", "x1", "x2"]).select("id", "predicted")


@query("mdl_gbm_bin")
def mdl_gbm_bin(spark, sf):
    rows = _examples(spark, sf).withColumn("y", (F.col("y") > 0).cast("int"))
    return models.predict(models.fit_trees(rows, ["x0", "x1", "x2"], 2, rounds=3), rows, ["x0", "x1", "x2"]).select("id", "predicted")


@query("mdl_oof")
def mdl_oof(spark, sf):
    return models.out_of_fold(_examples(spark, sf), ["x0", "x1", "x2"], "grp", 3).select("id", "fold", "predicted")


@query("mdl_ugdm", "SELECT count(*) AS n, 1.0::DOUBLE AS total FROM v_hosts")
def mdl_ugdm(spark, sf):
    """Forward pass of a decision network over encoded vectors: its heads sum to one in every row."""
    from .decision_queries import _vector

    rows = _vector(spark, sf)
    scored = models.score_network(features.with_encoded(rows, features.fit_normalizer(rows)), models.Network.random())
    total = F.aggregate("action", F.lit(0.0), lambda a, x: a + x)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(total), 9).alias("total"))


@query("mdl_ablation", "SELECT count(*) AS n, 0.0::DOUBLE AS left_over FROM v_hosts")
def mdl_ablation(spark, sf):
    from .decision_queries import _vector

    rows = models.ablate(_vector(spark, sf), ["url_length", "known_malicious"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("feature__url_length").alias("left_over"))


_PERMUTED = " UNION ALL ".join(f"""
SELECT 'x{k}' AS feature, avg(CAST((l.x0n * 2 > l.x1n + l.x2n) <> (l.x0 * 2 > l.x1 + l.x2) AS INTEGER)) AS change_rate FROM (
  SELECT a.x0, a.x1, a.x2, {', '.join(f'b.x{j} AS x{j}n' if j == k else f'a.x{j} AS x{j}n' for j in range(3))} FROM
  (SELECT *, substr(sha256('{42 + k}|' || id), 1, 2) AS b, row_number() OVER (PARTITION BY substr(sha256('{42 + k}|' || id), 1, 2) ORDER BY sha256('{1042 + k}|' || id), id) AS r FROM x) a JOIN
  (SELECT *, substr(sha256('{42 + k}|' || id), 1, 2) AS b, row_number() OVER (PARTITION BY substr(sha256('{42 + k}|' || id), 1, 2) ORDER BY sha256('{2042 + k}|' || id), id) AS r FROM x) b USING (b, r)) l""" for k in range(3))


@query("mdl_ablation_policy", "SELECT CASE WHEN white THEN 'ALLOW' WHEN p >= 0.7 AND CAST(ip AS INTEGER) + CAST(mismatch AS INTEGER) >= 1 THEN 'BLOCK' WHEN p >= 0.3 THEN 'REVIEW' ELSE 'ALLOW' END AS action, count(*) AS n FROM v_dec GROUP BY 1")
def mdl_ablation_policy(spark, sf):
    """What the first policy decides without intelligence and the login keyword."""
    rows = models.ablate(A.decisions(spark, sf), ["known_malicious", "contains_login"])
    decided = rows.select(policy.decide_v1(policy.evidence_count(set(rows.columns))).action.alias("action"))
    return decided.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("imp_permutation", f"WITH x AS (SELECT id, p0 AS x0, p1 AS x1, p2 AS x2 FROM v_scored3), u AS ({_PERMUTED}) SELECT feature, round(change_rate, 6) AS change_rate FROM u ORDER BY change_rate DESC, feature LIMIT 10")
def imp_permutation(spark, sf):
    score = lambda df: df.withColumn("predicted", (F.col("x0") * 2 > F.col("x1") + F.col("x2")).cast("int"))
    return models.permutation_importance(_examples(spark, sf), ["x0", "x1", "x2"], score, "id").select("feature", F.round("change_rate", 6).alias("change_rate"))


@query("cal_holdout", "SELECT count(*) AS n FROM v_scored3 WHERE half = 1 OR source <> 's1'")
def cal_holdout(spark, sf):
    rows = A.scored3(spark, sf).withColumn("split", F.when(F.col("half") == 1, "test").otherwise("train"))
    return sampling.source_holdout(rows, "s1").agg(F.count(F.lit(1)).alias("n"))

