"""Queries of the operators that are not one declarative plan: sources, sinks, graphs, detectors, learning, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detectors, graphs
from .plans.registry import OPERATORS, Engine
from .sources import archive, http
from .store import shared_folder
from .streaming import jobs
from .tables import bound_tables, duck_ctes


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(bound_tables(spark, sf_dir))


# ---- sources and sinks ---------------------------------------------------------------------------------------


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = bound_tables(spark, sf_dir)["posts"]
    text = F.col("created_at").cast("string")
    return posts.select(
        F.col("id").cast("string").alias("id"), "title", "content", F.struct(F.concat(F.lit("a"), "author_name").alias("id"), F.col("author_name").alias("name")).alias("author"),
        F.struct(F.col("submolt").alias("name")).alias("submolt"), "upvotes", F.lit(0).cast("long").alias("downvotes"), "comment_count", text.alias("created_at"),
    )


def src_json_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archive")
    archive.write_json(_nested(spark, sf_dir), f"{folder}/all_posts.json")
    return archive.read_posts(spark, [f"{folder}/missing.json", f"{folder}/all_posts.json"])


def src_json_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archive")
    archive.write_json(_nested(spark, sf_dir), f"{folder}/posts")
    return archive.read_posts(spark, [f"{folder}/missing.json"], f"{folder}/posts/*.json")


def src_json_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archive")
    archive.write_json(_nested(spark, sf_dir), f"{folder}/posts")
    return archive.read_json(spark, f"{folder}/posts/*.json", archive.POST).select("id", "title", "author.name")


def fake_interface(url: str) -> list | dict | None:
    """A stand-in of a paged interface for tests: 120 items, newest first."""
    from urllib.parse import parse_qs, urlparse

    query = {k: int(v[0]) for k, v in parse_qs(urlparse(url).query).items() if v[0].isdigit()}
    endpoint = urlparse(url).path.rsplit("/", 1)[-1]
    at = query["offset"] if "offset" in query else (query["page"] - 1) * query["limit"]
    items = [{"id": f"i{119 - k}", "comment_count": k % 4, "name": f"n{k % 7}", "comments": [{"id": f"c{k}", "content": "x"}]} for k in range(at, min(at + query["limit"], 120))]
    return {endpoint: items, "has_more": at + query["limit"] < 120}


def _paged(spark: SparkSession, **options: object) -> DataFrame:
    http.register(spark)
    reader = spark.read.format("paged_json").option("url", "http://test.invalid/api").option("fetch", f"{__name__}:fake_interface")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def src_http_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, page=25)


def src_http_page_and_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by number, then by offset; ids that both give are kept once."""
    return _paged(spark, page=25, paging="page").union(_paged(spark, page=50)).dropDuplicates(["id"])


def src_http_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, page=10, partitions=4)


def src_http_posts_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, page=25, paging="page")


def src_http_submolts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.from_json("body", "name string, id string")
    return _paged(spark, endpoint="submolts", page=50).select(body["name"].alias("name")).distinct()


def src_http_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, endpoint="users", page=50).select("id", F.get_json_object("body", "$.name").alias("name"))


def src_http_post_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = F.from_json(F.get_json_object("body", "$.comments"), "array<struct<id:string,content:string>>")
    return _paged(spark, page=50).select(F.col("id").alias("post_id"), F.explode(comments).alias("c")).select("post_id", "c.*")


def src_comments_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of the posts that have some."""
    return src_http_post_detail(spark, sf_dir).join(_paged(spark, page=50).filter("comment_count > 0").select(F.col("id").alias("post_id")), "post_id", "left_semi")


def _stream(spark: SparkSession, **options: object) -> DataFrame:
    http.register(spark)
    reader = spark.readStream.format("paged_json").option("url", "http://test.invalid/api").option("fetch", f"{__name__}:fake_interface")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def src_http_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "polled")
    jobs.run_available(_stream(spark, page=25), "append", lambda batch, _: batch.write.mode("append").parquet(out))
    return spark.read.parquet(out)


def src_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items, merged into a table by id."""
    out = shared_folder(spark, "synced")
    jobs.run_available(_stream(spark, page=25), "append", lambda batch, n: jobs.upsert(batch.withColumn("v", F.lit(n)), out, "id", "v"))
    return jobs.read_table(spark, out)


def src_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "html")
    archive.write_html(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return spark.read.text(folder).select(F.regexp_extract("value", "<title>([^<]*)</title>", 1).alias("title"))


def src_comments_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that lie in maps from post to list, written and read as files: the key becomes the post."""
    folder = shared_folder(spark, "comments")
    comments = bound_tables(spark, sf_dir)["comments"]
    listed = comments.groupBy("post_id").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.struct(F.col("author_name").alias("name")).alias("author"))).alias("list"))
    listed.select(F.to_json(F.create_map(F.col("post_id").cast("string"), "list")).alias("value")).write.text(folder)
    return archive.read_comments(spark, folder).select(F.col("post_id").cast("long").alias("post_id"), F.col("id").cast("long").alias("id"), "author_name")


def src_objectstore_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All JSON files under the prefixes of a store, as one table."""
    folder, t = shared_folder(spark, "store"), bound_tables(spark, sf_dir)
    for name in ("posts", "comments"):
        archive.write_json(t[name].select("id", "author_name", F.col("created_at").cast("string").alias("created_at")), f"{folder}/{name}")
    merged = archive.read_json(spark, f"{folder}/*/*.json", "id long, author_name string, created_at string")
    return merged.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace old ones of the same key in a stored table."""
    out, posts = shared_folder(spark, "upsert"), bound_tables(spark, sf_dir)["posts"]
    jobs.upsert(posts.select("id", "upvotes", F.lit(0).alias("version")), out, "id", "version")
    jobs.upsert(posts.filter("id % 3 = 0").select("id", (F.col("upvotes") + 1000).alias("upvotes"), F.lit(1).alias("version")), out, "id", "version")
    return jobs.read_table(spark, out)


def snk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to a stored table."""
    out, posts = shared_folder(spark, "append"), bound_tables(spark, sf_dir)["posts"]
    for batch, odd in ((1, 0), (2, 1)):
        posts.filter(F.col("id") % 2 == odd).select("author_name", F.lit(batch).alias("batch")).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def snk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows found on the other side take its value."""
    out, t = shared_folder(spark, "update"), bound_tables(spark, sf_dir)
    ids = t["posts"].select("id")
    jobs.upsert(ids.select("id", F.lit(False).alias("has_embedding"), F.lit(0).alias("v")), out, "id", "v")
    found = ids.join(t["embs"].select(F.col("content_id").alias("id")).distinct(), "id", "left_semi")
    jobs.upsert(found.select("id", F.lit(True).alias("has_embedding"), F.lit(1).alias("v")), out, "id", "v")
    return jobs.read_table(spark, out).drop("v")


def snk_json_append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id the stored table lacks are appended."""
    out, posts = shared_folder(spark, "dedup"), bound_tables(spark, sf_dir)["posts"]
    archive.append_new(posts.filter("rn % 2 = 0").select("id", F.lit("old").alias("part")), out)
    archive.append_new(posts.select("id", F.lit("new").alias("part")), out)
    return spark.read.parquet(out)


def snk_matrix_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a matrix that was saved and loaded."""
    folder, engine = shared_folder(spark, "matrices"), _engine(spark, sf_dir)
    archive.save_matrix(engine.run("mx_interaction"), folder, "interaction")
    return archive.matrix_info(spark, folder, "interaction")


def snk_json_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "json")
    archive.write_json(bound_tables(spark, sf_dir)["posts"].select("id", "title"), folder)
    return spark.read.schema("id long, title string").json(folder)


def snk_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    archive.write_csv(bound_tables(spark, sf_dir)["posts"], folder, ["id", "author_name", "upvotes", "content"])
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(folder)


def snk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "html")
    archive.write_html(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return spark.read.text(folder)


def snk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "files")
    bound_tables(spark, sf_dir)["posts"].select("id", "submolt").write.partitionBy("submolt").parquet(folder)
    return archive.manifest(spark, folder).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def snk_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bound_tables(spark, sf_dir)
    return archive.combined(t["posts"], t["comments"])


def snk_object_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per part; the commit marker tells that it is whole."""
    folder = shared_folder(spark, "parts")
    posts = bound_tables(spark, sf_dir)["posts"].select("id", "title", (F.col("id") % 4).alias("part"))
    posts.write.partitionBy("part").json(folder)
    if not archive.exists(spark, f"{folder}/_SUCCESS"):
        raise RuntimeError("the write left no marker")
    return spark.read.json(folder)


def snk_insight_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    names = ["ag_trending", "ag_viral", "ag_influence", "ag_status"]
    return archive.insight_cache({n: engine.run(n, **OPERATORS[n].test) for n in names}, "2024-01-31")


def sec_mask_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("http://user:secret@"), F.regexp_replace("url", "^https?://", "")).alias("url"))
    return urls.select("page_id", archive.masked().alias("url"))


# ---- graphs --------------------------------------------------------------------------------------------------


def gr_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.pagerank(graphs.graph(_engine(spark, sf_dir))[0])


def gr_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.betweenness(graphs.graph(_engine(spark, sf_dir))[1], k=100)


def gr_eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.eigenvector(graphs.graph(_engine(spark, sf_dir))[1])


def gr_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graphs.graph(_engine(spark, sf_dir))[1]
    return graphs.modularity(pairs, graphs.communities(pairs)).orderBy(F.desc("size"), "community").limit(20)


def gr_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.connected(graphs.graph(_engine(spark, sf_dir))[1])


def gr_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.bridges(_engine(spark, sf_dir))


def gr_cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.cliques(graphs.graph(_engine(spark, sf_dir), days=7)[1])


def gr_gatekeepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.gatekeepers(_engine(spark, sf_dir))


def gr_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.position(_engine(spark, sf_dir), "u5")


def gr_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.all_metrics(_engine(spark, sf_dir))


def gr_top_influencers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.top_influencers(_engine(spark, sf_dir))


def gr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.summary(_engine(spark, sf_dir))


# Parameters under which the test tables give rows.
PUSHES = {"hours": 240, "days": 30}
ALERT_TESTS = {
    "al_sync": {"low": 0.02, "high": 0.1, "minutes": 120, "threshold": 0.1, "as_of": "2024-01-05 00:00:00"},
    "al_cluster": {"low": 0.1, "high": 0.5},
    "al_push": {"critical": 0.05, "high": 0.02, "medium": 0.01, "alike": 0.5, **PUSHES},
    "al_bot_farm": {"threshold": 0.85},
}


# ---- detectors and learning ----------------------------------------------------------------------------------


def co_sync_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.sync_posting(_engine(spark, sf_dir), minutes=120, threshold=0.1, as_of="2024-01-05 00:00:00")


def co_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.clusters(_engine(spark, sf_dir))


def co_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.all_coordination(_engine(spark, sf_dir))


def tm_bot_farm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.bot_farms(_engine(spark, sf_dir), threshold=0.85)


def tm_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.all_temporal(_engine(spark, sf_dir))


def nv_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.identify_narratives(_engine(spark, sf_dir), eps=0.65, days=30)


def nv_pushes_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.pushes(_engine(spark, sf_dir), **PUSHES)


def nv_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.all_narratives(_engine(spark, sf_dir))


def al_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _engine(spark, sf_dir).run("al_burst", **OPERATORS["al_burst"].test).withColumn("authors", F.concat_ws(",", F.col("first_hour").cast("string"), F.col("last_hour").cast("string")))
    return detectors.create_alerts(found, "authors", "activity_burst", "2024-01-31 00:00:00").select("id", "alert_type", "severity", "confidence", "status")


def al_run_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.all_alerts(_engine(spark, sf_dir), {rule: ALERT_TESTS.get(rule) or OPERATORS[rule].test for rule in detectors.ALERT_RULES})


def al_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.sync_alerts(_engine(spark, sf_dir), **ALERT_TESTS["al_sync"])


def al_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.cluster_alerts(_engine(spark, sf_dir), **ALERT_TESTS["al_cluster"])


def al_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.push_alerts(_engine(spark, sf_dir), **ALERT_TESTS["al_push"])


def al_bot_farm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.bot_farm_alerts(_engine(spark, sf_dir), **ALERT_TESTS["al_bot_farm"])


def vx_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.generate_embeddings(_engine(spark, sf_dir))


def vx_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.content_clusters(_engine(spark, sf_dir))


def mx_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.topic_matrix(_engine(spark, sf_dir))


def mx_row_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx_topic(spark, sf_dir).filter("author_name = 'u5'")


def fp_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic part of every active author's fingerprint: zeros for authors without a row."""
    authors = bound_tables(spark, sf_dir).without_texts("activity").filter("author_name is not null").select("author_name").distinct()
    return authors.join(mx_topic(spark, sf_dir).select("author_name", "topic", "share"), "author_name", "left").select("author_name", F.coalesce("topic", F.lit(0)).alias("topic"), F.coalesce("share", F.lit(0.0)).alias("share"))


def mx_build_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.all_matrices(_engine(spark, sf_dir))


def fp_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "fingerprints")
    detectors.fingerprint_history(Engine(bound_tables(spark, sf_dir), "2024-01-31 00:00:00")).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def fp_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.latest_fingerprints(fp_save(spark, sf_dir))


def fp_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.fingerprint_clusters(_engine(spark, sf_dir))


# ---- streams -------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema.simpleString()[7:-1]
    return jobs.read_activity(spark, sf_dir, ", ".join(part.replace(":", " ", 1) for part in schema.split(",")), "events.parquet")


def ss_poll_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src_http_incremental(spark, sf_dir)


def ss_state_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("id"), F.col("value").cast("long").alias("comment_count"))
    out = shared_folder(spark, "grown")
    jobs.run_available(jobs.grown(events), "append", lambda batch, _: batch.write.mode("append").parquet(out))
    return spark.read.parquet(out)


def ss_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and whether each is due an hour after its last run."""
    return spark.createDataFrame([(name, minutes, jobs.due(3600, minutes)) for name, minutes in jobs.SCHEDULE.items()], "job string, minutes long, due boolean")


def ss_interval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss_schedule(spark, sf_dir).filter("due")


def ss_tumbling_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_available(jobs.tumbling(_events(spark, sf_dir))).select(F.col("start").cast("timestamp_ntz").alias("hour"), "n")


def ss_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_available(jobs.sliding(_events(spark, sf_dir), step="2 hours")).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def ss_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "sessions")
    jobs.run_available(jobs.sessions(_events(spark, sf_dir), "user_id"), "append", lambda batch, _: batch.write.mode("append").parquet(out))
    return spark.read.parquet(out)


def ss_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows within the watermark change their window in update mode; the last state of each window."""
    out = shared_folder(spark, "late")
    jobs.run_available(jobs.tumbling(_events(spark, sf_dir), late="7 days"), "update", lambda batch, n: jobs.upsert(batch.withColumn("v", F.lit(n)), out, "start", "v"))
    return jobs.read_table(spark, out).select(F.col("start").cast("timestamp_ntz").alias("hour"), "n")


def ss_microbatch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "upserted")
    rows = _events(spark, sf_dir).select((F.col("event_id") % 100).alias("key"), "event_id")
    jobs.run_available(rows, "append", lambda batch, _: jobs.upsert(batch, out, "key", "event_id"))
    return jobs.read_table(spark, out)


_OTHER = {"fake_interface"}
QUERIES = {name: f for name, f in globals().items() if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == __name__ and name not in _OTHER}

def _with_tables(sql: str) -> str:
    """SQL over the community tables for the checking engine."""
    return f"with {duck_ctes()[0]} {sql}"


_HOURS = "select date_trunc('hour', ts) as hour, count(*) as n from events group by 1"
_POSTS = _with_tables(
    "select cast(id as varchar) as id, title, content, concat('a', author_name) as author_id, coalesce(author_name, 'unknown') as author_name, submolt, upvotes, cast(0 as bigint) as downvotes, comment_count, created_at from posts"
)
ORACLES = {
    "src_json_archive": _POSTS,
    "src_json_glob": _POSTS,
    "src_json_iter": _with_tables("select cast(id as varchar) as id, title, author_name as name from posts"),
    "ss_tumbling_hour": _HOURS,
    "ss_late": _HOURS,
    "ss_microbatch_upsert": "select event_id % 100 as key, max(event_id) as event_id from events group by 1",
}
