"""Archives, the paged interface and streams on small inputs."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tideloom import queries
from tideloom.sources import archive, http
from tideloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_first_candidate_list_or_object(spark, tmp_path):
    item = {"id": "p1", "title": "t", "author": {"id": "a", "name": "n"}, "submolt": {"name": "s"}, "upvotes": 3, "created_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "list.json").write_text(json.dumps([item, {"id": "p2", "created_at": "no time"}]))
    (tmp_path / "object.json").write_text(json.dumps({"posts": [item]}))
    found = archive.read_posts(spark, [f"{tmp_path}/none.json", f"{tmp_path}/list.json"]).orderBy("id").collect()
    assert [(r["id"], r["author_name"], r["submolt"], r["upvotes"], r["created_at"] is None) for r in found] == [("p1", "n", "s", 3, False), ("p2", "unknown", None, 0, True)]
    assert archive.read_posts(spark, [f"{tmp_path}/object.json"]).count() == 1
    assert archive.read_posts(spark, [f"{tmp_path}/none.json"]).count() == 0


def test_comments_by_map_or_list(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"p1": [{"id": "c1", "content": "x"}], "p2": [{"id": "c2", "post_id": "p9"}]}))
    (tmp_path / "list.json").write_text(json.dumps([{"id": "c3", "_post_id": "p3"}]))
    got = {r["id"]: r["post_id"] for r in archive.read_comments(spark, f"{tmp_path}/map.json").collect()}
    assert got == {"c1": "p1", "c2": "p9"}
    assert archive.read_comments(spark, f"{tmp_path}/list.json").first()["post_id"] == "p3"


def test_paged_interface(spark):
    for query in (queries.src_http_offset, queries.src_http_partitioned, queries.src_http_page_and_offset, queries.src_http_incremental):
        got = query(spark, SF)
        assert got.count() == 120 and got.select("id").distinct().count() == 120
    assert queries.src_comments_fanout(spark, SF).count() == 90


def test_pages_of_a_server(spark):
    failed = set()

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            at = int(parse_qs(urlparse(self.path).query)["offset"][0])
            if at not in failed:  # busy at first
                failed.add(at)
                self.send_error(503)
                return
            body = json.dumps({"posts": [{"id": f"p{k}", "comment_count": k} for k in range(at, min(at + 40, 1700))], "has_more": at + 40 < 1700}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        assert http.ask(f"{url}/posts?offset=0", wait=0.01)["has_more"]
        failed.update(range(0, 2000, 40))
        http.register(spark)
        got = spark.read.format("paged_json").option("url", url).option("page", 40).load()
        assert got.count() == 1700 and got.select("id").distinct().count() == 1700
        out = f"{queries.shared_folder(spark, 'polled')}"
        stream = spark.readStream.format("paged_json").option("url", url).option("page", 40).load()
        jobs.run_available(stream, "append", lambda batch, _: batch.write.mode("append").parquet(out))
        assert spark.read.parquet(out).select("id").distinct().count() == 1700
    finally:
        server.shutdown()


def test_lines_and_whole_documents(spark, tmp_path):
    rows = [{"id": f"p{k}", "title": "t", "upvotes": k} for k in range(30)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "pretty.json").write_text(json.dumps({"posts": rows}, indent=2))
    (tmp_path / "list.json").write_text(json.dumps(rows))
    for name in ("lines", "pretty", "list"):
        assert archive.read_posts(spark, [f"{tmp_path}/{name}.json"]).count() == 30
        if name != "pretty":
            assert archive.read_json(spark, f"{tmp_path}/{name}.json", archive.POST).count() == 30


def test_append_new(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    archive.append_new(spark.range(5), path)
    archive.append_new(spark.range(3, 8), path)
    assert spark.read.parquet(path).count() == 8


def test_masked_url(spark):
    df = spark.createDataFrame([("http://u:p@h.example/x",), ("http://h.example/a@b",)], "url string")
    assert [r[0] for r in df.select(archive.masked()).collect()] == ["http://***:***@h.example/x", "http://h.example/a@b"]


def test_hours_of_stream_equal_batch(spark):
    batch = spark.sql(f"select date_trunc('hour', ts) as hour, count(*) as n from parquet.`{SF}/events.parquet` group by 1")
    assert sorted(map(tuple, queries.ss_tumbling_hour(spark, SF).collect())) == sorted(map(tuple, batch.collect()))


def test_upsert_keeps_the_latest(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    jobs.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, v long, s string"), path, "k", "v")
    jobs.upsert(spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k long, v long, s string"), path, "k", "v")
    assert sorted((r["k"], r["s"]) for r in jobs.read_table(spark, path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    before = jobs._pointer(spark, path)
    with pytest.raises(Exception):
        jobs.upsert(spark.createDataFrame([(1, 9, "z")], "k long, v long, s string").withColumn("s", F.expr("cast(raise_error('broken') as string)")), path, "k", "v")
    assert jobs._pointer(spark, path) == before and jobs.read_table(spark, path).count() == 3


def test_due():
    assert jobs.due(None, 10) and jobs.due(601, 10) and not jobs.due(600, 10)
