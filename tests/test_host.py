import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from strandline.errors import LineageError
from strandline.functions import accounts
from strandline.sources import cache, host, records


def client(replies, **k):
    waits, left = [], list(replies)
    return host.Client(lambda url: left.pop(0), sleep=waits.append, clock=lambda: 0.0, **k), waits


def test_retries_wait_longer_or_as_asked():
    c, waits = client([(503, {}, b""), (429, {"Retry-After": "99"}, b""), (200, {}, b'{"a": 1}')])
    assert c.fetch("u") == {"a": 1} and waits == [1.0, 10.0] and c.made == 3


def test_other_errors_are_not_retried_and_the_last_attempt_gives_up():
    c, _ = client([(404, {}, b"")])
    with pytest.raises(host.SourceError, match="404"):
        c.fetch("u")
    c, waits = client([(500, {}, b"")] * 3)
    with pytest.raises(host.SourceError):
        c.fetch("u")
    assert waits == [1.0, 2.0]


def test_budget_and_pacing():
    c, waits = client([(200, {}, b"{}")] * 3, budget=2, interval_s=1.1)
    c.fetch("u"), c.fetch("u")
    assert waits == [1.1]
    with pytest.raises(host.OverBudget):
        c.fetch("u")


def test_chat_model_retries_and_reads_the_message():
    seen, replies = [], [(429, {}, b""), (200, {}, json.dumps({"choices": [{"message": {"content": "{}"}}]}).encode())]

    def post(url, headers, body):
        seen.append((headers["Authorization"], json.loads(body)["messages"]))
        return replies.pop(0)

    assert host.chat_model("u", "m", "k", post, sleep=lambda s: None)([{"role": "user", "content": "x"}]) == "{}"
    assert seen == [("Bearer k", [{"role": "user", "content": "x"}])] * 2
    cited = {"model": "m2", "choices": [{"message": {"content": "{}", "annotations": [{"url_citation": {"url": "u1"}}, {"url_citation": {"url": "u1"}}, 3]}}]}
    asked = []
    said = host.chat_model("u", "m", "k", lambda u, h, body: asked.append(json.loads(body)) or (200, {}, json.dumps(cited).encode()), web_results=5)([])
    assert (said, said.urls, said.model) == ("{}", ["u1"], "m2") and asked[0]["plugins"] == [{"id": "web", "max_results": 5}]
    assert host.Settings().chat() is None and host.Settings(chat_url="u", chat_key="k").chat("m") is not None
    for body in (b'{"choices": []}', b'{"choices": [{"message": {"content": " "}}]}'):
        with pytest.raises(host.SourceError):
            host.chat_model("u", "m", "k", lambda *a, body=body: (200, {}, body))([])


def test_settings():
    s = host.Settings.from_env({"STRANDLINE_TOTAL_CAP": "7", "STRANDLINE_TOP_K": "x", "STRANDLINE_CACHE": "off", "STRANDLINE_MODE": " "})
    assert (s.total_cap, s.top_k, s.cache, s.mode) == (7, 40, False, "auto")
    assert s.clamped({"total_cap": 5, "fanout_cap": 60}, fanout_cap=10).fanout_cap == 10 and s.clamped({"total_cap": 5}).total_cap == 5


def test_field_list_and_batches():
    assert host.nested_fields("citedPaper").startswith("intents,isInfluential,citedPaper.paperId")
    assert [len(b) for b in host.batches([str(i) for i in range(120)], 50)] == [50, 50, 20]


def test_json_api_reads_in_batches(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            asked.append(q)
            body = json.dumps({"results": [{"id": k, "display_name": f"t{k}"} for k in q["ids"][0].split("|") if k != "W9"]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(host.JsonApi)
    url = f"http://127.0.0.1:{server.server_port}/works?ids={{keys}}"
    raw = spark.read.format("json_api").options(url=url, keys="W1,W2,W9,W4", batch="3", params="mailto=a@b.c").load()
    assert sorted(r.title for r in records.works_from_json(raw, "raw").collect()) == ["tW1", "tW2", "tW4"]
    assert all(q["mailto"] == ["a@b.c"] for q in asked) and max(len(q["ids"][0].split("|")) for q in asked) == 3
    server.shutdown()


class Works(BaseHTTPRequestHandler):
    """Works by id and by what they cite; gives more than it is asked for, and fails where a test says so."""

    asked: list = []
    fail: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        type(self).asked.append((time.time(), q))
        if self.fail:
            self.fail.pop()
            self.send_response(503)
            self.end_headers()
            return
        ids = [*q["ids"].split("|"), "W_MORE"] if "ids" in q else [f"{q['cites']}a", f"{q['cites']}b"]
        fields = q.get("select", "id,title,year,refs").split(",")
        body = json.dumps({"results": [{k: v for k, v in {"id": i, "title": f"t{i}", "year": len(i), "refs": ["x", i]}.items() if k in fields} for i in ids]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def works_server(spark):
    Works.asked, Works.fail = [], []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Works)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(host.JsonApi)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    at = f"http://127.0.0.1:{server.server_port}/works"

    def read(schema, **options):
        return spark.read.format("json_api").schema(schema).options(**{"url": at + "?ids={keys}", "by.cites": at + "?cites={value}", "select": "select", **options}).load()

    yield read
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()


def test_filters_are_pushed_and_only_asked_fields_are_requested(works_server):
    got = works_server("id string, year int").where("id in ('W1', 'W22') and year > 2").collect()
    assert [tuple(r) for r in got] == [("W22", 3)]  # what more came back is tested again
    assert [q for _, q in Works.asked] == [{"ids": "W1|W22", "select": "id,year"}]
    Works.asked.clear()
    got = works_server("id string, title string, refs array<string>, cites string").where("cites = 'W7'").collect()
    assert [tuple(r) for r in got] == [("W7a", "tW7a", ["x", "W7a"], "W7"), ("W7b", "tW7b", ["x", "W7b"], "W7")]
    assert [q for _, q in Works.asked] == [{"cites": "W7", "select": "id,title,refs"}]
    df = works_server("id string").where(F.col("id").isin([f"W{i}" for i in range(51)]))
    assert df.rdd.getNumPartitions() == 2 and df.count() == 51
    assert works_server("id string").where("id = 'W1' and id in ('W2')").count() == 0
    with pytest.raises(Exception, match="needs keys"):
        works_server("id string").collect()


def test_one_pace_and_one_budget_over_many_tasks(works_server):
    Works.fail = [1]
    df = works_server("id string", batch="1", interval="0.2", budget="16").where(F.col("id").isin([f"W{i}" for i in range(8)]))
    assert df.rdd.getNumPartitions() == 8
    Works.asked.clear()
    assert df.count() == 8
    times = sorted(t for t, _ in Works.asked)
    assert len(times) == 9  # a retry has a slot of its own, behind all first requests
    assert all(b - a > 0.1 for a, b in zip(times, times[1:])) and times[-1] - times[0] > 1.5
    Works.fail, tight = [1], works_server("id string", batch="1", budget="8").where(F.col("id").isin([f"W{i}" for i in range(8)]))
    Works.asked.clear()
    with pytest.raises(Exception, match="this task's share"):
        tight.collect()
    assert len(Works.asked) <= 8
    with pytest.raises(Exception, match="takes 8 requests, 7 are allowed"):
        works_server("id string", batch="1", budget="7").where(F.col("id").isin([f"W{i}" for i in range(8)])).collect()


def test_slots_are_dealt_without_overlap():
    whole = sorted(t for place in range(4) for t in host.dealt_slots(place, 4, 100.0, 0.5, 10))
    assert whole == [100 + 0.5 * k for k in range(10)]
    assert list(host.dealt_slots(3, 4, 0.0, 1.0, 3)) == []
    c, waits = client([(503, {}, b""), (503, {}, b"")], slots=iter([5.0]), now=lambda: 2.0)
    with pytest.raises(host.OverBudget):
        c.fetch("u")
    assert waits == [3.0, 1.0]


def test_cache_adds_and_replaces(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "id string, title string")
    cache.save(rows(("a", "1"), ("b", "1")), str(tmp_path), "S")
    cache.save(rows(("b", "2"), ("c", "2")), str(tmp_path), "S")
    cache.save(rows(("z", "0")), str(tmp_path), "S", enabled=False)
    got = cache.read(spark, str(tmp_path), "S", "id string, title string")
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    assert cache.read(spark, str(tmp_path), "none", "id string, title string").count() == 0
    assert cache.read(spark, str(tmp_path), "S", "id string, title string", enabled=False).count() == 0


def test_account_columns(spark):
    df = spark.createDataFrame([(" A@B.org ",), ("a@b",), ("x" * 250 + "@b.org",), (None,)], "e string")
    assert [r.v for r in df.select(accounts.email(F.col("e")).alias("v")).collect()] == ["a@b.org", None, None, None]
    r = spark.range(1).select(accounts.from_url_base64(accounts.url_base64(F.lit("?>~x").cast("binary"))).cast("string").alias("a"), accounts.from_iso(F.lit("2020-01-02T03:04:05+00:00")).alias("b"), accounts.from_iso(F.lit("no")).alias("c")).first()
    assert r.a == "?>~x" and r.b.year == 2020 and r.c is None


def test_stored_tables_are_released(spark):
    from pathlib import Path

    from strandline.sources import shared

    a, b = shared.stored(spark.range(3), "t"), shared.stored(spark.range(4), "t")
    assert (a.count(), b.count()) == (3, 4) and a.stored_at != b.stored_at
    shared.discard(a)
    assert not Path(a.stored_at).exists() and Path(b.stored_at).exists()
    kept, shared._made[:] = [p for p in shared._made if p != b.stored_at], [b.stored_at]
    shared.release(spark)
    assert not Path(b.stored_at).exists()
    shared._made[:] = kept


def test_settings_file_under_the_environment(tmp_path):
    path = tmp_path / "settings"
    path.write_text("# caps\nexport STRANDLINE_TOTAL_CAP = 7\nSTRANDLINE_TOP_K='9'\nSTRANDLINE_CACHE=no\n\nbroken line\nSTRANDLINE_FANOUT_CAP=x\n")
    got = host.Settings.load(str(path), {"STRANDLINE_TOP_K": "11"})
    assert (got.total_cap, got.top_k, got.cache, got.fanout_cap) == (7, 11, False, 100)
    assert host.Settings.load(str(tmp_path / "none"), {}) == host.Settings()


def test_a_closed_client_asks_no_more():
    with host.Client(lambda url: (200, {}, b"{}")) as c:
        assert c.fetch("u") == {}
    assert c.made == 1
    with pytest.raises(host.OverBudget):
        c.fetch("u")
    assert issubclass(host.OverBudget, LineageError)
