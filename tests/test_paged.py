"""The paged source against a small server: pages by the count, pushed filters, micro-batches that do not overlap."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from sonolake.sources import paged


@pytest.fixture
def service():
    """Sounds a minute apart, found by the span of creation times (both ends belong to it); what was asked for is kept."""
    sounds = [{"id": i, "name": f"n{i}", "created": f"2024-01-01T00:{i:02d}:00Z", "duration": 2, "tags": ["a"], "description": "x"} for i in range(60)]
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            ask = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(ask["filter"])
            low, high = ask["filter"].split("created:[")[1].rstrip("]").split(" TO ") if "created" in ask["filter"] else ("*", "*")
            found = [s for s in sounds if (low == "*" or s["created"] >= low) and (high == "*" or s["created"] <= high)]
            size, page = int(ask["page_size"]), int(ask["page"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"count": len(found), "results": found[size * (page - 1) : size * page]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/s", asked
    server.shutdown()


def at(minute):
    return f"2024-01-01T00:{minute:02d}:00Z"


def test_pages_and_pushed_filters(spark, service):
    url, asked = service
    paged.register(spark)
    source = lambda: spark.read.format("sound_search").option("url", url).option("queries", "rain").option("page_size", 7).load()
    assert source().count() == 60
    del asked[:]
    df = source().where(f"created >= '{at(50)}' and created < '{at(55)}' and id <> '52'")
    assert sorted(r.id for r in df.collect()) == ["50", "51", "53", "54"]
    assert asked and all(f"created:[{at(50)} TO {at(55)}]" in a for a in asked)
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert ">= 2024-01-01T00:50" not in above and "< 2024-01-01T00:55" in above  # a pushed one is gone, one that is only narrowed stays


def test_micro_batches_do_not_overlap(spark, service, tmp_path):
    url, asked = service
    paged.register(spark)

    def run(before):
        stream = spark.readStream.format("sound_search").option("url", url).option("queries", "rain").option("page_size", 7).option("created_after", at(5)).option("created_before", before).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted(int(r.id) for r in spark.read.schema(paged.SCHEMA).parquet(f"{tmp_path}/out").collect())

    assert run(at(20)) == list(range(5, 20))
    del asked[:]
    assert run(at(31)) == list(range(5, 31)) and all(at(20) in a for a in asked)
    assert run(at(31)) == list(range(5, 31))
