import http.server
import json
import threading
import time

import pytest

from mergewell.operators.embed import HttpEmbedder, StatusError, UpstreamError, embed_texts


@pytest.fixture
def served():
    state = {"status": 200, "body": None, "now": 0, "most": 0, "wait": 0.0}
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(state["wait"])
            with lock:
                state["now"] -= 1
            self.send_response(state["status"])
            self.end_headers()
            self.wfile.write(state["body"] or json.dumps({"embeddings": [[1.0, 2.0]] * len(asked["input"])}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()
    server.server_close()


@pytest.mark.parametrize("at_once", [1, 2])
def test_no_more_requests_at_a_time_than_allowed(spark, served, at_once):
    served["wait"] = 0.05
    texts = spark.range(400).selectExpr("concat('text ', id) as text").repartition(8)
    model = HttpEmbedder(served["url"], "m", 2, at_once=at_once)
    assert embed_texts(texts, model).select("text").distinct().count() == 400
    assert 1 <= served["most"] <= at_once


def test_kinds_of_errors(served):
    model = HttpEmbedder(served["url"], "m", 2)
    served |= {"status": 404, "body": b"  no such model  " + b"x" * 5000}
    with pytest.raises(StatusError) as refused:
        model.embed(["a"])
    assert refused.value.code == 404 and refused.value.body.startswith("no such model") and len(refused.value.body) <= 512
    served["status"] = 200
    for body in (b"{}", b"[]", b"no json", b'{"embeddings": 7}', b'{"embeddings": [["a", "b"]]}', b'{"embeddings": [[1.0], [2.0]]}', b'{"embeddings": [[1.0]]}', b'{"embeddings": [null]}'):
        served["body"] = body
        with pytest.raises(UpstreamError):
            model.embed(["a"])
    with pytest.raises(ValueError) as blank:
        model.embed([" "])
    assert not isinstance(blank.value, UpstreamError)
    with pytest.raises(UpstreamError):
        HttpEmbedder("http://127.0.0.1:9", "m", 2, timeout=2.0).embed(["a"])
