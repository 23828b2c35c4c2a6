import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from fieldproof.plans import evaluate, single
from fieldproof.sources import readers, remote

RULES = {"tax_amount": "string or null"}


@pytest.fixture
def server():
    """Answers like a model would, in either shape; the first request of each path fails once."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body))
            if sum(p == self.path for p, *_ in seen) == 1:
                self.send_response(503)
                self.end_headers()
                return
            if "missing" in json.dumps(body):
                self.send_response(404)
                self.end_headers()
                self.wfile.write(b"no such model")
                return
            text = '{"fields": {"tax_amount": "10%", "vendor": "V"}, "confidence": 0.5}'
            if self.path.endswith("/responses"):
                made = {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": text}]}]}
            else:
                made = {"choices": [{"message": {"content": text}}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(made).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/v1", seen
    http.shutdown()


def analyzer(url, **more):
    return remote.Remote(readers.Settings(api_key="k", base_url=url, **more))


@pytest.mark.parametrize("mode", ["responses", "chat"])
def test_both_shapes(server, tmp_path, monkeypatch, mode):
    monkeypatch.setattr(remote.time, "sleep", lambda s: None)
    url, seen = server
    (tmp_path / "a.jpg").write_bytes(b"image")
    a = analyzer(url, api_mode=mode)
    text, known = a.analyze(str(tmp_path / "a.jpg"), "What?", RULES)
    assert json.loads(text)["fields"]["tax_amount"] == "10%" and known["api_mode"] == mode and known["latency_seconds"] >= 0
    path, key, body = seen[-1]
    assert len(seen) == 2 and key == "Bearer k" and path == ("/v1/responses" if mode == "responses" else "/v1/chat/completions")
    assert "data:image/jpeg;base64,aW1hZ2U=" in json.dumps(body) and "What?" in json.dumps(body) and "tax_amount" in json.dumps(body)
    with pytest.raises(RuntimeError, match="HTTP 404: no such model"):
        a.analyze(str(tmp_path / "a.jpg"), "missing", RULES)


def test_key_is_needed():
    for key in (None, " ", "replace_me"):
        with pytest.raises(RuntimeError):
            remote.Remote(readers.Settings(api_key=key))


def test_run_and_single_document(spark, server, tmp_path):
    url, _ = server
    path = readers.write_fixtures(tmp_path / "d")
    rows = [json.loads(x) | {"field_schema": RULES, "expected_fields": {"tax_amount": "1"}} for x in path.read_text().splitlines()]
    path.write_text("\n".join(map(json.dumps, rows)))
    make = lambda: analyzer(url)
    run = evaluate.evaluate(spark, path, tmp_path / "run", "live", analyzer=make)
    assert run["configuration"]["model"] == "gpt-4.1-mini" and run["review_flagged_examples"] == 3
    first = run["results"][0]["prediction"]
    assert first["fields"] == {"tax_amount": "10%"} and first["metadata"]["backend"] == "openai" and first["raw_output"].startswith("{")
    status, got = single.read(spark, make, str(path.parent / rows[0]["image"]), "q", json.dumps(RULES))
    assert status == single.DONE and got["review_flags"][0]["reason"] == "percentage_is_not_amount"
    assert single.read(spark, make, None, "q", "{}") == (single.NO_IMAGE, None)
    assert single.read(spark, make, "x.png", "q", "{broken")[1] is None
    assert single.read(spark, make, str(tmp_path / "none.png"), "q", json.dumps(RULES))[0].startswith("Failed: FileNotFoundError")


def test_fixtures_make_a_dataset(spark, tmp_path):
    run = evaluate.evaluate(spark, readers.write_fixtures(tmp_path / "d"), tmp_path / "run")
    assert (run["correct_fields"], run["total_fields"]) == (15, 15)
    assert (tmp_path / "d/images/receipt_001.png").read_bytes().startswith(b"\x89PNG")
