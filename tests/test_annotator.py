"""The annotation client against a server that fails at times."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from pairloom.sources.annotator import PROPERTIES, Client, Server, annotate_by_server


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    lock, seen, busy, most = threading.Lock(), {}, 0, 0

    def log_message(self, *args):
        pass

    def do_POST(self):
        kind = type(self)
        text = self.rfile.read(int(self.headers["Content-Length"])).decode()
        with kind.lock:
            kind.seen[text] = n = kind.seen.get(text, 0) + 1
            kind.busy += 1
            kind.most = max(kind.most, kind.busy)
        try:
            asked = json.loads(parse_qs(urlsplit(self.path).query)["properties"][0])
            status, body = 200, self.answer(text, n)
            if asked != PROPERTIES or body is None:
                status, body = 500, "no"
            if text.startswith("hang up") and n == 1:
                self.close_connection = True
                return
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)
        finally:
            with kind.lock:
                kind.busy -= 1

    def answer(self, text, n):
        if "down" in text or (len(text) % 3 == 0 and n == 1):
            return None
        if "%" in text or "bad" in text:
            return "Could not handle incoming annotation"
        words = text.split()
        toks = [{"index": i, "word": w, "pos": "NN", "ner": "O"} for i, w in enumerate(words, 1)]
        deps = [{"dep": "ROOT", "governor": 0, "dependent": 1}] + [{"dep": "dep", "governor": i - 1, "dependent": i} for i in range(2, len(words) + 1)]
        return json.dumps({"sentences": [{"tokens": toks, "basicDependencies": deps}] if words else []})


@pytest.fixture
def url():
    Handler.seen, Handler.busy, Handler.most = {}, 0, 0
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_every_pair_stays_and_every_text_is_asked_once(spark, url):
    rows = [(i, f"what is word{i % 40}", f"hang up {i % 7}" if i % 5 else None) for i in range(300)] + [(900, "100 % sure", "bad text"), (901, "the server is down", ""), (902, None, "it's \"so\" 5 %")]
    df = spark.createDataFrame(rows, "pair_id bigint, question1 string, question2 string")
    got = {r["pair_id"]: r for r in annotate_by_server(df, Server(url, in_flight=3, tries=3, wait=0.01), tasks=2).collect()}
    assert got.keys() == {r[0] for r in rows}
    said = lambda side: None if side is None else [w["word"] for w in side]
    assert all(said(got[i]["s"]) == a.split() and said(got[i]["t"]) == (b or "Null").lower().split() for i, a, b in rows[:300])
    assert got[7]["s"][1]["deps"] == {2: "dep"} and got[7]["s"][0]["deps"] == {1: "dep"}
    assert said(got[900]["s"]) == ["100", "sure"] and got[900]["t"] is None and got[901]["s"] is None and got[901]["t"] is None
    assert said(got[902]["t"]) == ["its", "so", "5"] and said(got[902]["s"]) == ["null"]
    assert Handler.most <= 6 and all(n <= 2 for t, n in Handler.seen.items() if "down" not in t and "bad" not in t and t)


def test_answers_come_in_the_order_of_the_texts(url):
    from concurrent.futures import ThreadPoolExecutor

    client = Client(Server(url, wait=0.01))
    texts = [f"text number {i}" for i in range(60)]
    with ThreadPoolExecutor(8) as pool:
        assert [x[2]["word"] for x in pool.map(client.annotate, texts)] == [str(i) for i in range(60)]


def test_no_server_gives_null(spark):
    df = spark.createDataFrame([(1, "a", "b")], "pair_id bigint, question1 string, question2 string")
    assert annotate_by_server(df, Server("http://127.0.0.1:9", tries=2, wait=0.01)).collect() == [(1, None, None)]
