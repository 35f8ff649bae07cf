"""Connectors against a local server, with its failures, and the backends made of them."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from veriloom.functions import clients, prompts
from veriloom.functions.clients import ChatService, EmbeddingService, ModelClaims, ModelExplainer, ModelJudge, ModelValidity, ModelWriter, RerankService, ServiceError, retried, trimmed_json
from veriloom.operators import decompose, retrieval


class Server:
    """Answers by path; fail holds status codes for the next requests, seen holds bodies."""

    def __init__(self):
        self.fail, self.seen, self.said, self.lock = [], [], None, threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with outer.lock:
                    outer.seen.append((self.path, body))
                    code = outer.fail.pop(0) if outer.fail else 200
                raw = json.dumps(outer.answer(self.path, body)).encode() if code == 200 else b"no"
                self.send_response(code)
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def answer(self, path, body):
        if path == "/embeddings":
            return {"data": [{"index": i, "embedding": {"dense": [float(len(t)), 1.0], "sparse": {t: 0.5}}} for i, t in enumerate(body["input"])][::-1]}
        if path == "/rerank":
            return {"results": [{"index": i, "relevance_score": len(d) / 10} for i, d in enumerate(body["documents"])][::-1]}
        text = self.said(body)
        return {"choices": [{"finish_reason": "stop", "message": {"content": text}}]} if isinstance(text, str) else {"choices": [text]}


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def test_embeddings_in_batches_and_order(server):
    model = EmbeddingService(server.url, size=2, wait=0.001)
    server.fail = [500, 429]
    assert model.embed(["a", "bbb", "cc"]) == [([1.0, 1.0], {"a": 0.5}), ([3.0, 1.0], {"bbb": 0.5}), ([2.0, 1.0], {"cc": 0.5})]
    assert sorted(len(b["input"]) for _, b in server.seen if b["input"] != ["a", "bbb"]) and len(server.seen) == 4


def test_failures_end_after_the_tries(server):
    server.fail = [500] * 9
    with pytest.raises(ServiceError):
        EmbeddingService(server.url, tries=3, wait=0.001).embed(["a"])
    assert len(server.seen) == 3
    server.fail = [404]
    with pytest.raises(ServiceError):
        RerankService(server.url, wait=0.001).score(["q"], ["t"])
    assert len(server.seen) == 4  # a client's error isn't tried again
    with pytest.raises(ServiceError):
        EmbeddingService("http://127.0.0.1:9", tries=2, wait=0.001, timeout=1).embed(["a"])


def test_waits_grow():
    waits, calls = [], iter([OSError(), OSError(), OSError(), "done"])

    def call():
        x = next(calls)
        if isinstance(x, OSError):
            raise x
        return x

    assert retried(call, 4, 1.0, 3.0, sleep=waits.append) == "done" and waits == [1.0, 2.0, 3.0]


def test_rerank_groups_queries(server):
    scores = RerankService(server.url).score(["q", "r", "q"], ["aa", "b", "cccc"])
    assert scores == [0.2, 0.1, 0.4] and sorted(len(b["documents"]) for _, b in server.seen) == [1, 2]


def test_json_between_words():
    assert trimmed_json('{"a": 1}') == trimmed_json('Sure: {"a": 1} ok') == {"a": 1}
    with pytest.raises(clients.Unusable):
        trimmed_json("none { here")


def test_chat_warms_up_until_usable(server):
    answers = iter([{"finish_reason": "length", "message": {"content": "x"}}, "no JSON", '{"verdict": "perhaps", "reason": ""}', 'Well: {"verdict": "supported", "reason": "r"}'])
    server.said = lambda body: next(answers)
    assert ModelJudge(ChatService(server.url, temperature=0.1)).judge(["t"], ["f"]) == [("Supported", "r")]
    assert [round(b["temperature"], 1) for _, b in server.seen] == [0.1, 0.2, 0.3, 0.4]
    assert all(b["guided_json"]["required"] == ["verdict", "reason"] for _, b in server.seen)
    server.said = lambda body: "never"
    assert ModelJudge(ChatService(server.url, answers=2)).judge(["t"], ["f"]) == [(None, "")]


def test_reasoning_goes_through_the_auxiliary_model(server):
    server.said = lambda body: '{"verdict": "Not Addressed", "reason": "n"}' if "chain of thought" in body["messages"][1]["content"] else "First this, then that."
    judge = ModelJudge(ChatService(server.url, model="large"), reasoning=True, auxiliary=ChatService(server.url, model="small"))
    assert judge.judge(["t"], ["f"]) == [("Not Addressed", "n")]
    assert [b["model"] for _, b in server.seen] == ["large", "small"] and "First this" in server.seen[1][1]["messages"][1]["content"]


def test_judge_in_a_plan_quarantines(spark, server):
    server.said = lambda body: "never" if "odd" in body["messages"][1]["content"] else '{"verdict": "Supported", "reason": "r"}'
    df = spark.createDataFrame([(1, "fine", "f"), (2, "odd", "f")], "id long, text string, reference string")
    out = {r["id"]: r["verdict"] for r in decompose.judge(df, "text", "reference", ModelJudge(ChatService(server.url, answers=2))).collect()}
    assert out == {1: "Supported", 2: None}


def test_claims_in_two_steps(spark, server):
    def said(body):
        text = body["messages"][1]["content"]
        if "contains_claim" in text:
            return json.dumps({"contains_claim": "hello" not in text})
        return '{"claims": ["a is b", " ", "c is d "]}' if "good" in text else "broken"

    server.said = said
    finder = ModelClaims(ChatService(server.url, answers=2))
    assert finder.claims(["good text", "hello", "bad text", "", None]) == [["a is b", "c is d"], [], [], [], []]
    df = spark.createDataFrame([(1, "good text"), (2, "hello")], "id long, text string")
    assert sorted(tuple(r) for r in decompose.claims(df, "id", "text", finder).collect()) == [(1, 0, "a is b"), (1, 1, "c is d")]


def test_validity_writer_and_explanations(spark, server):
    server.said = lambda body: '{"answer": true}' if "question" in body["messages"][1]["content"] else '{"answer": false}' if "answer" in body["messages"][1]["content"] else "short sum"
    df = spark.createDataFrame([(1, "what?")], "id long, text string")
    flags = decompose.validity_flags(df, "text", ModelValidity(ChatService(server.url))).first()
    assert flags["interrogative"] is True and flags["imperative"] is False
    assert ModelWriter(ChatService(server.url)).write(["a b c"], 5) == "short sum"
    server.said = lambda body: "s" if "Shorten" in body["messages"][1]["content"] else "one two three four five six"
    assert ModelWriter(ChatService(server.url)).write(["before", "next"], 5) == "s"
    assert ModelExplainer(ChatService(server.url)).explain("Supported", ["r1", "r2"])
    assert "- r1\n- r2" in server.seen[-1][1]["messages"][1]["content"]


def test_services_in_retrieval(spark, server):
    df = spark.createDataFrame([("q", n, s, "query", "t" * n) for n, s in ((1, 0.9), (5, 0.5), (3, 0.1))], "query_id string, node_id long, score double, query string, text string")
    assert [r["node_id"] for r in retrieval.rerank(df, 2, RerankService(server.url)).orderBy("rank").collect()] == [5, 3]
    assert decompose.embed(df, "text", EmbeddingService(server.url)).where("node_id = 5").first()["dense"] == [5.0, 1.0]


def test_templates():
    assert prompts.prompt("judge", text="{x}", reference="a") .count("{x}") == 1 and len(prompts.TEMPLATES) >= 20
    with pytest.raises(KeyError):
        prompts.prompt("judge", text="x")
    assert all(prompts.prompt(n, **dict.fromkeys(prompts.fields(n), "v")) for n in prompts.TEMPLATES)
