"""Connectors to model services over HTTP, and backends made of them.

Each posts JSON and tries again a bounded number of times with growing waits. Objects hold addresses
and numbers only, so they travel to the executors; a call is made in the task that needs it, for a
batch, with at most `workers` requests under way. A service that stays away raises ServiceError, which
Spark's task retries meet; an answer that stays unusable gives None, for quarantine.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, TypeVar

from veriloom.functions.columns import VERDICTS
from veriloom.functions.prompts import VALIDITY, prompt

T, R = TypeVar("T"), TypeVar("R")


class ServiceError(RuntimeError):
    """A service didn't answer within the tries allowed."""


def retried(call: Callable[[], T], tries: int = 4, wait: float = 0.5, most: float = 8.0, errors: tuple[type[BaseException], ...] = (OSError, ValueError), sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; waits double from one try to the next, up to most. The last error becomes a ServiceError's cause."""
    for k in range(tries):
        try:
            return call()
        except errors as e:
            if k + 1 == tries:
                raise ServiceError(f"no usable answer after {tries} tries: {e}") from e
            sleep(min(most, wait * 2**k))
    raise ValueError("tries must be at least 1")


def in_parallel(call: Callable[[T], R], items: Sequence[T], workers: int) -> list[R]:
    """Results in order of the items, with a bounded number of calls under way."""
    if workers <= 1 or len(items) <= 1:
        return [call(x) for x in items]
    with ThreadPoolExecutor(min(workers, len(items))) as pool:
        return list(pool.map(call, items))


def batches(items: Sequence[T], size: int) -> list[Sequence[T]]:
    return [items[i : i + size] for i in range(0, len(items), size)]


@dataclass
class Service:
    base: str
    key: str = ""
    timeout: float = 30.0
    tries: int = 4
    wait: float = 0.5
    workers: int = 4

    def post(self, path: str, body: dict) -> Any:
        """The parsed answer. Errors of the client's making (4xx but 408 and 429) aren't tried again."""

        def once():
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
            request = urllib.request.Request(self.base.rstrip("/") + path, json.dumps(body).encode(), head)
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                if 400 <= e.code < 500 and e.code not in (408, 429):
                    raise ServiceError(f"{path}: {e.code} {e.reason}") from e
                raise

        return retried(once, self.tries, self.wait)


@dataclass
class EmbeddingService(Service):
    """Embedder: POST /embeddings gives for each text dense and sparse embeddings, or a plain vector."""

    model: str = ""
    size: int = 32

    def embed(self, texts: list[str]) -> list[tuple[list[float], dict[str, float]]]:
        def some(part):
            data = self.post("/embeddings", {"input": list(part), "model": self.model})["data"]
            if len(data) != len(part):
                raise ServiceError(f"{len(data)} embeddings for {len(part)} texts")
            found = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
            return [(list(map(float, e["dense"])), {str(k): float(v) for k, v in (e.get("sparse") or {}).items()}) if isinstance(e, dict) else (list(map(float, e)), {}) for e in found]

        return [e for part in in_parallel(some, batches(texts, self.size), self.workers) for e in part]


@dataclass
class RerankService(Service):
    """Reranker: POST /rerank scores all texts of one query at once."""

    def score(self, query: list[str], text: list[str]) -> list[float]:
        places: dict[str, list[int]] = {}
        for i, q in enumerate(query):
            places.setdefault(q, []).append(i)

        def one(q: str) -> list[float]:
            found = self.post("/rerank", {"query": q, "documents": [text[i] for i in places[q]]})["results"]
            if sorted(r["index"] for r in found) != list(range(len(places[q]))):
                raise ServiceError("the scores don't fit the texts")
            return [float(r["relevance_score"]) for r in sorted(found, key=lambda r: r["index"])]

        out = [0.0] * len(query)
        for q, scores in zip(places, in_parallel(one, list(places), self.workers), strict=True):
            for i, s in zip(places[q], scores, strict=True):
                out[i] = s
        return out


class Unusable(ValueError):
    """An answer that another try may better."""


def trimmed_json(text: str) -> Any:
    """JSON, or what lies between the first { and the last }. Unusable if neither parses."""
    for t in (text, m[0] if (m := re.search(r"\{.*\}", text, re.S)) else ""):
        try:
            return json.loads(t)
        except ValueError:
            continue
    raise Unusable("no JSON")


@dataclass
class ChatService(Service):
    """POST /chat/completions. A cut-off or unusable answer is asked for again, a little warmer each time."""

    model: str = ""
    temperature: float = 0.1
    step: float = 0.1
    warmest: float = 1.0
    answers: int = 5
    options: dict = field(default_factory=dict)

    def once(self, system: str, text: str, temperature: float, schema: dict | None = None) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "temperature": temperature} | self.options
        if schema:
            body |= {"guided_json": schema, "guided_whitespace_pattern": " "}
        choice = self.post("/chat/completions", body)["choices"][0]
        if choice.get("finish_reason", "stop") != "stop":
            raise Unusable(f"ended by {choice['finish_reason']}")
        return choice["message"]["content"] or ""

    def ask(self, system: str, text: str, schema: dict | None = None, valid: Callable[[Any], bool] = lambda x: True) -> Any:
        """Text, or the parsed object where a schema is given; None if no answer was usable."""
        temperature = self.temperature
        for _ in range(self.answers):
            try:
                said = self.once(system, text, temperature, schema)
                out = trimmed_json(said) if schema else said
                if schema and not all(k in out for k in schema.get("required", ())):
                    raise Unusable("keys are missing")
                if valid(out):
                    return out
            except (Unusable, TypeError):
                pass
            temperature = min(self.warmest, temperature + self.step)
        return None


def schema_of(**kinds: str | dict) -> dict:
    return {"type": "object", "properties": {k: v if isinstance(v, dict) else {"type": v} for k, v in kinds.items()}, "required": list(kinds)}


def verdict_of(label: object) -> str | None:
    """The verdict that a label names in whatever case."""
    return {v.lower(): v for v in VERDICTS}.get(str(label).strip().lower())


@dataclass
class ModelJudge:
    """Judge by a chat model. reasoning: a free chain of thought first, which the auxiliary model (or the same) turns into JSON."""

    chat: ChatService
    reasoning: bool = False
    auxiliary: ChatService | None = None

    def one(self, pair: tuple[str, str]) -> tuple[str | None, str]:
        text, reference = pair
        system, schema = prompt("judge_system"), schema_of(verdict={"type": "string", "enum": list(VERDICTS)}, reason="string")
        valid = lambda x: verdict_of(x["verdict"]) is not None
        if self.reasoning:
            chain = self.chat.ask(system, prompt("judge_reasoning", text=text, reference=reference))
            found = chain and (self.auxiliary or self.chat).ask(system, prompt("judge_from_reasoning", chain=chain), schema, valid)
        else:
            found = self.chat.ask(system, prompt("judge", text=text, reference=reference), schema, valid)
        return (verdict_of(found["verdict"]), str(found["reason"])) if found else (None, "")

    def judge(self, text: list[str], reference: list[str]) -> list[tuple[str | None, str]]:
        return in_parallel(self.one, list(zip(text, reference, strict=True)), self.chat.workers)


@dataclass
class ModelClaims:
    """ClaimFinder in two steps: whether a text makes a claim, then which. Unusable answers give none."""

    chat: ChatService

    def one(self, text: str | None) -> list[str]:
        system = prompt("claims_system")
        if not (text or "").strip():
            return []
        has = self.chat.ask(system, prompt("claims_contains", text=text), schema_of(contains_claim="boolean"))
        if not has or has["contains_claim"] is not True:
            return []
        found = self.chat.ask(system, prompt("claims_list", text=text), schema_of(claims={"type": "array", "items": {"type": "string"}}), lambda x: isinstance(x["claims"], list))
        return [c.strip() for c in found["claims"] if isinstance(c, str) and c.strip()] if found else []

    def claims(self, text: list[str]) -> list[list[str]]:
        return in_parallel(self.one, list(text), self.chat.workers)


@dataclass
class ModelValidity:
    """Six checks of each text; None where no answer was usable."""

    chat: ChatService

    def flags(self, text: list[str]) -> list[dict[str, bool | None]]:
        def one(ask: tuple[str, str]) -> bool | None:
            t, name = ask
            found = self.chat.ask(prompt("validity_system"), prompt(f"validity_{name}", text=t), schema_of(answer="boolean"), lambda x: isinstance(x["answer"], bool))
            return found["answer"] if found else None

        told = in_parallel(one, [(t, n) for t in text for n in VALIDITY], self.chat.workers)
        return [dict(zip(VALIDITY, told[i : i + len(VALIDITY)], strict=True)) for i in range(0, len(told), len(VALIDITY))]


@dataclass
class ModelWriter:
    """Writer: one text is summed up, two are what was written so far and what comes next; too long results are shortened."""

    chat: ChatService

    def write(self, texts: list[str], limit: int) -> str:
        system = prompt("writer_system")
        ask = prompt("writer_refine", before=texts[0], text="\n\n".join(texts[1:]), limit=limit) if len(texts) > 1 else prompt("writer_summarize", text=texts[0], limit=limit)
        out = self.chat.ask(system, ask) or ""
        if len(out.split()) > limit:
            out = self.chat.ask(system, prompt("writer_compact", text=out, limit=limit)) or out
        return out

    def combine(self, texts: list[str], limit: int) -> str:
        return self.chat.ask(prompt("writer_system"), prompt("writer_combine", text="\n\n".join(texts), limit=limit)) or ""


@dataclass
class ModelExplainer:
    """Sums up the reasons of one verdict."""

    chat: ChatService

    def explain(self, label: str, reasons: list[str]) -> str:
        return self.chat.ask(prompt("judge_system"), prompt("explain", label=label, reasons="\n".join(f"- {r}" for r in reasons))) or ""
