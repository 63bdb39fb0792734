"""Language models as an operator: a stored table of answers, or calls from the tasks that need them."""

from __future__ import annotations

import json
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import blocks
from millrace.operators.storage import kept

ANSWERS = "prompt_key string, response string, error string"


class ModelError(Exception):
    """A call that failed; daily: the provider's daily limit is used up."""

    def __init__(self, message: str, daily: bool = False):
        super().__init__(message)
        self.daily = daily


@dataclass
class Pace:
    """At most one call in so many seconds, in one process."""

    seconds: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = field(default=None, init=False)
    lock: threading.Lock = field(default_factory=threading.Lock, init=False, repr=False)

    def wait(self) -> None:
        if self.seconds > 0:
            with self.lock:
                if self.last is not None and (rest := self.last + self.seconds - self.clock()) > 0:
                    self.sleep(rest)
                self.last = self.clock()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"lock": threading.Lock()})


def seconds_in(text: str | None) -> float | None:
    """A wait as providers write it: 12, 1.5s, 250ms, 1m2s; null if it is none."""
    if not text:
        return None
    if re.fullmatch(r"\d+(\.\d+)?", text.strip()):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    return sum(float(n) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[unit] for n, unit in parts) if parts else None


def wait_after_429(headers: dict[str, str], body: str) -> float:
    """Seconds to wait after a minute's limit; a daily limit raises."""
    low = {k.lower(): v for k, v in headers.items()}
    left = low.get("x-ratelimit-remaining-requests", "")
    if re.search(r"\b(RPD|TPD|per day)\b", body, re.IGNORECASE) or (re.fullmatch(r"-?\d+", left) and int(left) <= 0):
        raise ModelError("daily rate limit exceeded", daily=True)
    said = re.search(r"try again in ([0-9.hms]+)", body)
    for text in (low.get("retry-after"), low.get("x-ratelimit-reset-tokens"), said and said[1]):
        if (wait := seconds_in(text)) is not None:
            return wait + 0.25
    return 60.25


def _post(url: str, payload: dict, headers: dict[str, str], timeout: float) -> str:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode()


@dataclass
class ChatModel:
    """A chat endpoint over HTTP. style: "openai" for chat/completions, "ollama" for /api/chat. strict: the schema binds."""

    url: str
    model: str
    style: str = "openai"
    api_key: str | None = None
    strict: bool = False
    #: Whether the endpoint takes a schema; otherwise it is asked for any JSON object.
    with_schema: bool = True
    timeout: float = 120.0
    retries: int = 3
    pace: Pace = field(default_factory=Pace)
    post: Callable[[str, dict, dict, float], str] = _post
    sleep: Callable[[float], None] = time.sleep

    def complete_with_schema(self, system: str, user: str, schema: dict) -> str:
        return self.complete(system, user, schema if self.with_schema else None)

    def complete(self, system: str, user: str, schema: dict | None = None) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        if self.style == "ollama":
            payload = {"model": self.model, "messages": messages, "stream": False, "format": schema or "json", "options": {"temperature": 0}}
        else:
            shape = {"type": "json_schema", "json_schema": {"name": "answer", "strict": self.strict, "schema": schema}} if schema else {"type": "json_object"}
            payload = {"model": self.model, "messages": messages, "temperature": 0, "response_format": shape}
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        failures = 0
        while True:
            self.pace.wait()
            try:
                body = json.loads(self.post(self.url, payload, headers, self.timeout))
                return body["message"]["content"] if self.style == "ollama" else body["choices"][0]["message"]["content"]
            except urllib.error.HTTPError as e:
                text, given = e.read().decode(errors="replace"), dict(e.headers or {})
                if e.code == 429:
                    self.sleep(wait_after_429(given, text))
                elif e.code >= 500 and failures < self.retries:
                    self.sleep(seconds_in(given.get("Retry-After")) or min(30.0, 2.0**failures))
                    failures += 1
                else:
                    raise ModelError(f"HTTP {e.code}: {text[:500]}") from e
            except (urllib.error.URLError, TimeoutError) as e:
                raise ModelError(str(e)) from e
            except (ValueError, KeyError, IndexError, TypeError) as e:
                raise ModelError("an answer of another shape") from e


def prompt_key(system: Column, user: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), system, user), 256)


def answers(prompts: DataFrame, model_of: Callable[[], object], stored: DataFrame | None = None, retries: int = 0, schema: dict | None = None, tasks: int | None = None) -> DataFrame:
    """prompt_key, response, error for each distinct prompt (prompt_key, system, user, and at: its place, if order matters).

    Stored answers are taken first. Only the rest is asked, once each, in tasks that make their own model by model_of(); what
    comes back is written before anything reads it, as an answer asked twice may differ. After a daily limit a task asks no more;
    it asks in order, so no prompt before the one that met the limit is left out for it.
    schema goes to models that have complete_with_schema(). tasks: at most so many ask at once, each at its share of the model's
    pace, so that the run as a whole keeps it.
    """
    at = F.min("at") if "at" in prompts.columns else F.lit(0)
    prompts = prompts.groupBy("prompt_key").agg(F.first("system").alias("system"), F.first("user").alias("user"), at.alias("at"))
    if stored is not None:
        stored = stored.select("prompt_key", "response", "error").where("error is null").dropDuplicates(["prompt_key"])
        known = stored.join(prompts.select("prompt_key"), "prompt_key", "left_semi")
        prompts = prompts.join(stored, "prompt_key", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, daily = None, False
        for batch in batches:
            rows = []
            for key, system, user in zip(*(batch.column(c).to_pylist() for c in ("prompt_key", "system", "user")), strict=True):
                response, error = None, "daily_limit" if daily else None
                if model is None:
                    model = model_of()
                    if tasks and isinstance(getattr(model, "pace", None), Pace):
                        model.pace.seconds *= tasks
                for attempt in range(0 if daily else retries + 1):
                    try:
                        bound = getattr(model, "complete_with_schema", None) if schema else None
                        response, error = bound(system, user, schema) if bound else model.complete(system, user), None
                        break
                    except Exception as e:
                        daily = getattr(e, "daily", False)
                        error = "daily_limit" if daily else f"error: {e}"
                        if daily or attempt == retries:
                            break
                rows.append((key, response, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, ["prompt_key", "response", "error"])

    # else Spark would join partitions of few bytes, however long a model takes for them
    prompts = prompts.repartition(tasks, "prompt_key") if tasks else blocks.spread(prompts, "prompt_key")
    asked = kept(prompts.sortWithinPartitions("at").select("prompt_key", "system", "user").mapInArrow(ask, ANSWERS))
    return known.unionByName(asked) if stored is not None else asked
