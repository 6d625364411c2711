"""Pluggable annotators and language-model providers behind Arrow batches.

A provider is a callable from a list of requests to a list of replies.  Failures are data: a reply that cannot be had or
parsed leaves the input row as it was, with the error in a column.  Network transport is a parameter; none is made here.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Provider = Callable[[list[str]], list[str]]
Transport = Callable[[dict[str, Any]], dict[str, Any]]
PREVIEW = 240


# --- errors -----------------------------------------------------------------------------------------------------
class ContentError(RuntimeError):
    """A reply that holds no usable summary; only this lets a summary fall back to the crawl's own."""

    def __init__(self, message: str, *, payload: dict | None = None):
        super().__init__(message)
        self.payload = payload or {}


class GeminiContentError(ContentError):
    pass


class GrokContentError(ContentError):
    pass


# --- replies ----------------------------------------------------------------------------------------------------
def strip_fence(text: str) -> str:
    """What stands in the first code fence, a fence on one line included, or the text itself."""
    t = text.strip()
    if not t.startswith("```"):
        return t
    lines = t.splitlines()
    body = []
    for line in lines[1:]:
        if line.strip().startswith("```"):
            break
        body.append(line)
    return "\n".join(body).strip() or t


def parse_reply(reply: str, error: type[ContentError] = ContentError) -> object:
    """The JSON in a reply, with or without a code fence around it or prose beside it; otherwise an error with a preview."""
    t = strip_fence(reply)
    try:
        return json.loads(t)
    except ValueError:
        m = re.search(r"\[.*\]|\{.*\}", t, re.S)
        try:
            if m is not None:
                return json.loads(m.group())
        except ValueError:
            pass
    shown = t.replace("\n", " ")
    shown = shown if len(shown) <= PREVIEW else shown[: PREVIEW - 3] + "..."
    raise error(f"the reply has invalid JSON: {shown}", payload={"text": reply})


def candidate_text(payload: dict) -> str:
    """The first text part of a reply of candidates; the error names why there is none."""
    candidates = payload.get("candidates") or []
    for c in candidates:
        for part in (c.get("content") or {}).get("parts") or []:
            if part.get("text"):
                return part["text"]
    if not candidates:
        raise GeminiContentError("the reply has no candidates", payload=payload)
    why = {"finishReason": candidates[0].get("finishReason"), "blockReason": (payload.get("promptFeedback") or {}).get("blockReason")}
    named = ", ".join(f"{k}={v}" for k, v in why.items() if v)
    raise GeminiContentError("the reply has no text part" + (f" ({named})" if named else ""), payload=payload)


def choice_text(payload: dict) -> str:
    """The message of the first choice of a chat reply."""
    for c in payload.get("choices") or []:
        if text := (c.get("message") or {}).get("content"):
            return text
    raise GrokContentError("the reply has no message", payload=payload)


# --- clients ----------------------------------------------------------------------------------------------------
class Client:
    """A provider over a transport: builds the request, reads the text of the reply.  ``close`` frees the transport."""

    error: type[ContentError] = ContentError

    def __init__(self, key: str, model: str = "", transport: Transport | None = None):
        self.key, self.model, self.transport = key, model, transport

    def request(self, prompt: str) -> dict:
        raise NotImplementedError

    def text(self, payload: dict) -> str:
        raise NotImplementedError

    def __call__(self, requests: list[str]) -> list[str]:
        if self.transport is None:
            raise RuntimeError("no transport is configured")
        out = []
        for r in requests:
            payload = self.transport(self.request(r))
            if (status := payload.get("status", 200)) >= 400:
                raise self.error(f"API error: {(payload.get('error') or {}).get('message') or f'HTTP {status}'}", payload={"status": status})
            out.append(self.text(payload))
        return out

    def close(self) -> None:
        if callable(done := getattr(self.transport, "close", None)):
            done()


class GeminiClient(Client):
    error = GeminiContentError

    def request(self, prompt: str) -> dict:
        return {"key": self.key, "model": self.model, "json": {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0.3, "responseMimeType": "application/json"}}}

    def text(self, payload: dict) -> str:
        return candidate_text(payload)


class GrokClient(Client):
    error = GrokContentError

    def request(self, prompt: str) -> dict:
        return {"key": self.key, "model": self.model, "json": {"messages": [{"role": "user", "content": prompt}], "temperature": 0.3, "response_format": {"type": "json_object"}}}

    def text(self, payload: dict) -> str:
        return choice_text(payload)


def identity(requests: list[str]) -> list[str]:
    return requests


REGISTRY: dict[str, Callable[..., Provider]] = {"identity": lambda **_: identity, "gemini": GeminiClient, "grok": GrokClient}
NEED_KEY = frozenset(("gemini", "grok"))


def make(name: str, **settings: Any) -> Provider:
    """A registered provider; unknown names give a ValueError, missing keys a RuntimeError."""
    low = name.lower()
    if low not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}")
    if low in NEED_KEY and not settings.get("key"):
        raise RuntimeError(f"a key is required for the provider {low}")
    return REGISTRY[low](**settings)


# --- use --------------------------------------------------------------------------------------------------------
def annotate(df: DataFrame, column: str, provider: Provider, out: str = "reply", retries: int = 3, wait: float = 0.0) -> DataFrame:
    """``df`` with the provider's reply and an error column; batches are retried, then left as they were."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = ["" if x is None else x for x in pdf[column]]
            error = None
            for n in range(retries):
                try:
                    got = provider(asked)
                    error = None
                    break
                except Exception as e:  # a provider may fail in any way
                    got, error = asked, f"{type(e).__name__}: {e}"[:PREVIEW]
                    time.sleep(wait * (n + 1))
            yield pdf.assign(**{out: got, "error": error})

    return df.mapInPandas(run, schema)


def summarised(prompts: DataFrame, key: str, provider: Provider, retries: int = 1) -> DataFrame:
    """(key, reply, reason): replies one by one; ``reason`` says why a row has to fall back: only content errors do, others fail."""
    schema = f"{key} {prompts.schema[key].dataType.simpleString()}, reply string, reason string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf["prompt"], strict=True):
                reply, reason = None, None
                for _ in range(retries):
                    try:
                        reply, reason = json.dumps(parse_reply(provider([p])[0])), None
                        break
                    except ContentError as e:
                        reason = str(e)
                rows.append((k, reply, reason))
            yield pd.DataFrame(rows, columns=[key, "reply", "reason"])

    return prompts.select(key, "prompt").mapInPandas(run, schema)


def refine(rows: DataFrame, order: str, provider: Provider, size: int = 100, retries: int = 3) -> DataFrame:
    """Rows sent to a provider as JSON in chunks of ``size`` along an order; a chunk whose reply is no list of rows stays as it was.

    What a reply leaves out is gone, what it adds is there; dedupe afterwards.
    """
    from inkgraph.operators.graph import chunks

    names = rows.columns
    numbered = chunks(rows, order, size).withColumn("_row", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    packed = numbered.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "_row"))), lambda x: x["_row"]).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for chunk in pdf["rows"]:
                kept = [str(r) for r in chunk]
                for _ in range(retries):
                    try:
                        got = parse_reply(provider(["[" + ", ".join(kept) + "]"])[0])
                        if isinstance(got, list) and all(isinstance(g, dict) for g in got):
                            kept = [json.dumps(g) for g in got]
                            break
                    except Exception:  # the input stands
                        continue
                out += kept
            yield pd.DataFrame({"row": out})

    return packed.mapInPandas(run, "row string").select(F.from_json("row", rows.schema).alias("r")).select("r.*")
