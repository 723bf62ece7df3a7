"""HTTP sources: driver-side fetches, and a retrying call for use inside executors."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable


def fetch_json(url: str, headers: dict[str, str] | None = None, payload: dict | None = None, timeout: float = 120) -> dict:
    """GET, or POST with a payload; raises on HTTP errors."""
    data = None if payload is None else json.dumps(payload).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def generator(host: str, model: str, temperature: float = 0.0, max_tokens: int = 512, fetch: Callable = fetch_json) -> Callable[[list[str]], list[str]]:
    """A function of prompts for retrieval.answer() that asks a text-generation server."""
    def run(prompts: list[str]) -> list[str]:
        ask = lambda p: {"model": model, "prompt": p, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens}}
        return [fetch(f"{host}/api/generate", payload=ask(p)).get("response", "").strip() for p in prompts]

    return run


def with_retries(call: Callable, tries: int = 6, delay: float = 1.0, cap: float = 30.0, sleep: Callable = time.sleep):
    """call(), again after growing delays; the last error is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(min(cap, delay * 2**k))
