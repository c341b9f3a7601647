"""A chat-completions connector with retries and a hard deadline, and JSON taken out of model text."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

RETRIED = (429, 500, 502, 503, 504)


@dataclass
class Provider:
    base_url: str
    model: str
    api_key: str | None = None
    api_key_env: str | None = None
    temperature: float = 0.0
    max_tokens: int | None = None
    timeout: float = 120.0
    retries: int = 3
    backoff: float = 2.0

    @classmethod
    def from_config(cls, config: dict[str, Any]) -> Provider:
        return cls(**{k: v for k, v in config.items() if k in cls.__dataclass_fields__})

    @property
    def key(self) -> str:
        found = self.api_key or (os.environ.get(self.api_key_env) if self.api_key_env else None)
        if not found:
            raise ValueError("no API key in the configuration or the environment")
        return found


def _post(provider: Provider, body: dict[str, Any]) -> dict[str, Any]:
    request = urllib.request.Request(provider.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {provider.key}"})
    with urllib.request.urlopen(request, timeout=provider.timeout) as answer:
        return json.loads(answer.read())


def _within(seconds: float, work: Callable[[], Any]) -> Any:
    """work's result, or TimeoutError after so many seconds, whatever the socket does."""
    box: dict[str, Any] = {}

    def run() -> None:
        try:
            box["value"] = work()
        except BaseException as error:  # noqa: BLE001  handed on to the caller
            box["error"] = error

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError(f"no answer within {seconds} s")
    if "error" in box:
        raise box["error"]
    return box["value"]


def chat(provider: Provider, prompt: str, system: str | None = None, post: Callable[[Provider, dict[str, Any]], dict[str, Any]] = _post, sleep: Callable[[float], None] = time.sleep) -> str:
    """The text of an answer. Busy services and server errors are tried again, each time after a longer wait."""
    messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
    body = {"model": provider.model, "messages": messages, "temperature": provider.temperature} | ({"max_tokens": provider.max_tokens} if provider.max_tokens else {})
    for attempt in range(provider.retries + 1):
        try:
            return _within(provider.timeout + 5, lambda: post(provider, body))["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as error:
            if error.code not in RETRIED or attempt == provider.retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == provider.retries:
                raise
        sleep(provider.backoff * (attempt + 1))
    raise AssertionError("unreachable")


def extract_json(text: str) -> Any:
    """The first JSON object or array in a text, with or without a fence around it."""
    body = text.strip()
    if "```" in body:
        inside = body.split("```")[1]
        body = inside.split("\n", 1)[1] if inside[:4].lower() == "json" and "\n" in inside else inside
    decoder = json.JSONDecoder()
    for at, c in enumerate(body):
        if c in "{[":
            try:
                return decoder.raw_decode(body, at)[0]
            except ValueError:
                continue
    raise ValueError("no JSON in the text")


def call_prompt_file(path: str | Path, call: Callable[[str], str], out_path: str | Path | None = None, mode: str = "text") -> Any:
    """The answer to a prompt file: as text, as JSON, or as JSON where there is some ('auto')."""
    answer: Any = call(Path(path).read_text(encoding="utf-8-sig"))
    if mode == "json":
        answer = extract_json(answer)
    elif mode == "auto":
        try:
            answer = extract_json(answer)
        except ValueError:
            pass
    elif mode != "text":
        raise ValueError("mode is text, json or auto")
    if out_path:
        Path(out_path).parent.mkdir(parents=True, exist_ok=True)
        Path(out_path).write_text(answer if isinstance(answer, str) else json.dumps(answer, indent=2, ensure_ascii=False))
    return answer
