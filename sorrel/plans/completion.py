"""Clients of a completion service, for the driver only."""

from __future__ import annotations

import json
import urllib.request
from collections import deque
from dataclasses import dataclass, field
from typing import Protocol


class CompletionClient(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Disabled:
    """No service: every call fails."""

    def complete(self, system: str, user: str) -> str:
        raise RuntimeError("no completion service is configured")


@dataclass
class Static:
    answer: str

    def complete(self, system: str, user: str) -> str:
        return self.answer


@dataclass
class Mock:
    """Answers in order; fails when they are used up."""

    answers: list[str]
    asked: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._left = deque(self.answers)

    def complete(self, system: str, user: str) -> str:
        self.asked.append((system, user))
        if not self._left:
            raise RuntimeError("no answer is left")
        return self._left.popleft()


@dataclass
class Http:
    """A chat completion service over HTTP."""

    base_url: str
    api_key: str
    model: str
    temperature: float = 0.3
    max_tokens: int = 4096
    timeout: float = 60.0

    def request(self, system: str, user: str) -> urllib.request.Request:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens}
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        return urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), head, method="POST")

    def complete(self, system: str, user: str) -> str:
        with urllib.request.urlopen(self.request(system, user), timeout=self.timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"]
