"""Calls of model servers from inside a task: a few at a time, each with a deadline, tried again after a pause, and never the task's end."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

_PIECE = re.compile(r"\w{1,6}|[^\w\s]")


@dataclass(frozen=True)
class Limits:
    """How calls are made: seconds that one may take, tries after the first, seconds before the first of those (twice as many before each next),
    calls at a time in a task, pieces of text that an input may have, and failures by deadline in a row after which a task calls no more.
    """

    deadline: float = 120.0
    retries: int = 1
    backoff: float = 0.5
    workers: int = 4
    max_tokens: int = 8192
    patience: int = 8


@dataclass(frozen=True)
class Outcome:
    """What came of a call: its value, or the error; and how often it was tried."""

    value: Any
    error: str | None
    tries: int


class Late(Exception):
    """A call that took longer than its deadline."""


def bounded_tokens(text: str, most: int) -> str:
    """A text up to its n-th piece: pieces are runs of up to six letters or digits, and single marks. Whole if it has no more."""
    if len(text) <= most:  # a piece has a character at least
        return text
    for n, piece in enumerate(_PIECE.finditer(text)):
        if n == most:
            return text[: piece.start()].rstrip()
    return text


def within(call: Callable, args: Sequence, deadline: float):
    """What a call returns or raises, or Late. A call that hangs is left to itself: its thread ends with the process at the latest."""
    done: list = []

    def run() -> None:
        try:
            done.append((True, call(*args)))
        except BaseException as e:  # handed on to the caller
            done.append((False, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(deadline)
    if not done:
        raise Late(f"no answer in {deadline:g} s")
    ok, value = done[0]
    if not ok:
        raise value
    return value


class Caller:
    """Calls of one task."""

    def __init__(self, call: Callable, limits: Limits):
        self.call, self.limits = call, limits
        self.late, self.lock = 0, threading.Lock()

    def one(self, args: Sequence) -> Outcome:
        error, tries = "", 0
        for attempt in range(self.limits.retries + 1):
            if self.late >= self.limits.patience:
                return Outcome(None, error or f"not tried: {self.late} calls before it had no answer", tries)
            if attempt:
                time.sleep(self.limits.backoff * 2 ** (attempt - 1))
            tries += 1
            try:
                value = within(self.call, args, self.limits.deadline)
            except Exception as e:  # whatever a model client raises
                error = f"{type(e).__name__}: {e}"
                with self.lock:
                    self.late = self.late + 1 if isinstance(e, Late) else 0
                continue
            with self.lock:
                self.late = 0
            return Outcome(value, None, tries)
        return Outcome(None, error, tries)

    def all(self, inputs: Sequence[Sequence]) -> Iterator[Outcome]:
        """Outcomes in the order of the inputs."""
        with ThreadPoolExecutor(max(1, self.limits.workers)) as pool:
            yield from pool.map(self.one, inputs)
