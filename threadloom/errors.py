"""Errors with codes, retry with backoff, fallbacks, and an error log of bounded size."""

from __future__ import annotations

import datetime
import os
import sys
import time
from collections.abc import Callable
from typing import Any, TypeVar

T = TypeVar("T")
#: Bytes of a log from which it begins anew.
MOST_LOG = 1 << 20


class EngineError(Exception):
    """An error with a code; ``recoverable`` ones may be tried again."""

    def __init__(self, message: str, code: str, recoverable: bool = False, context: dict[str, Any] | None = None):
        super().__init__(message)
        self.code, self.recoverable, self.context = code, recoverable, context or {}


def code_of(error: BaseException) -> str:
    return error.code if isinstance(error, EngineError) else "UNKNOWN"


def wrapped(call: Callable[[], T], fallback: T, what: str, out=None) -> T:
    """The call's result, or ``fallback`` with a line on standard error."""
    try:
        return call()
    except Exception as error:  # noqa: BLE001
        print(f"[threadloom] {what}: [{code_of(error)}] {error}", file=out or sys.stderr)
        return fallback


def retried(call: Callable[[], T], most: int, first_delay: float, longest_delay: float, if_: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result after at most ``most`` repetitions; waits double from ``first_delay`` up to ``longest_delay`` seconds."""
    wait, left = first_delay, most
    while True:
        try:
            return call()
        except Exception as error:
            if not left or not if_(error):
                raise
        sleep(wait)
        wait, left = min(2 * wait, longest_delay), left - 1


class ErrorLog:
    """A log file on the driver; one that has grown over ``MOST_LOG`` begins anew. Failing to write is no error."""

    def __init__(self, path: str):
        self.path = os.path.abspath(path)

    def write(self, error: BaseException, what: str) -> None:
        now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        line = f"[{now}] [{code_of(error)}] {what}: {error}\n"
        try:
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
            full = os.path.exists(self.path) and os.path.getsize(self.path) > MOST_LOG
            with open(self.path, "w" if full else "a", encoding="utf-8") as f:
                f.write(line)
        except OSError:
            print(f"[threadloom] log not written: {line}", end="", file=sys.stderr)


def action_after(error: BaseException, assembled: list | None = None) -> str:
    """What a pipeline does after an error: 'retry', 'partial' (use the context assembled so far) or 'passthrough'."""
    if isinstance(error, EngineError):
        if error.code.startswith("DB_"):
            return "passthrough"
        if error.recoverable:
            return "retry"
    return "partial" if assembled else "passthrough"
