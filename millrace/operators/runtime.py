"""Runtime surfaces around scoring and tools: loading functions, timeouts, rate limits, bounded pools and tool sessions."""

from __future__ import annotations

import importlib.util
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from functools import partial
from typing import Any

from pyspark.sql import DataFrame


def load_function(path: str, name: str, **bound) -> Callable:
    """A function of a Python file by name, with keywords bound."""
    spec = importlib.util.spec_from_file_location(f"custom_{uuid.uuid4().hex}", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return partial(getattr(module, name), **bound) if bound else getattr(module, name)


def with_timeout(fn: Callable, seconds: float, fallback: Any = None) -> Callable:
    """``fn`` that gives up after some seconds: the fallback, or TimeoutError if it is None. Its thread is left to end by itself."""

    def run(*args, **kwargs):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(fn, *args, **kwargs).result(seconds)
        except Late:
            if fallback is None:
                raise TimeoutError(f"over {seconds} s") from None
            return fallback
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return run


class RateLimit:
    """At most ``n`` holders at a time; ``wait`` counts those that had to wait."""

    def __init__(self, n: int):
        self._free, self._lock = threading.BoundedSemaphore(n), threading.Lock()
        self.held = self.waited = 0

    def __enter__(self) -> RateLimit:
        now = self._free.acquire(blocking=False)
        if not now:
            self._free.acquire()
        with self._lock:
            self.held += 1
            self.waited += not now
        return self

    def __exit__(self, *_) -> None:
        with self._lock:
            self.held -= 1
        self._free.release()


def run_pool(fn: Callable, items: Iterable, workers: int, seconds: float) -> list[dict]:
    """One record an item, in order: {item, value, error}; a late or failed one has an error instead of stopping the others."""

    def one(item):
        began = time.monotonic()
        try:
            return {"item": item, "value": with_timeout(fn, seconds)(item), "error": None, "seconds": time.monotonic() - began}
        except Exception as e:  # noqa: BLE001 - the record says what went wrong
            return {"item": item, "value": None, "error": f"{type(e).__name__}: {e}", "seconds": time.monotonic() - began}

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, items))


class Tool:
    """A tool with sessions: create, execute (a reply, a reward and metrics), reward of the session, release."""

    def __init__(self, execute: Callable[[dict, dict], tuple[str, float, dict]], reward: Callable[[dict], float]):
        self._execute, self._reward, self._open = execute, reward, {}

    def create(self, session: str | None = None, **state) -> str:
        session = session or uuid.uuid4().hex
        self._open[session] = state
        return session

    def execute(self, session: str, arguments: dict) -> tuple[str, float, dict]:
        return self._execute(self._open[session], arguments)

    def reward(self, session: str) -> float:
        return self._reward(self._open[session])

    def release(self, session: str) -> None:
        self._open.pop(session, None)


def resample_until(draw: Callable[[int], DataFrame], keep: Callable[[DataFrame], DataFrame], group: str, target: int, tries: int) -> DataFrame:
    """Draws batches until enough groups are kept; the first ``target`` groups in order, or ValueError if the tries don't do."""
    out = None
    for k in range(tries):
        new = keep(draw(k))
        out = new if out is None else out.unionByName(new)
        groups = [r[0] for r in out.select(group).distinct().orderBy(group).limit(target).collect()]
        if len(groups) >= target:
            return out.filter(out[group].isin(groups))
    raise ValueError(f"only {len(groups) if tries else 0} of {target} groups after {tries} tries")
