"""Result caches on the driver: least-recently-used with a time to live, and a cached search."""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable
from dataclasses import asdict

from lexigrove.operators.metrics import Monitor, benchmark
from lexigrove.options import Options


class LruCache:
    """Capacity and age bound; putting a key again does not renew its age."""

    def __init__(self, capacity: int = 1000, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.ttl, self._clock = capacity, ttl, clock
        self._rows: OrderedDict = OrderedDict()
        self._lock = threading.RLock()
        self.hits = self.misses = self.evictions = 0

    def _old(self, created: float) -> bool:
        return self.ttl > 0 and self._clock() - created > self.ttl

    def get(self, key, default=None):
        with self._lock:
            row = self._rows.get(key)
            if row is not None and self._old(row[1]):
                del self._rows[key]
                row = None
            if row is None:
                self.misses += 1
                return default
            self.hits += 1
            self._rows.move_to_end(key)
            return row[0]

    def put(self, key, value) -> None:
        with self._lock:
            created = self._rows[key][1] if key in self._rows else self._clock()
            self._rows[key] = (value, created)
            self._rows.move_to_end(key)
            while self.capacity > 0 and len(self._rows) > self.capacity:
                self._rows.popitem(last=False)
                self.evictions += 1

    def delete(self, key) -> bool:
        with self._lock:
            return self._rows.pop(key, None) is not None

    def clear(self) -> None:
        with self._lock:
            self._rows.clear()

    def sweep(self) -> int:
        """Remove expired rows from the least recently used on, up to the first live one."""
        with self._lock:
            gone = 0
            while self._rows and self._old(next(iter(self._rows.values()))[1]):
                self._rows.popitem(last=False)
                gone += 1
            return gone

    def keys(self) -> list:
        """The most recently used first."""
        with self._lock:
            return list(reversed(self._rows))

    def __len__(self) -> int:
        return len(self._rows)

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self._rows), "capacity": self.capacity, "hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_ratio": self.hits / asked if asked else 0.0}


def cache_key(query: str, options: Options) -> str:
    """Query (trimmed, lower case) and all options; no two option sets share a key."""
    return hashlib.sha256(f"{query.strip().lower()}|{json.dumps(asdict(options), sort_keys=True)}".encode()).hexdigest()


class CachedSearch:
    """Search one query at a time through a cache; empty results are not kept. ``timings`` has the last (query, seconds, hit), ``monitor`` the metrics of all."""

    def __init__(self, corpus, cache: LruCache | None = None, monitor: Monitor | None = None, timings: int = 10_000):
        self.corpus, self.cache, self.enabled, self.monitor = corpus, cache or LruCache(), True, monitor or Monitor()
        self.timings: deque[tuple[str, float, bool]] = deque(maxlen=timings)

    def search(self, spark, query: str, options: Options | None = None) -> list:
        from lexigrove.operators.search import search

        options, began = options or Options(), time.monotonic()
        key = cache_key(query, options)
        rows = self.cache.get(key) if self.enabled else None
        hit = rows is not None
        if not hit:
            rows = search(self.corpus, spark.createDataFrame([(0, query)], "qid long, text string"), options).orderBy("rank").collect()
            if rows and self.enabled:
                self.cache.put(key, rows)
        took = time.monotonic() - began
        self.timings.append((query, took, hit))
        self.monitor.searched(took, len(rows), hit, query)
        return rows

    def replace_corpus(self, corpus) -> None:
        """All tables of the new corpus are built anew, and nothing cached survives."""
        began = time.monotonic()
        self.corpus.release()
        self.corpus = corpus
        self.cache.clear()
        self.monitor.operated("load", time.monotonic() - began)

    def benchmark(self, spark, queries: list[str], iterations: int, options: Options | None = None) -> list[dict]:
        """A29 of each query's search, through the cache."""
        return [benchmark(f"search_{q}", lambda q=q: self.search(spark, q, options), iterations) for q in queries]
