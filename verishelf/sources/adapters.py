"""Search, fetch and model adapters: tables offline, injected callables live."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verishelf.functions import urls as U


def search_offline(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Candidates of stored searches: queries (row_uid, strategy, text) joined to results (text, rank, url, title)."""
    return queries.join(results, "text").withColumn("url", U.canonical(F.col("url"))).where(U.safe(F.col("url")))


def search_results(payloads: DataFrame) -> DataFrame:
    """text, rank, url, title, engine from JSON answers of a metasearch service; ranks count from one."""
    kind = "struct<results:array<struct<url:string,title:string,engine:string>>>"
    rows = payloads.select("text", F.posexplode(F.from_json("payload", kind)["results"]).alias("p", "r"))
    return rows.select("text", (F.col("p") + 1).alias("rank"), "r.url", "r.title", "r.engine")


def stray_engines(payloads: DataFrame) -> DataFrame:
    """text and the engines that answered without having been asked. payloads: text, payload, engines."""
    kind = "struct<results:array<struct<engine:string>>>"
    seen = F.array_distinct(F.transform(F.from_json("payload", kind)["results"], lambda r: r["engine"]))
    return payloads.select("text", F.array_except(seen, "engines").alias("stray")).where(F.size("stray") > 0)


@dataclass
class Answer:
    """What an injected getter gives for one request: no redirect is followed, the body comes in pieces."""

    status: int
    location: str | None = None
    body: Iterable[bytes] = ()
    charset: str = "utf-8"


def _allowed(url: str, resolve: Callable[[str], list[str]] | None) -> bool:
    """Whether a URL's host may be asked: http or https, and every address that it stands for is global."""
    try:
        parts = urlsplit(url)
        name = parts.hostname or ""
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or not name:
        return False
    if ":" in name or re.search(r"(^|\.)(\d+|0x[0-9a-f]*)\.?$", name):
        return U.is_global(name)
    if name.rstrip(".") == "localhost" or name.rstrip(".").endswith(".localhost"):
        return False
    if resolve is None:
        return True
    try:
        found = resolve(name)
    except OSError:
        return False
    return bool(found) and all(map(U.is_global, found))


def get_guarded(url: str, get: Callable[[str], Answer], *, resolve: Callable[[str], list[str]] | None = None, robots: Callable[[str], bool] | None = None, hops: int = 5, most_bytes: int = 4 << 20) -> tuple[str, int | None, str | None, str]:
    """status, http_status, text, last url. Each hop is checked anew, before it is asked: the address,
    what the name resolves to, and the site's rules for robots. Reading stops at most_bytes."""
    for _ in range(hops + 1):
        if not _allowed(url, resolve):
            return "blocked", None, None, url
        if robots is not None and not robots(url):
            return "robots", None, None, url
        answer = get(url)
        if 300 <= answer.status < 400 and answer.location:
            url = urljoin(url, answer.location)
            continue
        data = bytearray()
        for piece in answer.body:
            data += piece
            if len(data) > most_bytes:
                return "too_large", answer.status, None, url
        return ("ok" if answer.status < 400 else "http_error"), answer.status, bytes(data).decode(answer.charset, "replace"), url
    return "redirects", None, None, url


def fetch(urls: DataFrame, get: Callable[[str], Answer], *, resolve: Callable[[str], list[str]] | None = None, robots: Callable[[str], bool] | None = None, hops: int = 5, most_bytes: int = 4 << 20, pause: float = 2.0, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """url, status, http_status, html, final_url: pages by an injected getter, a host's pages one after another.

    A host's URLs are all in one task, so its pace holds for the whole run. Private and uncanonical
    URLs are refused before any call, redirects at every hop (get_guarded). Server errors and exceptions are
    tried again after a growing random wait.
    """
    ready = urls.select("url", U.host(F.col("url")).alias("host"), U.safe(F.col("url")).alias("ok")).repartition("host").sortWithinPartitions("host", "url")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for f in frames:
            rows = []
            for url, host, ok in zip(f["url"], f["host"], f["ok"], strict=True):
                if not ok:
                    rows.append((url, "blocked", None, None, url))
                    continue
                if host == last:
                    sleep(pause)
                last, got = host, ("timeout", None, None, url)
                for k in range(retries):
                    try:
                        got = get_guarded(url, get, resolve=resolve, robots=robots, hops=hops, most_bytes=most_bytes)
                    except Exception:  # whatever a getter raises is a failed fetch
                        got = ("timeout", None, None, url)
                    if got[0] != "timeout" and (got[1] or 0) < 500:
                        break
                    sleep(random.uniform(0, 2**k))
                rows.append((url, *got))
            yield pd.DataFrame(rows, columns=["url", "status", "http_status", "html", "final_url"]).astype({"http_status": "Int32"})

    return ready.mapInPandas(run, "url string, status string, http_status int, html string, final_url string")


class Rotation:
    """Engines in turn. An engine with `failures` failures in a row rests for `cooldown` seconds."""

    def __init__(self, engines: tuple[str, ...], failures: int = 3, cooldown: float = 900.0):
        if not engines:
            raise ValueError("no engine")
        self.engines, self.failures, self.cooldown = engines, failures, cooldown
        self.turn, self.row, self.until = 0, dict.fromkeys(engines, 0), dict.fromkeys(engines, float("-inf"))

    def next(self, now: float) -> tuple[str, float]:
        """The engine whose turn it is, of those that don't rest, and the wait until it may be asked."""
        n = len(self.engines)
        turns = [self.engines[(self.turn + k) % n] for k in range(n)]
        ready = [e for e in turns if self.until[e] <= now]
        engine = ready[0] if ready else min(turns, key=lambda e: self.until[e])
        self.turn = (self.engines.index(engine) + 1) % n
        return engine, max(0.0, self.until[engine] - now)

    def record(self, engine: str, ok: bool, now: float) -> None:
        self.row[engine] = 0 if ok else self.row[engine] + 1
        if self.row[engine] >= self.failures:
            self.row[engine], self.until[engine] = 0, now + self.cooldown


def search(
    queries: DataFrame,
    find: Callable[[str, int, str], list[tuple[str, str]]],
    *,
    engines: tuple[str, ...] = ("default",),
    cache: DataFrame | None = None,
    max_calls: int | None = None,
    limit: int = 8,
    pause: float = 2.0,
    retries: int = 3,
    failures: int = 3,
    cooldown: float = 900.0,
    longest_wait: float = 900.0,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
    partitions: int = 1,
) -> DataFrame:
    """text, rank, url, title, engine, failed: answers of an injected search (text, limit, engine), each distinct text asked once.

    cache: rows of the same columns; its answers are taken first, whichever engine gave them, but for failed ones.
    max_calls: more searches (with their retries) than that raise before the first. Engines take turns,
    and one that keeps failing rests (Rotation); if all rest, the search waits, or fails beyond longest_wait. A search backend is
    shared, so its load is set by the number of partitions, which each have a rotation of their own. A
    search that fails every time gives one row with failed set.
    """
    asked = queries.select("text").distinct()
    known = None if cache is None else cache.where(~F.col("failed")).join(asked, "text", "left_semi").select("text", "rank", "url", "title", "engine", "failed")
    misses = asked if known is None else asked.join(known.select("text").distinct(), "text", "left_anti")
    if max_calls is not None and (n := misses.count()) * retries > max_calls:
        raise ValueError(f"{n} searches may take more than {max_calls} calls")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = Rotation(engines, failures, cooldown)
        for f in frames:
            rows = []
            for text in f["text"]:
                for k in range(retries):
                    engine, wait = turns.next(clock())
                    if wait > longest_wait:
                        rows.append((text, None, None, None, None, True))
                        break
                    if wait:
                        sleep(wait)
                    try:
                        found = find(text, limit, engine)[:limit]
                        turns.record(engine, True, clock())
                        rows += [(text, i + 1, url, title, engine, False) for i, (url, title) in enumerate(found)]
                        break
                    except Exception:  # whatever a backend raises is a failed search
                        turns.record(engine, False, clock())
                        sleep(random.uniform(0, 2**k))
                else:
                    rows.append((text, None, None, None, None, True))
                sleep(pause)
            yield pd.DataFrame(rows, columns=["text", "rank", "url", "title", "engine", "failed"]).astype({"rank": "Int32", "failed": bool})

    fresh = misses.repartition(partitions).mapInPandas(run, "text string, rank int, url string, title string, engine string, failed boolean")
    return fresh if known is None else fresh.unionByName(known.withColumn("rank", F.col("rank").cast("int")))


def images(urls: DataFrame, get: Callable[[str], tuple[str, Iterable[bytes]]], *, kinds: tuple[str, ...] = ("image/jpeg", "image/png", "image/webp"), most_bytes: int = 8 << 20) -> DataFrame:
    """url, status, media_type, sha256, data: images of allowed kinds and sizes by an injected getter.

    The getter gives the kind and the data in pieces; pieces beyond most_bytes, and of other kinds, aren't read.
    """
    ready = urls.select("url", U.safe(F.col("url")).alias("ok"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for url, ok in zip(f["url"], f["ok"], strict=True):
                try:
                    kind, pieces = get(url) if ok else ("", ())
                    data = bytearray()
                    for piece in pieces if kind in kinds else ():
                        data += piece
                        if len(data) > most_bytes:
                            break
                    data = bytes(data)
                    status = "blocked" if not ok else "bad_type" if kind not in kinds else "too_large" if len(data) > most_bytes else "ok"
                except Exception:  # whatever a getter raises is a failed fetch
                    kind, data, status = "", b"", "timeout"
                good = status == "ok"
                rows.append((url, status, kind if good else None, hashlib.sha256(data).hexdigest() if good else None, data if good else None))
            yield pd.DataFrame(rows, columns=["url", "status", "media_type", "sha256", "data"])

    return ready.mapInPandas(run, "url string, status string, media_type string, sha256 string, data binary")
