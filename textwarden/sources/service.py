"""The optional HTTP service of deep mode: rows of a high local score are posted, and its answer replaces theirs."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.scoring import RISK, block_limit
from .config import Config

ESCALATE_AT = 60
FIELDS = [f.split(":")[0] for f in RISK[len("struct<") : -1].replace("array<string>", "list").split(",")]


class Client:
    """Posts texts with retries; after some failures in a row it pauses (one client a worker)."""

    def __init__(self, cfg: Config, post: Callable[[str, bytes, float], tuple[int, bytes]] | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.url = cfg.service_url.rstrip("/") + "/assess"
        self.timeout, self.mode = cfg.service_timeout_s or 5.0, cfg.mode
        self.retries = min(3, max(0, cfg.service_retries))
        self.limit = max(0, cfg.service_circuit_failures)
        self.cooldown = cfg.service_circuit_cooldown_s if cfg.service_circuit_cooldown_s > 0 else 15.0
        self.post, self.clock, self.sleep = post or _post, clock, sleep
        self.failed, self.open_until = 0, 0.0

    def assess(self, text: str, url: str | None = None) -> dict | None:
        """The service's result, or nothing if it failed in any way."""
        if self.clock() < self.open_until:
            return None
        body = json.dumps({"text": text, "mode": self.mode} | ({"url": url} if url else {})).encode()
        for attempt in range(self.retries + 1):
            status, data = self.post(self.url, body, self.timeout)
            if status == 200:
                result = _decoded(data)
                if result is not None:
                    self.failed, self.open_until = 0, 0.0
                return result
            if status and status != 429 and status < 500:
                return None
            self.failed += 1
            if self.limit and self.failed >= self.limit:
                self.failed, self.open_until = 0, self.clock() + self.cooldown
            if attempt < self.retries:
                self.sleep(0.05 * 2**attempt)
        return None


def _post(url: str, body: bytes, timeout: float) -> tuple[int, bytes]:
    """(status, body); status 0 if there was no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""
    except OSError:
        return 0, b""


def _decoded(data: bytes) -> dict | None:
    """A risk of known fields only; absent lists are empty."""
    try:
        found = json.loads(data)
    except ValueError:
        return None
    if not isinstance(found, dict) or set(found) - set(FIELDS):
        return None
    empty = {"score": 0, "level": "safe", "blocked": False, "reason": "", "over_defense_risk": 0.0, "is_output_scan": False, "pii_found": False, "redacted_text": "", "relevance_score": 0.0, "code_detected": False, "intent": ""}
    return {k: found.get(k) if found.get(k) is not None else empty.get(k, []) for k in FIELDS}


def escalate(df: DataFrame, text: str, url: str | None, cfg: Config, client: Callable[[], Client] | None = None) -> DataFrame:
    """``risk`` replaced by the service's where the local score is ESCALATE_AT or more and it answers; it is sent ``text``, as
    it was assessed (clamped).

    The call is not repeatable, so write or checkpoint the result before it is used twice.
    """
    make = client or (lambda: Client(cfg))
    limit = block_limit(cfg.strict, cfg.block_threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = make()
        for batch in batches:
            names = batch.schema.names
            risks, texts = batch.column(names.index("risk")).to_pylist(), batch.column(names.index(text)).to_pylist()
            urls = batch.column(names.index(url)).to_pylist() if url else [None] * len(risks)
            for k, (r, t, u) in enumerate(zip(risks, texts, urls, strict=True)):
                told = service.assess(t, u) if t is not None and r["score"] >= ESCALATE_AT else None
                if told:
                    risks[k] = told | {"blocked": told["score"] >= limit}
            at = names.index("risk")
            yield batch.set_column(at, batch.schema.field(at), pa.array(risks, type=batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
