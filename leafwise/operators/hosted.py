"""The hosted judge from end to end: evidence, requests, calls, answers, verdicts."""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JUDGES
from ..plans.lineage import kept
from . import judges

PATH, MODEL = "/v1/systemone", "jev-latest"
#: Where the key, the address and the model of the judge may stand in the environment.
KEYS, URL, MODEL_NAME = ("LEAFWISE_JUDGE_KEY", "LEAFWISE_API_KEY"), "LEAFWISE_JUDGE_URL", "LEAFWISE_JUDGE_MODEL"
ANSWERS = "map<string,struct<type:string,noul:double>>"


@dataclass(frozen=True)
class Http:
    """A client behind HTTP: POST with a bearer key; every attempt is told, with how it failed."""

    base_url: str
    key: str
    timeout: float = judges.TIMEOUT_SECONDS

    def __call__(self, body: str) -> dict:
        began = time.monotonic()
        told = lambda **more: {"elapsed_ms": round((time.monotonic() - began) * 1000), **more}
        request = urllib.request.Request(self.base_url.rstrip("/") + PATH, body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout if self.timeout and self.timeout > 0 else None) as got:
                status, text = got.status, got.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return told(failure="http", status=e.code)
        except (TimeoutError, socket.timeout):
            return told(failure="timeout")
        except urllib.error.URLError as e:
            return told(failure="timeout" if isinstance(e.reason, TimeoutError) else "http")
        except OSError:
            return told(failure="http")
        try:
            usage = json.loads(text).get("usage") or {}
        except (ValueError, AttributeError):
            return told(failure="protocol", status=status)
        return told(answer=text, status=status, input_tokens=usage.get("input_tokens"), output_tokens=usage.get("output_tokens"))


@dataclass(frozen=True)
class Hosted:
    """A judge behind a client. gated: only ambiguous documents are asked about; strict: a document whose call fails gets no verdict,
    else the heuristic's under the reason of the failure. Calls are written once; `log` holds them, a table for each use."""

    client: Callable[[str], dict]
    model: str = MODEL
    gated: bool = False
    strict: bool = False
    limit: int = judges.FAILURES_IN_A_ROW
    cool_off: float = judges.COOL_OFF_SECONDS
    threshold: float = judges.THRESHOLD
    log: list = field(default_factory=list, compare=False)
    needs_text = True

    @property
    def name(self) -> str:
        return JUDGES[2] if self.gated else JUDGES[1]

    def requests(self, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((doc_id, page, chunk), (doc_id, chunk, body)) of the documents that are asked about."""
        if self.gated:
            evidence = evidence.join(judges.ambiguous(evidence).where("is_ambiguous").select("doc_id"), "doc_id", "left_semi")
        seen = judges.page_state(evidence).withColumnsRenamed({"flagged_by_inspector": "inspector_flagged", "reasons": "inspector_reasons"})
        states = seen.select("doc_id", "page", "question", judges.state_json(seen).alias("state"))
        chunks = judges.chunk_ids(states.select("doc_id", "page", judges.wire_size(F.col("page"), F.col("state")).alias("size")))
        return chunks, judges.request_bodies(states.join(chunks, ["doc_id", "page"]), self.model)

    def judge(self, evidence: DataFrame) -> DataFrame:
        chunks, bodies = self.requests(evidence)
        calls = kept(judges.ask(bodies, self.client, limit=self.limit, cool_off=self.cool_off), "judge-calls")
        self.log.append(calls)
        pages = chunks.join(calls.select("doc_id", "chunk", "answer", F.col("failure").alias("call_failure")), ["doc_id", "chunk"])
        answered = judges.matched(pages.where("call_failure IS NULL").select("doc_id", "page", F.from_json("answer", f"answers {ANSWERS}")["answers"].alias("answers")))
        failed = pages.where("call_failure IS NOT NULL").select("doc_id", "page", F.lit(None).cast("double").alias("probability"), F.col("call_failure").alias("failure"))
        return judges.settled(evidence, answered.unionByName(failed), gated=self.gated, strict=self.strict, limit=self.threshold)

    def usage(self) -> DataFrame | None:
        """(judge, doc_id, elapsed_ms, input_tokens, output_tokens) of the calls of the last use that were sent."""
        return self.log[-1].where("sent").select(F.lit(self.name).alias("judge"), "doc_id", "elapsed_ms", "input_tokens", "output_tokens") if self.log else None


def from_environment(environment: dict[str, str], *, base_url: str | None = None, key: str | None = None) -> Hosted | None:
    """The judge that the environment sets up, or None without a key; blank values don't count."""
    full = lambda x: x if x and x.strip() else None
    key = full(key) or next((environment[k] for k in KEYS if full(environment.get(k))), None)
    if key is None:
        return None
    return Hosted(Http(full(base_url) or full(environment.get(URL)) or "http://localhost:4000", key), full(environment.get(MODEL_NAME)) or MODEL)


def by_name(name: str, ready: Hosted | None) -> judges.Judge:
    """A judge and, with it, its log of calls. Unknown names and names of judges that can't be used are different errors."""
    judges.by_name(name, "ready" if ready else None)
    if name == judges.Heuristic.name:
        return judges.Heuristic()
    return replace(ready, gated=name == JUDGES[2], log=[])
