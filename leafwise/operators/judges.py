"""Page judges: each turns evidence rows into verdict rows (doc_id, page, needs_ocr, confidence, reason)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ASKED_CLEAR, ASKED_NEEDS, FAILURES, GATED_REASON, JUDGES

# The limits of a judge's request, when a page needs OCR, and when calls stop.
MAX_TEXT_CHARS, MAX_PAGES, MAX_BYTES = 2_000, 50, 262_144
THRESHOLD, FAILURES_IN_A_ROW, COOL_OFF_SECONDS, TIMEOUT_SECONDS = 0.5, 3, 30.0, 30.0
# End of fixed values.


class Judge(Protocol):
    """A judge is a name, whether it needs page texts, and a transform."""

    name: str
    needs_text: bool

    def judge(self, evidence: DataFrame) -> DataFrame: ...


class Heuristic:
    """What the structural analyser flagged needs OCR."""

    name, needs_text = "heuristic", False

    def judge(self, evidence: DataFrame) -> DataFrame:
        flagged = F.col("flagged_by_inspector")
        reason = F.when(flagged, F.coalesce(F.get("reasons", F.lit(0)), F.lit("inspector_flagged"))).otherwise("inspector_clear")
        return evidence.select("doc_id", "page", flagged.alias("needs_ocr"), F.lit(1.0).cast("float").alias("confidence"), reason.alias("reason"))


def threshold(value: float) -> float:
    """A usable threshold: what isn't finite is ignored, the rest is clamped."""
    return float(min(1.0, max(0.0, value))) if np.isfinite(value) else THRESHOLD


def verdict_columns(p: Column, limit: float = THRESHOLD) -> tuple[Column, Column]:
    """(needs_ocr, confidence) of a probability that the page needs OCR, all in 32-bit floats."""
    one = F.lit(1.0).cast("float")
    clamped = F.least(F.greatest(p.cast("float"), F.lit(0.0).cast("float")), one)
    needs = clamped >= F.lit(threshold(limit)).cast("float")
    return needs, F.when(needs, clamped).otherwise(one - clamped)


def ambiguous(evidence: DataFrame) -> DataFrame:
    """(doc_id, is_ambiguous): encoding issues, some but not all pages flagged, or a flagged page without reason."""
    flagged = F.col("flagged_by_inspector")
    found = evidence.groupBy("doc_id").agg(
        F.bool_or("has_encoding_issues").alias("odd"), F.count_if(flagged).alias("flags"), F.count(F.lit(1)).alias("n"), F.bool_or(flagged & (F.size("reasons") == 0)).alias("mute"),
    )
    return found.select("doc_id", (F.col("odd") | ((F.col("flags") > 0) & (F.col("flags") < F.col("n"))) | F.col("mute")).alias("is_ambiguous"))


def failure_reason(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, reason in FAILURES.items():
        out = F.when(kind == name, reason).otherwise(out)
    return out


def matched(responses: DataFrame) -> DataFrame:
    """(doc_id, page, probability, failure) of (doc_id, page, answers): the answer stands under the page's key; one that is missing, of another
    type, without value or not finite is a protocol failure. A finite value out of range is clamped."""
    answer = F.try_element_at("answers", F.concat(F.lit("page_"), F.col("page").cast("string")))
    value = answer["noul"]
    bad = answer.isNull() | (answer["type"] != "noul") | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    bad = F.coalesce(bad, F.lit(True))
    return responses.select("doc_id", "page", F.when(~bad, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("probability"), F.when(bad, "protocol").alias("failure"))


def settled(evidence: DataFrame, answers: DataFrame, *, gated: bool = False, strict: bool = False, limit: float = THRESHOLD) -> DataFrame:
    """Verdicts of the hosted judge from its answers (doc_id, page, probability, failure).

    Clear documents keep the heuristic's verdicts if gated. One failed page fails its document: the first failure by page counts, the
    heuristic's verdicts are taken under its reason, and if strict the document gives no verdict at all.
    """
    base = Heuristic().judge(evidence)
    failed = answers.where("failure IS NOT NULL").groupBy("doc_id").agg(F.min_by("failure", "page").alias("failed"))
    needs, sure = verdict_columns(F.col("probability"), limit)
    asked = base.join(answers.select("doc_id", "page", "probability"), ["doc_id", "page"], "left").join(failed, "doc_id", "left")
    clear = F.lit(False)
    if gated:
        asked = asked.join(ambiguous(evidence), "doc_id", "left")
        clear = ~F.col("is_ambiguous")
    lost = F.coalesce(F.col("failed"), F.when(F.col("probability").isNull(), "protocol"))
    out = asked.select("doc_id", "page", lost.alias("lost"), clear.alias("clear"), "needs_ocr", "confidence", "reason", needs.alias("asked_needs"), sure.alias("asked_sure"))
    if strict:
        out = out.where("clear OR lost IS NULL")
    use = ~F.col("clear") & F.col("lost").isNull()
    return out.select(
        "doc_id", "page", F.when(use, F.col("asked_needs")).otherwise(F.col("needs_ocr")).alias("needs_ocr"), F.when(use, F.col("asked_sure")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("clear"), GATED_REASON).when(F.col("lost").isNotNull(), failure_reason(F.col("lost"))).otherwise(F.when(F.col("asked_needs"), ASKED_NEEDS).otherwise(ASKED_CLEAR)).alias("reason"),
    )


def fallback_counts(verdicts: DataFrame) -> DataFrame:
    """(reason, pages) of the failures that verdicts were taken under."""
    return verdicts.where(F.col("reason").isin(*FAILURES.values())).groupBy("reason").agg(F.count(F.lit(1)).alias("pages"))


def page_state(evidence: DataFrame) -> DataFrame:
    """evidence as a judge sees it: the text clipped, its whole length, and whether it was clipped. A null text has length 0 and stays null."""
    n = F.coalesce(F.length("text"), F.lit(0))
    return evidence.withColumn("text_chars", n).withColumn("text_truncated", n > MAX_TEXT_CHARS).withColumn("text", F.substring("text", 1, MAX_TEXT_CHARS)).withColumn("question", F.concat(F.lit("page_"), F.col("page").cast("string")))


def state_json(pages: DataFrame) -> Column:
    """One page's state as JSON, nulls written."""
    return F.to_json(F.struct("page", "text", "text_chars", "text_truncated", *[c for c in ("inspector_flagged", "inspector_reasons", "has_tables", "has_columns", "has_encoding_issues") if c in pages.columns]), {"ignoreNullFields": "false"})


def question_json(page: Column) -> Column:
    """The question about one page as JSON; true means that it needs OCR."""
    text = F.concat(F.lit("Does the page of the entry in state whose page is "), page.cast("string"), F.lit(" need OCR, because its text is missing or isn't what the page shows?"))
    return F.to_json(F.struct(F.lit("noul").alias("type"), text.alias("instructions")))


def wire_size(page: Column, state: Column) -> Column:
    """Bytes of a page in a request: its state and its question."""
    return F.octet_length(state.cast("binary")) + F.octet_length(question_json(page).cast("binary"))


def chunk_ids(sizes: DataFrame, *, most_pages: int = MAX_PAGES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, page, chunk) of (doc_id, page, size): greedy requests in page order, a new one at so many pages or bytes. A fold over the pages of
    a document, whose number is bounded; an oversized page is a request of its own."""
    listed = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page"), F.col("size").cast("long").alias("size")))).alias("pages"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("held"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<struct<page:int,chunk:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["held"] >= most_pages) | ((a["held"] > 0) & (a["bytes"] + x["size"] > most_bytes))
        chunk = a["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(chunk.alias("chunk"), F.when(new, 1).otherwise(a["held"] + 1).alias("held"), F.when(new, x["size"]).otherwise(a["bytes"] + x["size"]).alias("bytes"), F.concat(a["out"], F.array(F.struct(x["page"].cast("int").alias("page"), chunk.alias("chunk")))).alias("out"))

    folded = listed.select("doc_id", F.aggregate("pages", start, step, lambda a: a["out"]).alias("out"))
    return folded.select("doc_id", F.explode("out").alias("o")).select("doc_id", "o.page", "o.chunk")


def request_bodies(states: DataFrame, model: str) -> DataFrame:
    """(doc_id, chunk, body) of (doc_id, page, chunk, question, state): model, states in page order, questions by key."""
    gathered = states.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("page", "state", "question"))).alias("p"))
    state = F.array_join(F.transform("p", lambda x: x["state"]), ",")
    ask = lambda x: F.concat(F.lit('"'), x["question"], F.lit('":'), question_json(x["page"]))
    body = F.concat(F.to_json(F.struct(F.lit(model).alias("model"))), F.lit(""))
    body = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"state":['), state, F.lit('],"questions":{'), F.array_join(F.transform("p", ask), ","), F.lit("}}"))
    return gathered.select("doc_id", "chunk", body.alias("body"))


CALLS = "chunk int, answer string, failure string, elapsed_ms long, status int, input_tokens long, output_tokens long, sent boolean"


def usable(answer: str, body: str) -> bool:
    """Whether a response has a finite number for each question of its request."""
    try:
        answers = json.loads(answer)["answers"]
        return all(answers[k]["type"] == "noul" and np.isfinite(float(answers[k]["noul"])) for k in json.loads(body)["questions"])
    except (ValueError, KeyError, TypeError):
        return False


class Breaker:
    """After so many failures in a row no call is made until the cool-off is over; limit 0 turns it off."""

    def __init__(self, limit: int, cool_off: float, now: Callable[[], float] = time.monotonic):
        self.limit, self.cool_off, self.now, self.run, self.opened = limit, cool_off, now, 0, None

    def is_open(self) -> bool:
        if self.opened is not None and self.now() - self.opened >= self.cool_off:
            self.run, self.opened = 0, None
        return self.opened is not None

    def note(self, ok: bool) -> None:
        self.run = 0 if ok else self.run + 1
        self.opened = self.now() if 0 < self.limit <= self.run else None


def ask(requests: DataFrame, client: Callable[[str], dict], *, limit: int = FAILURES_IN_A_ROW, cool_off: float = COOL_OFF_SECONDS) -> DataFrame:
    """(doc_id, chunk, answer, failure, elapsed_ms, status, input_tokens, output_tokens, sent) of requests (doc_id, chunk, body): the client is called in
    the tasks, a document's requests in order until the first that fails; those after it aren't sent and have no row. client(body) gives
    answer or failure (timeout, http, protocol), and what is known of the call. Each task has a circuit breaker of its own; it is asked once a document."""

    def run(frames):
        import pandas as pd

        breaker, doc, lost = Breaker(limit, cool_off), None, False
        for pdf in frames:
            out = []
            for doc_id, chunk, body in zip(pdf["doc_id"], pdf["chunk"], pdf["body"], strict=True):
                if doc_id != doc:
                    doc, lost = doc_id, breaker.is_open()
                    if lost:
                        out.append((doc_id, chunk, None, "breaker_open", None, None, None, None, False))
                elif lost:
                    continue
                if lost:
                    continue
                got = client(body)
                failure = got.get("failure")
                breaker.note(failure is None)
                if failure is None and not usable(got["answer"], body):
                    failure = "protocol"
                    breaker.note(False)
                lost = failure is not None
                out.append((doc_id, chunk, None if lost else got["answer"], failure, got.get("elapsed_ms"), got.get("status"), got.get("input_tokens"), got.get("output_tokens"), True))
            frame = pd.DataFrame(out, columns=["doc_id", "chunk", "answer", "failure", "elapsed_ms", "status", "input_tokens", "output_tokens", "sent"])
            yield frame.astype({c: "Int64" for c in ("elapsed_ms", "status", "input_tokens", "output_tokens")})

    kind = requests.schema["doc_id"].dataType.simpleString()
    dealt = requests.select("doc_id", "chunk", "body").repartition("doc_id").sortWithinPartitions("doc_id", "chunk")
    return dealt.mapInPandas(run, f"doc_id {kind}, {CALLS}")


def breaker_log(calls: DataFrame, *, limit: int, cool_off_ms: int) -> DataFrame:
    """(judge, ts_ms, ok, refused, run): the circuit breaker over an ordered log (judge, ts_ms, ok).

    `limit` failures in a row open it; a call while it is open is refused and not counted; a call after the cool-off closes it and begins
    the run anew; a success closes it; limit 0 turns it off. One judge's log is streamed through one task in order, in constant memory.
    """

    def run(batches):
        judge, count, opened = None, 0, None
        for pdf in batches:
            refused, runs = [], []
            for j, ts, ok in zip(pdf["judge"], pdf["ts_ms"], pdf["ok"], strict=True):
                if j != judge:
                    judge, count, opened = j, 0, None
                if opened is not None and ts - opened >= cool_off_ms:
                    count, opened = 0, None
                if opened is not None:
                    refused.append(True)
                else:
                    refused.append(False)
                    if ok:
                        count, opened = 0, None
                    else:
                        count += 1
                        if 0 < limit <= count:
                            opened = ts
                runs.append(count)
            yield pdf.assign(refused=refused, run=runs)

    kind = calls.schema["judge"].dataType.simpleString()
    dealt = calls.select("judge", "ts_ms", "ok").repartition("judge").sortWithinPartitions("judge", "ts_ms")
    return dealt.mapInPandas(run, f"judge {kind}, ts_ms long, ok boolean, refused boolean, run int")


def registry(key: str | None = None) -> dict[str, str]:
    """Judge name -> ready, or why it isn't."""
    return {name: "ready" if name == "heuristic" or key else "no API key" for name in JUDGES}


def by_name(name: str, key: str | None = None) -> str:
    """ready; an error for an unknown judge and another for one that can't be used here."""
    known = registry(key)
    if name not in known:
        raise KeyError(f"no judge is named {name}; there are {', '.join(known)}")
    if known[name] != "ready":
        raise RuntimeError(f"judge {name} can't be used: {known[name]}")
    return name


def first_failures(failures: DataFrame) -> DataFrame:
    """(doc_id, leg_no, error): the first failed leg of each document."""
    w = Window.partitionBy("doc_id").orderBy("leg_no")
    return failures.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
