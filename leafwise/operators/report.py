"""The bench's result as relations and, from their few rows, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import bench, scoring

COST_NOTE = (
    "The saving is counted over this corpus and is no forecast.",
    "Pages are priced one by one; minimums, tiers and fees of real contracts are left out.",
    "It is measured against OCR of every page, not against today's routing.",
    "A page that needed OCR and got none is never set off against one that got it for nothing.",
)


def relations(verdicts: DataFrame, docs: DataFrame, truth: DataFrame, times: DataFrame, usage: DataFrame, *, price: float, per_million: float | None = None) -> dict[str, DataFrame]:
    """Every block of the report. verdicts: judge, doc_id, page, needs_ocr, confidence; docs: doc_id, source, page_count, seq; truth: doc_id, page;
    times: judge, doc_id, ms; usage: judge, input_tokens, output_tokens, a row a call."""
    per_doc = scoring.score_pages(verdicts, truth, "judge", "doc_id")
    every = bench.every_judge(docs, verdicts.select("judge").distinct())
    full = every.join(per_doc, ["judge", "doc_id"], "left")
    full = full.fillna(0, list(scoring.COUNTS)).withColumn("route_exact", F.coalesce("route_exact", F.lit(True)))
    groups = bench.by_source(full, "judge").withColumn("source", F.coalesce("source", F.lit("(all)")))
    whole = groups.where("source = '(all)'")
    deltas = bench.with_delta(times)
    judged = verdicts.join(truth.withColumn("truly", F.lit(True)), ["doc_id", "page"], "left").select("judge", "confidence", (F.col("needs_ocr") == F.coalesce("truly", F.lit(False))).alias("right"))
    return {
        "errors": scoring.with_totals(whole), "documents": full.join(deltas, ["judge", "doc_id"], "left"), "sources": scoring.with_totals(groups), "rates": scoring.with_rates(whole),
        "cost": scoring.with_cost(whole, price).withColumn("verdict", scoring.ceiling_verdict()), "latency": scoring.latency(times, "judge").join(bench.overhead(deltas), "judge", "left"),
        "spend": scoring.with_spend(scoring.token_usage(usage, "judge"), per_million).withColumn("state", scoring.judge_state()), "confidence": judged.groupBy("judge", "confidence").agg(F.count(F.lit(1)).alias("verdicts"), F.count_if("right").alias("correct")),
        "reliability": judged.groupBy("judge", C.bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("verdicts"), F.count_if("right").alias("correct"), F.avg(F.col("confidence").cast("double")).alias("mean_confidence")).withColumn("accuracy", C.ratio(F.col("correct"), F.col("verdicts"))),
        "brier": judged.groupBy("judge").agg(F.avg(F.pow(F.col("confidence").cast("double") - F.col("right").cast("double"), F.lit(2))).alias("brier")),
        "caveats": bench.synthetic_caveats(groups.where("source <> '(all)'")),
    }


def rows(found: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """The relations on the driver. All but `documents` have a few rows a judge; that one a row a document, as the report lists them."""
    return {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in found.items()}


def wrap(text: str, width: int = 88, indent: str = "    ") -> str:
    """Words in lines of at most so many bytes of UTF-8; a longer word has a line of its own."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(f"{lines[-1]} {word}".encode()) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(word)
    return "\n".join(indent + line for line in lines)


def header(head: dict, names: list[str], failures: int) -> list[str]:
    """What was measured, over what, how often and at what price."""
    out = ["bench", f"corpus   {head['corpus']}", f"scored   {head['scored']} of {head['documents']} document(s)" + (f", {failures} excluded (see below)" if failures else "")]
    out += [f"repeat   {head['repeat']} run(s) per document; times are medians", f"cost     {head['cost_per_page']:.4f} per OCR page, in units of the caller's choice"]
    if head["cost_per_million_input_tokens"] is not None:
        out.append(f"tokens   {head['cost_per_million_input_tokens']:.4f} per million input tokens of a hosted judge; output tokens are counted, not priced")
    return [*out, "judges   " + ", ".join(n + " (baseline)" * (n == bench.BASELINE) for n in names)]


def confidence_block(values: list[dict], tenths: list[dict], brier: dict | None) -> list[str]:
    """Distinct confidences; the reliability table and the Brier score only where they differ."""
    out = [f"  confidence: {len(values)} distinct value(s) over {sum(x['verdicts'] for x in values)} verdict(s): " + ", ".join(f"{x['confidence']:.3f} x{x['verdicts']}" for x in values)]
    if len(values) < 2:
        return [*out, f"  degenerate: {'constant %.3f' % values[0]['confidence'] if values else 'no verdicts'}; a confidence that is always the same tells nothing"]
    for t in sorted(tenths, key=lambda x: x["bucket"]):
        low = t["bucket"] / 10
        out.append(f"    [{low:.1f}, {low + 0.1:.1f}{']' if t['bucket'] == 9 else ')'} {t['verdicts']:>7} verdict(s), {t['correct']:>7} right, accuracy {t['accuracy']:.3f}, mean confidence {t['mean_confidence']:.3f}")
    return out + ([f"  Brier {brier['brier']:.4f} (0 is perfect, 0.25 is a coin flip stated at 0.5)"] if brier and brier["brier"] is not None else [])


SAVING = {"exact": "as much as a router without error", "beyond": "more than a router without error: needed OCR was not bought", "short": "less than a router without error", "cancelled": "as much as a router without error, by misses and waste that cancel"}


def savings(cost: dict, spend: list[dict]) -> list[str]:
    """What was saved against OCR of every page, and what the judge's own calls leave of it."""
    if not cost["all_pages"]:
        return ["  saving: n/a (no pages were scored)"]
    out = [f"  saved {cost['saving']:.4f} of {cost['naive']:.4f}; at most {cost['ceiling_saving']:.4f} could be: {SAVING[cost['verdict']]}"]
    told = {"no_calls": "made no calls", "unreported": "calls report no tokens, so their cost is unknown", "unpriced": "tokens have no price here", "priced": "", "floor": "some calls report no tokens; the cost is a floor"}
    for s in spend:
        line = f"  judge: {s['calls']} call(s), {s['input_tokens']} input and {s['output_tokens']} output token(s)" + f"; {told[s['state']]}" * bool(told[s["state"]])
        out.append(line + (f"; cost {s['judge_cost']:.4f}, net {cost['saving'] - s['judge_cost']:.4f}" if s["judge_cost"] is not None and s["state"] != "unreported" else "; net n/a"))
    return out


def _rate(value: float | None, why: str) -> str:
    return f"n/a ({why})" if value is None else f"{value:.3f}"


def render(r: dict[str, list[dict]], skipped: list[tuple[str, str]], failures: list[dict], head: dict | None = None) -> str:
    """The report as text: the header, what was left out, then a part per judge, then the notes."""
    names = sorted({x["judge"] for x in r["errors"]}, key=lambda j: (j != bench.BASELINE, j))
    out = header(head, names, len(failures)) if head else ["JUDGES: " + ", ".join(n + " (baseline)" * (n == bench.BASELINE) for n in names)]
    out += [f"SKIPPED {n}: {why}" for n, why in skipped] + [f"FAILED {f['document']}: {f['error']}" + (f" (judge {f['judge']})" if f.get("judge") else "") for f in failures]
    for name in names:
        own = {k: [x for x in v if x.get("judge") == name] for k, v in r.items()}
        e, c, t, l = own["errors"][0], own["cost"][0], own["rates"][0], (own["latency"] or [None])[0]
        out += ["", f"== {name}", f"  {e['documents']} document(s), {e['pages']} page(s), {e['exact']} exact", f"  missed {e['missed_ocr']} of {e['truly_needs_ocr']}, wasted {e['wasted_ocr']} of {e['truly_local']}"]
        out += [f"    {d['doc_id']}: {d['page_count']} page(s), {'exact' if d['route_exact'] else 'OFF'}" + "".join(f", {k} {d[k + '_pages']}" for k in ("missed", "wasted") if d.get(k + "_pages")) for d in own["documents"] if not d["route_exact"]]
        out += [f"  {s['source']}: {s['exact']}/{s['documents']} exact, {s['missed_ocr']} missed, {s['wasted_ocr']} wasted" for s in own["sources"] if s["source"] != "(all)"]
        out += [f"  precision {_rate(t['precision'], 'nothing was routed')}, recall {_rate(t['recall'], 'nothing needed it')}, F1 {_rate(t['f1'], 'undefined')}"]
        out += [f"  cost {c['routed']:.4f} of {c['naive']:.4f}, ideal {c['ideal']:.4f}, over {c['overspend']:.4f}, under {c['underspend']:.4f}; saved {c['saving']:.4f}, ceiling {c['ceiling_saving']:.4f}: {c['verdict']}"]
        out += savings(c, own["spend"])
        if l:
            out.append(f"  ms p50 {l['p50']:.3f}, p95 {l['p95']:.3f}, max {l['max']:.3f}" + (f", overhead {l['overhead_ms']:+.3f}" if l["overhead_ms"] is not None else ""))
        values = sorted(own["confidence"], key=lambda x: x["confidence"])
        out += confidence_block(values, own.get("reliability", []), (own.get("brier") or [None])[0])
    out += [""] + [wrap(f"{x['judge']} is perfect on {x['documents']} synthetic document(s) with {x['pages']} page(s). That shows that nothing broke; it can't tell judges apart.", indent="") for x in r["caveats"]]
    return "\n".join(out + ([wrap(x, indent="- ") for x in COST_NOTE] if r["documents"] else []))
