"""Language ID as a mixture: every document is taken to be a mixture of the learned languages.

Learning: for each language, counts of letter trigrams (with word edges) in a bounded sample of labelled texts.
Prediction: each word has a likelihood under each language, the product of its trigrams'. Expectation-maximisation
finds the document's language proportions; for sets of 1, 2, ... languages, up to all (the largest
proportions first), it is run again on the set alone, and the set with the least penalised likelihood (BIC) is selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, share_of_ids, tidy

BITS = 17
ALPHA = 0.05
#: About so many labelled texts of each language at most are learned from, those whose hash of the id is small enough.
TEXTS_A_LANGUAGE = 2_000
#: A document's proportions are settled when none moves by more than this in a round; the rounds are limited.
SETTLED, MOST_ROUNDS = 1e-3, 100
CHARS_AT_ONCE = 1_000_000
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log likelihood of a trigram bucket by language


_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-case letters, 0 for all else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(_letters()[codes], codes, np.uint32(0))


def trigrams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram around each letter, and the indexes among them at which words begin."""
    codes = np.concatenate([np.zeros(1, np.uint32), _codes(text), np.zeros(1, np.uint32)])
    at = np.flatnonzero(codes)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = codes[at - 1] * np.uint32(0x9E3779B1) + codes[at] * np.uint32(0x85EBCA77) + codes[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h >> np.uint32(32 - bits)).astype(np.int64), np.flatnonzero(codes[at - 1] == 0)


def _stretches(text: str, chars: int) -> Iterator[str]:
    """A long text in stretches that end at a space where there is one."""
    start = 0
    while len(text) - start > chars:
        cut = text.rfind(" ", start, start + chars)
        cut = start + chars if cut <= start else cut
        yield text[start:cut]
        start = cut
    yield text[start:]


def word_likelihoods(text: str, model: Model) -> np.ndarray:
    """(words, languages) log likelihoods; memory beyond the result is that of one stretch."""
    rows = []
    for part in _stretches(text, CHARS_AT_ONCE):
        found, starts = trigrams(part, int(model.table.shape[0]).bit_length() - 1)
        if len(starts):
            rows.append(np.add.reduceat(model.table[found], starts, axis=0))
    return np.concatenate(rows) if rows else np.zeros((0, len(model.languages)), np.float32)


def _em(like: np.ndarray, count: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Settled proportions, and the log likelihood of each document under them. count: words of each document; those that have
    settled are left out of further rounds."""
    share, own, words, n = share.copy(), np.arange(len(share)), like, count
    for _ in range(MOST_ROUNDS):
        part = share[own]
        resp = words * np.repeat(part, n, axis=0)
        resp /= np.maximum(resp.sum(axis=1, keepdims=True), 1e-30)
        share[own] = np.add.reduceat(resp, np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
        open_ = np.abs(share[own] - part).max(axis=1) > SETTLED
        if not open_.all():
            words, own, n = words[np.repeat(open_, n)], own[open_], n[open_]
        if not len(own):
            break
    fit = np.log(np.maximum((like * np.repeat(share, count, axis=0)).sum(axis=1), 1e-30))
    return share, np.add.reduceat(fit.astype(np.float64), np.cumsum(count) - count)


def infer(texts: list[str], model: Model, largest: int | None = None) -> list[tuple[str, float, list[str], list[float]]]:
    """(language, score, language set, proportions) of each text; sets of all sizes are tried, or up to the largest."""
    none = (UNDETERMINED, 0.0, [], [])
    out: list[tuple[str, float, list[str], list[float]]] = [none] * len(texts)
    found = [word_likelihoods(t, model) for t in texts] if model.languages else []
    some = [k for k, x in enumerate(found) if len(x)]
    if not some:
        return out
    logs = np.concatenate([found[k] for k in some])
    size = np.array([len(found[k]) for k in some])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = len(model.languages)
    single = np.add.reduceat(logs.astype(np.float64), starts, axis=0)
    like = np.exp(logs - logs.max(axis=1, keepdims=True))
    share = np.full((len(some), n), 1.0 / n, np.float32)
    share, _ = _em(like, size, share)
    order = np.argsort(-share, axis=1, kind="stable")
    best = single.argmax(axis=1)
    top = np.add.reduceat(logs.max(axis=1).astype(np.float64), starts)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(some)), best] = 1
    penalty = np.log(np.maximum(size, 2))
    cost = -2 * (single.max(axis=1) - top) + penalty
    for k in range(2, min(n if largest is None else largest, n) + 1):
        allowed = np.zeros_like(share)
        np.put_along_axis(allowed, order[:, :k], 1, axis=1)
        part = np.maximum(share, 1e-4) * allowed
        part, fit = _em(like, size, part / part.sum(axis=1, keepdims=True))
        now = -2 * fit + (2 * k - 1) * penalty
        better = now < cost
        chosen[better], cost[better] = part[better], now[better]
    sure = 1 / np.exp(single - single.max(axis=1, keepdims=True)).sum(axis=1)
    for i, k in enumerate(some):
        main = int(chosen[i].argmax())
        held = [j for j in np.argsort(-chosen[i], kind="stable").tolist() if chosen[i, j] > 0]
        alone = len(held) == 1
        out[k] = (model.languages[main], float(min(1.0, chosen[i, main] * (sure[i] if alone else 1.0))), [model.languages[j] for j in held], [float(chosen[i, j]) for j in held])
    return out


def learn(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS_A_LANGUAGE, bits: int = BITS) -> Model:
    """Learn from rows with text and language. To the driver come the languages and at most 2 ** bits counts of each."""
    import pyarrow as pa

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = {r["lang"]: texts / r["count"] for r in rows.groupBy("lang").count().collect()}
    part = F.element_at(F.create_map(*[F.lit(x) for item in parts.items() for x in item]), F.col("lang")) if parts else F.lit(0.0)
    sample = rows.where(share_of_ids("id", part)).select("lang", "text")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for part in _stretches(text, CHARS_AT_ONCE):
                    table += np.bincount(trigrams(part, bits)[0], minlength=1 << bits)
        for lang, table in counts.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "bucket", "n"])

    found = sample.mapInArrow(tidy(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts = np.zeros((1 << bits, len(languages)))
    counts[found["bucket"].to_numpy(int), found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = found["n"].to_numpy(float)
    table = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * (1 << bits)))
    return Model(languages, table.astype(np.float32))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str, str] = ("lang_pred", "score", "languages", "proportions")) -> DataFrame:
    """The columns in keep (all by default) with the predicted language, its score, the language set and its proportions.

    A text that is null or has no letters is `und` with score 0, as is every text if nothing was learned. The score is
    the proportion of the predicted language and, where it stands alone, its posterior. Ties go to the language
    that sorts first. Rows are independent: repeated rows get repeated results, an empty table an empty one.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            lang, score, langs, shares = zip(*infer(texts, shared.value), strict=True)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]

        return work

    kinds = ("string", "double", "array<string>", "array<double>")
    return map_texts(docs, text_col, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), make, keep)
