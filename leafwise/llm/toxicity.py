"""Toxicity behind a noisy channel: restore what leetspeak, spacing and repetition have hidden, then score the words.

A token that the channel may have touched becomes a lattice: each character stands for itself, for the letters it can
imitate, or (separators, repeats) for nothing, each at a price. Viterbi search over the last two letters finds the
reading that is likeliest under a character trigram model of the whole corpus. Tokens that ordinary writing makes as well
(a doubled letter, a hyphen, a digit) count both as they stand and as they are read. Features are words, their beginnings
and their ends that toxic texts use far more, where texts with one context for a word (copies of a text) count once. A
text's evidence is the odds of its most telling feature, by how often it stands in the text against what chance would bring into
a text of that length; how many tokens tell; and how many of all that is. What it comes to is learned by logistic
regression on labelled texts that the features were not learned from, for there a feature is never as pure as where it was found.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import parts_of
from .common import map_texts, share_of_ids, tidy, written


LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SIDE, SETTLE = 64, 64
#: What a character of the channel's output may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
SEPARATORS = ".-_*~'`^,:;/\\#=\u200b\u00ad "
SWAP, DROP, REPEAT, DOUBLE, ODD = 1.5, 0.4, 0.7, 2.5, 14.0
#: About so many labelled texts of each class at most are learned from, those whose hash of the id is small enough.
TEXTS_A_CLASS = {1: 4_000, 0: 8_000}
#: A feature tells if so many toxic texts use it in contexts of their own, and if the lower bound (Wilson's, at so many
#: standard deviations) of its toxic share is so high.
LEAST_CONTEXTS, SURE, LEAST_SHARE = 5, 3.0, 0.3
#: A feature is pure up to this many clean texts a toxic one; pure words are looked for inside runs of single letters.
PURE = 0.02
#: One in so many labelled texts is kept for the regression; its weights are held to what stands for the odds alone, so strongly.
CALIBRATE, PRIOR, RIDGE = 4, (0.0, 1.0, 0.0, 0.0, 0.0), 0.1
BEGINNINGS, ENDS = (4, 5, 6, 7, 8), (5,)
#: Distinct tokens with the feature that a toxic text is taken to hold beyond chance, on average.
EXTRA = 2.0
TOKENS_KEPT = 300_000
THRESHOLD = 0.3

_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
_SWAPS = {c: [(x, _INDEX[x], SWAP) for x in letters] for c, letters in LEET.items()}
# Runs of up to three single characters are ordinary writing: initials, lists, formulas.
_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_SURE = re.compile(r"[^\W\d_][0-9@$!|+(<€£¡§*]+[^\W\d_]|^[0-9@$!|+(<€£¡§]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$|+(<€£¡§]+[.,;:?!\"')]*$|([^\W\d_])\1\1|(?:^|[^\w])[^\W_](?:[.\-_*~'`^,:;/\\#=\u200b\u00ad][^\W_]){3,}|[^\W\d_][\u200b\u00ad*][^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1", re.IGNORECASE)
_PARTED = re.compile(rf"[^\W_][{re.escape(SEPARATORS)}]+[^\W_]".replace(r"[^\W_]", rf"(?:[^\W_]|[{re.escape(''.join(c for c in LEET if not c.isdigit()))}])"))
_LEET = re.compile(f"[{re.escape(''.join(LEET))}]")
#: Digits and separators alone are a number, not a word in disguise.
_NUMBER = re.compile(rf"[\d{re.escape(SEPARATORS)}]*\Z")
_EDGE = re.compile(r"^\W+|\W+$")
_WORDS = re.compile(r"[^\W\d_]+")


_CODE: list[np.ndarray] = []


def _code_table() -> np.ndarray:
    if not _CODE:
        table = np.zeros(0x110000, np.uint8)
        for c, i in _INDEX.items():
            table[ord(c)] = i
            if len(c.upper()) == 1:
                table[ord(c.upper())] = i
        _CODE.append(table)
    return _CODE[0]


def trigram_counts(text: str) -> np.ndarray:
    """Counts of (two before, before, letter or end) in the words of a text; 0 stands for a word's edge."""
    codes = np.concatenate([np.zeros(2, np.uint8), _code_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], np.zeros(1, np.uint8)]).astype(np.int32)
    now, before, prior = codes[2:], codes[1:-1], codes[:-2]
    use = (now > 0) | (before > 0)
    prior = np.where(before > 0, prior, 0)
    return np.bincount(((prior * SIDE + before) * SIDE + now)[use], minlength=SIDE**3)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log likelihood of a letter after two, from all texts; to the driver come at most 64 ** 3 sums."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(SIDE**3, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in parts_of(texts, 1_000_000):
                together = "\n".join(texts[a:b])  # the end of a text ends its last word
                for i in range(0, len(together), 4_000_000):
                    total += trigram_counts(together[i : i + 4_000_000])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    found = docs.select(text_col).mapInArrow(tidy(run), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SIDE**3)
    n[found["gram"].to_numpy(int)] = found["n"].to_numpy(float)
    n = n.reshape(SIDE, SIDE, SIDE)
    n2, n1 = n.sum(axis=0), n.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + SIDE)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


_FLAT: list[tuple[np.ndarray, list[float]]] = []


def _flat(model: np.ndarray) -> list[float]:
    """The model as a list, which Python reads faster; that of the model last used is kept."""
    if not _FLAT or _FLAT[0][0] is not model:
        _FLAT[:] = [(model, model.ravel().tolist())]
    return _FLAT[0][1]


def viterbi(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token. Ties go to the reading that was found first, in the order of the options."""
    flat = _flat(model)
    # A state is the last two letters, as two digits to the base SIDE.
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    settled: list[str] = []
    lower = token.lower()
    for k, c in enumerate(lower):
        options: list[tuple[str, int, float]] = []
        if c in _INDEX:
            options.append((c, _INDEX[c], 0.0))
        elif c.isalpha():
            options.append(("", 0, ODD))
        options += _SWAPS.get(c, ())
        if c in SEPARATORS:
            options.append(("", 0, DROP))
        elif k and c == lower[k - 1]:
            longer = (k > 1 and c == lower[k - 2]) or lower[k + 1 : k + 2] == c
            options.append(("", 0, REPEAT if longer else DOUBLE))
        elif not options or c in LEET:
            options.append(("", 0, ODD))
        new: dict[int, tuple[float, str]] = {}
        for state, (score, so_far) in states.items():
            for letter, i, price in options:
                if i:
                    at = state * SIDE + i
                    key, value = at % SIDE**2, score + flat[at] - price
                else:
                    key, value = state, score - price
                if key not in new or value > new[key][0]:
                    new[key] = (value, so_far + letter)
        states = new
        if k % SETTLE == SETTLE - 1:
            # What all ways have in common is settled; so a long token isn't copied at every step.
            settled.append(os.path.commonprefix([so_far for _, so_far in states.values()]))
            states = {state: (score, so_far[len(settled[-1]) :]) for state, (score, so_far) in states.items()}
    return "".join(settled) + max(states.items(), key=lambda x: x[1][0] + flat[x[0] * SIDE])[1][1]


def touched(token: str) -> bool:
    """Whether the lattice has other readings of a token than its letters: it holds a doubled letter, a separator between
    characters, or a character that can stand for a letter."""
    if token.isalpha():
        lower = token.lower()
        return any(map(eq, lower, lower[1:]))
    return bool((_DOUBLED.search(token) or _PARTED.search(token) or _LEET.search(token) or _SURE.search(token)) and not _NUMBER.match(token))


def _core(token: str) -> str:
    """A token without punctuation at its edges, unless a character there can stand for a letter."""
    return _EDGE.sub("", token) if token[:1] not in LEET and token[-1:] not in LEET else token


def restore_token(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token that the channel may have touched, any other token as it is."""
    return viterbi(_core(token), model) if touched(token) else token


def readings(token: str, model: np.ndarray) -> list[str]:
    """What a token is taken to say, first what counts as its place in the text. A token that may be ordinary writing stands for
    itself and for what the lattice reads, with and without a mark at its edge that may be punctuation."""
    if not touched(token):
        return [token]
    core, bare = _core(token), _EDGE.sub("", token)
    found = [viterbi(core, model)]
    if bare and bare != core:
        found.append(viterbi(bare, model))
    return list(dict.fromkeys(found if _SURE.search(token) else [token, *found]))


def restore(text: str, model: np.ndarray) -> str:
    """A text with its touched tokens and its runs of single characters read anew."""
    text = _SPACED.sub(lambda m: viterbi(m[0], model), text)
    return re.sub(r"\S+", lambda m: restore_token(m[0], model), text)


def features(token: str) -> list[str]:
    """Of the words in a token: the word, its beginnings, its ends."""
    out = []
    for w in _WORDS.findall(token.lower()):
        out.append(w)
        out += [f"{w[:n]}-" for n in BEGINNINGS if len(w) > n]
        out += [f"-{w[-n:]}" for n in ENDS if len(w) > n]
    return out


@dataclass
class Model:
    letters: np.ndarray
    base: float = 0.0
    #: Of each telling feature: the share of toxic texts that use it, its rate among the words of clean texts, whether it is pure.
    told: dict[str, tuple[float, float, bool]] = field(default_factory=dict)
    weights: tuple[float, ...] = PRIOR


class _Tokens(dict):
    """Token -> its telling features; for most tokens none."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        #: How words with a telling feature may begin and end: what does neither tells nothing.
        self.starts = {f.removesuffix("-")[: BEGINNINGS[0]] for f in model.told if f[0] != "-"}
        self.ends = {f[1:] for f in model.told if f[0] == "-"}

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > TOKENS_KEPT:
            self.clear()
        told, starts, ends = self.model.told, self.starts, self.ends
        found = ()
        for said in readings(token, self.model.letters):
            for w in _WORDS.findall(said.lower()):
                if w[: BEGINNINGS[0]] in starts or w[-ENDS[0] :] in ends:
                    found = tuple({*found, *(f for f in features(w) if f in told)})
        self[token] = found
        return found


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.tokens = _Tokens(model)
        #: Whole words to look for inside a run of single characters, which may hold several.
        self.words = [f for f, (_, _, pure) in model.told.items() if len(f) > 3 and "-" not in f and pure]

    def evidence(self, text: str) -> tuple[float, int, int]:
        """Log odds by the most telling feature, tokens that tell, tokens; distinct tokens are counted. Nothing tells: (-inf, 0, tokens)."""
        model, odds = self.model, -math.inf
        tokens = set(text.split())
        hits = [h for h in map(self.tokens.__getitem__, tokens) if h]
        for m in _SPACED.finditer(text):
            run = viterbi(m[0], model.letters)
            hits += [h for h in (self.tokens[run], *(self.tokens[w] for w in self.words if w in run)) if h]
        for feature, k in Counter(f for h in hits for f in h).items():
            use, rate, _ = model.told[feature]
            odds = max(odds, math.log(use) - EXTRA + k * math.log1p(EXTRA / (rate * len(tokens))))
        return odds + math.log(max(1e-9, model.base) / max(1e-9, 1 - model.base)), len(hits), len(tokens)

    def score(self, text: str) -> float:
        odds, hits, tokens = self.evidence(text)
        least = 0.2 * self.model.base
        if not hits:
            return least
        z = float(np.dot(self.model.weights, signals(odds, hits, tokens)))
        return max(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), least)


def signals(odds: float, hits: int, tokens: int) -> tuple[float, ...]:
    """What the regression sees of a text in which something tells."""
    return 1.0, max(-10.0, min(10.0, odds)), float(hits > 1), float(hits > 2), math.log(hits / (tokens + 20.0))


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method, held to the prior by the ridge; the prior if there is nothing to learn from."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (y - p)) - RIDGE * (w - prior))
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, letters: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labels (id, 0 or 1) of docs. Rows without label, id or text teach nothing; an id with both labels counts for both."""
    import pyarrow as pa

    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("toxic_")).distinct()
    totals = {r[0]: r[1] for r in known.groupBy("toxic_").count().collect()}
    if not totals.get(1):
        return Model(letters, 0.0, {})
    part = F.when(F.col("toxic_") == 1, TEXTS_A_CLASS[1] / totals[1]).otherwise(TEXTS_A_CLASS[0] / max(1, totals.get(0, 0)))
    sample = known.where(share_of_ids("id_", part))
    kept = F.pmod(F.xxhash64("id_", F.lit("regression")), F.lit(CALIBRATE)) == 0
    chosen = docs.join(F.broadcast(sample), F.col(id_col) == F.col("id_")).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col("toxic_").alias("toxic"), kept.alias("kept"))
    chosen = written(chosen, "tox-sample")
    rows = chosen.where("NOT kept").select("text", "toxic")
    shared = spark.sparkContext.broadcast(letters)

    def run(batches):
        import zlib

        model = shared.value
        #: Token -> the words that stand in the text, and other words it may say.
        read: dict[str, tuple[list[str], list[str]]] = {}
        for batch in batches:
            found: list[tuple[str, int, int]] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = _SPACED.sub(lambda m: viterbi(m[0], model), text or "")
                words: list[str] = []
                placed: list[tuple[str, int, int]] = []
                for t in text.split():
                    if t not in read:
                        if len(read) > TOKENS_KEPT:
                            read.clear()
                        first, *others = [_WORDS.findall(said.lower()) for said in readings(t, model)]
                        read[t] = first, [w for w in dict.fromkeys(w for other in others for w in other) if w not in first]
                    stand, more = read[t]
                    at = len(words)
                    words += stand
                    placed += [(w, at + i, at + i + 1) for i, w in enumerate(stand)]
                    placed += [(w, at, len(words)) for w in more]
                around, least = ["", *words, ""], {}
                for w, i, j in placed:
                    context = zlib.crc32(f"{around[i]} {around[j + 1]}".encode()) & 0x7FFFFFFF
                    if context < least.get(w, 1 << 31):
                        least[w] = context
                found += [(w, context, toxic) for w, context in least.items()]
            if found:
                a, b, c = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], names=["word", "around", "toxic"])

    uses = rows.mapInArrow(tidy(run), "word string, around int, toxic int").groupBy("word", "around").agg(F.max("toxic").alias("toxic"))
    words = written(uses.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "tox-words")
    w = F.col("word")
    edges = [F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("-"))) for n in BEGINNINGS] + [F.when(F.length(w) > n, F.concat(F.lit("-"), F.expr(f"right(word, {n})"))) for n in ENDS]
    exploded = words.select("word", F.explode(F.array_compact(F.array(w, *edges))).alias("feature"), "bad", "good")
    weight = max(1.0, totals.get(0, 0) / TEXTS_A_CLASS[0]) / max(1.0, totals[1] / TEXTS_A_CLASS[1])
    base = totals[1] / sum(totals.values())
    n = F.col("bad") + F.col("good") * F.lit(weight)
    p = F.col("bad") / n
    bound = (p + SURE**2 / (2 * n) - SURE * F.sqrt(p * (1 - p) / n + SURE**2 / (4 * n * n))) / (1 + SURE**2 / n)

    pure_ = F.col("good") * F.lit(weight) <= PURE * F.col("bad")

    def telling(rows: DataFrame, more: Column) -> DataFrame:
        """All of them: their number is bounded by the words of the sample's toxic texts."""
        summed = rows.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        return summed.where(F.col("bad") >= LEAST_CONTEXTS).where(bound >= LEAST_SHARE).where(more).withColumn("pure", pure_)

    # First what hardly any clean text uses; what else tells must do so by words that hold none of that.
    pure = written(telling(exploded, pure_), "tox-pure")
    covered = exploded.join(pure.select("feature"), "feature", "left_semi").select("word").distinct()
    best = pure.unionByName(telling(exploded.join(covered, "word", "left_anti"), F.lit(True)))
    toxic = max(1.0, min(totals[1], TEXTS_A_CLASS[1]) * (CALIBRATE - 1) / CALIBRATE)
    words_read = words.agg(F.sum("good")).first()[0] or 1
    model = Model(letters, base, {r["feature"]: (min(1.0, r["bad"] / toxic), (r["good"] + 0.1) / words_read, r["pure"]) for r in best.collect()})
    if not model.told:
        return model
    first = spark.sparkContext.broadcast(model)

    def weigh(batches):
        scorer = Scorer(first.value)
        for batch in batches:
            seen = [(*scorer.evidence(text), toxic_) for text, toxic_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            # Copies of a text tell once, as they do among the features.
            told = [x for x in set(seen) if x[1]]
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.float64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["odds", "hits", "tokens", "toxic"])

    seen = chosen.where("kept").select("text", "toxic").mapInArrow(tidy(weigh), "odds double, hits long, tokens long, toxic int").distinct().orderBy("odds", "hits", "tokens", "toxic").collect()
    if seen:
        x, y = np.array([signals(r["odds"], r["hits"], r["tokens"]) for r in seen]), np.array([r["toxic"] for r in seen], float)
        model.weights = regression(x, y, np.where(y > 0, 1.0, weight))
    return model


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns in keep (all by default) with score and prediction. A null text is read as an empty one, which
    gets the base score. Rows are independent: repeated rows get repeated results, an empty table an empty one."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def work(texts: list[str]) -> list[pa.Array]:
            scores = [scorer.score(t) for t in texts]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]

        return work

    return map_texts(docs, text_col, f"{names[0]} double, {names[1]} int", make, keep)
