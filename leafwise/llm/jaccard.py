"""N-gram Jaccard join by parity sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets of Jaccard measure J or more differ in at
most D(n) = floor(n (1 - J) / J) elements, n the size of the smaller one.

Parity sketches. Within a band of sizes, every element toggles one bit of one of k pieces, so each differing element
changes at most one piece: the number of bits (and of pieces) that differ is a lower bound of the symmetric difference. Pieces are as
wide as the hash, so a piece is kept as the XOR of its elements' hashes, its key. As k > D(n), two linked sets share pieces
(pigeonhole). With k = D + 1 + t pieces at least t + 1 are shared, so each set may leave out its t commonest
pieces, by any order that depends on content alone: here the rarest element's count in a count sketch
of the whole corpus, so text that many documents share drops out first. A set is filed in its own band and, where a
partner may be in the next one, there too. A second, small parity sketch per set tests candidates by Hamming distance.

Equal sets are one node. Round one compares, in each group of sets that share a piece, the least node with all others:
as many candidates as rows. The links found give components. In groups that then still hold several components
all pairs across components are tested, in tiles of bounded size, by Hamming distance inside the task; only
those that pass leave it. Candidates are verified exactly on whole texts, one centre against a stream of others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import parts_of
from .common import WORD, forget, tidy, unused, written

#: Counters of the count sketch, as powers of 2: so few and so many, and between them one for so many characters.
FEWEST, MOST, CHARS_A_COUNTER, CHUNK = 20, 24, 768, 1 << 16
NODES_KEPT = 500_000
CHARS_AT_ONCE, BYTES_AT_ONCE = 1_000_000, 4 << 20
TILE = 2_048
#: Tasks whose counters are added in one bundle, bundles in a larger one, and so on, so many times.
FAN, LEVELS = 16, 3
#: Candidates of a centre that one task verifies.
SPREAD = 64
PLACE = ["id", "missing", "text_mark"]
#: Rounds with a middle node for centre, after the first and before all pairs across components.
STARS = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ORDER = _mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_POWERS = [np.cumprod(np.full(64, 0xF1357AEA2E62A9C5, np.uint64))]


def _hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, by its bytes and their places, and where it starts."""
    text = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[text], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, length = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    while length.max() > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(max(int(length.max()), 2 * len(_POWERS[0])), 0xF1357AEA2E62A9C5, np.uint64))
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = _BYTE[text[inside[1:-1]]] * _POWERS[0][place]
    return _mixed(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    n = len(words) - size + 1
    total = words[:n] * _ORDER[0]
    for i in range(1, size):
        total = total + words[i : n + i] * _ORDER[i]
    return _mixed(total + np.uint64(size))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles, A-Z lower-cased; a text of fewer words is one
    shingle, one without words has none. Texts are hashed together, a very long one in stretches that end at spaces."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    raws = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    for a, b in parts_of(raws, BYTES_AT_ONCE):
        if b - a == 1 and len(raws[a]) > BYTES_AT_ONCE:
            raw, at, found = raws[a], 0, []
            while at < len(raw):
                cut = at + BYTES_AT_ONCE
                while cut < len(raw) and not _SPACE[raw[cut]]:
                    cut += 1
                found.append(_hashed_words(raw[at:cut])[0])
                at = cut
            words, count = np.concatenate(found), np.array([sum(map(len, found))])
        else:
            words, starts = _hashed_words(b" ".join(raws[a:b]))
            ends = np.cumsum([len(r) + 1 for r in raws[a:b]])
            count = np.diff(np.searchsorted(starts, ends), prepend=0)
        whole = _shingles(words, width) if len(words) >= width else np.zeros(0, np.uint64)
        at = 0
        for k, n in enumerate(count.tolist()):
            if n >= width:
                out[a + k] = _distinct(whole[at : at + n - width + 1])
            elif n:
                out[a + k] = _shingles(words[at : at + n], n)
            at += n
    return out


def node_of(found: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """The id of a set, and a second number that tells whether two sets share an id: a hash of its elements."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(found.tobytes(), seed)
    return tuple(np.array([value & 0xFFFFFFFFFFFFFFFF, value >> 64], np.uint64).astype(np.int64).tolist())


def counters_for(chars: int) -> int:
    """The number of counters for a corpus of so many characters."""
    return 1 << min(MOST, max(FEWEST, (chars // CHARS_A_COUNTER).bit_length()))


def band(n: int) -> int:
    return int(n).bit_length()


def sketch(found: np.ndarray) -> bytes:
    """The small parity sketch; its size depends on the band, and a larger one folds to a smaller."""
    bits = max(64, 4 << band(len(found)))
    parity = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    """A sketch as bytes, folded to a size by XOR of halves."""
    out = np.frombuffer(raw, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


class Measure:
    """J >= part / whole, in whole numbers."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def apart(self, n: int) -> int:
        """The most elements by which a set of n elements and one at least as large may differ."""
        return n * (self.whole - self.part) // self.part

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most elements by which sets of these sizes may differ."""
        return (a + b) * (self.whole - self.part) // (self.whole + self.part)

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.whole * both >= self.part * (a + b - both)


def pieces(sets: list[np.ndarray], counts: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """(index of set, key) of the pieces under which each set is filed. Sets that only an equal one can be linked with have none."""
    who, bands, hashes, piece_of, keep, width = [], [], [], [], [], []
    for i, found in enumerate(sets):
        n = len(found)
        if not measure.apart(n):
            continue
        for b in range(band(n), band(n * measure.whole // measure.part) + 1):
            k = 3 * (measure.apart((1 << b) - 1) + 1) // 2
            who.append(i)
            bands.append(b)
            width.append(k)
            keep.append(measure.apart(n) + 1)
            hashes.append(found)
            piece_of.append((((found >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(x) for x in hashes])
    entry = np.repeat(np.arange(len(who)), size)
    value = np.concatenate(hashes)
    place = np.concatenate(piece_of)
    order = np.argsort(entry.astype(np.int64) << 32 | place, kind="stable")
    entry, place, value = entry[order], place[order], value[order]
    starts = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (place[1:] != place[:-1])]))
    seen = counts[(value >> np.uint64(20)).astype(np.int64) & (len(counts) - 1)]
    rare = np.minimum.reduceat(seen, starts)
    key = np.bitwise_xor.reduceat(value, starts)
    entry, place = entry[starts], place[starts]
    key = _mixed(key + _mixed(place.astype(np.uint64) * np.uint64(64) + np.array(bands, np.uint64)[entry]))
    # Empty pieces are the commonest of all; a set files some only if it has not enough others.
    some = np.bincount(entry, minlength=len(who))
    entries, keys, rares = [entry], [key], [rare.astype(np.int64)]
    ends = np.cumsum(some)
    for e in np.flatnonzero(some < np.array(keep)).tolist():
        empty = np.setdiff1d(np.arange(width[e]), place[ends[e] - some[e] : ends[e]])
        more = np.sort(_mixed(_mixed(empty.astype(np.uint64) * np.uint64(64) + np.uint64(bands[e]))))[: keep[e] - some[e]]
        entries.append(np.full(len(more), e))
        keys.append(more)
        rares.append(np.full(len(more), 1 << 40))
    entry, key, rare = np.concatenate(entries), np.concatenate(keys), np.concatenate(rares)
    order = np.lexsort((key, rare, entry))
    entry, key = entry[order], key[order]
    first = np.searchsorted(entry, np.arange(len(who)))
    kept = np.arange(len(entry)) - first[entry] < np.array(keep)[entry]
    return np.array(who)[entry[kept]], key[kept].astype(np.int64)


def _prepared(docs: DataFrame, width: int, counters: int, seed: int) -> DataFrame:
    """doc_id, mark (of the text), n, node (id of the set), check, sketch of each document; and in rows of their own the counts of all elements, in chunks,
    with the number of a bundle of tasks for mark."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["doc_id", "mark", "n", "node", "check", "sketch", "chunk", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        counts, any_ = np.zeros(counters, np.uint32), False
        for batch in batches:
            ids, marks, texts = (batch.column(c).to_pylist() for c in range(3))
            for a, b in parts_of([t or "" for t in texts], CHARS_AT_ONCE):
                sets = shingle_sets(texts[a:b], width)
                every = np.concatenate(sets)
                any_ = any_ or len(every) > 0
                np.add.at(counts, (every >> np.uint64(20)).astype(np.int64) & (counters - 1), np.uint32(1))
                rows = [(doc_id, mark, len(x), *(node_of(x, seed) if len(x) else (None, None)), sketch(x) if len(x) else None, None, None) for doc_id, mark, x in zip(ids[a:b], marks[a:b], sets, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if any_:
            for i in range(counters // CHUNK):
                row = (None, TaskContext.get().partitionId() // FAN, None, None, None, None, i, counts[i * CHUNK : (i + 1) * CHUNK].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=names)

    return docs.select("doc_id", "mark", "text").mapInArrow(tidy(run), "doc_id long, mark long, n long, node long, check long, sketch binary, chunk int, counts binary")


def _total_counts(chunks: DataFrame, counters: int) -> np.ndarray:
    """The counters summed over all tasks, first in bundles: 4 to 64 MB."""
    import pandas as pd

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint64)
        for raw in pdf["counts"]:
            total += np.frombuffer(raw, np.uint32)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "mark": [pdf["mark"].iloc[0]], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    out = np.zeros(counters, np.uint32)
    kind = "chunk int, mark long, counts binary"
    for _ in range(LEVELS):
        chunks = chunks.groupBy("chunk", "mark").applyInPandas(add, kind).withColumn("mark", F.floor(F.col("mark") / FAN))
    for row in chunks.groupBy("chunk").applyInPandas(add, kind).collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint32)
    return out


def _filed(docs: DataFrame, counts: np.ndarray, width: int, measure: Measure, seed: int) -> DataFrame:
    """(key, node): the pieces of each set, once for each task that meets it."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in parts_of(texts, CHARS_AT_ONCE):
                new = {node: x for x in shingle_sets(texts[a:b], width) if len(x) and (node := node_of(x, seed)[0]) not in met}
                met.update(new)
                if len(met) > NODES_KEPT:
                    met.clear()
                if new:
                    who, key = pieces(list(new.values()), shared.value, measure)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(list(new), np.int64)[who])], names=["key", "node"])

    return docs.select("text").mapInArrow(tidy(run), "key long, node long")


def _tested(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Those of the pairs (a, b) whose sketches allow a link."""
    import pyarrow as pa

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    sized = pairs.join(one, "a").join(two, "b").where(F.least("a_n", "b_n") * measure.whole >= F.greatest("a_n", "b_n") * measure.part)

    def run(batches):
        for batch in batches:
            a_n, b_n = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            keep = np.zeros(len(a_n), bool)
            most = measure.most(a_n, b_n)
            for i, (x, y) in enumerate(zip(batch.column("a_sketch").to_pylist(), batch.column("b_sketch").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return sized.mapInArrow(tidy(run), "a long, b long")


def _place(doc_id: str, mark: str) -> list[Column]:
    """PLACE, the key of a text by its id and hash, with no nulls in it."""
    return [F.coalesce(F.col(doc_id), F.lit(0)).alias("id"), F.col(doc_id).isNull().alias("missing"), F.col(mark).alias("text_mark")]


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, measure: Measure) -> DataFrame:
    """Those of the pairs (a, b) that are linked, by their whole texts. docs: (doc_id, mark, text), no id and mark twice."""
    import pyarrow as pa

    pairs = written(pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD))), "jaccard-candidates")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    others = pairs.select("a", "part", "b", F.col("b").alias("node"))
    centres = pairs.select("a", "part").distinct().select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    wanted = centres.unionByName(others).join(nodes.select("node", *_place("any.doc_id", "any.mark")), "node").drop("node")
    # The only columns that travel beside the texts: each text goes to its own place once, and from there to its centres.
    dealt = docs.select(*_place("doc_id", "mark"), "text").join(wanted.hint("shuffle_hash"), PLACE).select("a", "part", "b", "text")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            a_s, b_s, texts = (batch.column(c).to_pylist() for c in ("a", "b", "text"))
            found_sets = (x for i, j in parts_of(texts, CHARS_AT_ONCE) for x in shingle_sets(texts[i:j], width))
            for a, b, found in zip(a_s, b_s, found_sets, strict=True):
                if b is None:
                    centre, own = a, found
                    continue
                if centre != a:
                    raise ValueError("a candidate came without its centre")
                both = int((np.searchsorted(own, found, "right") - np.searchsorted(own, found, "left")).sum())
                if measure.linked(both, len(own), len(found)):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    links = written(dealt.mapInArrow(tidy(run), "a long, b long"), "jaccard-links")
    forget(pairs)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node that a node of the edges (a, b) reaches. Least-neighbour labels with
    shortcuts; each round is written, rounds grow with the logarithm of the longest path."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "jaccard-edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "jaccard-labels")
    last = labels
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "near").alias("new"))
        # What a label's own node has been told, the nodes under that label are told too.
        told = step.groupBy("label").agg(F.min("new").alias("told"))
        step = step.join(told.withColumnRenamed("label", "label_"), F.col("label") == F.col("label_")).select("node", "label", F.least("new", "told").alias("new"))
        jump = step.select(F.col("node").alias("at"), F.col("new").alias("jump"))
        step = step.join(jump, F.col("new") == F.col("at"), "left").select("node", "label", F.least("new", "jump").alias("new"))
        step = written(step, "jaccard-labels")
        forget(last)
        last, labels = step, step.select("node", F.col("new").alias("label"))
        if step.where("label <> new").isEmpty():
            forget(both)
            return labels


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label): the groups that hold more than one component."""
    labelled = shared.select("key", "node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return labelled.join(mixed, "key", "left_semi")


def _across(rest: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (a, b) of different components in one group whose sketches allow a link. rest: (key, node, label).

    A group is cut into tiles, and each pair of tiles is one task's input; a pair stays in the task unless it passes.
    """
    import pyarrow as pa

    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("m")).withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    rows = rest.join(sizes, "key").join(nodes.select("node", "n", "sketch"), "node")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    rows = rows.withColumn("tile", tile)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "label", "n", "sketch")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node")

    def found(block: list[tuple]) -> list[tuple[int, int]]:
        out = []
        i, j = block[0][1], block[0][2]
        tile = np.array([r[3] for r in block])
        node, label, n = (np.array([r[c] for r in block], np.int64) for c in (4, 5, 6))
        raw = [r[7] for r in block]
        for x in range(len(block) - 1):
            end = np.searchsorted(n, n[x] * measure.whole // measure.part, "right")
            at = np.arange(x + 1, end)
            at = at[(label[at] != label[x]) & ((tile[at] != tile[x]) if i != j else True)]
            if not len(at):
                continue
            size = len(raw[x])
            own, others = fold(raw[x], size), np.stack([fold(raw[y], size) for y in at])
            close = np.bitwise_count(others ^ own).sum(axis=1, dtype=np.int64) <= measure.most(n[x], n[at])
            out += [(min(int(node[x]), int(node[y])), max(int(node[x]), int(node[y]))) for y in at[close]]
        return out

    def run(batches):
        block: list[tuple] = []
        told: set[tuple[int, int]] = set()

        def once(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
            new = {x for x in links if x not in told}
            if len(told) > NODES_KEPT // 4:
                told.clear()
            told.update(new)
            return sorted(new)

        for batch in batches:
            links = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if block and row[:3] != block[0][:3]:
                    links += found(block)
                    block = []
                block.append(row)
            if links := once(links):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])
        if block and (links := once(found(block))):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def classes(docs: DataFrame, *, width: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, mark, label: one row per row of docs; documents whose shingle sets have a Jaccard measure of
    part / whole or more are linked, component_id is the smallest id that links reach. mark is a hash of the text, label
    names the component where ids repeat; it is null for an empty set.

    A text that is null or has no words has an empty set and is linked with nothing. Rows that repeat an id or a text
    are nodes with equal sets. Rows without an id have the component of their text. Ids are integers.
    """
    measure = Measure(part, whole)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    counters = counters_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    for seed in itertools.count():
        prepared = written(_prepared(docs, width, counters, seed), "jaccard-sets")
        slim = prepared.where("chunk IS NULL").select("doc_id", "mark", "n", "node", "check", "sketch")
        nodes = written(slim.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "mark")).alias("any"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("check").alias("low"), F.max("check").alias("high")), "jaccard-nodes")
        # Two sets with one id, which 64 bits don't rule out at any size, are hashed anew.
        if nodes.where("low <> high").isEmpty():
            break
    counts = _total_counts(prepared.where("chunk IS NOT NULL").select("chunk", "mark", "counts"), counters)
    filed = _filed(docs, counts, width, measure, seed)
    # Rows that repeat id and text would each come with every candidate of their node.
    single = docs if slim.groupBy("doc_id", "mark").count().where("count > 1").isEmpty() else docs.dropDuplicates(["doc_id", "mark"])
    group = Window.partitionBy("key")
    centred = filed.withColumn("centre", F.min("node").over(group)).withColumn("last", F.max("node").over(group))
    shared = written(centred.where("centre <> last").select("key", "node", "centre"), "jaccard-groups")
    star = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tried = star = written(star, "jaccard-star")
    links = _verified(_tested(star, nodes, measure), nodes, single, width, measure)
    labels = written(components(links), "jaccard-labels")
    for _ in range(STARS):
        rest = written(_unsettled(shared, labels), "jaccard-rest")
        # The node that most of these groups hold is the likeliest middle of its kin.
        known = rest.groupBy("node").agg(F.count(F.lit(1)).alias("groups"))
        ranked = rest.join(known, "node").withColumn("rank", F.struct("groups", "node"))
        middle = ranked.groupBy("key").agg(F.max(F.struct("rank", "label")).alias("m")).select("key", F.col("m.rank.node").alias("a"), F.col("m.label").alias("a_label"))
        star = rest.join(middle, "key").where("label <> a_label").select("a", F.col("node").alias("b")).distinct()
        star = written(_tested(star, nodes, measure).join(tried, ["a", "b"], "left_anti"), "jaccard-star")
        forget(rest)
        more = _verified(star, nodes, single, width, measure)
        tried = tried.union(star)
        if more.isEmpty():
            break
        links = links.union(more)
        labels = written(components(links), "jaccard-labels")
    across = _across(_unsettled(shared, labels), nodes, measure).distinct()
    both = tried.union(tried.select("b", "a"))
    more = _verified(across.join(both, ["a", "b"], "left_anti"), nodes, single, width, measure)
    labels = written(components(links.union(more)), "jaccard-labels") if not more.isEmpty() else labels
    best = labels.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("least"))
    reach = labels.join(best, "label").select("node", "least", "label")
    known = nodes.select("node", "doc_id").join(reach, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component"), F.coalesce("label", "node").alias("label"))
    rows = slim.select("doc_id", "mark", F.col("n").alias("n_shingles"), "node").join(known, "node", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "mark", "label")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay when one document of each class stays: the one with the smallest id (a null id is the
    smallest), of equal ids that with the smallest hash, of equal rows one. Texts without words all stay."""
    found = written(classes(docs, id_col=id_col, text_col=text_col, **options), "jaccard-classes")
    best = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.*")
    stay = best.unionByName(found.where("label IS NULL").select("doc_id", "mark")).distinct()
    own, mark, nth = unused(docs, "stay_id", "stay_mark", "stay_nth")
    stay = stay.select(F.col("doc_id").alias(own), F.col("mark").alias(mark))
    same = docs[id_col].cast("long").eqNullSafe(stay[own]) & F.xxhash64(docs[text_col]).eqNullSafe(stay[mark])
    kept = docs.join(stay.hint("shuffle_hash"), same)
    rows, names = found.where("label IS NOT NULL").agg(F.count(F.lit(1)), F.countDistinct(F.struct("doc_id", "mark"))).first()
    if rows > names:
        worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
        order = Window.partitionBy(own, mark).orderBy(*[c for c in docs.columns if c != text_col])
        kept = kept.withColumn(nth, F.row_number().over(order)).where((F.col(nth) == 1) | ~worded)
    return kept.select(*[docs[c] for c in docs.columns])


#: All pairs that share a shingle, for tables of some thousand documents.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS a_n, b.n AS b_n, count(*) AS both_n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * both_n >= 85 * (a_n + b_n - both_n)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.node = s.doc_id
"""
