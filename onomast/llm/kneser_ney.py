"""Character n-gram models: counted by Spark over all documents, smoothed in numpy, stored in sorted hash arrays.

One n-gram of ``order`` characters is packed into one integer of
``order * bits`` bits, so that its suffixes (lower orders) and its prefix (the
context) are plain bit operations.  Only the highest order is counted; lower
orders follow from it: for Kneser-Ney they count distinct left neighbours, for
``raw`` models (Witten-Bell) they are the sums of the higher counts.

A model of a class has, for every order k, the log probability of each k-gram
seen (interpolated with all shorter contexts) and the log weight that each
context leaves to the shorter ones, so a lookup is: find the k-gram, otherwise
add the context's weight and go on with k-1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onomast.llm import files
from onomast.llm.shared import new_folder, remove, small_batches
from onomast.llm.vec import SortedHashArray, as_array, code_points, slices, trimmed

BOS = 1
#: A task gives out the distinct n-grams of a class when it holds this many; Spark adds them up.
HELD = 600_000
#: Characters of one text that are handled at a time.
WINDOW = 1 << 20
#: Text bytes scored together: their arrays take some 50 times that, and no time is gained from more.
SCORED = 1 << 18


def bits_of(order: int) -> int:
    return 60 // order


def symbols(cps: np.ndarray, bits: int) -> np.ndarray:
    """Characters as numbers below 2**bits: themselves in the lower half, the others hashed into the upper half."""
    top = 1 << (bits - 1)
    return np.where(cps < top, np.maximum(cps, 3), top + ((cps * np.uint32(2654435769)) >> np.uint32(33 - bits))).astype(np.uint64)


def windows(texts: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, packed n-grams that end at each character, how many of each row): slices of texts, and stretches of long ones."""
    texts = as_array(texts)
    pad = order - 1
    for first, part in slices(texts):
        if len(part) > 1 or (pc.binary_length(part)[0].as_py() or 0) <= WINDOW:
            keys, n = ngram_keys(part, order)
            yield np.arange(first, first + len(part)), keys, n
            continue
        cps, _ = code_points(part)
        for a in range(0, len(cps), WINDOW):
            start = max(0, a - pad)
            own = cps[start : a + WINDOW]
            keys = _keys(own, np.array([len(own)]), order, BOS)[a - start :]
            yield np.array([first]), keys, np.array([len(keys)])


def ngram_keys(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each character of all texts, and how many each text has."""
    cps, offsets = code_points(texts)
    lengths = np.diff(offsets)
    return _keys(cps, lengths, order, BOS), lengths


def _keys(cps: np.ndarray, lengths: np.ndarray, order: int, fill: int) -> np.ndarray:
    bits = bits_of(order)
    pad = order - 1
    padded = np.full(len(cps) + pad * len(lengths), fill, np.uint64)
    at = np.arange(len(cps)) + np.repeat(pad * np.arange(1, len(lengths) + 1), lengths)
    padded[at] = symbols(cps, bits)
    keys = np.zeros(max(0, len(padded) - pad), np.uint64)
    for j in range(order):
        keys |= padded[pad - j : len(padded) - j] << np.uint64(bits * j)
    return keys[at - pad]


def _count(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def count_ngrams(df: DataFrame, text: Column, label: Column, order: int) -> DataFrame:
    """(label string, gram long, n long) over every row whose label and text are not null.

    Each task counts its own rows first, so the shuffle moves one row per
    distinct n-gram and task, however long the texts are.
    """
    rows = df.select(label.cast("string").alias("label"), text.alias("text")).where("label IS NOT NULL AND text IS NOT NULL")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(name: str) -> Iterator[pa.RecordBatch]:
            """Fold what is held of a class, and give it out if that is much."""
            parts = held[name]
            held[name] = [_count(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))] if len(parts) > 1 else parts
            if len(held[name][0][0]) > HELD:
                yield from given(name)

        def given(name: str) -> Iterator[pa.RecordBatch]:
            for k, n in held.pop(name):
                for a in range(0, len(k), 100_000):
                    part = k[a : a + 100_000]
                    yield pa.record_batch({"label": pa.array([name] * len(part)), "gram": pa.array(part.astype(np.int64)), "n": pa.array(n[a : a + 100_000].astype(np.int64))})

        for batch in trimmed(batches):
            labels = batch.column(0).dictionary_encode()
            codes = labels.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(labels.dictionary.to_pylist()):
                for _, keys, _ in windows(batch.column(1).take(pa.array(np.flatnonzero(codes == i))), order):
                    held.setdefault(name, []).append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in held[name]) > 1.5 * HELD:
                        yield from folded(name)
        for name in list(held):
            yield from folded(name)
            if name in held:
                yield from given(name)

    return rows.mapInArrow(counted, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def collect_counts(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """All the counts by label, on the driver: 16 bytes for each distinct n-gram.

    They are written to the shared folder and read file by file, so neither
    the size of results nor a lost executor matters.  Distinct n-grams of
    characters grow far slower than the corpus; none is left out.
    """
    spark = counts.sparkSession
    folder = new_folder(spark, "ngrams")
    with small_batches(spark):
        counts.write.parquet(folder)
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for path, _ in files.sizes(folder, (".parquet",)):
        with files.open_read(path) as f:
            table = pq.read_table(f)
        if not table.num_rows:
            continue
        labels = table.column("label").combine_chunks().dictionary_encode()
        codes = labels.indices.to_numpy(zero_copy_only=False)
        grams, ns = table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.float64)
        for i, name in enumerate(labels.dictionary.to_pylist()):
            held.setdefault(name, []).append((grams[codes == i], ns[codes == i]))
    remove(spark, folder)
    out = {}
    for name in sorted(held):
        grams, ns = (np.concatenate(x) for x in zip(*held.pop(name)))
        order = np.argsort(grams)
        out[name] = (grams[order], ns[order])
    return out


def _discounts(counts: np.ndarray, modified: bool) -> np.ndarray:
    """Discount of counts 1, 2 and 3 or more, from how many n-grams occur once, twice, ..."""
    n1, n2, n3, n4 = (float((counts == i).sum()) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9]) if modified else np.full(3, 0.75)
    y = n1 / (n1 + 2 * n2)
    if not modified:
        return np.full(3, y)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 * y])
    return np.clip(d, [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])


class NgramModel:
    """A character model of one class: ``log_probability(keys)`` of packed n-grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, smoothing: str = "kn"):
        """``smoothing``: "kn" (one discount), "mkn" (modified: three discounts) or "wb" (Witten-Bell on raw counts)."""
        bits = bits_of(order)
        self.order, self.bits = order, np.uint64(bits)
        levels = [(grams.astype(np.uint64), counts.astype(np.float64))]
        for k in range(order - 1, 0, -1):
            keys, n = levels[0]
            levels.insert(0, _count(keys & np.uint64((1 << bits * k) - 1), n if smoothing == "wb" else np.ones(len(n))))
        self.find_gram, self.log_p, self.find_context, self.log_left = [], [], [], []
        self.base = 1.0 / (1 << bits)  # each symbol, seen or not
        shorter = None
        for k, (keys, n) in enumerate(levels, 1):
            context, which = np.unique(keys >> self.bits, return_inverse=True)
            total = np.bincount(which, n, len(context))
            if smoothing == "wb":
                kinds = np.bincount(which, minlength=len(context))
                left = kinds / (total + kinds)
                p = n / (total + kinds)[which]
            else:
                d = _discounts(n, smoothing == "mkn")
                off = d[np.minimum(n, 3).astype(np.int64) - 1]
                left = np.bincount(which, off, len(context)) / total
                p = (n - off) / total[which]
            if shorter is None:
                lower = np.full(len(keys), self.base)
            else:
                lower = np.exp(shorter[1][shorter[0].find(keys & np.uint64((1 << bits * (k - 1)) - 1))])
            log_p = np.log(p + left[which] * lower)
            table, contexts = SortedHashArray(keys), SortedHashArray(context)
            self.find_gram.append(table)
            self.log_p.append(table.arrange(log_p).astype(np.float32))
            self.find_context.append(contexts)
            self.log_left.append(contexts.arrange(np.log(np.maximum(left, 1e-12))).astype(np.float32))
            contexts.forget_order()
            if shorter:
                shorter[0].forget_order()
            shorter = (table, log_p)
        shorter[0].forget_order()

    def log_probability(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Natural log of P(last character | the characters before it, at most ``order`` - 1 of them) for each packed n-gram."""
        out = np.zeros(len(keys))
        todo, at = np.arange(len(keys)), np.asarray(keys, np.uint64)
        for k in range(order or self.order, 0, -1):
            at = at & np.uint64((1 << int(self.bits) * k) - 1)
            row = self.find_gram[k - 1].find(at, arranged=True)
            seen = row >= 0
            out[todo[seen]] += self.log_p[k - 1][row[seen]]
            todo, at = todo[~seen], at[~seen]
            if not len(todo):
                return out
            row = self.find_context[k - 1].find(at >> self.bits, arranged=True)
            known = row >= 0
            out[todo[known]] += self.log_left[k - 1][row[known]]
        out[todo] += np.log(self.base)
        return out


def fit(df: DataFrame, text: Column, label: Column, order: int, smoothing: str) -> dict[str, NgramModel]:
    """A model for each label, from the n-grams of all its rows."""
    counts = collect_counts(count_ngrams(df, text, label, order))
    return {name: NgramModel(k, n, order, smoothing) for name, (k, n) in counts.items()}


def text_scores(texts: pa.Array, models: list[NgramModel], which: np.ndarray | None = None, low: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log probabilities of each text under each model (or under model ``which[row]`` alone), and its characters.

    Distinct n-grams of a slice are looked up once.  With ``low`` as many
    columns again follow: the sums of the log joint probabilities of ``low``
    characters, which is a character's by each order up to that, added up.
    """
    width = len(models) if which is None else 1
    sums, lengths = np.zeros((len(texts), width * (1 + bool(low)))), np.zeros(len(texts), np.int64)
    groups = [(None, np.arange(len(texts)))] if which is None else [(m, np.flatnonzero(which == m)) for m in np.unique(which[which >= 0])]
    for m, rows in groups:
        own = texts if m is None else texts.take(pa.array(rows))
        for first, some in slices(own, SCORED):
            for part, keys, n in windows(some, models[0].order):
                at = rows[first + part]
                lengths[at] += n
                distinct, back = np.unique(keys, return_inverse=True)
                ends = np.cumsum(n)
                if low:
                    short, again = np.unique(distinct & np.uint64((1 << bits_of(models[0].order) * low) - 1), return_inverse=True)
                for j, model in enumerate(models if m is None else [models[m]]):
                    found = [(j, model.log_probability(distinct))] + ([(width + j, sum(model.log_probability(short, k) for k in range(1, low + 1))[again])] if low else [])
                    for column, of_key in found:
                        values = np.concatenate([[0.0], np.cumsum(of_key[back])])
                        sums[at, column] += values[ends] - values[ends - n]
    return sums, lengths
