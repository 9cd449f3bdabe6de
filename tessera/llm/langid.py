"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's letters are lowered (ASCII) and every other ASCII byte becomes a space; byte n-grams of each word, edges included, hash to
rows of an embedding table, whose average feeds a softmax. The class scores of every row are multiplied out once,
so a prediction is one gather and sum over the whole text. The temperature and the rejection threshold are
calibrated on a part of the training sample that the weights never see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows of the training sample at most, in expectation, and characters of each at most, from a hashed place of its text on: a bound on what the driver gets.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 4000
#: Words of the chunks that are learnt from, one of each size from each sampled text.
CHUNKS = (8, 24, 80)
#: Bytes of text that are looked at at once; longer texts are cut at white space and their sums added up.
PART_BYTES = 1 << 20
GRAMS = (2, 3, 4)
BUCKETS, DIM = 1 << 16, 12

_NORMAL = np.full(256, 32, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _NORMAL[_c] = ord(chr(_c).lower()) if _c < 128 else _c


def grams(data: np.ndarray, offsets: np.ndarray):
    """For each n: buckets of the n-grams of the concatenated texts, and the len(offsets) places where the texts begin among them.

    A text is thought to be between spaces; an n-gram has no space but at its ends and isn't blank. Two spaces part texts, so none
    spans them.
    """
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1) * 2
    flat = np.full(int(at[-1]), 32, np.uint8)
    if len(data):
        flat[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = _NORMAL[data]
    letter = flat != 32
    for k in GRAMS:
        m = max(0, len(flat) - k + 1)
        ok = letter[:m] | letter[1 : 1 + m] if k == 2 else np.logical_and.reduce([letter[j : j + m] for j in range(1, k - 1)])
        where = np.flatnonzero(ok)
        h = np.full(len(where), k, np.uint64)
        for j in range(k):
            h = (h ^ flat[where + j]) * np.uint64(0x100000001B3)
        yield ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64) % BUCKETS, np.searchsorted(where, at)


def _by_text(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """All buckets in the order of their texts, and the len(offsets) offsets."""
    every = list(grams(data, offsets))
    of = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(at)) for _, at in every])
    bucket = np.concatenate([b for b, _ in every])[np.argsort(of, kind="stable")]
    return bucket, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(offsets) - 1))])


def cut_texts(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of parts of at most `most` bytes, and the text of each part. Cuts come after bytes that are no letters; only a word longer than that is cut itself."""
    most = PART_BYTES if most is None else most
    if (np.diff(offsets) <= most).all():
        return offsets, np.arange(len(offsets) - 1)
    cuts, of = [], []
    for d, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while z - a > most:
            blank = np.flatnonzero(_NORMAL[data[a : a + most]] == 32)
            cuts.append(a)
            of.append(d)
            a += int(blank[-1]) + 1 if len(blank) else most
        cuts.append(a)
        of.append(d)
    return np.array([*cuts, offsets[-1]], np.int64), np.array(of, np.int64)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, texts x languages; rows of texts without n-grams are NaN."""
        n = len(offsets) - 1
        cuts, of = cut_texts(data, offsets)
        total, sums = np.zeros(n), np.zeros((n, len(self.langs)))
        for i, j in C.pieces(cuts, PART_BYTES):
            o = cuts[i : j + 1]
            for bucket, at in grams(data[o[0] : o[-1]], o - o[0]):
                running = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.scores[bucket], axis=0)])
                np.add.at(sums, of[i:j], running[at[1:]] - running[at[:-1]])
                np.add.at(total, of[i:j], np.diff(at))
        with np.errstate(invalid="ignore", divide="ignore"):
            out = sums / total[:, None] + self.bias
        return softmax(out / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 1.0, seed: int = 7, reject: float = 0.001) -> Model:
    """Trains on chunks of the texts' words, four fifths for the weights and one fifth for temperature and threshold.

    The threshold lets through all but the share `reject` of held-out texts whose language was found, and is 0.5 at most.
    """
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    if not langs:
        raise ValueError("no labelled row to train on")
    chunks, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        w = text.split()
        for size in CHUNKS:
            a = int(rng.integers(0, max(1, len(w) - size + 1)))
            chunks.append(" ".join(w[a : a + size]))
            ys.append(langs.index(label))
    data, offsets = C.text_bytes(pa.array(chunks, pa.large_string()))
    bucket, ends = _by_text(data, offsets)
    counts, ends = np.diff(ends), ends[1:]
    y = np.array(ys)
    held = (np.arange(len(chunks)) // len(CHUNKS)) % 5 == 4 if len(texts) >= 20 else np.zeros(len(chunks), bool)
    E, W, b = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    train = np.flatnonzero(~held & (counts > 0))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
            if not len(batch):
                continue
            index = np.concatenate([bucket[ends[i] - counts[i] : ends[i]] for i in batch])
            first = np.concatenate([[0], np.cumsum(counts[batch])[:-1]])
            x = np.add.reduceat(E[index], first) / counts[batch][:, None]
            g = softmax(x @ W + b)
            g[np.arange(len(batch)), y[batch]] -= 1
            back = (g @ W.T) / counts[batch][:, None]
            W -= step * (x.T @ g) / len(batch) * 4
            b -= step * g.mean(axis=0)
            np.add.at(E, index, -step * 4 * np.repeat(back, counts[batch], axis=0))
    model = Model(langs, E @ W, b, 1.0, 0.0)
    test = held if held.any() else ~held
    ok = np.flatnonzero(test & (counts > 0))
    if len(ok):
        z = np.log(np.maximum(model.predict(data, offsets)[ok], 1e-300))
        loss = {t: -np.mean(np.log(softmax(z / t)[np.arange(len(ok)), y[ok]] + 1e-12)) for t in np.geomspace(0.1, 10, 41)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        right = p.argmax(axis=1) == y[ok]
        if right.any():
            model.threshold = float(min(0.5, np.quantile(p.max(axis=1)[right], reject)))
    return model


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on the rows of docs with a lang whose hashed doc_id is below a threshold: about `rows` of them, the same in every run, of which the driver gets SAMPLE_CHARS characters each.

    Rows that share a doc_id are drawn by their texts, too, so a repeated id can't hold more of the sample than of the table.
    """
    usable = labelled(docs)
    n = usable.count()
    share = 1.0 if n <= rows else rows / n
    picked = usable.filter((F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit("langid")), 11).cast("double") / float(1 << 53)) < share)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    picked = picked.select("doc_id", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("text"), "lang").collect()
    picked.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]))
    return fit([r["text"] for r in picked], [r["lang"] for r in picked])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Predicts the language of every text.

    Returns doc_id, held_out, lang_pred, score (calibrated probability), accepted (score reaches the calibrated threshold
    and lang_pred isn't `und`). Null texts and texts without a letter are `und` with score 0. The prediction depends on the
    text only, so repeated rows agree; null doc_ids are not held out. A table without a labelled row predicts `und` for all.
    """
    C.configure(docs.sparkSession)
    if model is None:
        model = train_or_none(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x languages

    def run(batches):
        for b in batches:
            lang, score, accepted = judge(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def train_or_none(docs: DataFrame) -> Model:
    """The model of train(), or where no row is labelled one that knows no language."""
    try:
        return train(docs)
    except ValueError:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)


def judge(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and acceptance of each text of a column."""
    data, offsets = C.text_bytes(column)
    n = len(column)
    lang, score = np.full(n, "und", object), np.zeros(n)
    if model.langs and n:
        p = model.predict(data, offsets)
        letters = np.array([bool(x) and any(map(str.isalpha, x)) for x in column.to_pylist()])
        p[np.isnan(p)] = 0
        best = p.argmax(axis=1)
        lang = np.where(letters, np.array(model.langs, object)[best], "und")
        score = np.where(letters, np.round(np.clip(p[np.arange(n), best], 0, 1), 9), 0.0)
    return lang, score, (lang != "und") & (score >= model.threshold)


def accepted_rows(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose language identify() accepts; nothing is joined."""
    C.configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train_or_none(docs) if model is None else model)
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(shared.value, b.column(place))[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
