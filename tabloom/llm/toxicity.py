"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import boxed, small_batches, tidied, words, written

#: Buckets that words and their beginnings are hashed to; rows of the embedding at most, its width; filter widths, and filters of each.
BUCKETS, ROWS, DIM, WIDTHS, FILTERS = 1 << 24, 1 << 17, 12, (1, 2, 3), 12
#: Lengths in bytes of the beginnings that stand beside a longer word, and the documents of the sample that a bucket needs.
PREFIXES, LEAST_DOCS = (4, 5, 6, 7, 8, 9), 5
#: At most so many labelled documents of each class are fitted, and so many characters of text in all.
SAMPLE, SAMPLE_CHARS, TEXTS = (1500, 3000), 32 << 20, 2
#: Steps of a logit by which scores are counted for the calibration.
STEPS = 1024
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 32, 0.01, 1e-4, 7
#: Words that a worker remembers the rows of.
REMEMBERED = 150_000
THRESHOLD = 0.3
UNITS = len(PREFIXES) + 1


def buckets(word: bytes) -> list[int]:
    """The bucket of a word, and those of its beginnings."""
    return [zlib.crc32(word) % BUCKETS] + [zlib.crc32(b"<" + word[:k]) % BUCKETS for k in PREFIXES if len(word) > k]


class Hasher:
    """Numbers the words of a block and gives each its rows of the embedding; row 0 is padding and all unknown buckets."""

    def __init__(self, rows: dict[int, int]):
        self.rows, self.known = rows, {}

    def units(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = [self.rows.get(b, 0) for b in buckets(word)]
            self.known[word] = found = tuple(found + [0] * (UNITS - len(found)))
        return found


def pack(texts: list[str | None], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of each distinct word (the first is padding); all words by number, each text followed by padding for the
    widest filter; where each text begins, and its words. An empty text is one padding word."""
    number: dict[bytes, int] = {b"": 0}
    pad, flat, begin, size = [0] * (max(WIDTHS) - 1), [], [], []
    for text in texts:
        ids = [number.setdefault(w, len(number)) for w in words(text)] or [0]
        begin.append(len(flat))
        size.append(len(ids))
        flat += ids + pad
    units = np.array([(0,) * UNITS, *(hasher.units(w) for w in list(number)[1:])], np.int64)
    return units, np.array(flat, np.int64), np.array(begin, np.int64), np.array(size, np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    rows: dict[int, int]  # bucket: row of the embedding
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # Platt
    thresholds: dict[str, float] = field(default_factory=dict)
    fitted: list = field(default_factory=list)  # the rows that the weights come from; `train` puts their ids here

    @staticmethod
    def start(rows: dict[int, int], seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (len(rows) + 1, DIM)).astype(np.float32)
        table[0] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return Model(rows, table, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, n).astype(np.float32), np.zeros(1, np.float32))

    def pooled(self, units: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, where: bool = False):
        """Each filter's largest response in each text (rectified), and, if asked, the responses and their places.

        Distinct words are embedded and multiplied with the filters once; a convolution is then a sum of table rows."""
        table = self.embedding[units[:, 0]]
        for k in range(1, units.shape[1]):
            table = table + self.embedding[units[:, k]]
        cuts = np.stack([begin, begin + size], 1).ravel()  # every second piece is padding
        n = len(flat) - max(WIDTHS) + 1
        best, at = [], []
        for weights, bias in zip(self.filters, self.bias, strict=True):
            conv = (table @ weights[0])[flat[:n]]
            for k in range(1, len(weights)):
                conv += (table @ weights[k])[flat[k : n + k]]
            top = np.maximum.reduceat(conv, np.minimum(cuts, n - 1), axis=0)[::2]
            if where:
                doc = np.repeat(np.arange(len(begin)), size + max(WIDTHS) - 1)[:n]
                inside = np.arange(n) < begin[doc] + size[doc]
                r, c = np.nonzero((conv == top[doc]) & inside[:, None])
                place = np.zeros((len(begin), conv.shape[1]), np.int64)
                place[doc[r[::-1]], c[::-1]] = r[::-1]
                at.append(place)
            best.append(top + bias)
        raw = np.concatenate(best, 1)
        return (np.maximum(raw, 0), raw, at, table) if where else np.maximum(raw, 0)

    def logits(self, packed: tuple) -> np.ndarray:
        return (self.pooled(*packed) @ self.out + self.out_bias[0]).astype(np.float64)

    def score(self, packed: tuple) -> np.ndarray:
        return sigmoid(self.scale[0] * self.logits(packed) + self.scale[1])


def fit(texts: list[str | None], labels: np.ndarray, langs: list[str | None], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Fits on whole texts with Adam, then calibrates on a fifth that was kept apart: Platt's scale for the score, and
    for each language the threshold of the best F1 there (the common one where a language has fewer than 20 rows or
    one class only). `fitted` has the rows outside that fifth."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    if len(texts) == 0 or y.min() == y.max():
        model = Model.start({}, seed)
        model.out[:] = 0
        model.scale = (0.0, -30.0)
        return model
    order = rng.permutation(len(y))
    apart, train = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(apart) or y[apart].min() == y[apart].max() or y[train].min() == y[train].max():
        apart = train = order
    seen: Counter[int] = Counter()
    for i in train:
        seen.update({b for w in set(words(texts[i])) for b in buckets(w)})
    least = min(LEAST_DOCS, max(1, len(train) // 20))
    kept = [b for b, c in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if c >= least][:ROWS]
    model = Model.start({b: i + 1 for i, b in enumerate(kept)}, seed)
    hasher = Hasher(model.rows)
    params = [model.embedding, *model.filters, *model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n, step, weight = len(WIDTHS), 0, np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for epoch in range(epochs):
        rng.shuffle(train)
        rate = RATE * (1 - epoch / epochs)
        for i in range(0, len(train), BATCH):
            rows = train[i : i + BATCH]
            units, flat, begin, size = packed = pack([texts[j] for j in rows], hasher)
            act, raw, at, table = model.pooled(*packed, where=True)
            error = ((sigmoid(act @ model.out + model.out_bias[0]) - y[rows]) * weight[rows]).astype(np.float32) / len(rows)
            grads = [None, *(np.zeros_like(f) for f in model.filters), *(np.zeros_like(b) for b in model.bias), act.T @ error, error.sum(keepdims=True)]
            back = error[:, None] * model.out * (raw > 0)
            used, which = np.unique(units, return_inverse=True)
            which = which.reshape(units.shape)
            moved = np.zeros((len(used), DIM), np.float32)
            for w, width in enumerate(WIDTHS):
                part = back[:, w * FILTERS : (w + 1) * FILTERS]
                grads[1 + n + w] = part.sum(0)
                for k in range(width):
                    word = flat[at[w] + k]  # (texts, FILTERS)
                    grads[1 + w][k] = np.einsum("bf,bfd->df", part, table[word])
                    pull = part[:, :, None] * model.filters[w][k].T[None]
                    for u in range(units.shape[1]):
                        np.add.at(moved, which[word, u], pull)
            step += 1
            grow = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(params, [moved, *grads[1:]], first, second, strict=True):
                spot = used if p is model.embedding else slice(None)
                g = g + DECAY * p[spot]
                m[spot] = 0.9 * m[spot] + 0.1 * g
                v[spot] = 0.999 * v[spot] + 0.001 * g * g
                p[spot] -= rate * grow * m[spot] / (np.sqrt(v[spot]) + 1e-8)
            model.embedding[0] = 0
    logit = np.concatenate([model.logits(pack([texts[j] for j in apart[i : i + 64]], hasher)) for i in range(0, len(apart), 64)])
    _set_scale(model, logit, y[apart], np.array([langs[i] or "" for i in apart]), np.ones(len(apart)))
    model.fitted = sorted(train.tolist())
    return model


def _set_scale(model: Model, logit: np.ndarray, y: np.ndarray, langs: np.ndarray, n: np.ndarray, share: tuple[float, float] = (1.0, 1.0)) -> None:
    """Platt's scale and the thresholds from logits that stand for n rows each, which weigh share[class] each."""

    def merged(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each, which = np.unique(np.stack([logit[of], y[of]], 1), axis=0, return_inverse=True)
        return each[:, 0], each[:, 1], np.bincount(which.ravel(), n[of]) * np.where(each[:, 1] > 0, share[1], share[0])

    def threshold(of: np.ndarray) -> float:
        x, of_class, weight = merged(of)
        return best_threshold(sigmoid(model.scale[0] * x + model.scale[1]), of_class, weight)

    model.scale = platt(*merged(np.ones(len(y), bool)))
    model.thresholds = {"": threshold(np.ones(len(y), bool))}
    for lang in sorted(set(langs) - {""}):
        of = langs == lang
        if n[of].sum() >= 20 and y[of].min() < y[of].max():
            model.thresholds[lang] = threshold(of)


def platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset by Newton steps, with Platt's smoothed targets."""
    weight = np.ones(len(y)) if weight is None else weight
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * logit + b)
        g = np.array([(weight * (p - target) * logit).sum() + 1e-3 * (a - 1), (weight * (p - target)).sum()])
        w = weight * (p * (1 - p) + 1e-9)
        h = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(b)


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The middle of the widest gap among the cuts of highest F1. Equal scores are on one side of a cut."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum((weight * y)[order])
    f1 = np.where(np.append(s[1:] < s[:-1], True), 2 * hit / (np.cumsum(weight[order]) + hit[-1]), -1.0)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    below = np.append(s[1:], 0.0)[top]
    k = int(np.argmax(s[top] - below))
    return float(np.clip((s[top][k] + below[k]) / 2, 0.05, 0.95))


def held_out() -> Column:
    """The rows that are never fitted: crc32 of the id's decimal text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from."""
    return labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from a bounded sample of labelled rows: at most sample[label] of each class ((toxic, other)), in order of
    a hash of their ids, and at most `sample_chars` characters; a text that doesn't fit any more is passed over, and the
    calibration scores it. Of ids with several texts each counts, up to TEXTS for each id on average. Nothing held out
    is fitted. A document with several labels counts as toxic if one of them says so."""
    each = _labelled(labels)
    picked = None
    for most, rows in zip(sample, (each.where("toxic = 1"), each.where("toxic = 0")), strict=True):
        rows = rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
        picked = rows if picked is None else picked.unionByName(rows)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", lang.alias("lang"), F.xxhash64("text").alias("key"))
    labelled = texts.join(F.broadcast(picked), "doc_id")
    # which texts fit is decided by their sizes; only those that do come to the driver
    order = [F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "key"]
    sizes = labelled.groupBy("doc_id", "key").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size")).orderBy(*order).limit(TEXTS * sum(sample))
    fits, held = {}, 0
    for r in sizes.collect():
        if held + r["size"] <= sample_chars:
            held += r["size"]
            fits[r["doc_id"], r["key"]] = len(fits)
    wanted = docs.sparkSession.createDataFrame([(*k, i) for k, i in fits.items()], T.StructType([texts.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType())]))
    one = labelled.join(F.broadcast(wanted), ["doc_id", "key"]).groupBy("at").agg(F.first(F.struct("doc_id", "text", "lang", "toxic")).alias("row"))
    rows = [r["row"] for r in sorted(one.collect(), key=lambda r: r["at"])]
    model = fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows]), [r["lang"] for r in rows])
    model.fitted = sorted({rows[i]["doc_id"] for i in model.fitted})
    return model


def calibrate(model: Model, scored: DataFrame, labels: DataFrame) -> Model:
    """The model with its scale and thresholds learned anew, from (doc_id, lang, key, logit) of all documents: every
    labelled row counts that is neither held out nor fitted, however many there are. The fitted sample has a mix of
    classes of its own, so the rest weighs by class as all labelled rows do. Where the rest lacks a class, the fitted
    rows count too. Logits are counted in steps of 1 / STEPS."""
    if not model.thresholds:
        return model
    fitted = scored.sparkSession.createDataFrame([(i,) for i in model.fitted], T.StructType([T.StructField("doc_id", scored.schema["doc_id"].dataType)]))
    rows = scored.join(_labelled(labels), "doc_id").dropDuplicates(["doc_id", "key"]).join(F.broadcast(fitted.withColumn("fitted", F.lit(True))), "doc_id", "left")
    step = F.round(F.greatest(F.least(F.col("logit"), F.lit(100.0)), F.lit(-100.0)) * STEPS).cast("int")
    found = rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", F.coalesce("fitted", F.lit(False)).alias("fitted"), step.alias("step")).count().toPandas()
    every = found.groupby("toxic")["count"].sum()
    if found[~found["fitted"]]["toxic"].nunique() == 2:
        found = found[~found["fitted"]]
    own = found.groupby("toxic")["count"].sum()
    share = every / own * own.sum() / every.sum()
    step, y, n = (found[c].to_numpy(float) for c in ("step", "toxic", "count"))
    _set_scale(model, step / STEPS, y, found["lang"].to_numpy(object), n, (share[0], share[1]))
    return model


def apply(docs: DataFrame, model: Model, keep: list[str], text: str = "text", block_chars: int = 2 << 20, as_logit: bool = False) -> DataFrame:
    """The columns `keep` and the score of each whole text (or the logit before calibration), in one pass without a
    shuffle. The model's size is fixed."""
    name = "logit" if as_logit else "score"
    shared = small_batches(docs.sparkSession).sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        hasher = Hasher(fitted.rows)
        for batch in batches:
            scores, block, held = [], [], 0
            for i, cell in enumerate(batch.column("_text")):
                block.append(content := cell.as_py())
                held += len(content or "")
                if held >= block_chars or i + 1 == batch.num_rows:
                    scores.append((fitted.logits if as_logit else fitted.score)(pack(block, hasher)))
                    block, held = [], 0
            done = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], done], [*keep, name])

    return kept.mapInArrow(tidied(run), T.StructType([*kept.schema.fields[:-1], T.StructField(name, T.DoubleType())]))


def _scaled(model: Model) -> Column:
    """The score of a logit."""
    x = F.lit(model.scale[0]) * F.col("logit") + F.lit(model.scale[1])
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score of THRESHOLD or more), and by the threshold
    calibrated for its language, lang_threshold and lang_toxic.

    The language chooses a threshold and is no input of the score; nor is any other column than the text. Null and
    empty texts score as a text of no words. Without labels of both classes nothing is known and nothing rejected:
    all scores are next to 0. Repeated rows score alike; labels of unknown documents and null labels are ignored; extra columns too.
    """
    model = train(docs, labels)
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    scored = written(apply(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("key")), model, ["doc_id", "lang", "key"], as_logit=True), "logits")
    model = calibrate(model, scored, labels)
    common = model.thresholds.get("", THRESHOLD)
    threshold = F.lit(common)
    for lang, t in model.thresholds.items():
        if lang:
            threshold = F.when(F.col("lang") == lang, F.lit(t)).otherwise(threshold)
    return scored.withColumn("score", _scaled(model)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        threshold.alias("lang_threshold"), (F.col("score") >= threshold).cast("int").alias("lang_toxic"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below THRESHOLD, whole and with all their columns. They are scored once and
    written with their logits, which the calibration reads before any document is kept or dropped."""
    model = train(docs, labels)
    scored = written(apply(boxed(docs), model, ["row"], "row.text", as_logit=True), "logits")
    lang = F.col("row.lang") if "lang" in docs.columns else F.lit(None).cast("string")
    model = calibrate(model, scored.select(F.col("row.doc_id").alias("doc_id"), lang.alias("lang"), F.xxhash64("row.text").alias("key"), "logit"), labels)
    return scored.where(_scaled(model) < THRESHOLD).select("row.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
