"""A quality classifier by co-training.

Two logistic classifiers see different views of a document: its text (hashed words and word shapes, and shares of
lines, signs, digits and capitals) and its metadata (source, language, length). Both are calibrated on held-out labels.
Over rounds each labels, among all documents, some that its calibrated probability is sure of, and these become
training rows of the other; a view that is sure of nothing gives nothing. At last the calibrated views are combined.

Features are made once and stored; rounds and scoring read them. Fitting uses bounded samples: at most LABELLED
labelled rows, and GIVEN pseudo-labels per view, class and round. They are the rows with the smallest seeded hashes
among all rows that qualify, so every document has a part in it: counts of hash ranges find where the GIVEN smallest
end, and only the rows below are ranked. Only their sparse features reach the driver. Scoring covers all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freeing, slices, stored, table, task, temporary

LABELLED, GIVEN, ROUNDS, CONFIDENT = 6000, 250, 2, 0.95
#: One of so many labelled rows is held out for calibration.
HELD_OUT = 4
WORDS, SHAPES, EXTRA, META = 1 << 13, 1 << 10, 12, 1 << 9
KEEP = 0.5
#: Ranges of hashes that candidates for pseudo-labels are counted by.
RANGES = 1 << 16
_CACHE = 100_000
_DIGITS, _CAPITALS = b"0123456789", bytes(range(65, 91))
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class Views:
    """Sparse features (indices, values) of the two views."""

    _LETTERS, _UPPER, _DIGITS = re.compile(r"[^\W\d_A-Z]+"), re.compile("[A-Z]+"), re.compile(r"\d+")

    def __init__(self):
        self.words: dict[str, int] = {}

    def _word(self, w: str) -> int:
        """A word's hash and that of its shape, in one number."""
        shape = self._DIGITS.sub("9", self._UPPER.sub("X", self._LETTERS.sub("x", w)))
        got = xxhash.xxh32_intdigest(w.lower()) % WORDS * SHAPES + xxhash.xxh32_intdigest(shape, 1) % SHAPES + 1
        if len(self.words) >= _CACHE:
            self.words.clear()
        self.words[w] = got
        return got

    def text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.array([WORDS + SHAPES], np.int32), np.ones(1, np.float32)
        known = self.words
        ids = np.array([known.get(w) or self._word(w) for w in words], np.int64) - 1
        n = np.bincount(ids // SHAPES, minlength=WORDS + SHAPES)
        n[WORDS:] = np.bincount(ids % SHAPES, minlength=SHAPES)
        at = np.flatnonzero(n)
        lines = [x for x in map(str.rstrip, text.split("\n")) if x]
        raw = text.encode("utf-8", "surrogatepass")
        share = lambda which: 1 - len(raw.translate(None, which)) / len(raw)
        extra = [
            1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / len(words), min(1.0, math.log2(len(words)) / 20),
            min(2.0, len(text) / len(words) / 10), 4 * share(_DIGITS), 4 * share(_CAPITALS), 4 * share(_SIGNS),
            min(1.0, len(words) / max(1, len(lines)) / 50), sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)),
            sum(map(str.isalpha, words)) / len(words), sum(map(str.isupper, words)) / len(words),
        ]
        at = np.concatenate([at, np.arange(WORDS + SHAPES + 1, WORDS + SHAPES + 1 + len(extra))])
        return at.astype(np.int32), np.concatenate([np.sqrt(n[n > 0] / len(words)), extra]).astype(np.float32)

    def meta(self, source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
        size = "none" if n_chars is None or n_chars != n_chars else str(int(math.log2(max(0, n_chars) + 1) * 2))
        return self._hashed(source, lang, size)

    @staticmethod
    @lru_cache(maxsize=50_000)
    def _hashed(source, lang, size: str) -> tuple[np.ndarray, np.ndarray]:
        names = [f"source={source}", f"lang={lang}", f"size={size}", f"{lang}/{size}"]
        return np.array([xxhash.xxh32_intdigest(x) % META for x in names], np.int32), np.full(4, 0.5, np.float32)


class Logistic:
    """Logistic regression on sparse rows, fitted by full-batch adaptive gradient steps with classes balanced."""

    def __init__(self, dim: int):
        self.w, self.b = np.zeros(dim), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 120, rate: float = 0.5, decay: float = 1e-5) -> Logistic:
        y = np.asarray(y, float)
        if not len(y) or y.min() == y.max():
            self.b = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
            return self
        at, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        seen, seen_b = np.full(len(self.w), 1e-8), 1e-8
        for _ in range(steps):
            z = np.bincount(of, self.w[at] * val, len(rows)) + self.b
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            g = np.bincount(at, val * err[of], len(self.w)) + decay * self.w
            seen += g * g
            seen_b += err.sum() ** 2
            self.w -= rate * g / np.sqrt(seen)
            self.b -= rate * err.sum() / np.sqrt(seen_b)
        return self

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.w[at] @ val + self.b for at, val in rows], float)


def calibration(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (with the constant last) of a logistic fit of y on a few columns, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[:-1] = 1.0
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (y - p) - ridge * w), -5, 5)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Rows = list[tuple[np.ndarray, np.ndarray]]


def _rows(at: list[bytes], val: list[bytes]) -> Rows:
    return [(np.frombuffer(a, np.uint16), np.frombuffer(v, np.float32)) for a, v in zip(at, val)]


_FEATURES = ("at_t", "val_t", "at_m", "val_m")


def features(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(``row``: struct of the carried columns, all by default; doc_id; at_t, val_t, at_m, val_m): sparse features of both views as bytes, one row per row of docs."""
    kind = T.StructType([T.StructField(n, T.BinaryType()) for n in _FEATURES])

    @F.arrow_udf(kind)
    def made(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with task():
            views = Views()
            for columns in batches:
                parts = []
                for part in zip(*(slices([c]) for c in columns)):
                    texts, sources, langs, sizes = (c.to_pylist() for c in part)
                    t, m = [views.text(x) for x in texts], [views.meta(*x) for x in zip(sources, langs, sizes)]
                    told = [[x.astype(np.uint16).tobytes() for x, _ in t], [x.tobytes() for _, x in t], [x.astype(np.uint16).tobytes() for x, _ in m], [x.tobytes() for _, x in m]]
                    parts.append(pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in told], _FEATURES))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.binary()) for n in _FEATURES]))

    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    out = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), made("text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double")).alias("f"))
    return out.select("row", "doc_id", "f.*")


class CoTrained:
    """The fitted views, their calibrations and the combination. Without held-out labels the raw scores count."""

    def __init__(self, text: Logistic, meta: Logistic, held: tuple[Rows, Rows, np.ndarray]):
        self.text, self.meta = text, meta
        zt, zm, y = text.logits(held[0]), meta.logits(held[1]), held[2]
        self.of_text, self.of_meta = calibration(zt[:, None], y), calibration(zm[:, None], y)
        self.both = calibration(np.column_stack([zt * self.of_text[0] + self.of_text[1], zm * self.of_meta[0] + self.of_meta[1]]), y)

    def scores(self, t: Rows, m: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities by text, by metadata, and combined."""
        zt = self.text.logits(t) * self.of_text[0] + self.of_text[1]
        zm = self.meta.logits(m) * self.of_meta[0] + self.of_meta[1]
        return sigmoid(zt), sigmoid(zm), sigmoid(zt * self.both[0] + zm * self.both[1] + self.both[2])


def _confident(feats: DataFrame, model: CoTrained, used: list[int], seed: int) -> DataFrame:
    """(view, y, doc_id, features) of documents that one view is sure of, as training rows of the other: up to GIVEN ids of each view and class, those with the smallest seeded hashes. Of several rows of an id one counts."""

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = set(used)
        for batch in slices(batches):
            ids, (at_t, val_t, at_m, val_m) = batch.column(0).to_pylist(), (batch.column(i).to_pylist() for i in range(1, 5))
            p_text, p_meta, _ = model.scores(_rows(at_t, val_t), _rows(at_m, val_m))
            views, classes, names, orders = [], [], [], []
            for view, p in (("meta", p_text), ("text", p_meta)):
                for i in np.flatnonzero(np.maximum(p, 1 - p) >= CONFIDENT).tolist():
                    if ids[i] is not None and ids[i] not in taken:
                        views.append(view)
                        classes.append(float(p[i] > 0.5))
                        names.append(ids[i])
                        orders.append(xxhash.xxh64_intdigest(str(ids[i]), seed) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(views, pa.string()), pa.array(classes, pa.float64()), pa.array(names, pa.int64()), pa.array(orders, pa.int64())], names=["view", "y", "doc_id", "o"])

    with temporary(feats.sparkSession) as tables:
        found = feats.select("doc_id", *_FEATURES).mapInArrow(freeing(sure), "view string, y double, doc_id long, o long")
        found = tables(found.withColumn("range", F.floor(F.col("o") / F.lit((1 << 63) // RANGES)).cast("int")), "sure")
        counts = found.groupBy("view", "y", "range").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()  # at most 4 * RANGES rows
        cuts, room = {}, {}
        for r in sorted(counts, key=lambda r: r["range"]):
            key = r["view"], r["y"]
            if room.get(key, 0) < 2 * GIVEN:
                room[key], cuts[key] = room.get(key, 0) + r["n"], r["range"]
        if not cuts:
            return found.limit(0).select("view", "y", "doc_id").join(feats.select("doc_id", *_FEATURES), "doc_id").limit(0)
        below = [(F.col("view") == v) & (F.col("y") == y) & (F.col("range") <= cut) for (v, y), cut in cuts.items()]
        few = found.filter(reduce(lambda a, b: a | b, below)).dropDuplicates(["view", "y", "doc_id"])
        chosen = None
        for v, y in cuts:
            part = few.filter((F.col("view") == v) & (F.col("y") == y)).orderBy("o", "doc_id").limit(GIVEN)
            chosen = part if chosen is None else chosen.unionByName(part)
        one = feats.select("doc_id", F.struct(*_FEATURES).alias("f")).join(F.broadcast(chosen.select("view", "y", "doc_id")), "doc_id")  # 4 * GIVEN rows
        return stored(one.groupBy("view", "y", "doc_id").agg(F.min("f").alias("f")).select("view", "y", "doc_id", "f.*"), "given")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rounds: int = ROUNDS, seed: int = 9, feats: DataFrame | None = None) -> CoTrained:
    """Fits on documents (doc_id, text, source, lang, n_chars) and labels (doc_id, 0/1). feats: features() of docs, if they are at hand.

    Null labels and ids are left out; of several labels of a document the mean decides, and of several rows of a
    labelled document one is taken, the same in each run. Without labels of both classes the scores are the same for
    all documents.
    """
    with temporary(docs.sparkSession) as tables:
        if feats is None:
            feats = tables(features(docs.select("doc_id", "text", "source", "lang", "n_chars"), ["doc_id"]), "features")
        marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.avg(label_col).alias("y"))
        marked = marked.select("doc_id", (F.col("y") >= 0.5).cast("double").alias("y"), F.xxhash64("doc_id", F.lit(seed)).alias("o")).orderBy("o", "doc_id").limit(LABELLED)
        known = feats.select("doc_id", F.struct(*_FEATURES).alias("f")).join(F.broadcast(marked.select("doc_id", "y")), "doc_id")  # LABELLED ids at most
        rows = known.groupBy("doc_id", "y").agg(F.min("f").alias("f")).select("doc_id", "y", "f.*").collect()
        rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"]), seed), r["doc_id"]))
        held, train = rows[::HELD_OUT], [r for k, r in enumerate(rows) if k % HELD_OUT]
        of = lambda some: (_rows([r["at_t"] for r in some], [r["val_t"] for r in some]), _rows([r["at_m"] for r in some], [r["val_m"] for r in some]), np.array([r["y"] for r in some]))
        kept, used = of(held), [r["doc_id"] for r in rows]
        by = {"text": list(train), "meta": list(train)}
        for r in range(rounds + 1):
            t, m = of(by["text"]), of(by["meta"])
            model = CoTrained(Logistic(WORDS + SHAPES + EXTRA).fit(t[0], t[2]), Logistic(META).fit(m[1], m[2]), kept)
            if r == rounds or len({x["y"] for x in train}) < 2:
                return model
            given = _confident(feats, model, used, seed + 1 + r).collect()  # 4 * GIVEN rows at most
            for row in sorted(given, key=lambda x: x["doc_id"]):
                used.append(row["doc_id"])
                by[row["view"]].append(row)
        return model


def scored(feats: DataFrame, model: CoTrained) -> DataFrame:
    """``row``, p_text, p_meta (calibrated), score (combined) and kept for each row of features()."""
    names = ("p_text", "p_meta", "score")

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with task():
            for columns in batches:
                parts = []
                for part in zip(*(slices([c]) for c in columns)):
                    at_t, val_t, at_m, val_m = (c.to_pylist() for c in part)
                    parts.append(pa.StructArray.from_arrays([pa.array(p, pa.float64()) for p in model.scores(_rows(at_t, val_t), _rows(at_m, val_m))], names))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.float64()) for n in names]))

    out = feats.select("row", run(*_FEATURES).alias("s"))
    return out.select("row", "s.p_text", "s.p_meta", "s.score", (F.col("s.score") >= KEEP).alias("kept"))


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``row`` (struct of docs' columns), p_text, p_meta (calibrated), score (combined) and kept, for each row of docs.

    Null texts and metadata have features of their own. Repeated rows score alike; columns of docs cannot clash, as
    they stay inside ``row``; an empty table gives an empty result.
    """
    return scored(features(docs), model)


def op9_cotraining_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    with temporary(spark) as tables:
        feats = tables(features(docs, ["doc_id"]), "features")
        out = scored(feats, fit(docs, table(spark, sf_dir, "labels"), feats=feats))
        return stored(out.select("row.doc_id", "p_text", "p_meta", "score", "kept"), "scores")


QUERIES = {"op9_cotraining_quality": op9_cotraining_quality}
