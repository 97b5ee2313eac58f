"""Quality classifier by co-training: two views teach each other, calibrated views are combined.

The text view sees character classes, line and word habits and hashed byte pairs of the whole text, as shares and
not as lengths; the metadata view sees source, language and length. Each round, each view labels the unlabelled
documents that it is surest of (per class, above a confidence) for the *other* view's training set.
They are chosen from all documents of the table: a histogram of confidences, combined in the map tasks, gives
the least confidence that is needed, and only the rows at or over it are ranked. Afterwards each view is calibrated on
labelled documents that neither was trained on, and a small logistic model of both calibrated logits gives the score.
All documents are then scored in place.

Only the labelled documents of the fit are bounded: it takes at most `most_labelled`, those with the lowest hash
of their ids. The features of all documents are written once, for the rounds to read. The model is a few hundred numbers.

Defined results: null or empty texts have features of zero; null metadata is a value of its own;
repeated labels of a document are averaged (a tie counts as good) and null labels ignored; a document
that comes repeatedly trains once, with its least feature row, and is scored each time; documents with a null id are scored
and never train; of equally confident documents the smaller id is taught first; with labels of fewer than two
classes every document gets the share of good labels (one half without labels); where the labelled documents kept for calibration
are of one class, all labelled documents calibrate; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, claim_worker, scratch_dir, slices, unused

PAIRS, SOURCES, LANGS = 64, 64, 16
STYLE = 16
#: Byte classes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 line end, 6 sentence mark, 7 symbol, 8 bar, 9 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5), (b".,;:?'\"()-", 6), (b"#*$%&<>{}[]\\^~=_@+/`", 7), (b"|", 8)):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = 9
CLASSES = 10


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row of STYLE + PAIRS numbers for each text."""
    raw = [("" if t is None else t).encode() for t in texts]
    n = len(raw)
    size = np.fromiter(map(len, raw), np.int64, n)
    out = np.zeros((n, STYLE + PAIRS), np.float32)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(n), size)
    kinds = _CLASS[data]
    share = np.bincount(owner * CLASSES + kinds, minlength=n * CLASSES).reshape(n, CLASSES)
    length = np.maximum(size, 1)[:, None]
    out[:, :CLASSES] = share / length
    bang = np.bincount(owner[data == 0x21], minlength=n)
    out[:, 10] = bang / length[:, 0]
    for i, t in enumerate(raw):
        words = t.split()
        if not words:
            continue
        lines = t.split(b"\n")
        out[i, 11] = len(set(words)) / len(words)
        out[i, 12] = min(20.0, len(t) / len(words)) / 20
        out[i, 13] = len(set(lines)) / len(lines)
        out[i, 14] = sum(1 for x in lines if not x.rstrip().endswith((b".", b"?", b"!"))) / len(lines)
        out[i, 15] = sum(map(len, set(words))) / max(1, len(t))
    if len(data) > 1:
        pair = (data[:-1].astype(np.int64) * 31 + data[1:]) % PAIRS
        own = owner[:-1] == owner[1:]
        out[:, STYLE:] = np.sqrt(np.bincount((owner[:-1] * PAIRS + pair)[own], minlength=n * PAIRS).reshape(n, PAIRS) / length)
    return out


def metadata_features(sources: list, langs: list, lengths: list) -> np.ndarray:
    """One row of hashed source and language and length numbers for each document."""
    out = np.zeros((len(sources), SOURCES + LANGS + 3), np.float32)
    for i, (source, lang, chars) in enumerate(zip(sources, langs, lengths)):
        out[i, zlib.crc32(repr(source).encode()) % SOURCES] = 1
        out[i, SOURCES + zlib.crc32(repr(lang).encode()) % LANGS] = 1
        x = math.log1p(max(0, chars)) / 12 if chars is not None else 0.0
        out[i, -3:] = x, x * x, chars is None
    return out


@dataclass
class Logistic:
    """L2-regularised logistic regression on standardised columns, fitted by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12) -> Logistic:
        x, weight = x.astype(np.float64), np.ones(len(x)) if weight is None else weight
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-6] = np.inf  # constant columns say nothing
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z
            h[np.diag_indices_from(h)] += penalty
            step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class Model:
    views: tuple[Logistic, Logistic] | None
    calibration: tuple[Logistic, Logistic] | None
    combined: Logistic | None
    prior: float
    exchanged: tuple[int, int] = (0, 0)

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both combined."""
        if self.views is None:
            return (np.full(len(text), self.prior),) * 3
        own = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibration, (text, metadata))]
        logits = [*own, self.combined.logit(np.column_stack(own))]
        return tuple(1 / (1 + np.exp(-x)) for x in logits)


def _featured(inputs: DataFrame, batch_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("cotraining")
        for b in slices(batches, "_text", batch_bytes):
            text = text_features(b.column("_text").to_pylist())
            meta = metadata_features(*(b.column(c).to_pylist() for c in ("_source", "_lang", "_chars")))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], names=["_id", "text", "meta"])

    return inputs.mapInArrow(run, "_id long, text binary, meta binary")


def _inputs(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("_id"), *_view_columns(df))


def _view_columns(df: DataFrame, prefix: str = "_") -> list:
    """What the features are made of, in the types that all of fit, score and filter see."""
    return [F.coalesce("text", F.lit("")).alias(f"{prefix}text"), F.col("source").cast("string").alias(f"{prefix}source"), F.col("lang").cast("string").alias(f"{prefix}lang"), F.col("n_chars").cast("long").alias(f"{prefix}chars")]


def _matrix(rows: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    width = STYLE + PAIRS if column == "text" else SOURCES + LANGS + 3
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), np.float32).reshape(-1, width)


#: Who teaches whom what: (teacher, pupil, label).
LESSONS = ((0, 1, 1), (0, 1, 0), (1, 0, 1), (1, 0, 0))
BINS = 1024


def sureness(views: list[Logistic], features: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each lesson, how sure its teacher is of its label, as a logit."""
    logits = [v.logit(x) for v, x in zip(views, features)]
    # Rounded, as sums of products may differ in their last bits with the rows of a batch.
    return [np.round(logits[teacher] if label else -logits[teacher], 9) for teacher, _, label in LESSONS]


def fit_views(text: np.ndarray, meta: np.ndarray, y: np.ndarray, hold: np.ndarray, choose, rounds: int, per_round: int, confidence: float) -> Model:
    """Co-training on feature rows; `hold` marks labelled rows that are kept for calibration.

    `choose(views, taken, wanted, least)` gives for each lesson (ids, text, meta) of the `wanted[lesson]` unlabelled documents
    whose teacher is surest, of those at `least` or over (a logit) whose ids are not in `taken[pupil]`.
    """
    prior = float(y.mean()) if len(y) else 0.5
    if not (0 < y[~hold].sum() < (~hold).sum()):
        return Model(None, None, None, prior)
    features = (text, meta)
    xs, ys, ws = ([f[~hold] for f in features], [y[~hold].astype(float)] * 2, [np.ones((~hold).sum())] * 2)
    taken: tuple[set[int], set[int]] = (set(), set())
    views = [Logistic.fit(x, t) for x, t in zip(xs, ys)]
    exchanged = [0, 0]
    wanted = [max(1, round(per_round * (prior if label else 1 - prior))) for _, _, label in LESSONS]
    least = math.log(confidence / (1 - confidence))
    for _ in range(rounds):
        taught = 0
        for (teacher, pupil, label), (ids, *rows) in zip(LESSONS, choose(views, taken, wanted, least)):
            taken[pupil].update(ids.tolist())
            xs[pupil] = np.concatenate([xs[pupil], rows[pupil]])
            ys[pupil] = np.concatenate([ys[pupil], np.full(len(ids), float(label))])
            ws[pupil] = np.concatenate([ws[pupil], np.full(len(ids), 0.5)])  # a pseudo-label weighs half
            exchanged[teacher] += len(ids)
            taught += len(ids)
        if not taught:
            break
        views = [Logistic.fit(x, t, w) for x, t, w in zip(xs, ys, ws)]
    held = hold if 0 < y[hold].sum() < hold.sum() else np.ones(len(y), bool)
    raw = [v.logit(f[held])[:, None] for v, f in zip(views, features)]
    calibration = [Logistic.fit(r, y[held].astype(float)) for r in raw]
    own = np.column_stack([c.logit(r) for c, r in zip(calibration, raw)])
    return Model(tuple(views), tuple(calibration), Logistic.fit(own, y[held].astype(float)), prior, tuple(exchanged))


def chooser(pool: DataFrame):
    """`choose` of `fit_views` over all rows of the table `pool` (_id, text, meta)."""

    def choose(views: list[Logistic], taken: tuple[set[int], set[int]], wanted: list[int], least: float) -> list[tuple]:
        taken_rows = [np.array(sorted(t), np.int64) for t in taken]
        scale = (BINS - 1) / max(1e-9, 30 - least)

        def sure_of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
            ids = b.column("_id").to_numpy()
            for lesson, sure in enumerate(sureness(views, (_matrix(b, "text"), _matrix(b, "meta")))):
                rows = np.flatnonzero((sure >= least) & ~np.isin(ids, taken_rows[LESSONS[lesson][1]]))
                yield lesson, rows, sure[rows], np.floor((sure[rows] - least) * scale).astype(np.int64)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim_worker("cotraining")
            for b in batches:
                for lesson, _, _, bins in sure_of(b):
                    number, n = np.unique(bins, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), lesson, np.int32)), pa.array(number), pa.array(n)], names=["lesson", "bin", "n"])

        heights = np.zeros((len(LESSONS), BINS), np.int64)
        for r in pool.mapInArrow(counted, "lesson int, bin long, n long").groupBy("lesson", "bin").agg(F.sum("n").alias("n")).collect():  # at most a row for each bin
            heights[r.lesson, r.bin] = r.n
        # The lowest bin that is needed to have as many as wanted.
        from_top = np.cumsum(heights[:, ::-1], axis=1)[:, ::-1]
        lowest = [int(np.flatnonzero(h >= w)[-1]) if (h >= w).any() else 0 for h, w in zip(from_top, wanted)]

        def shortlisted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim_worker("cotraining")
            for b in batches:
                ids = b.column("_id").to_numpy()
                for lesson, rows, sure, bins in sure_of(b):
                    own = np.flatnonzero(bins >= lowest[lesson])
                    own = own[np.lexsort((ids[rows[own]], -sure[own]))[: wanted[lesson]]]
                    part = b.take(pa.array(rows[own]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), lesson, np.int32)), pa.array(sure[own]), *part.columns], names=["lesson", "sure", "_id", "text", "meta"])

        best = Window.partitionBy("lesson").orderBy(F.desc("sure"), "_id")
        limit = F.element_at(F.array(*map(F.lit, wanted)), F.col("lesson") + 1)
        listed = pool.mapInArrow(shortlisted, "lesson int, sure double, _id long, text binary, meta binary")
        rows = listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(wanted)).where(F.col("rank") <= limit).toArrow()
        found = []
        for lesson in range(len(LESSONS)):
            own = rows.filter(pa.array(rows.column("lesson").to_numpy() == lesson)).sort_by("rank")
            found.append((own.column("_id").to_numpy(), _matrix(own, "text"), _matrix(own, "meta")))
        return found

    return choose


def _once(features: DataFrame, scratch: Scratch) -> DataFrame:
    """Each id's least feature row."""
    ids = features.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id").checkpoint()
    if ids.isEmpty():
        return features
    least = features.join(ids, "_id", "left_semi").groupBy("_id").agg(F.min(F.struct("text", "meta")).alias("f")).select("_id", "f.*")
    return scratch.written(features.join(ids, "_id", "left_anti").unionByName(least), "cotraining-once")


def fit(documents: DataFrame, labels: DataFrame, most_labelled: int = 20_000, rounds: int = 5, per_round: int = 1000, confidence: float = 0.95, id_col: str = "doc_id", label_col: str = "quality", batch_bytes: int = 1 << 20) -> Model:
    """Fit on a bounded sample of the labelled and on all unlabelled documents (`labels` has id and 0/1 label)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    scratch_dir(documents.sparkSession)
    scratch = Scratch(documents.sparkSession)
    features = _once(scratch.written(_featured(_inputs(documents, id_col).where("_id is not null"), batch_bytes), "cotraining-features"), scratch)
    # At most most_labelled ids, so the broadcast is bounded.
    picked = F.broadcast(features.select("_id").join(known, "_id").orderBy(F.xxhash64("_id"), "_id").limit(most_labelled))
    rows = features.join(picked, "_id").select("_id", "text", "meta", "y").toArrow().sort_by("_id")
    y = rows.column("y").to_numpy()
    hold = np.array([zlib.crc32(b"hold%d" % i) % 4 == 0 for i in rows.column("_id").to_pylist()], bool)
    pool = scratch.written(features.join(known.select("_id"), "_id", "left_anti"), "cotraining-pool")
    model = fit_views(_matrix(rows, "text"), _matrix(rows, "meta"), y, hold, chooser(pool), rounds, per_round, confidence)
    scratch.clear()
    return model


def _judged(b: pa.RecordBatch, model: Model, prefix: str = "_") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = text_features(b.column(f"{prefix}text").to_pylist())
    return model.scores(text, metadata_features(*(b.column(f"{prefix}{c}").to_pylist() for c in ("source", "lang", "chars"))))


def score(documents: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", batch_bytes: int = 1 << 20) -> DataFrame:
    """(id, p_text, p_metadata, score, keep) of every row: probabilities of good quality; `keep` is score >= `threshold`."""
    names = [id_col, "p_text", "p_metadata", "score", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("cotraining")
        for b in slices(batches, "_text", batch_bytes):
            p = _judged(b, model)
            yield pa.RecordBatch.from_arrays([b.column("_id"), *map(pa.array, p), pa.array(p[2] >= threshold)], names=names)

    return _inputs(documents, id_col).mapInArrow(run, f"{id_col} long, p_text double, p_metadata double, score double, keep boolean")


def filtered(documents: DataFrame, model: Model, threshold: float = 0.5, batch_bytes: int = 1 << 20) -> DataFrame:
    """The rows of `documents` (text, lang, source, n_chars and any others) that `score` would keep, unchanged."""
    prefix = unused(documents, "_view_")
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix += "_"
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_worker("cotraining")
        for b in slices(batches, f"{prefix}text", batch_bytes):
            yield b.select(columns).filter(pa.array(_judged(b, model, prefix)[2] >= threshold))

    return documents.select("*", *_view_columns(documents, prefix)).mapInArrow(run, documents.schema)
