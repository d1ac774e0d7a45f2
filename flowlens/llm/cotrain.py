"""Quality classifier by co-training: a view of the text's content and a view of the page's metadata.

Labelled rows train one naive Bayes classifier on the words (content) and one on what can be told without reading them
(metadata: language, source, length, lines, shares of kinds of characters, repetition). Over some rounds each calibrated
view labels the other rows that it is sure of for the other view to learn from. At the end both views are calibrated on
labelled rows that neither has learned from, combined by a logistic fit on the same rows, and score every document.

Only the labelled rows are a bounded sample (about ``labelled`` of them, chosen by a hash of the id). All other documents take part
in every round: one pass counts the features of those a view is sure of, copies once. Features are hashed to a
fixed number of slots, so the counts that come to the driver have a bound. All documents are scored, each by itself, without a shuffle.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import CHUNK_BYTES
from flowlens.llm.substring import hash_spans, mixed
from flowlens.session import cut, ship

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Kinds of bytes whose shares are metadata.
KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "high": range(128, 256)}
KIND_OF = np.full(256, len(KINDS), np.int64)
for _at, _bytes in enumerate(KINDS.values()):
    KIND_OF[list(_bytes)] = _at
SHARE_STEPS = (0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.16, 0.2, 0.3, 0.5, 0.8, 1.0)
#: Rows (groups of copies) that a feature with a weight needs.
LEAST = 5
#: Without any label nothing is rejected.
WITHOUT_LABELS = {"quality": 0.999, "toxic": 0.001}
SKETCHES, BAND = 12, 3
TARGETS = ("quality", "toxic")
SLOTS = 1 << 20
#: Shingles that are mixed at once.
SPANS = 1 << 12
#: Seeds of the orders of a sketch, one a row.
SEEDS = np.arange(1, SKETCHES + 1, dtype=np.uint64)[:, None]


@dataclass
class View:
    """Log odds of features, and the calibration of their sum."""

    weights: dict = field(default_factory=dict)
    scale: float = 0.0
    shift: float = 0.0

    def raw(self, features: Iterable) -> float:
        return math.fsum(map(self.weights.get, features, repeat(0.0)))

    def logit(self, features: Iterable) -> float:
        return self.scale * self.raw(features) + self.shift


@dataclass
class Classifier:
    """Two calibrated views and how their logits are combined: (bias, content, metadata)."""

    content: View
    metadata: View
    combine: tuple[float, float, float]

    def probability(self, content: Iterable, metadata: Iterable) -> float:
        bias, a, b = self.combine
        return float(_sigmoid(bias + a * self.content.logit(content) + b * self.metadata.logit(metadata)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def content_features(text: str) -> set[str]:
    """Words and runs of signs."""
    return set(TOKEN.findall(text.lower()))


def metadata_features(text: str, given: dict[str, object]) -> set[str]:
    """Names of what is told by the given columns and by the shape of the text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(KIND_OF[raw], minlength=len(KINDS) + 1)
    shares = counts / max(1, len(raw))
    words = text.split()
    distinct = len(set(words)) / len(words) if words else 0.0
    found = {f"{k}={v}" for k, v in given.items()}
    found |= {f"{k}~{bisect_right(SHARE_STEPS, x)}" for k, x in zip([*KINDS, "sign"], shares.tolist(), strict=True)}
    found |= {f"length~{int(2 * np.log2(len(raw) + 1))}", f"lines~{int(2 * np.log2(counts[list(KINDS).index('line')] + 1))}",
              f"distinct~{int(10 * distinct)}", f"word~{int(2 * np.log2(len(raw) / (len(words) + 1) + 1))}"}
    return found


def slots(features: set[str]) -> array:
    """Distinct slots of features, in order."""
    return array("I", sorted({xxhash.xxh3_64_intdigest(x) % SLOTS for x in features}))


@dataclass
class Counts:
    """Numbers of rows with label 0 and 1, in all and for each feature."""

    totals: list[int] = field(default_factory=lambda: [0, 0])
    of: tuple[Counter, Counter] = field(default_factory=lambda: (Counter(), Counter()))

    def add(self, features: Iterable, y: int) -> None:
        self.totals[y] += 1
        self.of[y].update(features)


def counted(rows: list[Iterable], groups: list[int], labels: list[int]) -> Counts:
    """Copies in one group count once for a feature."""
    whole: dict[tuple[int, int], set] = {}
    for features, group, y in zip(rows, groups, labels, strict=True):
        whole.setdefault((group, y), set()).update(features)
    counts = Counts()
    for (_, y), features in whole.items():
        counts.add(features, y)
    return counts


def fit_weights(mine: Counts, given: Counts, least: int = LEAST, z: float = 4.0) -> dict:
    """Naive Bayes log odds of the features that tell the labels apart, from labelled rows and rows labelled by the other view."""
    totals = [a + b for a, b in zip(mine.totals, given.totals, strict=True)]
    if not min(totals):
        return {}
    weights = {}
    for x in mine.of[0].keys() | mine.of[1].keys() | given.of[0].keys() | given.of[1].keys():
        n, m = mine.of[0][x] + given.of[0][x], mine.of[1][x] + given.of[1][x]
        if n + m < least:
            continue
        p, q, both = n / totals[0], m / totals[1], (n + m) / sum(totals)
        spread = (max(both * (1 - both), 1e-9) * (1 / totals[0] + 1 / totals[1])) ** 0.5
        if abs(p - q) > z * spread:
            weights[x] = math.log((m + 0.5) / (totals[1] + 1)) - math.log((n + 0.5) / (totals[0] + 1))
    return weights


def logistic(columns: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """(bias, one weight for each column) by Newton's method."""
    x = np.column_stack([np.ones(len(labels)), columns])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sketch_of(text: str) -> list[int]:
    """Least hashes of three-word shingles in SKETCHES orders."""
    words = text.lower().encode().split()
    stretch, at = hash_spans([words]), np.arange(max(1, len(words) - 2))
    hashes = stretch(at, np.minimum(at + 3, len(words)))
    least = [mixed(hashes[a : a + SPANS] ^ SEEDS).min(axis=1) for a in range(0, len(hashes), SPANS)]
    return (np.min(least, axis=0) >> np.uint64(1)).tolist()


def groups_of(sketches: list[list[int]]) -> list[int]:
    """A number for each row, equal where a chain of rows shares all hashes of one band; copies mostly do, others hardly."""
    leader = list(range(len(sketches)))

    def top(i: int) -> int:
        while leader[i] != i:
            leader[i] = i = leader[leader[i]]
        return i

    first: dict[tuple, int] = {}
    for i, sketch in enumerate(sketches):
        for k in range(0, SKETCHES, BAND):
            a, b = top(i), top(first.setdefault((k, *sketch[k : k + BAND]), i))
            leader[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sketches))]


#: From two views and what each may label (its kinds of labels) to what the content and the metadata view learn from the other.
Exchange = Callable[[list[View], list[tuple[bool, bool]], float], list[Counts]]


def co_train(labelled: list[tuple[Iterable, Iterable]], labels: np.ndarray, pool: list[tuple[Iterable, Iterable]] | Callable[[np.ndarray], Exchange],
             groups: list[int], rounds: int = 3, sure: float = 0.98, default: float = 0.5) -> Classifier:
    """A classifier of (content, metadata) features from labelled rows and a pool without labels.

    The pool is a list, or gives from the flags of the rows held for calibration the exchange over a table. ``groups`` are those
    of the labelled rows, then of a listed pool. Whole groups of copies calibrate: neither view learns
    from them. ``default`` is the probability where there are no labels at all.
    """
    mine, pool_groups = groups[: len(labelled)], groups[len(labelled) :]
    held = np.array([xxhash.xxh3_64_intdigest(str(g)) % 4 == 0 for g in mine], bool)
    if len(labels) == 0 or len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else default
        return Classifier(View(), View(), (float(np.log(share / (1 - share))), 0.0, 0.0))
    truth = labels[held].astype(float)
    learn = [(row, int(y), int(g)) for row, y, g, h in zip(labelled, labels, mine, held, strict=True) if not h]
    check = [row for row, h in zip(labelled, held, strict=True) if h]
    known = [counted([r[side] for r, _, _ in learn], [g for _, _, g in learn], [y for _, y, _ in learn]) for side in (0, 1)]
    if callable(pool):
        exchange = pool(held)
    else:
        aside = {g for g, h in zip(mine, held, strict=True) if h}
        exchange = _listed([(r, g) for r, g in zip(pool, pool_groups, strict=True) if g not in aside])
    given = [Counts(), Counts()]
    for turn in range(rounds + 1):
        views = [View(fit_weights(known[side], given[side])) for side in (0, 1)]
        for side, view in enumerate(views):
            view.shift, view.scale = logistic(np.array([[view.raw(r[side])] for r in check]), truth)
        if turn < rounds:
            given = exchange(views, [_sure(v, [r[side] for r in check], truth, sure) for side, v in enumerate(views)], sure)
    logits = np.array([[views[0].logit(c), views[1].logit(m)] for c, m in check])
    return Classifier(views[0], views[1], tuple(float(x) for x in logistic(logits, truth)))


def _listed(pool: list[tuple[tuple[Iterable, Iterable], int]]) -> Exchange:
    """Exchange over a list of ((content, metadata), group)."""
    def exchange(views, may, sure):
        given: list[Counts] = []
        for side in (0, 1):
            rows = []
            for row, group in pool:
                p = _sigmoid(views[1 - side].logit(row[1 - side]))
                rows += [(row[side], group, y) for y in (0, 1) if may[1 - side][y] and (p if y else 1 - p) >= sure]
            given.append(counted([r for r, _, _ in rows], [g for _, g, _ in rows], [y for _, _, y in rows]))
        return given

    return exchange


def _tabled(pool: DataFrame, aside: list[int]) -> Exchange:
    """Exchange over a table of (bands, content, metadata), one row for each group: a pass that counts slots in every task.

    Rows that share a band with one held for calibration (``aside``) teach nothing. What a task gives has at most two rows for
    each slot, and so has what comes to the driver.
    """
    aside = np.unique(np.array(aside, np.int64))

    def exchange(views, may, sure):
        if not any(map(any, may)):
            return [Counts(), Counts()]
        models = [(np.fromiter(v.weights.keys(), np.int64, len(v.weights)), np.fromiter(v.weights.values(), float, len(v.weights)), v.scale, v.shift)
                  for v in views]

        def count(batches):
            weights = [np.zeros(SLOTS) for _ in models]
            for dense, (at, w, _, _) in zip(weights, models, strict=True):
                dense[at] = w
            found = [[np.zeros(SLOTS + 1, np.int64) for _ in (0, 1)] for _ in (0, 1)]  # the last slot counts rows
            for batch in batches:
                bands = batch.column("bands")
                off = bands.offsets.to_numpy()
                held = np.concatenate([[0], np.cumsum(np.isin(bands.values.to_numpy(), aside))])
                free = held[off[1:]] == held[off[:-1]]
                lists = [(x.offsets.to_numpy(), x.values.to_numpy()) for x in (batch.column("content"), batch.column("metadata"))]
                for side, (off, values) in enumerate(lists):
                    sums = np.concatenate([[0.0], np.cumsum(weights[side][values])])
                    p = _sigmoid(models[side][2] * (sums[off[1:]] - sums[off[:-1]]) + models[side][3])
                    other_off, other = lists[1 - side]
                    for y in (0, 1):
                        if may[side][y]:
                            rows = free & ((p if y else 1 - p) >= sure)
                            picked = np.repeat(rows, np.diff(other_off))
                            found[1 - side][y] += np.bincount(other[other_off[0] : other_off[-1]][picked], minlength=SLOTS + 1)
                            found[1 - side][y][SLOTS] += rows.sum()
            for side, (n, m) in enumerate(found):
                at = np.flatnonzero(n + m)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(m[at])],
                                                 ["side", "slot", "n", "m"])

        rows = pool.mapInArrow(count, "side int, slot int, n long, m long").groupBy("side", "slot").agg(
            F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
        side, slot, n, m = (rows.column(c).to_numpy() for c in ("side", "slot", "n", "m"))
        given = [Counts(), Counts()]
        for i in (0, 1):
            for y, number in ((0, n), (1, m)):
                at = (side == i) & (number > 0)
                given[i].of[y].update(dict(zip(slot[at].tolist(), number[at].tolist(), strict=True)))
                given[i].totals[y] = given[i].of[y].pop(SLOTS, 0)
        return given

    return exchange


def _sure(view: View, rows: list[Iterable], truth: np.ndarray, sure: float) -> tuple[bool, bool]:
    """May the view give the labels 0 and 1? Only if it is right about the rows it is sure of here."""
    p = _sigmoid(np.array([view.logit(r) for r in rows]))
    return tuple(bool((at := q >= sure).sum() >= 10 and (truth[at] == y).mean() >= 0.95) for y, q in ((0, 1 - p), (1, p)))


def bands_of(sketch: list[int]) -> list[int]:
    """A number for each band of a sketch."""
    return [xxhash.xxh3_64_intdigest(repr((k, sketch[k : k + BAND]))) >> 1 for k in range(0, SKETCHES, BAND)]


def _pieces(batches: Iterable[pa.RecordBatch], text: str | int) -> Iterable[pa.RecordBatch]:
    """The batches in pieces of about CHUNK_BYTES of text, so that a task holds what Python makes of few rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK_BYTES)) + 1
        for a, b in zip([0, *at.tolist()], [*at.tolist(), len(sizes)], strict=True):
            yield batch.slice(a, b - a)


def _features(df: DataFrame, id_col: str, text_col: str, metadata: list[str], without: frozenset[int] = frozenset()) -> DataFrame:
    """(doc_id, content, metadata, bands, sketch) with features as slots, of the rows whose id is not in ``without``."""
    def make(batches):
        for batch in _pieces(batches, "text"):
            given = [batch.column(c).to_pylist() for c in metadata]
            out = []
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if doc not in without:
                    text, sketch = text or "", sketch_of(text or "")
                    shape = metadata_features(text, {c: v[i] for c, v in zip(metadata, given, strict=True)})
                    out.append((doc, slots(content_features(text)), slots(shape), bands_of(sketch), sketch))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             ["doc_id", "content", "metadata", "bands", "sketch"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     *[F.col(c).cast("string").alias(c) for c in metadata if c not in ("doc_id", "text")]) \
        .mapInArrow(make, "doc_id long, content array<int>, metadata array<int>, bands array<long>, sketch array<long>")


def _share(df: DataFrame, id_col: str, most: int, seed: str) -> DataFrame:
    """All rows, or about ``most`` of them by a hash of the id."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 6000, rounds: int = 3, metadata: tuple[str, ...] = ("lang", "source"),
        id_col: str = "doc_id", text_col: str = "text") -> dict[str, Classifier]:
    """A classifier for each of quality (1: good) and toxic (1: toxic), from a bounded sample of labelled rows and all others.

    Of rows that share a labelled id one counts, the least by text. Other rows with the same first band are one group, whose first row counts.
    Of several labels of one document the worse counts; labels without id or value are left aside. With one kind of a label
    the classifier gives every document the share of that label, without any nothing is bad or toxic. Metadata columns that ``docs`` lacks are left aside.
    """
    ship(docs.sparkSession)
    metadata = [c for c in metadata if c in docs.columns and c not in (id_col, text_col)]
    worst = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")).where("label_id IS NOT NULL")
    chosen = _share(worst, "label_id", labelled, "labelled")
    key = F.col(id_col).cast("long")
    one = docs.join(chosen.select("label_id"), key == F.col("label_id"), "left_semi").groupBy(key.alias("doc_id")).agg(
        F.min(F.struct(F.col(text_col).alias("text"), *metadata)).alias("row")).select("doc_id", "row.*")
    with_label = _features(one, "doc_id", "text", metadata)
    rows = with_label.join(chosen, with_label.doc_id == chosen.label_id).select(with_label["*"], *TARGETS).toArrow().to_pylist()
    sets = [(array("I", r.pop("content")), array("I", r.pop("metadata"))) for r in rows]
    others = cut(_features(docs, id_col, text_col, metadata, frozenset(r["doc_id"] for r in rows)).groupBy(F.col("bands")[0].alias("key")).agg(
        F.min(F.struct("doc_id", "content", "metadata", "bands")).alias("row")).select("row.bands", "row.content", "row.metadata"))
    models = {}
    for target in TARGETS:
        at = [i for i, r in enumerate(rows) if r[target] in (0, 1)]
        aside = lambda held, at=at: _tabled(others, [b for i, h in zip(at, held, strict=True) if h for b in rows[i]["bands"]])
        models[target] = co_train([sets[i] for i in at], np.array([rows[i][target] for i in at], np.int64), aside,
                                   groups_of([rows[i]["sketch"] for i in at]), rounds, default=WITHOUT_LABELS[target])
    return models


def judge(docs: DataFrame, models: dict[str, Classifier], bad: float = 0.8, toxic: float = 0.5,
          metadata: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text",
          as_column: str = "judged") -> DataFrame:
    """All columns of ``docs`` and a struct (quality, toxic, score, keep) of each row.

    quality and toxic are probabilities, score the one of being good and not toxic. A row is rejected if it is bad with
    probability ``bad`` or more, or toxic with ``toxic`` or more: a clean document lost weighs more than a dull one kept. A
    null text is judged as an empty one; null metadata is a value of its own.
    """
    ship(docs.sparkSession)
    metadata = [c for c in metadata if c in docs.columns and c not in (id_col, text_col)]
    at_text, at_given = docs.columns.index(text_col), [docs.columns.index(c) for c in metadata]
    inner = pa.struct([("quality", pa.float64()), ("toxic", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches):
        for batch in _pieces(batches, at_text):
            given = [batch.column(i).to_pylist() for i in at_given]
            out = []
            for i, text in enumerate(batch.column(at_text).to_pylist()):
                content = slots(content_features(text or ""))
                shape = slots(metadata_features(text or "", {c: None if v[i] is None else str(v[i]) for c, v in zip(metadata, given, strict=True)}))
                p, q = (models[t].probability(content, shape) for t in TARGETS)
                out.append({"quality": p, "toxic": q, "score": p * (1 - q), "keep": 1 - p < bad and q < toxic})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, inner)], [*batch.schema.names, as_column])

    schema = T.StructType([*docs.schema.fields, T.StructField(as_column, T.StructType.fromDDL(
        "quality double, toxic double, score double, keep boolean"))])
    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, quality, toxic, score, keep), one row for each input row; see ``fit`` and ``judge``. Repeated rows are judged
    each; a null id stays null; other columns are left aside; an empty table gives an empty one."""
    names = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    rows = docs.select(*names)
    return judge(rows, fit(rows, labels, **options)).select("doc_id", "judged.*")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    mine = max([*docs.columns, "judged"], key=len) + "_judged"
    return judge(docs, fit(docs, labels, **options), as_column=mine).where(F.col(f"{mine}.keep")).select(*docs.columns)
