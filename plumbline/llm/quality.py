"""Quality classifier: co-training of a text-content view and a page-metadata view.

For each target (high quality, toxic) two classifiers see disjoint views of a document:

* content: which words and beginnings of words it has, and shares of character classes;
* metadata: where it is from, its language, and its size and layout.

Each starts from a labelled sample. In every round one pass over all documents lets each
view label those that it is sure of, and the *other* view learns from these: how often
they have each feature, by side, is added up in the tasks (two vectors of fixed size for
each view) and sharpens the odds that the other view's weights start from. At the end each
view is calibrated (a logistic fit of its scores on labelled rows it did not learn from),
and the calibrated views are combined by another one. All documents are scored.

Only the labelled sample is bounded: at most ``LABELLED`` rows for each combination of labels,
of lowest hash of their id. Calibration and combination count each row as often as its
combination has labels for a sampled one, so probabilities follow the shares of all labels,
whatever the bound leaves out. Every pass is narrow and reads whole texts; only the sample's
features and the summed vectors reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WORD_BYTES, texts_of, with_columns

#: Bound of the fit: labelled rows for each combination of labels.
LABELLED = 1500
#: A target with fewer labelled documents of the sample on either side has no model.
LEAST_SIDE = 10
ROUNDS = 2
#: A view passes on its label of a document if it is this sure.
SURE = 0.9
#: What a view is told by the other weighs so much for each document, but together no more
#: than its labelled rows of that side.
TOLD = 0.3
#: Features of documents are summed in whole numbers of this part, so that no order changes a sum.
UNIT = 2.0**-20
#: A document goes where it is less likely than this to be of high quality, or this likely toxic.
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.5
#: Hashed places of each view's features.
CONTENT_PLACES, METADATA_PLACES = 1 << 17, 1 << 10
#: Besides its words, a text has the beginnings of its words, of so many bytes.
BEGINNINGS = (4, 6, 8)
COPIES = 12

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:'\"()-",
    "loud": b"!?",
    "mark": b"#$%&*+/<=>@[\\]^_`{|}~",
    "space": b" \t\r\n",
}

_IN_CLASS = np.array([[b in chars for chars in _CLASSES.values()] for b in range(256)], np.int64)
SHARES = len(_CLASSES) * 32 * COPIES
WORD_PLACES = CONTENT_PLACES - SHARES


def _level(share: float) -> int:
    """Shares and sizes in steps that double."""
    return int(np.log2(max(share, 1e-4) * 1e4) * 2)


#: Texts of about so many bytes, and at most so many, have their words found at once.
PIECE, PIECE_TEXTS = 1 << 20, 1 << 13


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_table()


def _word_places(words: pa.LargeStringArray) -> np.ndarray:
    """Hashed places of each word and of its beginnings; where it is no longer than one, its own place again."""
    n = len(words)
    spaced = pc.binary_join(pa.ListArray.from_arrays([0, n], words), pa.scalar(" ", pa.large_string()))[0].as_buffer().to_pybytes()
    out = np.zeros((n, 1 + len(BEGINNINGS)), np.int64)
    out[:] = (np.fromiter(map(zlib.crc32, spaced.split(b" ")[:n]), np.int64, n) % WORD_PLACES)[:, None]
    length = pc.binary_length(words).to_numpy()
    start, data = np.cumsum(length + 1) - length - 1, np.frombuffer(spaced + bytes(max(BEGINNINGS)), np.uint8)
    step = lambda c, x: _CRC[(c ^ x) & 255] ^ (c >> 8)
    c = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(max(BEGINNINGS)):
        c = step(c, data[start + k])
        if k + 1 in BEGINNINGS:
            beginning = (~step(c, np.uint8(ord("-")))).astype(np.int64) % WORD_PLACES
            column = out[:, 1 + BEGINNINGS.index(k + 1)]
            column[:] = np.where(length > k + 1, beginning, column)
    return out


def _once(x: np.ndarray) -> np.ndarray:
    """The different numbers in order."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _piece_places(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(edges) - 1
    spaced = pa.LargeStringArray.from_buffers(n, pa.py_buffer(edges), pa.py_buffer(data.tobytes().translate(WORD_BYTES)))
    split = pc.ascii_split_whitespace(spaced)
    coded = split.flatten().dictionary_encode()
    codes, count = coded.indices.to_numpy(), len(coded.dictionary)
    doc = np.repeat(np.arange(n), split.value_lengths().to_numpy())
    if (empty := coded.dictionary.index("").as_py()) >= 0:  # before a first space, or after a last one
        doc, codes = doc[codes != empty], codes[codes != empty]
    doc, word = np.divmod(_once(doc * count + codes), max(count, 1))
    table = _word_places(coded.dictionary)
    counts = np.array([np.bincount(data[a:b], minlength=256) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)])
    size = np.diff(edges)
    least = np.maximum(size, 1)[:, None]
    share = (least - size[:, None] + counts @ _IN_CLASS) / least
    level = np.minimum(np.log2(np.maximum(share, 1e-4) * 1e4) * 2, 31).astype(np.int64)
    # Shares have several places each, so that many words don't drown them.
    first = WORD_PLACES + (32 * np.arange(len(_CLASSES)) + level) * COPIES
    shares = (np.arange(n)[:, None] * CONTENT_PLACES + first)[:, :, None] + np.arange(COPIES)
    both = _once(np.concatenate([(doc[:, None] * CONTENT_PLACES + table[word]).ravel(), shares.ravel()]).astype(np.int32))
    return both % CONTENT_PLACES, np.bincount(both // CONTENT_PLACES, minlength=n)


def content_places(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of the words that texts have, and of their shares of character classes: in order for
    each text, one text after the other; and how many each has."""
    data, edges = texts_of(texts)
    made, start = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], 0
    while start < len(edges) - 1:
        full = int(np.searchsorted(edges, edges[start] + PIECE, side="right")) - 1
        stop = min(max(full, start + 1), start + PIECE_TEXTS)
        made.append(_piece_places(data[edges[start] : edges[stop]], edges[start : stop + 1] - edges[start]))
        start = stop
    places, n = (np.concatenate(x) for x in zip(*made, strict=True))
    return places, n


def content_features(text: str | None) -> list[int]:
    """``content_places`` of one text."""
    return content_places(pa.chunked_array([pa.array([text], pa.large_string())]))[0].tolist()


def metadata_features(text: str | None, source: str | None, lang: str | None) -> list[int]:
    """Hashed places of where a page is from, and of how long it and its lines are."""
    t = text or ""
    lines = t.count("\n") + 1
    facts = (
        f"source={source}",
        f"lang={lang}",
        f"size={_level(len(t) / 1e4)}",
        f"lines={_level(lines / 1e4)}",
        f"line={_level(len(t) / lines / 1e4)}",
        f"word={_level(len(t) / (t.count(' ') + lines) / 1e4)}",
        f"source={source},lang={lang}",
    )
    return sorted({zlib.crc32(f.encode()) % METADATA_PLACES for f in facts})


class Rows:
    """Sparse rows of 0 and 1, each divided by the root of its number of ones."""

    def __init__(self, places: list, width: int):
        self._set(np.concatenate([np.zeros(0, np.int32), *(np.asarray(p, np.int32) for p in places)]), np.array([len(p) for p in places], np.int32), width)

    @classmethod
    def laid(cls, places: np.ndarray, length: np.ndarray, width: int) -> Rows:
        """Of rows that lie one after the other."""
        out = cls.__new__(cls)
        out._set(places, length.astype(np.int32), width)
        return out

    def _set(self, places: np.ndarray, length: np.ndarray, width: int) -> None:
        self.width, self.n = width, len(length)
        self.length, self.places = length, places
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), self.length)
        self.value = (1 / np.sqrt(np.maximum(self.length, 1))).astype(np.float32)[self.row]

    def dot(self, beta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=beta[self.places] * self.value, minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.places, weights=r[self.row] * self.value, minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Told:
    """What one view learns from the other: sums of features by side (not so, so), and numbers of documents."""

    def __init__(self, width: int):
        self.sums, self.n = np.zeros((2, width)), np.zeros(2)


def fit_view(rows: Rows, y: np.ndarray, told: Told | None = None, steps: int = 40) -> np.ndarray:
    """Weights (the bias last) of a logistic regression on features scaled by their log odds.

    Features that only the other view's documents have take the average weight of the others.
    """
    sides = (1 - y, y)
    own = np.stack([rows.back(s) for s in sides])
    total = own.copy()
    if told is not None:
        for k, s in enumerate(sides):
            if told.n[k]:
                total[k] += told.sums[k] * min(TOLD, s.sum() / told.n[k])
    odds = np.log((total[1] + 0.02) / (total[1].sum() + 0.02 * rows.width))
    odds -= np.log((total[0] + 0.02) / (total[0].sum() + 0.02 * rows.width))
    odds[total.sum(axis=0) == 0] = 0
    beta, bias = np.zeros(rows.width), 0.0
    grad_sq, bias_sq = np.full(rows.width, 1e-8), 1e-8
    balance = np.where(y > 0.5, 0.5 / max(y.sum(), 1e-9), 0.5 / max((1 - y).sum(), 1e-9))
    for _ in range(steps):
        r = balance * (_sigmoid(rows.dot(beta * odds) + bias) - y)
        g = rows.back(r) * odds + 1e-5 * beta
        grad_sq += g * g
        bias_sq += r.sum() ** 2
        beta = beta - 1.0 * g / np.sqrt(grad_sq)
        bias -= 0.5 * r.sum() / bias_sq**0.5
    seen = own.sum(axis=0)
    beta[seen == 0] = (beta @ seen) / max(seen.sum(), 1e-9)
    return np.append(beta * odds, bias)


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Logistic regression of weighted rows on few columns by Newton's steps, with a weak pull to small weights."""
    w = w / w.mean()  # the pull counts the same against rows of any weight
    x = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(x.shape[1])
    pull = 1e-2 * np.eye(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        h = x.T @ ((w * (p * (1 - p) + 1e-6))[:, None] * x) + pull
        beta = beta - np.linalg.solve(h, x.T @ (w * (p - y)) + pull @ beta)
    return beta


@dataclass(frozen=True)
class CoTrained:
    """For one target: weights of both views, and how their raw scores combine to a probability."""

    content: np.ndarray
    metadata: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def probability(self, content: Rows, metadata: Rows) -> np.ndarray:
        views = [r.dot(b[:-1]) + b[-1] for r, b in ((content, self.content), (metadata, self.metadata))]
        logits = [c[0] * v + c[1] for v, c in zip(views, self.calibration, strict=True)]
        return _sigmoid(np.column_stack([*logits, np.ones(len(views[0]))]) @ self.combined)


WIDTHS = (CONTENT_PLACES, METADATA_PLACES)


class CoTraining:
    """For one target: both views, trained in rounds; a fifth of the labelled rows is kept for calibration."""

    def __init__(self, content: list, metadata: list, y: np.ndarray, w: np.ndarray | None = None):
        spare = np.arange(len(y)) % 5 == 4
        y = y.astype(float)

        def rows(which: np.ndarray) -> list[Rows]:
            return [Rows([f for f, s in zip(v, which, strict=True) if s], n) for v, n in zip((content, metadata), WIDTHS, strict=True)]

        self.known, self.y = rows(~spare), y[~spare]
        self.held, self.y_held, self.w_held = rows(spare), y[spare], (np.ones(len(y)) if w is None else w)[spare]
        self.betas = [fit_view(v, self.y) for v in self.known]

    def learn(self, told: list[Told]) -> None:
        self.betas = [fit_view(v, self.y, t) for v, t in zip(self.known, told, strict=True)]

    def model(self) -> CoTrained:
        raw = [r.dot(b[:-1]) + b[-1] for r, b in zip(self.held, self.betas, strict=True)]
        calibration = tuple(_platt(x[:, None], self.y_held, self.w_held) for x in raw)
        logits = np.column_stack([c[0] * x + c[1] for x, c in zip(raw, calibration, strict=True)])
        return CoTrained(*self.betas, calibration, _platt(logits, self.y_held, self.w_held))


def tell(betas: list[np.ndarray], views: Sequence[Rows], told: list[Told]) -> None:
    """Adds what each view is sure of to what the other one is told."""
    for i, (beta, view) in enumerate(zip(betas, views, strict=True)):
        p = _sigmoid(view.dot(beta[:-1]) + beta[-1])
        other = views[1 - i]
        for side, sure in enumerate((p <= 1 - SURE, p >= SURE)):
            told[1 - i].n[side] += sure.sum()
            whole = np.round(other.value / UNIT) * sure[other.row]
            told[1 - i].sums[side] += np.bincount(other.places, weights=whole, minlength=other.width)


TARGETS = ("quality", "toxic")
FEATURES = T.StructType(
    [
        T.StructField("content", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("metadata", T.ArrayType(T.IntegerType(), False), False),
    ]
)
JUDGED = T.StructType(
    [
        T.StructField("p_quality", T.DoubleType(), False),
        T.StructField("p_toxic", T.DoubleType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("keep", T.BooleanType(), False),
    ]
)


def _views(batch: pa.RecordBatch, text: str, source: str, lang: str) -> tuple[tuple[np.ndarray, np.ndarray], list]:
    none = [None] * batch.num_rows
    t, s, g = (batch.column(c).to_pylist() if c in batch.schema.names else none for c in (text, source, lang))
    texts = batch.column(text) if text in batch.schema.names else pa.array(none, pa.large_string())
    return content_places(pa.chunked_array([texts])), [metadata_features(*x) for x in zip(t, s, g, strict=True)]


def _rows(batch: pa.RecordBatch, text: str, source: str, lang: str) -> tuple[Rows, Rows]:
    content, metadata = _views(batch, text, source, lang)
    return Rows.laid(*content, CONTENT_PLACES), Rows(metadata, METADATA_PLACES)


def _featured(batch: pa.RecordBatch, text: str, source: str, lang: str) -> list:
    (places, n), metadata = _views(batch, text, source, lang)
    return [np.split(places, np.cumsum(n)[:-1]), metadata]


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of one array."""
    whole = column.combine_chunks()
    values, at = whole.values.to_numpy(), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def _low(df: DataFrame, share: Column) -> DataFrame:
    """The rows whose id's hash is in the lowest share of all hashes."""
    return df.where(F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1_000_003)) < share * 1_000_003)


def _lowest(rows: list, n: int) -> list:
    return sorted(rows, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))[:n]


def told_by_all(docs: DataFrame, betas: dict[str, list[np.ndarray]], labelled: set, names: tuple[str, str, str, str]) -> dict[str, list[Told]]:
    """One pass: what both views of each target are told by the other, over all documents but those labelled."""
    id_col, text, source, lang = names
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((betas, labelled))  # weights of fixed size, ids of the sample
    targets = list(betas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        betas, labelled = shared.value
        told = {t: [Told(n) for n in WIDTHS] for t in targets}
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                mask = [i not in labelled for i in batch.column(id_col).to_pylist()]
                views = _rows(batch.filter(pa.array(mask, pa.bool_())), text, source, lang)
                for t in targets:
                    tell(betas[t], views, told[t])
        for k, t in enumerate(targets):
            for view, one in enumerate(told[t]):
                for side in (0, 1):
                    # Place -1 is the number of documents.
                    sums = np.concatenate([[one.n[side]], one.sums[side]]).astype(np.int64)
                    at = np.flatnonzero(sums)
                    kind = np.full(len(at), 4 * k + 2 * view + side, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array((at - 1).astype(np.int32)), pa.array(sums[at])], names=["kind", "place", "n"])

    inputs = [c for c in dict.fromkeys(names) if c in docs.columns]
    sums = docs.select(*inputs).mapInArrow(run, "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    out = {t: [Told(n) for n in WIDTHS] for t in targets}
    kinds, places, n = (sums.column(c).to_numpy() for c in ("kind", "place", "n"))
    for k, t in enumerate(targets):
        for view, one in enumerate(out[t]):
            for side in (0, 1):
                of = kinds == 4 * k + 2 * view + side
                counted = of & (places < 0)
                one.n[side] = n[counted].sum()
                one.sums[side][places[of & ~counted]] = n[of & ~counted] * UNIT
    return out


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
    rounds: int = ROUNDS,
) -> dict[str, CoTrained]:
    """A model for each of ``TARGETS`` of which the labels have ``LEAST_SIDE`` documents on both sides.

    Each target learns from the labels that aren't null in its own column. Labels with a null id, or
    where both are null, aren't used, nor are those of absent documents. Of documents that share an id
    one is used, and of several labels for an id each target's largest. Each round of co-training
    reads all documents once.
    """
    given = labels.select(F.col(id_col).alias("id"), *(F.col(t).cast("boolean").alias(t) for t in TARGETS))
    given = given.where(F.col("id").isNotNull() & F.coalesce(*TARGETS).isNotNull())
    named = given.groupBy("id").agg(*(F.max(t).alias(t) for t in TARGETS))
    sizes = named.groupBy(*TARGETS).count().orderBy(*TARGETS).collect()
    chosen: dict = {}
    counts: dict = {}  # labels for each sampled row, by combination
    for r in sizes:  # one for each combination of labels, of which either may be null
        same = named.where(F.col("quality").eqNullSafe(r["quality"]) & F.col("toxic").eqNullSafe(r["toxic"]))
        share = min(1.0, 1.2 * LABELLED / r["count"] + 20 / r["count"])
        rows = _low(same, F.lit(share)).select("id").collect()
        same_ids = _lowest(rows, LABELLED)
        chosen |= {x["id"]: (r["quality"], r["toxic"]) for x in same_ids}
        counts[r["quality"], r["toxic"]] = r["count"] / max(len(same_ids), 1)
    if not chosen:
        return {}
    spark = docs.sparkSession
    picked = spark.createDataFrame([(i,) for i in chosen], f"id {docs.schema[id_col].dataType.simpleString()}")
    inputs = [c for c in dict.fromkeys((text, source, lang)) if c in docs.columns]
    sample = docs.select(F.col(id_col).alias("id"), *inputs).join(F.broadcast(picked), "id")
    featured = with_columns(sample, FEATURES, lambda b: _featured(b, text, source, lang))
    # Bounded by the picked ids, also where an id stands on very many rows.
    rows = featured.groupBy("id").agg(F.min(F.struct("content", "metadata")).alias("f")).orderBy("id")
    sample = rows.select("id", "f.content", "f.metadata").toArrow()
    names = sample.column("id").to_pylist()
    content, metadata = (_lists(sample.column(c)) for c in ("content", "metadata"))
    training = {}
    for k, target in enumerate(TARGETS):
        own = [i for i, name in enumerate(names) if chosen[name][k] is not None]
        y = np.array([int(chosen[names[i]][k]) for i in own])
        # Both sides need rows to learn from, and others to be calibrated on.
        if min(y.sum(), len(y) - y.sum()) < LEAST_SIDE:
            continue
        w = np.array([counts[chosen[names[i]]] for i in own])
        training[target] = CoTraining([content[i] for i in own], [metadata[i] for i in own], y, w)
    for _ in range(rounds if training else 0):
        told = told_by_all(docs, {t: c.betas for t, c in training.items()}, set(chosen), (id_col, text, source, lang))
        for t, c in training.items():
            c.learn(told[t])
    return {t: c.model() for t, c in training.items()}


def judge_quality(
    docs: DataFrame, models: dict[str, CoTrained], text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """``docs`` with ``p_quality``, ``p_toxic``, ``score`` (the product of the first and of being
    not toxic) and ``keep``. One narrow pass over whole texts; equal rows get equal results.

    A target without a model leaves its probability at 1 (quality) or 0 (toxic), so nothing
    goes on its account. Null texts count as empty; null or absent metadata is a value like
    others. Columns of ``docs`` with the names of results are replaced; others pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # two weight vectors of fixed size

    def made(batch: pa.RecordBatch) -> list:
        views = _rows(batch, text, source, lang)
        p = {k: m.probability(*views) for k, m in shared.value.items()}
        good = p.get("quality", np.ones(batch.num_rows))
        toxic = p.get("toxic", np.zeros(batch.num_rows))
        return [good, toxic, good * (1 - toxic), (good >= LEAST_QUALITY) & (toxic < MOST_TOXIC)]

    return with_columns(docs, JUDGED, made)
