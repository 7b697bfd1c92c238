"""Language ID by string kernels: presence of character n-grams, Nystrom landmarks, ridge.

The blended-spectrum presence kernel of two texts counts the character n-grams (n = 1 to 4,
after lower-casing, with runs of anything but letters as one space) that both have, divided
by the root of the product of their own counts. N-grams are known by 64 bits each, so long
texts don't run together. A few landmark texts stand for the space: with K the kernel of
landmarks among themselves, a text's features are its kernels with the landmarks times
K^(-1/2), and one ridge regression per language (that language against the rest) scores
them. Batches of texts are scored by one matrix product.

Every language of the labelled rows is learned. The fit takes a bounded sample of them: at
most ``SAMPLE`` texts of a language, ``ALL_SAMPLE`` in all and ``ALL_CHARS`` code points in all
(but one text for each language at least), the lowest hashes of their text. Every text is read
whole when it is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import with_columns

#: Bounds of the fit: texts for each language, texts in all, code points of a text in the sample, and of the sample.
SAMPLE, ALL_SAMPLE, SAMPLE_CHARS, ALL_CHARS = 150, 15_000, 200_000, 40_000_000
#: Code points whose n-grams are held at a time.
BLOCK = 1 << 18
#: Landmarks for each language and in all; of a language's sample, the texts nearest to this length.
LANDMARKS, ALL_LANDMARKS, LANDMARK_CHARS = 24, 512, 3_000
GRAMS = (1, 2, 3, 4)
RIDGE = 1e-3
UNKNOWN = "und"

_NOT_LETTERS = regex.compile(r"\P{L}+")


def letters_of(text: str | None) -> str:
    """The lower-cased words of a text with single spaces around; empty where it has no letter."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def presence(text: str) -> np.ndarray:
    """The different n-grams of a prepared text as sorted numbers of 64 bits; what is held is a block and the result."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(0, np.uint64)
    # Blocks share the characters of n-grams that begin in one and end in the next.
    for b in range(0, len(codes), BLOCK):
        block = codes[b : b + BLOCK + max(GRAMS) - 1].astype(np.uint64)
        rolled = np.zeros(len(block), np.uint64)
        found = [out]
        for n in range(1, min(max(GRAMS), len(block)) + 1):
            # The n-gram from each character on, as a number; then its upper bits mixed.
            rolled = rolled[: len(block) - n + 1] * np.uint64(0x100000001B3) + block[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                found.append(rolled * np.uint64(0x9E3779B97F4A7C15))
        out = np.unique(np.concatenate(found))
    return out


class Landmarks:
    """The n-grams of the landmark texts, and for each n-gram the landmarks that have it."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.root = np.sqrt([max(len(r), 1) for r in rows])
        grams = np.concatenate([np.zeros(0, np.uint64), *rows])
        owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])
        order = np.argsort(grams, kind="stable")
        self.owner = owner[order]
        self.grams, start = np.unique(grams[order], return_index=True)
        self.start = np.append(start, len(grams))

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        """One row for each text, one column for each landmark."""
        out = np.zeros((len(rows), self.n))
        for i, r in enumerate(rows):
            if not len(r) or not len(self.grams):
                continue
            at = np.minimum(np.searchsorted(self.grams, r), len(self.grams) - 1)
            at = at[self.grams[at] == r]
            first, count = self.start[at], self.start[at + 1] - self.start[at]
            flat = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            out[i] = np.bincount(self.owner[flat], minlength=self.n) / np.sqrt(len(r))
        return out / self.root


@dataclass(frozen=True)
class KernelModel:
    """``weights``: landmarks x languages."""

    languages: tuple[str, ...]
    landmarks: Landmarks
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.landmarks.kernel(rows) @ self.weights + self.bias


def choose_landmarks(texts: list[str], langs: list[str], each: int = LANDMARKS) -> list[int]:
    """Places of the landmarks: as many of each language, of those of middle length; ``ALL_LANDMARKS`` at most."""
    languages = sorted(set(langs))
    each = max(1, min(each, ALL_LANDMARKS // max(len(languages), 1)))

    def middle(i: int) -> tuple[float, int]:
        return abs(np.log((len(texts[i]) + 1) / LANDMARK_CHARS)), i

    own = {lang: [] for lang in languages}
    for i, lang in enumerate(langs):
        own[lang].append(i)
    chosen = [i for lang in languages for i in sorted(own[lang], key=middle)[:each]]
    return chosen[:: -(-len(chosen) // ALL_LANDMARKS)] if chosen else []


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Kernel ridge regression on Nystrom features, one against the rest."""
    languages = tuple(sorted(set(langs)))
    rows = [presence(letters_of(t)) for t in texts]
    chosen = choose_landmarks(texts, langs, landmarks)
    marks = Landmarks([rows[i] for i in chosen])
    shared = marks.kernel(rows)
    own = shared[chosen]
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = shared @ root
    place = {lang: k for k, lang in enumerate(languages)}
    of = np.array([place[x] for x in langs], dtype=int)
    aims = np.full((len(langs), len(languages)), -1.0)
    aims[np.arange(len(langs)), of] = 1.0
    # Each language weighs the same, however many texts it has.
    w = (len(langs) / len(languages) / np.bincount(of, minlength=len(languages)))[of][:, None]
    mean, mid = (w * features).sum(axis=0) / w.sum(), (w * aims).sum(axis=0) / w.sum()
    centred = features - mean
    gram = centred.T @ (w * centred) + ridge * len(langs) * np.eye(centred.shape[1])
    beta = np.linalg.solve(gram, centred.T @ (w * (aims - mid)))
    return KernelModel(languages, marks, root @ beta, mid - mean @ beta)


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang") -> KernelModel | None:
    """Fits on a sample of the texts of every language; None where there is nothing to learn from.

    Rows with a null language, or a text without letters, aren't used. Texts over ``SAMPLE_CHARS``
    are used only where a language has no other: then its shortest one is. Otherwise the sample of a
    language is its different texts of lowest hash, until they are ``SAMPLE`` or its share of
    ``ALL_CHARS`` is spent, so it depends on the rows only, not on their order or on how often a text
    is repeated. A text of two languages is in the sample of both. How many languages there are is
    taken to be what a driver can hold.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.length(text).alias("chars"), F.xxhash64(F.lit("sample"), F.col(text)).alias("place")
    )
    short = F.col("chars") <= SAMPLE_CHARS
    # Copies of a text have one place, so the share that is taken goes by different places, not by rows.
    sizes = known.groupBy("lang").agg(
        F.approx_count_distinct(F.when(short, F.col("place")), 0.03).alias("n"), F.min(F.struct("chars", "place"))["place"].alias("shortest")
    ).collect()
    if not sizes:
        return None
    each, chars = max(1, min(SAMPLE, ALL_SAMPLE // len(sizes))), ALL_CHARS // len(sizes)
    # First those of low hash, by a share that leaves enough of each language (twice as many texts as
    # are needed; the counts are off by some hundredths), then the lowest.
    shares = labelled.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, (2 * each + 20) / r["n"]) if r["n"] else None, None if r["n"] else r["shortest"]) for r in sizes],
        "lang string, share double, shortest long",
    )
    wanted = (short & (F.pmod("place", F.lit(1_000_003)) / 1_000_003 <= F.col("share"))) | (F.col("place") == F.col("shortest"))
    low = known.join(F.broadcast(shares), "lang").where(wanted).groupBy("lang", "place").agg(F.min("text").alias("text"))
    by_place = Window.partitionBy("lang").orderBy("place")
    # Of each language some hundreds are left, so they are put in order by one task, and what the driver gets is bounded.
    spent = F.sum(F.length("text")).over(by_place) - F.length("text")
    taken = low.select("*", F.row_number().over(by_place).alias("k"), spent.alias("spent")).where((F.col("k") <= each) & (F.col("spent") < chars) | (F.col("k") == 1))
    found = sorted(taken.select("lang", "place", "text").collect(), key=lambda r: (r["lang"], r["place"]))
    return fit([r["text"] for r in found], [r["lang"] for r in found])


PREDICTED = T.StructType(
    [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
)


def predict_languages(docs: DataFrame, model: KernelModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; one narrow pass over whole texts.

    ``score`` is the softmax share (0 to 1) of the predicted language. A null text, or one
    without letters (numerals of any kind aren't letters), gives ``und`` and 0; so does
    everything if there is no model. Of languages with equal scores the first by name is
    predicted. Columns of ``docs`` with these names are replaced, others pass. Equal texts get
    equal results.
    """
    # At most ALL_LANDMARKS texts' n-grams and a weight for each landmark and language.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def made(batch: pa.RecordBatch) -> list:
        model = shared.value
        texts = [letters_of(t) for t in batch.column(text).to_pylist()]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t] if model is not None else []
        if some:
            raw = 4 * model.scores([presence(texts[i]) for i in some])
            raw = np.exp(raw - raw.max(axis=1, keepdims=True))
            best = raw.argmax(axis=1)
            share = raw.max(axis=1) / raw.sum(axis=1)
            for i, b, s in zip(some, best, share, strict=True):
                names[i], scores[i] = model.languages[b], float(s)
        return [names, scores]

    return with_columns(docs, PREDICTED, made)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of all ids, by the checksum of their text form; not used in any fit."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
