"""PII by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

1. Candidate spans of each kind are found in whole texts, in one narrow pass. Labelers vote
   on every candidate: its format, a check of its digits, gazetteers, and words around it;
   +1 for personal data, -1 against, 0 for no opinion.
2. How often each pattern of kind, votes and shape occurs is counted over all documents.
   There are at most some thousand patterns, whatever the input. Expectation-maximisation
   on these counts estimates how reliable each labeler is, and how likely each pattern.
3. With these likelihoods as soft labels, a logistic regression over votes and shape, which
   EM doesn't see, is trained on the counted patterns. It decides every candidate.

Spans of the base patterns always stay; the classifier adds spans of other candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import stored, with_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "national_id")
LABELERS = ("format", "digits", "gazetteer", "context", "contrary", "shape")

#: Words that announce data of a kind, shortly before it.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "iban", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "credential"),
    "national_id": ("ssn", "social", "security", "passport", "tax", "insurance"),
}
#: Words after which such strings are mostly something else.
CONTRARY = ("version", "isbn", "page", "figure", "commit", "hash", "sha", "checksum", "md5", "revision", "section")
#: Top-level domains, first digits of card issuers, country calling codes.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "ch", "at", "it")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "36", "38", "62")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
           "48", "49", "51", "52", "55", "61", "81", "82", "86", "90", "91")

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
#: A run of any length, also with parts joined by dots, as signed tokens have, and padded at its end.
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,}(?:\.[A-Za-z0-9_+/-]{8,})*={0,2}(?![A-Za-z0-9_+/=-])")
_LETTER = re.compile(r"[A-Za-z]")
_AT_WORD = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}){1,8}")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) << (i & 1)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the e-mail pattern matches from left to right, without its retries on long words."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT_DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)``: matches of the base patterns, and weaker ones of all kinds."""
    for a, b in emails(text):
        yield "email", a, b, True
    if "at]" in text or "at)" in text:
        for m in _AT_WORD.finditer(text):
            yield "email", *m.span(), False
    if _DIGIT.search(text) is None:
        return
    for m in _IP.finditer(text):
        if _ip_ok(m[0]):
            yield "ip", *m.span(), True
    if ":" in text:
        for m in _LONG_IP.finditer(text):
            yield "ip", *m.span(), False
    for m in _CARD.finditer(text):
        digits = _only_digits(m[0])
        if 13 <= len(digits) <= 19:
            yield "card", *m.span(), luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_only_digits(m[0])) <= 15:
                yield "phone", *m.span(), True
    for m in _LOCAL_PHONE.finditer(text):
        yield "phone", *m.span(), False
    for m in _SECRET.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            yield "secret", *m.span(), False
    for m in _NATIONAL.finditer(text):
        yield "national_id", *m.span(), False


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The opinion of each of ``LABELERS`` on a candidate."""
    s = text[start:end]
    digits = _only_digits(s)
    before = _WORD.findall(text[max(0, start - 32) : start].lower())[-3:]
    lone = not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())
    numbers = kind in ("card", "phone", "national_id")
    if kind == "card":
        check = 1 if luhn(digits) else -1
        listed = 1 if digits.startswith(ISSUERS) else -1
    elif kind == "ip":
        check = 1 if ":" in s or _ip_ok(s) else -1
        listed = -1 if s.startswith(("0.", "127.", "255.", "0:0:0:0:")) else 0
    elif kind == "phone":
        check = 1 if 9 <= len(digits) <= 15 else 0
        listed = 1 if s[0] == "+" and digits.startswith(CALLING) else 0
    elif kind == "email":
        check = 0
        listed = 1 if re.split(r"[^a-z]+", s.lower())[-1] in DOMAINS else 0
    elif kind == "secret":
        share = len(digits) / len(s)
        check = 1 if 0.2 <= share <= 0.9 and len(set(s)) >= 10 else -1
        listed = 1 if len(s) in (32, 40, 64) else 0
    else:
        check = -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
        listed = 0
    return (
        1 if base else 0,
        check,
        listed,
        1 if any(w.startswith(x) for w in before for x in CONTEXT[kind]) else 0,
        -1 if any(w in CONTRARY for w in before) else 0,
        (-1 if numbers and len(set(digits)) <= 2 else 1 if lone else -1),
    )


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("pattern", T.StringType()),
    ]
)
CANDIDATES = T.StructType([T.StructField("candidates", T.ArrayType(SPAN, False), False)])


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``candidates``; ``pattern`` is a candidate's kind, votes and shape as text."""

    def one(t: str) -> list[dict]:
        out = []
        for kind, a, b, base in candidates(t):
            v = votes(kind, t, a, b, base)
            size = min((b - a) // 8, 9)
            cut = int(any(c in " -.()" for c in t[a:b]))
            edge = int(a == 0 or t[a - 1] in " \n\t")
            pattern = f"{kind}:{','.join(map(str, v))}:{size}{cut}{edge}"
            out.append({"kind": kind, "start": a, "end": b, "base": base, "pattern": pattern})
        return out

    return with_columns(docs, CANDIDATES, lambda batch: [[one(t or "") for t in batch.column(text).to_pylist()]])


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """How likely each pattern is personal data: EM over labeler reliabilities, for each kind.

    A labeler has, for true and for false candidates, its own odds of +1, 0 and -1; labelers
    are taken as independent given the truth. It starts at the sign of the votes' sum, and
    base matches (the first labeler's +1) are kept true.
    """
    out: dict[str, float] = {}
    for kind in KINDS:
        names = sorted(p for p in counts if p.startswith(f"{kind}:"))
        if not names:
            continue
        n = np.array([counts[p] for p in names], float)
        v = np.array([[int(x) for x in p.split(":")[1].split(",")] for p in names])
        truth = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
        fixed = v[:, 0] == 1
        for _ in range(rounds):
            truth = np.where(fixed, 0.999, truth)
            prior = (n @ truth + 1) / (n.sum() + 2)
            odds = np.log(prior) - np.log1p(-prior) + np.zeros(len(names))
            for j in range(1, v.shape[1]):
                for value in (-1, 0, 1):
                    has = v[:, j] == value
                    # A little weight goes to labelers being right, so that classes keep their names.
                    yes = (n[has] @ truth[has] + 1 + 2 * (value == 1)) / (n @ truth + 5)
                    no = (n[has] @ (1 - truth[has]) + 1 + 2 * (value == -1)) / (n @ (1 - truth) + 5)
                    odds[has] += np.log(yes) - np.log(no)
            truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out |= dict(zip(names, np.where(fixed, 0.999, truth), strict=True))
    return out


def _features(pattern: str) -> np.ndarray:
    kind, v, shape = pattern.split(":")
    x = [float(k == kind) for k in KINDS]
    given = [int(i) for i in v.split(",")]
    x += [float(i) for i in given]
    x += [float(i) * (k == kind) for k in KINDS for i in given]
    size, cut, edge = int(shape[0]), int(shape[1]), int(shape[2])
    x += [float(size == k) for k in range(10)] + [float(cut), float(edge)]
    return np.array(x)


def train(counts: dict[str, int], likely: dict[str, float], rounds: int = 400) -> dict[str, float]:
    """The span classifier's probability for every pattern: logistic regression on soft labels."""
    names = sorted(counts)
    if not names:
        return {}
    x = np.stack([_features(p) for p in names])
    y = np.array([likely[p] for p in names])
    w = np.sqrt([counts[p] for p in names])
    w /= w.sum()
    beta = np.zeros(x.shape[1])
    speed = np.zeros_like(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        speed = 0.9 * speed - x.T @ (w * (p - y)) - 1e-4 * beta
        beta = beta + 0.5 * speed
    return dict(zip(names, 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), strict=True))


FOUND = T.StructType(
    [
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kind", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("base", T.BooleanType()),
                        T.StructField("score", T.DoubleType()),
                    ]
                ),
                False,
            ),
            False,
        )
    ]
)


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without its text, with ``spans``: all base spans, and those the classifier adds.

    A span has ``kind``, ``start``, ``end``, ``base`` and ``score``, in code points, end
    exclusive; spans are in the order of ``KINDS``, then of start. Candidates, of any length,
    are found in one pass over whole texts and kept in the shared folder; only pattern counts
    reach the driver, and a score for each pattern (kinds x votes x shapes at most) the tasks.

    A null or empty text has no spans. Columns named ``spans`` or ``candidates`` are replaced;
    others pass. Equal texts get equal spans. An empty table gives an empty one.
    """
    found = stored(with_candidates(docs, text).drop(text), "pii-candidates")
    each = found.select(F.explode("candidates").alias("c")).groupBy("c.pattern").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["pattern"]: r["n"] for r in each.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(train(counts, estimate(counts)))
    order = {k: i for i, k in enumerate(KINDS)}

    def made(batch: pa.RecordBatch) -> list:
        score = shared.value
        rows = []
        for spans in batch.column("candidates").to_pylist():
            kept = [s | {"score": float(score[s["pattern"]])} for s in spans]
            kept = [s for s in kept if s["base"] or s["score"] >= threshold]
            rows.append(sorted(kept, key=lambda s: (order[s["kind"]], s["start"], s["end"])))
        return [rows]

    return with_columns(found, FOUND, made).drop("candidates")
