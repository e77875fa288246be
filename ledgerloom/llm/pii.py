"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation tells how reliable each is, a classifier decides.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers by fixed patterns and checks. ``candidates`` adds looser
spans: spelt-out addresses, numbers without the marks that the patterns ask for, national ids, and names after a title or with a known given name.
Six labelers say of each candidate yes, no or nothing: its pattern, its check (Luhn, octets, number of digits), a gazetteer
(mail domains, card issuers, country codes, given names, reserved networks), the words before it, what it borders on, and its digits' variety.

All candidates of the whole table are counted by kind, votes and shape: a table bounded by PATTERNS rows, whatever the corpus.
From these counts expectation-maximisation estimates, kind by kind, each labeler's reliability and each pattern's probability of being personal
data, and a logistic regression on votes, kind and shape is trained on these probabilities: the final span classifier.
Base spans always stay. Another candidate becomes a span if the classifier gives it ACCEPTED or more and its context votes yes, so a
bare number in prose is none; it may not overlap a base span or one accepted before it.

Defined results: a null text is empty; no span gives no row less, an empty list. Places are code points, ends exclusive. Spans come by KINDS, then
by start. Runs of digits and separators of over 64 characters, and names spelt out beyond 64, are no candidates (none has a valid form that long); base spans have no limit.
Repeated rows are counted and scanned each. Very long texts are read whole in linear time. An empty table gives an empty result and a model
that accepts nothing. Extra columns are kept only when named in ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, strings, table

#: Kinds in the order in which spans are given; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "id", "name")
BASE_KINDS = KINDS[:4]
LABELERS = ("pattern", "check", "gazetteer", "context", "border", "variety")
ACCEPTED = 0.5
#: Shape bits: long, has a plus sign, brackets, dots, hyphens, blanks.
SHAPES = 6
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 2**SHAPES
ROUNDS, RIDGE = 200, 1e-2
#: Votes that each labeler is given beforehand, and the part of them that is right, so that one that seldom votes tells little.
PRIOR, TRUSTED = 2.0, 0.7

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Loose forms.
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-]{0,2}[0-9])++")
_AT = re.compile(r"\s?(?:\(at\)|\[at\]|\sat\s)\s?")
_SPELT = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,4}")
_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NAME = re.compile(r"\b(Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? ([A-Z]\w{1,30}(?: [A-Z]\w{1,30})?)")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? $")
_PAIR = re.compile(r"\b([A-Z][a-z]{2,14}) [A-Z][a-z]{2,30}\b")
#: Gazetteers.
GIVEN = frozenset("James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Hans Peter Wolfgang Klaus Jürgen Ursula Monika Petra Carlos José María Carmen Antonio Manuel Jean Pierre Michel Marie Nathalie Isabelle".split())
MAIL_ENDS = (".com", ".org", ".net", ".edu", ".gov", ".de", ".fr", ".es", ".uk", ".io")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "353", "358", "380", "420")
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
_RESERVED = re.compile(r"0\.|127\.|255\.")
#: Words before a span that speak for its kind, and some that speak against any number.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone", "anrufen"),
    "id": ("ssn", "social", "security", "id", "passport", "dni", "ausweis"),
    "name": ("name", "dear", "sincerely", "regards", "contact", "named", "nombre", "nom"),
}
AGAINST = frozenset("order invoice version isbn page chapter figure table total price serial part item room section article".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    """Whether the digits have a valid check digit."""
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part begins as early as its characters reach back."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, kind by kind, leftmost and not overlapping within a kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    shape: int

    @property
    def pattern(self) -> int:
        """Kind, votes and shape as one number below PATTERNS."""
        code = KINDS.index(self.kind)
        for v in self.votes:
            code = code * 3 + v + 1
        return code * 2**SHAPES + self.shape


def _kind_of(said: str) -> str | None:
    """What a loose run of digits may be by its shape."""
    n = len(_digits(said))
    if _ID.fullmatch(said):
        return "id"
    if said.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", said):
        return "ip"
    return "card" if 13 <= n <= 19 else "phone" if 7 <= n <= 12 else None


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if 7 <= m.end() - m.start() <= 64 and (kind := _kind_of(m[0])):
                yield kind, *m.span()
    if " dot " in text or "(dot)" in text or "[dot]" in text:
        for m in _AT.finditer(text):
            window = text[max(0, m.start() - 64) : m.start()]
            begin = m.start() - (len(window) - len(window.rstrip(_LOCAL)))
            if begin < m.start() and (host := _SPELT.match(text, m.end())):
                yield "email", begin, host.end()
    for m in _NAME.finditer(text):
        yield "name", *m.span(2)
    for m in _PAIR.finditer(text):
        if m[1] in GIVEN:
            yield "name", *m.span()


def _check(kind: str, said: str) -> int:
    if kind == "card":
        return 1 if luhn(_digits(said)) else -1
    if kind == "ip":
        return 1 if _octets(said) else -1
    if kind == "phone":
        return 1 if 9 <= len(_digits(said)) <= 15 else -1
    if kind == "id":
        return -1 if said[:3] in ("000", "666") or said[0] == "9" or said[4:6] == "00" or said[7:] == "0000" else 1
    return 0


def _gazetteer(kind: str, said: str) -> int:
    d = _digits(said)
    if kind == "email":
        return 1 if re.sub(r"\s?[(\[ ]dot[)\] ]\s?", ".", said.lower()).endswith(MAIL_ENDS) else -1
    if kind == "card":
        return 1 if _ISSUER.match(d) else -1
    if kind == "ip":
        return -1 if _RESERVED.match(said) else 0
    if kind == "phone":
        return (1 if d.startswith(COUNTRY_CODES) else -1) if said.startswith("+") else 0
    return 1 if kind == "name" and said.split(" ")[0] in GIVEN else 0


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    said = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]
    context = 1 if any(w in CONTEXT[kind] for w in before) else -1 if any(w in AGAINST for w in before) else 0
    if kind == "name" and _TITLE.search(text, max(0, start - 12), start):
        context = 1
    left, right = text[start - 1 : start], text[end : end + 1]
    border = 1 if (not left or left.isspace() or left in "(:<,;") and (not right or right.isspace() or right in ").,;:>!?") else -1
    d = _digits(said)
    variety = 0 if kind in ("email", "name") else -1 if len(set(d)) < 3 or d in "01234567890123456789" else 0
    return (1 if base else 0, _check(kind, said), _gazetteer(kind, said), context, border, variety)


def _shape(said: str) -> int:
    return (len(said) > 16) | ("+" in said) << 1 | ("(" in said) << 2 | ("." in said) << 3 | ("-" in said) << 4 | (" " in said) << 5


def candidates(text: str | None) -> list[Candidate]:
    """Base spans, and loose ones that overlap none of them, of a whole text."""
    text = text or ""
    base = base_spans(text)
    out = [Candidate(kind, a, b, True, _votes(text, kind, a, b, True), _shape(text[a:b])) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], dtype=np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], dtype=np.int64)) if taken else starts
    for kind, a, b in _loose(text):
        k = int(np.searchsorted(starts, b, side="left"))  # base spans that begin before the end
        if not k or ends[k - 1] <= a:
            out.append(Candidate(kind, a, b, False, _votes(text, kind, a, b, False), _shape(text[a:b])))
    return out


def _features(kinds: np.ndarray, votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """One row a pattern: a constant, kinds, yes and no of each labeler, shape bits."""
    bits = (shapes[:, None] >> np.arange(SHAPES)) & 1
    return np.concatenate([np.ones((len(kinds), 1)), np.eye(len(KINDS))[kinds], votes == 1, votes == -1, bits], axis=1).astype(float)


def _unpacked(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shapes, code = patterns % 2**SHAPES, patterns // 2**SHAPES
    votes = np.stack([code // 3**k % 3 - 1 for k in range(len(LABELERS))][::-1], axis=1)
    return code // 3 ** len(LABELERS), votes, shapes


@dataclass(frozen=True)
class Model:
    """reliability[kind, labeler] is the probability that a vote given is right; weights are the classifier's."""

    reliability: np.ndarray
    weights: np.ndarray

    def scores(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of personal data for each pattern."""
        return 1 / (1 + np.exp(-_features(*_unpacked(patterns)) @ self.weights)) if len(patterns) else np.zeros(0)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each pattern, reliability of each labeler) from vote patterns of one kind and how often each stands.

    A candidate is personal data with a share that is estimated too; given that, labelers vote independently, each right with its
    own probability when it votes at all. It starts where most labelers agree.
    """
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    q = 1 / (1 + np.exp(-votes.sum(axis=1)))
    for _ in range(ROUNDS):
        weight, rest = q * counts, (1 - q) * counts
        right = weight @ yes + rest @ no + PRIOR * TRUSTED
        given = counts @ (yes + no) + PRIOR
        reliability = right / given
        share = (weight.sum() + 1) / (counts.sum() + 2)
        fresh = 1 / (1 + np.exp(-(np.log(share / (1 - share)) + votes @ np.log(reliability / (1 - reliability)))))
        change, q = np.abs(fresh - q).max(), fresh
        if change < 1e-9:
            break
    return q, reliability


def fit_model(found: dict[int, int]) -> Model:
    """The model of a corpus from its number of candidates by pattern."""
    patterns = np.array(sorted(found), dtype=np.int64)
    kinds, votes, shapes = _unpacked(patterns)
    counts = np.array([found[int(p)] for p in patterns], dtype=float)
    target, reliability = np.zeros(len(patterns)), np.full((len(KINDS), len(LABELERS)), 0.5)
    for k in range(len(KINDS)):
        if (own := kinds == k).any():
            target[own], reliability[k] = expectation_maximisation(votes[own], counts[own])
    x = _features(kinds, votes, shapes)
    w = np.zeros(x.shape[1] if len(patterns) else 1 + len(KINDS) + 2 * len(LABELERS) + SHAPES)
    if not len(patterns):
        w[0] = -10.0
        return Model(reliability, w)
    for _ in range(100):  # Newton's steps of the ridge regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (target - p)) - RIDGE * counts.sum() * w / len(w)
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + RIDGE * (counts.sum() / len(w) + 1) * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return Model(reliability, w)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of all documents. Each task counts its candidates by pattern; at most PATTERNS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in slices(batches, 0):
            for t in strings(batch.column(0)):
                found.update(c.pattern for c in candidates(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return fit_model({int(p): int(n) for p, n in counted.toPandas().itertuples(index=False)})


def spans(text: str | None, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) of a whole text by kind, then start."""
    found = candidates(text)
    scores = model.scores(np.array([c.pattern for c in found], dtype=np.int64))
    out = [(c.kind, c.start, c.end, True, float(s)) for c, s in zip(found, scores, strict=True) if c.base]
    more = sorted(((c.start, -float(s), c) for c, s in zip(found, scores, strict=True) if not c.base and s >= ACCEPTED and c.votes[3] == 1), key=lambda x: x[:2])
    free = 0
    for start, s, c in more:
        if start >= free:
            free = c.end
            out.append((c.kind, c.start, c.end, False, -s))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def find(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep... and found, an array of (kind, start, end, base, score), of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            got = [[dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in spans(t, model)] for t in strings(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.list_(_SPAN))], [*keep, "found"])

    part = docs.select(*keep, F.col(text).cast("string").alias("text to read"))
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], T.StructField("found", kind)]))


def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: base counts and digest, and all spans, of every document; score is that of its surest span."""
    docs = table(spark, sf_dir, "documents")
    each = find(docs, fit(docs))
    base = F.filter("found", lambda s: s["base"])
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(kind) for kind in BASE_KINDS]
    score = F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0))
    return each.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), score.alias("score"))
