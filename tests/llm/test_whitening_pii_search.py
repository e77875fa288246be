"""Whitening, personal data and ranked search against plain versions, and their defined results of odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import lexical, pii, whitening

VEC = "vec_id long, embedding array<float>, component int, x int"


def vectors(d: int, n: int, seed: int = 1) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * 0.3).astype(np.float32).tolist()


def test_outer_products_are_exact_to_twice_double_precision():
    rng = np.random.default_rng(1)
    x = rng.integers(999_000, 1_001_000, (5000, 4))
    mean = [Fraction(int(s), len(x)) for s in x.sum(0)]
    first = np.array([float(m) for m in mean])
    c, e = whitening.two_sum(x.astype(float), -first[None, :])
    high, low = whitening.outer_products(*whitening.two_sum(c, e - np.array([float(m - Fraction(float(m))) for m in mean])[None, :]))
    for i in range(4):
        for j in range(4):
            want = sum((int(r[i]) - mean[i]) * (int(r[j]) - mean[j]) for r in x[:, [i, j] if i != j else [i, i]].tolist() for r in [{i: r[0], j: r[1]}])
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want) < Fraction(1, 2**60)


def test_whitening_equals_a_plain_version(spark):
    lists = vectors(6, 400)
    rows = [(i, v, 0, 0) for i, v in enumerate(lists)]
    rows += [(900, lists[3], 0, 0), (900, lists[3], 0, 0), (None, lists[4], 0, 0)]  # repeated vectors count once in the fit
    rows += [(901, None, 0, 0), (902, [float("nan")] * 6, 0, 0), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, 0), (904, [float("inf")] + [0.0] * 5, 0, 0), (905, [1.0, 2.0], 0, 0), (906, [], 0, 0)]
    got = whitening.whiten(spark.createDataFrame(rows, VEC)).collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in lists])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s).astype(np.longdouble) / n
    v = np.array((centred.T @ centred) / n, dtype=float)
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == 403 * 6 and {r.n for r in got} == {n}
    assert not {r.vec_id for r in got} & set(range(901, 907))
    by = {(r.vec_id, r.component): r for r in got}
    for i in (0, 3, 399):
        assert by[i, 1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))
    w = np.array([[by[i, k].whitened for k in range(1, 7)] for i in range(400)])
    assert np.allclose([by[0, k].explained for k in range(1, 7)], values / v.trace(), rtol=1e-12)
    white = np.array([w[np.flatnonzero((x == r).all(1))[0]] for r in fit])
    assert np.abs(white.T @ white / n - np.eye(6)).max() < 1e-9
    back = w @ np.diag(np.sqrt(values)) @ (np.linalg.pinv(np.diag(np.sqrt(values))) @ np.linalg.lstsq(w, (n * x - s) / n, rcond=None)[0])
    assert np.allclose(back, (n * x - s) / n, atol=1e-6)  # all components together give the vectors back
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert by[900, 2].whitened == by[3, 2].whitened == by[900, 2].whitened and sum(r.vec_id is None for r in got) == 6


def test_whitening_of_few_and_of_dependent_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame([(i, v, 0, 0) for i, v in enumerate(rows)], VEC))
    assert make([]).count() == 0 and make([[1.0, 2.0]] * 3).count() == 0
    line = make([[float(i), 2.0 * i, -1.0 * i] for i in range(10)]).collect()  # one direction only
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-9
    assert make([]).columns == make([[0.0, 1.0], [1.0, 0.0]]).columns
    many = make(vectors(20, 100)).collect()
    assert {r.component for r in many} == set(range(1, 17))
    with pytest.raises(Exception, match="too large"):
        make([[1e30, 0.0], [0.0, 1.0]]).count()


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a.b", "@", "@@", "x_y", "mail.example.com", ".", "-", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4539 1488 0343 6467", "4539148803436467", "+1 (988) 555-2485", "+49", "(", ")", " ", "\n", "é", "漢", "12", "7-7", "%", "..", "a@b.c", "_d@e.f", "1"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    for long in ("a" * 300_000, "@" * 100_000, "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "1 " * 100_000, "a@" * 100_000):
        pii.candidates(long)


def test_personal_data_of_a_corpus(spark):
    rng = random.Random(1)
    prose = "the river ran by the old house and nobody saw the cat".split()
    said = ["mail me at jo.doe@mail.example.com today", "server 10.20.30.40 is down", "my card 4539148803436467 expired", "call +1 (988) 555-2485 now"]
    texts = [" ".join(rng.choices(prose, k=12) + ([said[i % 4]] if i % 3 else []) + rng.choices(prose, k=5)) for i in range(300)]
    texts += ["please call 988 555 2485 tonight", "phone: (988) 555-2486", "write to jane at mail dot example dot com", "Dear Mr. John Smith of the hill", "order 4041894974608795 shipped", "item 988 555 2485", "see version 1.2.3.4 notes", None, "", "  "]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, said[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, score string")
    model = pii.fit(docs)
    got = {r.doc_id: [tuple(s)[:4] for s in r.found] for r in pii.find(docs, model).collect()}
    assert len(got) == len(texts) + 1 and pii.find(docs, model).count() == len(rows)
    for i, t in enumerate(texts):
        assert [s[:3] for s in got[i] if s[3]] == brute_spans(t or "")
    text_of = lambda i: [(s[0], texts[i][s[1] : s[2]]) for s in got[i] if not s[3]]
    assert text_of(300) == [("phone", "988 555 2485")] and text_of(301) == [("phone", "(988) 555-2486")]
    assert text_of(302) == [("email", "jane at mail dot example dot com")] and text_of(303) == [("name", "John Smith")]
    assert not any(text_of(i) for i in (*range(300), 304, 305, 306))
    assert got[307] == got[308] == got[309] == []
    assert (model.reliability[2] >= 0.4).all()  # no labeler is held for a liar
    empty = pii.fit(docs.limit(0))
    assert pii.find(docs.limit(0), empty).count() == 0 and pii.spans("call 988 555 2485", empty) == []
    assert [s[:3] for s in pii.spans(said[0], empty)] == brute_spans(said[0])


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.6, 0.7, 0.55])
    votes = np.where(rng.random((len(truth), 6)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    q, reliability = pii.expectation_maximisation(patterns, counts)
    assert np.abs(reliability - right).max() < 0.03
    best = ((np.log(0.4 / 0.6) + votes @ np.log(right / (1 - right)) > 0) == truth).mean()  # with the true reliabilities
    assert ((q[place.ravel()] > 0.5) == truth).mean() > best - 0.003
    code = lambda v: pii.Candidate("card", 0, 1, False, tuple(int(x) for x in v), 0).pattern
    model = pii.fit_model({code(p): int(c) for p, c in zip(patterns, counts, strict=True)})
    scores = model.scores(np.array([code(p) for p in patterns]))
    assert ((scores[place.ravel()] > 0.5) == truth).mean() > best - 0.01  # the classifier, trained without the truth


def test_pii_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.c, d@e.f and 1.2.3.4"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.pii_query(spark, str(tmp_path)).collect()}
    base = "email:0:5,email:7:12,ip:17:24"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 1, 0, 0)
    assert got[1].spans == base and got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and 0 <= got[1].score <= 1 and got[2].score == 0


def brute_search(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    own = [(k, Counter(words(t)), len(words(t))) for k, t in docs if words(t)]
    many, total = len(own), sum(n for _, _, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    asked: dict = {}
    for k, t in items:
        asked.setdefault(k, Counter()).update(words(t))
    out = []
    for item, times in asked.items():
        found = []
        for place, (k, tf, n) in enumerate(own):
            m = 75 + 25 * n * many // total
            score = sum(q * math.floor(1000 * math.log((2 * many + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w, q in times.items() if w in tf)
            if score > 0:
                found.append((-score, k is None, k or 0, place, k, score))
        out += [(item, r + 1, x[4], x[5]) for r, x in enumerate(sorted(found)[:top])]
    return out


def test_search_equals_a_plain_version(spark):
    rng = random.Random(2)
    words = ["cat", "dog", "House", "río", "42", "über", "x"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "!!! ..."), (403, "cat " * 5000), (404, docs[5][1]), (405, docs[5][1]), docs[6], docs[6], (None, docs[7][1]), (500, "CAT-dog_house"), (501, "a" * 200_000)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(20, "cat cat CAT"), (21, None), (22, "?"), (23, "nowhere"), (24, "dog"), (24, "cat")]
    a = spark.createDataFrame([(*d, 1, "t", 2) for d in docs], "doc_id long, text string, place int, term string, n int").repartition(5)
    b = spark.createDataFrame([(*x, 3) for x in items], "item_id long, text string, score int")
    got = lexical.ranked_search(a, b)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_search(docs, items, lexical.TOP), key=key)
    assert lexical.ranked_search(a.limit(0), b).count() == 0 and lexical.ranked_search(a, b.limit(0)).count() == 0
    whole = lexical.postings(a)
    assert whole.where("term is not null").count() == sum(len(set(lexical.terms(t))) for _, t in docs)
