"""Training-data operators on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, components, embeddings, jaccard, langid, licenses, mixing, preferences, quality, registry, rules, urls

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double"
EN, DE = "the cat and the dog went over there with their thing ", "der hund und die katze gehen nicht zu dem schloss "
TEXTS = [None, "", "   ", "x", EN * 20, EN * 20, DE * 20, DE * 30, "!!! 123", "y" * 5000, (EN + DE) * 4000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, {4: "en", 5: "en", 6: "de", 7: "de"}.get(i), [None, "a"][i % 2], 0, 0.5) for i, t in enumerate(TEXTS)], DOC)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_language(spark, docs, none):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(TEXTS)
    assert [got[i].lang_pred for i in (0, 1, 2, 4, 6, 8)] == ["und", "und", "und", "en", "de", "und"]
    assert got[3].lang_pred in ("en", "de") and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def test_a_rare_language_is_learned_and_kept(spark):
    import corpus_pipeline

    fi = "kissa ja koira menivät yhdessä metsään, mutta kukaan ei löytänyt heidän pientä taloaan "
    words = lambda t, i: " ".join(random.Random(i).choices(t.split(), k=12))
    rows = [(i, words(EN if i % 2 else DE, i), "en" if i % 2 else "de", "a", 0) for i in range(6000)] + [(10000 + i, fi * 10, "fi", "a", 0) for i in range(5)] + [(20000, fi, "zz", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(df)
    assert model.languages == ["de", "en", "fi"] and model.default in ("de", "en")
    got = dict(map(tuple, langid.predict(df, model).where("doc_id >= 10000 or doc_id < 2").select("doc_id", "lang_pred").collect()))
    assert [got[i] for i in (0, 1, *range(10000, 10005))] == ["de", "en", *["fi"] * 5]
    assert corpus_pipeline.language(spark, df, "").where("lang = 'fi'").count() == 5


def test_bloom_holds_every_language_of_a_gram():
    grams = np.arange(1, 500, dtype=np.uint64) * np.uint64(0x1234567)
    cells = np.zeros(1 << langid.CELL_BITS, dtype=np.uint64)
    for at in langid._cells(grams):
        cells[at] |= np.uint64(5)
    mask = np.full(len(grams), np.uint64(2**64 - 1))
    for at in langid._cells(grams):
        mask &= cells[at]
    assert (mask == 5).all()


def oracle_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.find("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    given = [None, "", "x", "http://", "http://A.Example.NET/en/1?x", "https://example.net/EN/", "http://net", "http://net/", "ftp://a.org/fr/#", "http://a.org/fr", "http://xorg/fr/", "http://example.com/de/x", "a://b://c.net/", "http://" + "a." * 500 + "net/"] * 2
    df = spark.createDataFrame([(i, u, "host") for i, u in enumerate(given)], "page_id long, url string, host string")
    for r in urls.judge(df, urls.RULES).collect():
        host, path, rule = oracle_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == (urls.RULES[rule] if rule else "allow")
    assert urls.judge(df.limit(0), urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, {}).collect()} == {"allow"}


def test_cascade_is_exact_over_its_keys(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    cascade = urls.build_cascade(keys, listed)
    assert {r.key for r in keys.where(urls.listed(F.col("key"), cascade)).collect()} == set(listed)


def test_mixing(spark, docs, none):
    rows = spark.createDataFrame([(i, "w " * (i % 5), "big" if i % 10 else f"s{i % 30}", i) for i in range(3000)] + [(None, None, None, 1)], "doc_id long, text string, source string, epoch long")
    drawn = mixing.mix(rows).cache()
    totals = {r["source"]: (r.t, r.n) for r in drawn.groupBy("source").agg(F.sum("mix_tokens").alias("t"), F.countDistinct("doc_id").alias("n")).collect()}
    own = {r["source"]: r.n for r in rows.groupBy("source").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert {k: v[1] for k, v in totals.items()} == own  # everything is read
    most = max(drawn.groupBy("doc_id", "source").count().agg(F.max("count")).first()[0], 1)
    assert most <= mixing.REPETITION_LIMIT + 1e-9
    half = mixing.mix(rows, budget=2000)
    assert 1900 <= half.agg(F.sum("mix_tokens")).first()[0] <= 2000
    assert mixing.mix(none).count() == 0
    sources = spark.createDataFrame([("a", 800), ("b", 150), ("c", 50)], "source string, t long")
    x = mixing.exponent_for_entropy(sources, 1000, 1.0)
    w = np.array([0.8, 0.15, 0.05]) ** x
    assert abs(-(w / w.sum() * np.log(w / w.sum())).sum() - 1.0) < 1e-6


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (9, 0), (3, 0), (8, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(TEXTS) and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1]
    assert quality.score(none, model).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_arrays(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + (0.02 * rng.standard_normal(16) if i % 3 else 0)).tolist()) for i in range(600)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None]), (1004, []), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    x = np.array([v for i, v in rows if i < 600])
    hit = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= embeddings.LIMIT
    assert [got[i].n_links for i in range(600)] == (hit.sum(1) - 1).tolist()
    assert all(got[i].component_id == min(np.flatnonzero(hit[i])) for i in range(600))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1006))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_isolated_near_vectors_are_found_as_the_table_grows(spark):
    rng = np.random.default_rng(2)
    n, d = 12000, 32
    x = rng.standard_normal((n, d)) / np.sqrt(d) + 2 * np.eye(d)[0]  # a cone: mean cosine 0.8
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((400, d))
    y -= (y * x[:400]).sum(1)[:, None] * x[:400]
    y = 0.955 * x[:400] + np.sqrt(1 - 0.955**2) * y / np.linalg.norm(y, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    group = dict(map(tuple, embeddings.near_duplicates(df).select("vec_id", "component_id").collect()))
    assert sum(group[i] == group[n + i] for i in range(400)) >= 396
    few = [embeddings.passes_needed(rng.standard_normal((2048, 64)), k) for k in (10_000, 1_000_000, 100_000_000)]
    assert few == sorted(few) and few[0] < few[1] < few[2]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    folder, c = os.environ.get("SF_DIR", "/root/testdata/sf0.001"), duckdb.connect()
    for t in os.listdir(folder):
        c.execute(f"create view {t.split('.')[0]} as select * from '{folder}/{t}'")
    want = c.execute(registry.oracle_sql()[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(k) for k in columns]
    got = registry.queries()[name](spark, folder)
    assert sorted(got.columns) == columns
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


def cone(n, mean, seed, d=64):
    x = np.sqrt(1 - mean) * np.random.default_rng(seed).standard_normal((n, d)) / np.sqrt(d) + np.sqrt(mean) * np.eye(d)[0]
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("mean", [0.88, 0.9, 0.91])
def test_natural_links_in_a_dense_cone_are_found(mean):
    """Links that no one planted, over one sorted list a pass: nearly all lie within one component of what the windows find."""
    x = cone(20000, mean, 0)
    a, b = (np.concatenate(k) for k in zip(*[(i[j > i + s] + s, j[j > i + s]) for s in range(0, len(x), 2000) for i, j in [np.nonzero(x[s : s + 2000] @ x.T >= embeddings.LIMIT)]], strict=True))
    sample = x[np.random.default_rng(1).choice(len(x), embeddings.SAMPLE, replace=False)]
    centre, seen = embeddings._centre(sample), np.zeros(len(a), bool)
    for which in range(embeddings.passes_needed(sample, len(x))):
        place = np.argsort(np.argsort(embeddings._keys(x, which, centre), kind="stable"))
        seen |= np.abs(place[a] - place[b]) <= embeddings.WINDOW
    label, before = np.arange(len(x)), None
    while before is None or (label != before).any():
        before, least = label.copy(), np.minimum(label[a[seen]], label[b[seen]])
        np.minimum.at(label, a[seen], least)
        np.minimum.at(label, b[seen], least)
        label = label[label]
    assert (label[a] == label[b]).mean() >= 0.99


def test_links_in_a_dense_cone_are_counted(spark):
    x = cone(4000, 0.9, 3).astype(np.float32)
    got = dict(map(tuple, embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).select("vec_id", "n_links").collect()))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (y @ y.T >= embeddings.LIMIT).sum(1) - 1
    got = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 1000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_components_of_a_long_chain(spark):
    n = 1 << 14
    order = np.random.default_rng(1).permutation(n)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:], strict=False)], "a long, b long")
    found = components.components(links)
    assert found.count() == n and found.where("component = 0").count() == n
    with pytest.raises(RuntimeError, match="rounds"):
        components.components(links, most_rounds=1)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(0, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 540)]
    parent = list(range(600))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a int, b int")).collect()))
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}


def test_bpe_matches_the_library(spark, docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    odd = ["".join(rng.choice("abcéß日😀 \n\t#1<|>") for _ in range(rng.randrange(400))) for _ in range(40)] + ["<|endoftext|>", "é" * 900, " " * 700]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    both = bpe.unpack(bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN))
    texts = dict(map(tuple, df.collect()))
    for r in both.collect():
        assert r.token_ids == library.encode_ordinary(texts[r.doc_id] or ""), r.doc_id
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert bpe.encode(none, RANKS, PATTERN).count() == 0


def test_preferences(spark):
    turn = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (3, 0, "user", "same"), (None, 0, "user", "x")], turn)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no!"), (3, 0, "user", "same")], turn)
    got = {r.pair_id: r for r in preferences.format_pairs(a, b).collect()}
    assert got[1].prompt == "<|user|>\nhi<|end|>\n" and got[1].prompt_turns == 1
    assert got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].rejected == "<|assistant|>\nno!<|end|>\n"
    s = [x for x in got[1].chosen_spans if x.trained]
    assert [got[1].chosen[x.start : x.end] for x in s] == ["yes<|end|>\n"]
    assert got[2].prompt == "" and got[2].rejected == "" and got[3].chosen == "" and None not in got
    assert preferences.format_pairs(a.limit(0), b.limit(0)).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, docs, none):
    rng = random.Random(7)
    odd = ["".join(rng.choice("ab #|\n\té\u2028\x1c") for _ in range(200)) for _ in range(200)] + TEXTS[:-1]
    assert [rules.counts(t) for t in odd] == [brute_counts(t) for t in odd]
    refs = rules.learn(docs)
    got = {r.doc_id: r for r in rules.judge(docs, refs).collect()}
    assert got[0].base_failed and not got[0].kept and got[0].n_words == 0 and len(got) == len(TEXTS)
    assert rules.judge(none, refs).count() == 0 and rules.judge(docs, rules.learn(none)).count() == len(TEXTS)
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert rules.divergence(p, q) == pytest.approx(1.0) and rules.divergence(p, p) == 0


def test_rules_of_a_rare_language(spark):
    rng = random.Random(13)
    tongue = lambda letters: ["".join(rng.choices(letters, k=6)) for _ in range(60)]
    common, rare, rarest = tongue("abcdefgh"), tongue("ijklmnop"), tongue("qrstuvwx")
    text = lambda words, n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(common, 60), "common") for i in range(5000)]
    rows += [(10000 + i, text(rare, 800), "rare") for i in range(3)] + [(20000, text(rarest, 100), "rarest"), (30000, text(rarest, 100), None), (40000, text(rarest, 800), "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = rules.learn(df)
    assert refs.languages == ["common", "rare"]
    words = Counter(w.encode() for _, t, a in rows if a == "rare" for w in t.split())
    assert set(refs.words[1]) == {w for w, n in words.items() if n * 500 >= words.total()}
    got = {r.doc_id: r for r in rules.judge(df, refs).collect()}
    assert all(got[i].kept and got[i].nearest == "rare" for i in range(10000, 10003))
    assert got[20000].kept and got[20000].nearest is None and not got[30000].kept and got[30000].nearest is not None
    for i in (0, 10001, 30000):  # against the plain definition
        t = next(t for k, t, _ in rows if k == i).encode()
        n, p = len(t.split()), rules._class_counts(t.decode(), rules._bytes(t))
        q = [np.array([0, *(t.split().count(w) for w in held)]) / n for held in refs.words]
        q = [x + (1 - x.sum()) * (np.arange(len(x)) == 0) for x in q]
        both = [(rules.divergence(p / p.sum(), refs.classes[k]), rules.divergence(q[k], refs.shares[k])) for k in range(2)]
        best = min(both, key=lambda x: max(x[0] / rules.MOST_CLASS_DISTANCE, x[1] / rules.MOST_WORD_DISTANCE))
        assert (got[i].class_distance, got[i].word_distance) == pytest.approx(best)


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for x, i in enumerate(keys):
        for j in keys[x + 1 :]:
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_is_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    common = rng.choices(words, k=60)
    texts = {0: None, 1: "", 2: " \n", 3: "One two", 4: "one TWO", 5: "one two three", 6: "a " * 50}
    for g in range(12):
        own = rng.choices(words, k=rng.randrange(20, 90))
        for _ in range(rng.randrange(1, 12)):
            t = list(own)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[len(texts)] = " ".join(t)
    for _ in range(60):  # many documents that are mostly one passage
        texts[len(texts)] = " ".join(common + rng.choices(words, k=rng.randrange(12, 22)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n", F.lit("x"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect()} == brute_components(texts)
    assert jaccard.components_of(df.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    assert licenses.scan("SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)\n GPL")[5] == "apache-2,gpl-2,mit"
    assert licenses.evaluate("GPL-3.0 AND MIT") == ({"gpl-3", "mit"}, False) and licenses.evaluate("GPL-3.0 OR MIT")[1]
    assert licenses.evaluate(")(")[0] == set() and licenses.to_postfix("a OR b AND c") == ["a", "b", "c", "AND", "OR"]
    assert licenses.scan("CC BY-NC cc by nc. Under THE MIT License!")[:5] == (10, 3, 0, 6, "cc-by-nc,mit")
    assert licenses.scan("undér the mit license; under the mit licensee")[1] == 0
    assert licenses.scan(None) == licenses.scan("") == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan_licenses(docs).count() == len(TEXTS) and licenses.scan_licenses(none).count() == 0


def test_license_verdict_of_many_alternatives():
    groups = " AND ".join(f"(MIT OR x{i})" for i in range(300))
    assert licenses.evaluate(groups) == ({"mit", *(f"x{i}" for i in range(300))}, True)
    assert not licenses.evaluate(groups + " AND GPL-3.0")[1]
    assert licenses.scan(f"SPDX-License-Identifier: {groups}")[6] == 0.5
    assert licenses.evaluate("MIT WITH x OR GPL-3.0") == ({"mit", "gpl-3"}, True) and licenses.evaluate("") == (set(), False)


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert 0 < docs.count() <= 2 * before and docs.where("n_tokens * 4 <> octet_length(ids)").count() == 0


def test_registered():
    assert [sum(n.startswith(f"op{k}_") for n in registry.queries()) for k in range(1, 11)] == [1] * 10
