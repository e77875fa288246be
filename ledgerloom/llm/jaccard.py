"""Exact n-gram Jaccard join of documents in metric space: pivots, their Voronoi regions, and windows.

A document is the set of its distinct n-word shingles, as 64-bit hashes; d(x, y) = 1 - |x & y| / |x | y| is a metric,
and documents link where d <= RADIUS = 0.25.

1. *Equal sets* are one class.
2. *Pivots and Voronoi regions.* Min-hash bands bring classes together, and each band's group elects a pivot. The
   distance of every member from its pivots is measured; a class belongs to the region of its nearest pivot, and by the
   triangle inequality it is replicated to the region of every pivot q with d(x, q) - d(x, nearest) <= 2 * RADIUS. Classes
   within RADIUS of a pivot are linked to it. A group of any size costs one row and one measured distance a member.
3. *Regions join recursively.* In each region the members not yet united with the pivot elect one of them as a new
   pivot r; by the triangle inequality only members y with |d(y, q) - d(r, q)| <= RADIUS can link with it, and only
   these are measured. That gives the regions of the next level.
4. *The region at distance one.* Most documents share no shingle with any pivot. There every window is the whole
   region, and the inequality excludes nothing, so this region, and what links across regions, is joined by the
   exact bound on sets instead: |x ^ y| <= RADIUS * |x | y|, so linked sets share one of the first |x| - ceil(0.75 |x|) + 1
   shingles of any common order. A document is replicated to the groups of these shingles only, and of |x| / SPARE more:
   with k more on both sides, linked sets share k + 1. The order puts frequent shingles last (found on a bounded sample,
   which changes the work but never the result). Within a shingle's group only pairs that step 3 has not united, and whose sizes allow
   a link, are compared. If that would be too many, the shingle is put off. A document with no more shingles put off
   than the spare ones has met all it could link with at another shingle; for the rest, shingles put off move to
   the end of the order and these documents are replicated anew. What is left after the rounds are documents
   that consist of frequent shingles for more than a quarter: each group of them that hangs together by shared prefix shingles
   is cut into blocks, and every two blocks meet in one task, which measures whole sets and returns what to unite,
   not pairs. Two linked documents have met unless both have more shingles put off than spare, and then both are in the
   next round. So no link is lost.

Distances are measured on whole sets. Classes are then united over all links.

Defined results: a text without words, or null, has an empty set and links with nothing; one with fewer than n words
has one shingle, its whole sequence. Repeated documents are one class. A doc_id that stands with several texts
counts as the one whose set has the least hash, in all its rows; a row of a null doc_id has no shingles and a null component.
An empty table gives an empty result. Very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, slices, strings, table
from .components import components
from .embeddings import _runs

WORDS, PERCENT = 5, 75
#: Bands and min-hashes in a band.
BANDS, ROWS = 8, 4
#: Expected documents and least count of the sample that finds frequent shingles, and how many of these are told apart.
SAMPLE_DOCS, SAMPLE_COUNT, MOST_FREQUENT = 5_000, 5, 200_000
#: Levels of regions below the first; another follows only if one found this share of what it measured near.
LEVELS, LEVEL_YIELD = 2, 0.05
#: Rows of one side of a distance join that meet in one group.
SALT_ROWS = 256
#: Bits of the filter of wanted documents for each of them, and at most.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27
#: A document has one spare prefix shingle for so many of its set.
SPARE = 16
#: A shingle is put off to the next round if it would compare more pairs than this; rows of a group held at most; rounds; rows and shingles of a block after them.
MOST_PAIRS, MOST_HELD, ROUNDS, BLOCK, BLOCK_SHINGLES = 64, 4096, 2, 512, 500_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLY
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted hashes (uint64) of a whole text's set."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(w))
    h = np.full(len(w) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = _mix(h) + w[k : len(w) - width + 1 + k]
    return np.unique(_mix(h))


def _prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles that decide where a set is replicated to: the first ones, frequent ones last."""
    size = len(s) - -(-len(s) * PERCENT // 100) + 1 + len(s) // SPARE
    if len(frequent) and len(s):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
        s = np.concatenate([s[~often], s[often]])
    return s[:size]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _set(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint64)


def _hash(s: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=seed)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _describe(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n, h1, h2 (of the set), bands, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, h1, h2, bands, prefixes = [], [], [], [], []
            for text in strings(batch.column(1)):
                s = shingles(text)
                n.append(len(s))
                h1.append(_hash(s))
                h2.append(_hash(s, 1))
                prefixes.append(_prefix(s, frequent.value))
                if not len(s):
                    bands.append(s)
                    continue
                least = np.min([(_A[:, None] * s[None, at : at + 20_000] + _B[:, None]).min(1) for at in range(0, len(s), 20_000)], axis=0).reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    key = _mix(key) + least[:, k]
                bands.append(_mix(key))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _longs(h1), _longs(h2), _lists(bands), _lists(prefixes)], ["doc_id", "n", "h1", "h2", "bands", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>, prefix array<long>")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs that may have one of ids (doc_id): by a Bloom filter of one hash, joined as at most MOST_FILTER_BITS / 64 broadcast rows, so that texts are not shuffled."""
    bits = 1 << min(MOST_FILTER_BITS, max(1 << 16, FILTER_BITS * ids.count())).bit_length() - 1
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    return docs.join(F.broadcast(words), (F.shiftright(slot, 6) == F.col("word")) & (F.getbit("bits", (slot % 64).cast("int")) == 1), "left_semi")


def _sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, n, s) of the classes named by ids (doc_id), one row each; s is the sorted set as packed 64-bit integers. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [shingles(t) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), _longs([_hash(s) for s in found]), pa.array([s.tobytes() for s in found], pa.binary())], ["doc_id", "n", "h1", "s"])

    ids = materialise(classes.select("doc_id", "h1").join(ids, "doc_id", "left_semi"), "ids")
    read = _only(docs, ids).mapInArrow(run, "doc_id long, n long, h1 long, s binary")
    sets = materialise(read.join(ids, ["doc_id", "h1"], "left_semi").drop("h1").dropDuplicates(["doc_id"]), "sets")
    discard(ids)
    return sets


def _frequent_on_sample(docs: DataFrame) -> np.ndarray:
    """Shingles that a bounded sample holds often: an order of work, never a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for text in strings(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], ["s"])

    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_DOCS / max(1, n))))
    return _top(part.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= SAMPLE_COUNT))


def _top(counts: DataFrame) -> np.ndarray:
    top = counts.orderBy(F.desc("c"), "s").limit(MOST_FREQUENT).select("s").toPandas()["s"]
    return np.sort(top.to_numpy(dtype=np.int64).view(np.uint64))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, d): distances of pairs from both packed sets."""
    for batch in slices(slices(batches, 2), 3):
        d = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = _set(x), _set(y)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            n = int((both[1:] == both[:-1]).sum())
            near = 100 * n >= PERCENT * (len(x) + len(y) - n)
            d.append((near, 1 - n / max(1, len(x) + len(y) - n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in d], pa.bool_()), pa.array([x for _, x in d], pa.float64())], ["a", "b", "near", "d"])


def _measured(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, near, d) of the pairs, measured on their whole sets. A b of many pairs is salted, so its pairs are many groups."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    with_b = shares.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
    with_a = salted.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
    both = with_a.join(with_b, ["b", "salt"]).select("a", "b", "x", "y")
    return materialise(both.mapInArrow(_common, "a long, b long, near boolean, d double"), "measured")


def _in_regions(distances: DataFrame) -> DataFrame:
    """(x, q, d): the class x in the region of its nearest pivot, and in those that the window of 2 * RADIUS reaches; a pivot in its own."""
    own = distances.select(F.col("b").alias("x"), F.col("b").alias("q"), F.lit(0.0).alias("d"))
    every = distances.select(F.col("a").alias("x"), F.col("b").alias("q"), "d").union(own).groupBy("x", "q").agg(F.min("d").alias("d"))
    nearest = every.groupBy("x").agg(F.min("d").alias("least"))
    return every.join(nearest, "x").where(F.col("d") - F.col("least") <= 2 * (1 - PERCENT / 100)).select("x", "q", "d")


def _voronoi(docs: DataFrame, classes: DataFrame, trace: list | None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found through pivots, and the (node, component) that these make."""
    banded = classes.select("doc_id", "n", F.explode("bands").alias("band"))
    pivots = banded.groupBy("band").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("p"), F.count("*").alias("c")).where("c > 1").select("band", "p")
    fits = lambda a, b, percent: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    first = banded.join(pivots, "band").where((F.col("doc_id") != F.col("p.doc_id")) & fits(F.col("n"), F.col("p.n"), 2 * PERCENT - 100))
    pairs = materialise(first.select(F.col("doc_id").alias("a"), F.col("p.doc_id").alias("b")).distinct(), "pairs")
    sets = _sets(docs, classes, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())  # no level names others
    links, found = None, None
    for level in range(LEVELS + 1):
        measured = pairs.count()
        if not measured:
            break
        distances = _measured(sets, pairs)
        near = distances.where("near").select("a", "b")
        links = near if links is None else links.union(near)
        got = near.count()
        if trace is not None:
            trace.append((f"level {level}", measured, got))
        before, found = found, materialise(components(near if found is None else near.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))), "regions")
        discard(pairs, *([before] if before is not None else []))
        pairs = None
        if level == LEVELS or got < LEVEL_YIELD * measured:
            break
        # members of a region that its pivot's links have not reached elect the pivot of the next level
        united = found.select(F.col("node").alias("x"), "component")
        members = _in_regions(distances).join(united, "x", "left").withColumn("component", F.coalesce("component", "x"))
        members = materialise(members.join(classes.select(F.col("doc_id").alias("x"), "n"), "x"), "members")
        of_pivot = members.where("x = q").select("q", F.col("component").alias("own"))
        elected = members.join(of_pivot, "q").where("component <> own").groupBy("q").agg(F.min_by(F.struct("x", "d", "n", "component"), F.xxhash64("x", "q")).alias("r"))
        window = members.join(elected, "q").where((F.col("component") != F.col("r.component")) & (F.abs(F.col("d") - F.col("r.d")) <= 1 - PERCENT / 100 + 1e-9) & fits(F.col("n"), F.col("r.n"), PERCENT))
        pairs = materialise(window.select(F.col("x").alias("a"), F.col("r.x").alias("b")).distinct(), "pairs")
        discard(members)
    discard(sets)
    empty = classes.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where(F.lit(False))
    if links is None:
        links = empty
    return links, found if found is not None else empty.toDF("node", "component")


_MET = ["a", "b", "n_a", "n_b", "shared", "kind"]
_PAIR, _LATE, _HELD = 0, 1, 2


def _met(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *[pa.nulls(n, pa.int64())] * (5 - len(columns)), pa.array(np.full(n, kind, np.int32))], _MET)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    both, shared = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
    return _met(_PAIR, *both, shared)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle: pairs of different regions with their sizes and number of shared prefix shingles (kind 0);
    shingles put off, with a count of rows (kind 1), and their documents (kind 2: doc_id, shingle, n).

    At most MOST_HELD rows of a shingle are held: with more, and more than one region, it is put off whatever follows.
    """
    held = np.zeros((4, 0), dtype=np.int64)
    hot: list[int] | None = None  # the shingle under way when it is too long to hold: shingle, least and greatest region, rows
    found: list[np.ndarray] = []
    size = 0

    def close(group: list[int]) -> Iterator[pa.RecordBatch]:
        if group[1] != group[2]:
            yield _met(_LATE, np.array([group[0]]), np.array([group[3]]))

    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(4)])
        if hot is not None:
            end = int(np.searchsorted(rows[0], hot[0], side="right")) if rows.shape[1] and rows[0, 0] == hot[0] else 0
            if end:
                hot = [hot[0], min(hot[1], int(rows[1, :end].min())), max(hot[2], int(rows[1, :end].max())), hot[3] + end]
                yield _met(_HELD, rows[2, :end], rows[0, :end], rows[3, :end])
            rows = rows[:, end:]
            if not rows.shape[1]:
                continue
            yield from close(hot)
            hot = None
        rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        cut = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        held = rows[:, cut[-1] :]
        for out in _groups(rows[:, : cut[-1]], cut[:-1], found):
            yield out
        size = sum(x.shape[1] for x in found)
        if size > 200_000:
            yield _pairs(found)
            found.clear()
        if held.shape[1] > MOST_HELD:
            hot = [int(held[0, 0]), int(held[1].min()), int(held[1].max()), held.shape[1]]
            yield _met(_HELD, held[2], held[0], held[3])
            held = held[:, :0]
    if hot is not None:
        yield from close(hot)
    if held.shape[1]:
        yield from _groups(held, np.zeros(1, dtype=np.int64), found)
    if found:
        yield _pairs(found)


def _groups(rows: np.ndarray, cut: np.ndarray, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Adds to found the pairs (a, b, n_a, n_b) of whole groups; gives back what is put off."""
    if not len(cut):
        return
    token, region, doc, n = rows
    mixed = np.minimum.reduceat(region, cut) != np.maximum.reduceat(region, cut)
    ends = np.concatenate([cut[1:], [len(token)]])
    late: list[tuple[int, int]] = []
    for s, e in zip(cut[mixed], ends[mixed], strict=True):
        if e - s > 2 * MOST_PAIRS:  # of two regions at least, so of more pairs than that
            late.append((s, e))
            continue
        i, j = np.triu_indices(e - s, 1)
        i, j = i + s, j + s
        other = region[i] != region[j]
        if int(other.sum()) > MOST_PAIRS:
            late.append((s, e))
            continue
        other &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        i, j = i[other], j[other]
        a, b = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
        found.append(np.stack([doc[a], doc[b], n[a], n[b]]))
    if late:
        yield _met(_LATE, token[[s for s, _ in late]], np.array([e - s for s, e in late]))
        at = np.concatenate([np.arange(s, e) for s, e in late])
        yield _met(_HELD, doc[at], token[at], n[at])


def _could_link(met: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose shared prefix shingles leave a link possible.

    Up to the end of the prefix that ends first both sets are known, so what they share is at most the shared prefix
    shingles and what that set has behind its prefix. A link needs 75 / 175 of both sizes together. Shingles put off
    are not in the count, and spare ones are counted as if they stood behind: a pair shares no more of the former than
    there are of the latter, or both are met again in the next round.
    """
    pairs = met.where(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("shared").alias("shared"))
    behind = lambda n: F.ceil(n * PERCENT / 100) - 1
    most = F.col("shared") + F.greatest(behind(F.col("n_a")), behind(F.col("n_b")))
    return pairs.where((100 + PERCENT) * most >= PERCENT * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _window_join(documents: DataFrame) -> DataFrame:
    """Brings the documents of each prefix shingle together and joins these groups."""
    ordered = documents.select(F.explode("prefix").alias("token"), "region", "doc_id", "n").repartition("token").sortWithinPartitions("token")
    return ordered.mapInArrow(_meet, "a long, b long, n_a long, n_b long, shared long, kind int")


def _linked(sets: list[bytes], n: np.ndarray) -> np.ndarray:
    """Which of the sets link, as a square matrix; a shingle of one set only is in no intersection and is left out."""
    flat, owner = _set(b"".join(sets)), np.repeat(np.arange(len(n)), n)
    _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts > 1
    owner, at = owner[often[at]], (np.cumsum(often) - 1)[at[often[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    shared = np.zeros((len(n), len(n)), dtype=np.float32)
    for first in range(0, int(often.sum()), 4096):
        s, e = np.searchsorted(at, [first, first + 4096])
        held = np.zeros((len(n), 4096), dtype=np.float32)
        held[owner[s:e], at[s:e] - first] = 1
        shared += held @ held.T
    return 100 * shared >= PERCENT * (n[:, None] + n[None, :] - shared).astype(np.float64)


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): regions that links of each two blocks' documents bring together, no more than a row a document."""
    for whole in _runs(batches, 3):
        whole = whole.combine_chunks()
        group = np.stack([whole[c].to_numpy() for c in ("part", "low", "high")])
        cut = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
        for s, e in zip(cut, [*cut[1:], whole.num_rows], strict=True):
            part = whole.slice(s, e - s)
            n, region = part["n"].to_numpy(), part["region"].to_numpy()
            linked = _linked(part["s"].to_pylist(), n) | (region[:, None] == region[None, :])
            label, before = region, None
            while before is None or (label != before).any():
                before, label = label, np.where(linked, label[None, :], label[:, None]).min(1)
            found = np.unique(np.stack([region, label])[:, region != label], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])


def _block_join(docs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b): regions to unite for the links among documents (doc_id, n, region, prefix) that share a prefix shingle, measured on whole sets."""
    rows = documents.select(F.explode("prefix").alias("token"), "doc_id", "region")
    least = rows.groupBy("token").agg(F.min("doc_id").alias("m"), F.min("region").alias("r"), F.max("region").alias("q")).where("r <> q").select("token", "m")
    hangs = components(rows.join(least, "token").select(F.col("doc_id").alias("a"), F.col("m").alias("b")).distinct())
    hung = documents.select("doc_id", "n", "region").join(hangs.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id")
    sizes = hung.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    hung = materialise(hung.join(sizes, "part"), "hung")
    sets = _sets(docs, classes, hung.select("doc_id"))
    placed = hung.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).join(sets.select("doc_id", "s"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select("part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", "n", "region", "s")
    ordered = met.repartition("part", "low", "high").sortWithinPartitions("part", "low", "high")
    near = materialise(ordered.mapInArrow(_links_in_blocks, "a long, b long").distinct(), "near")
    discard(hung, sets)
    return near


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", trace: list | None = None) -> DataFrame:
    """Result: doc_id, n_shingles, component_id. A list given as trace gets (step, pairs measured, links) of each step."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    given = docs.where("doc_id is not null")
    context = docs.sparkSession.sparkContext
    frequent = _frequent_on_sample(given)
    described = materialise(_describe(given, context.broadcast(frequent)), "described")
    own = materialise(described.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("o")).select("doc_id", "o.*"), "own")
    least = own.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    classes = described.select("doc_id", "h1", "h2", "n", "bands").join(least, ["doc_id", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"])
    classes = materialise(classes, "classes")

    links, regions = _voronoi(given, classes, trace)
    class_regions = classes.select("doc_id", "h1").join(regions.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "h1", F.coalesce("component", "doc_id").alias("region"))
    class_regions = materialise(class_regions, "class-regions")

    # the region at distance one, and what links across regions
    documents = described.select("doc_id", "h1", "n", "prefix").join(class_regions, ["doc_id", "h1"])
    for k in range(ROUNDS + 1):
        if k == ROUNDS:
            near = _block_join(given, classes, documents)
            links = links.union(near)
            if trace is not None:
                trace.append(("blocks", documents.count(), near.count()))
            break
        met = materialise(_window_join(documents), "met")
        discard(described)
        fresh = materialise(_could_link(met), "pairs")
        if not fresh.isEmpty():
            sets = _sets(given, classes, fresh.select(F.col("a").alias("doc_id")).union(fresh.select("b")).distinct())
            near = _measured(sets, fresh).where("near").select("a", "b")
            links = links.union(near)
            if trace is not None:
                trace.append((f"prefix {k}", fresh.count(), near.count()))
            discard(sets)
        discard(fresh)
        late = materialise(met.where(F.col("kind") == _LATE).select(F.col("a").alias("s"), F.col("b").alias("c")), "late")
        if late.isEmpty():
            break
        put_off = met.where(F.col("kind") == _HELD).select(F.col("a").alias("doc_id"), F.col("b").alias("s"), F.col("n_a").alias("n"))
        put_off = put_off.join(late, "s", "left_semi").groupBy("doc_id", "n").agg(F.count("*").alias("put_off"))
        least_partner = F.ceil(F.col("n") * PERCENT / 100)  # no linked set is smaller, so none has fewer spare shingles than this one would
        again = materialise(put_off.where(F.col("put_off") > F.floor(least_partner / SPARE)).select("doc_id"), "again")
        frequent = np.union1d(frequent, _top(late))
        discard(met, late)
        described = materialise(_describe(_only(given, again), context.broadcast(frequent)).select("doc_id", "h1", "n", "prefix"), "described")
        documents = described.join(class_regions.join(again, "doc_id", "left_semi"), ["doc_id", "h1"])
    found = materialise(components(links).withColumnRenamed("node", "class_id"), "found")
    discard(described, class_regions, regions)

    # one narrow row a class; a hot class is many rows on the other side only
    of_class = classes.select("h1", "h2", F.col("doc_id").alias("class_id")).join(found, "class_id", "left").select("h1", "h2", F.coalesce("component", "class_id").alias("component_id"))
    own = own.join(of_class, ["h1", "h2"], "left").select("doc_id", "n", "component_id")
    out = docs.select("doc_id").join(own, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: set size and component of every document."""
    return components_of(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle and every document reachable from each. For small tables.
ORACLE = r"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
  placed as (select doc_id, len(w) n, unnest(w) word, generate_subscripts(w, 1) place from words),
  runs as (select doc_id, n, place, concat_ws(' ', word, lead(word, 1) over run, lead(word, 2) over run, lead(word, 3) over run, lead(word, 4) over run) sh from placed window run as (partition by doc_id order by place)),
  held as (select distinct doc_id, sh from runs where place <= greatest(1, n - 4)),
  sizes as (select doc_id, count(sh) n from documents left join held using (doc_id) group by doc_id),
  links as (select x.doc_id a, y.doc_id b from held x join held y on x.sh = y.sh and x.doc_id <> y.doc_id join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
    group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 75 * (p.n + q.n - count(*))),
  reached as (select doc_id, doc_id other from documents union select doc_id, b from reached join links on a = other)
select doc_id, any_value(n) n_shingles, min(other) component_id from reached join sizes using (doc_id) group by doc_id"""
