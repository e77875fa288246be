"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class, so a very common vector is one row. In each pass a class gets a key of 64 sign bits of
random projections; rows are range-partitioned and sorted by (pass, key), so vectors whose keys share a long prefix
are neighbours, and each row is compared with the WINDOW rows after it. Pairs of cosine >= limit, verified in
double precision, are united over all passes. Then each component counts its links exactly: its classes are cut into
blocks of about BLOCK rows and every two blocks of a component meet in one task, which returns counts, not pairs. So
the window bounds the search, not the links of a group once it is found.

Keys are made of unit vectors less their mean, so that a direction that all share takes no bits; cosines are those of the
vectors as they are. For a pair whose vectors so centred have cosine c one key bit is equal with probability
1 - acos(c) / pi, and a window of W is reached if as many leading bits agree as leave W rows, in any pass: about
log2(n / W) bits of n classes, more where some vectors crowd. The bits and, for a pair at the limit, c are measured on a
sample, and passes are made until such a pair of the classes that are found least, a share of HARDEST, is found with
probability RECALL; so their number grows with the table. They run PASSES at a time, which bounds the disk in use.
The rows at both ends of a partition meet their neighbours of the next one. Recall is tested against brute force.

Defined results: vectors that are null, of norm 0, or with a null or non-finite component have no links and are their
own component. Repeated vectors are linked with each other. A vec_id that stands with several vectors has the figures
of the one with the least hash in all its rows. Vectors of different lengths are never linked. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, table
from .components import components

#: Passes that run together, the fewest made, rows that each row is compared with, rows of a block.
PASSES, LEAST, WINDOW, BLOCK, SEED = 8, 16, 128, 256, 17
LIMIT = 0.95
#: Probability, on average over the share of classes that are found least, that a pair of cosine LIMIT is found; closer pairs are found more often.
RECALL, HARDEST = 0.99, 0.1
#: Classes whose keys tell how many passes that takes.
SAMPLE = 2048
_KEY_BITS = 64
_FOUND = ("a", "b", "gap", "pass", "key", "class_id", "vector")


def classes_of(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, class_id) of valid vectors, and (class_id, n, vector) of the classes of equal vectors; class_id is the least vec_id.

    Vectors of floats move as floats, half the bytes; every product is formed in double precision.
    """
    floats = isinstance(getattr(vectors.schema[vector].dataType, "elementType", None), T.FloatType)
    values = F.col(vector) if floats else F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(good, F.lit(False)) & (F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0)
    valid = vectors.select(F.col(key).cast("long").alias("vec_id"), values.alias("vector")).where(good & F.col(key).isNotNull())
    valid = valid.withColumn("h1", F.xxhash64(F.lit(1), "vector")).withColumn("h2", F.xxhash64(F.lit(2), "vector"))
    classes = valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    return valid.select("vec_id", "h1", "h2"), classes


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Unit vectors less the centre; vectors of another length than it are left at that."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return unit - centre if x.shape[1] == len(centre) else unit


def _centre(x: np.ndarray) -> np.ndarray:
    """Mean of unit vectors."""
    return _centred(x, np.zeros(0)).mean(0) if len(x) else np.zeros(0)


def _keys(x: np.ndarray, which: int, centre: np.ndarray) -> np.ndarray:
    """Sign bits of one pass, as integers that sort like the bit strings."""
    planes = np.random.default_rng([SEED, which, x.shape[1]]).standard_normal((x.shape[1], _KEY_BITS))
    bits = np.packbits(_centred(x, centre) @ planes > 0, axis=1)
    return (bits.view(">u8").astype(np.uint64).ravel() ^ np.uint64(1 << 63)).view(np.int64)


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length, and their vectors."""
    starts = column.offsets.to_numpy()
    flat, n = column.values.to_numpy(zero_copy_only=False), np.diff(starts)
    out = []
    for length in np.unique(n):
        rows = np.flatnonzero(n == length)
        out.append((rows, flat[starts[rows][:, None] + np.arange(length)[None, :]].astype(np.float64)))
    return out


def _with_keys(batches: Iterator[pa.RecordBatch], passes: range, centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            for rows, x in _vectors(part.column(1)):
                own = part.take(pa.array(rows))
                for which in passes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), which, np.int32)), pa.array(_keys(x, which, centre)), *own.columns], ["pass", "key", "class_id", "vector"])


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits that two arrays of keys share."""
    differ = np.unpackbits((a ^ b).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.where(differ.any(1), differ.argmax(1), _KEY_BITS)


def passes_needed(x: np.ndarray, n: int) -> int:
    """Passes that find a pair of cosine LIMIT among n classes with probability RECALL, told from x, a sample of them."""
    if len(x) < 2:
        return PASSES
    centre = _centre(x)
    hit = _cosines(x, x) >= LIMIT
    label, before = np.arange(len(x)), None
    while before is None or (label != before).any():  # near copies lie close in every pass and are found by each other, so a group counts once
        before, label = label, np.where(hit, label[None, :], label[:, None]).min(1)
    x = x[label == np.arange(len(x))]
    share = n / max(1, len(label))  # classes for each of the sample
    if len(x) * share <= WINDOW + 1 or len(x) < 2:  # one window holds all
        return PASSES
    # both vectors of a pair lie about as far from the centre, and 2 - 2 * LIMIT apart by square
    off = np.maximum((_centred(x, centre) ** 2).sum(1), 1 - LIMIT)
    agree = 1 - np.arccos(1 - (1 - LIMIT) / off) / np.pi
    place = np.arange(len(x))
    rank = max(1, min(len(x) - 1, int(WINDOW / share)))  # rows of the sample that a window spans
    far = min(len(x) - 1, 16 * rank)
    found = np.zeros(len(x))
    for which in range(PASSES):
        key = _keys(x, which, centre)
        order = np.argsort(key, kind="stable")
        key = key[order]
        bits = _shared_bits(key, key[np.minimum(place + rank, len(x) - 1)]).astype(float)
        bits[len(x) - rank :] = 0  # the last rows' windows hold all that follows
        if share > WINDOW and far > rank:  # the window is narrower than the sample's steps: go on at the rate at which bits divide the sample
            wide = _shared_bits(key[: len(x) - far], key[far:]).mean()
            bits += max(1.0, (bits[: len(x) - far].mean() - wide) / np.log2(far / rank)) * np.log2(share / WINDOW)
        found[order] += agree[order] ** np.minimum(bits + 1, _KEY_BITS) / PASSES
    found = np.sort(found)[: max(1, int(HARDEST * len(found)))]
    passes = LEAST
    while ((1 - found) ** passes).mean() > 1 - RECALL:
        passes += PASSES
    return passes


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the same rows as the pairs (i, j), one for each row but the first of what hangs together."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label, before = np.arange(len(rows)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    more = label != np.arange(len(rows))
    return rows[label[more]], rows[more]


def _windows(batches: Iterator[pa.RecordBatch], ends: bool = True) -> Iterator[pa.RecordBatch]:
    """What connects verified pairs of rows at most WINDOW apart, within runs of one pass; and, with the number of the gap they border on, the rows at both ends of a partition."""
    here = TaskContext.get().partitionId() if ends else 0
    carried, first = None, None

    def border(rows: pa.Table, gap: int) -> Iterator[pa.RecordBatch]:
        rows = rows.append_column("gap", pa.array(np.full(rows.num_rows, gap, np.int32)))
        none = pa.nulls(rows.num_rows, pa.int64())
        for x in rows.append_column("a", none).append_column("b", none).select(_FOUND).to_batches():
            yield x

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = pa.Table.from_batches([batch.slice(at, 1000)])
            if carried is not None:
                part = pa.concat_tables([carried, part])
            if ends and (first is None or first.num_rows < WINDOW):
                seen = pa.Table.from_batches([batch.slice(at, 1000)])
                first = seen.slice(0, WINDOW) if first is None else pa.concat_tables([first, seen.slice(0, WINDOW - first.num_rows)])
            old = carried.num_rows if carried is not None else 0
            part = part.combine_chunks()
            ids, which = part["class_id"].to_numpy(), part["pass"].to_numpy()
            place = np.arange(len(ids))
            for rows, x in _vectors(part["vector"].chunk(0)):
                for lo in range(0, len(rows), 256):
                    hi = min(len(rows), lo + 256 + WINDOW)
                    i, j = np.nonzero(_cosines(x[lo : lo + 256], x[lo:hi]) >= LIMIT)
                    i, j = rows[lo + i], rows[lo + j]
                    near = (j > i) & (place[j] - place[i] <= WINDOW) & (which[i] == which[j]) & (j >= old)
                    if near.any():
                        a, b = _forest(i[near], j[near])
                        none = [pa.nulls(len(a), kind) for kind in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), part.schema.field("vector").type)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), *none], list(_FOUND))
            carried = part.slice(max(0, part.num_rows - WINDOW))
    if ends and carried is not None:
        yield from border(first, here - 1)
        yield from border(carried, here)


def _over_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows that border on one gap between partitions."""
    for whole in _runs(batches, 1):
        whole = whole.combine_chunks()
        gap = whole["gap"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], gap[1:] != gap[:-1]]))
        for s, e in zip(cut, [*cut[1:], len(gap)], strict=True):
            for found in _windows(iter(whole.slice(s, e - s).combine_chunks().to_batches()), ends=False):
                yield found.select(["a", "b"])


def pairs(classes: DataFrame) -> DataFrame:
    """(a, b): what connects the verified pairs of classes found by any pass. A pair given back need not be near itself: both hang together by near ones."""
    n, kind = classes.count(), classes.schema["vector"].dataType.simpleString()
    drawn = classes.where(F.pmod(F.xxhash64("class_id"), F.lit(max(1, n))) < SAMPLE).select("vector").limit(2 * SAMPLE).toArrow()
    sample = max((x for _, x in _vectors(drawn["vector"].combine_chunks())), key=len, default=np.zeros((0, 1))) if drawn.num_rows else np.zeros((0, 1))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, centre = [], _centre(sample)
    for start in range(0, passes_needed(sample, n), PASSES):
        passes = range(start, start + PASSES)
        keyed = classes.select("class_id", "vector").mapInArrow(lambda batches, passes=passes: _with_keys(batches, passes, centre), f"pass int, key long, class_id long, vector {kind}")
        keyed = materialise(keyed, "keyed")
        ordered = keyed.repartitionByRange(parts, "pass", "key", "class_id").sortWithinPartitions("pass", "key", "class_id")
        near = materialise(ordered.mapInArrow(_windows, f"a long, b long, gap int, pass int, key long, class_id long, vector {kind}"), "near")
        discard(keyed)
        borders = near.where("gap is not null").select("gap", "pass", "key", "class_id", "vector").repartition("gap").sortWithinPartitions("gap", "pass", "key", "class_id")
        both = near.where("gap is null").select("a", "b").union(borders.mapInArrow(_over_gaps, "a long, b long"))
        found.append(materialise(both.distinct(), "pairs"))
        discard(near)
    return reduce(DataFrame.union, found).distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: of the rows with equal first columns, which follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
            if held:
                new[0] |= v[0] != held[-1].column(k)[-1].as_py()
        at = np.flatnonzero(new)
        if not held:
            held.append(batch)
        elif len(at):
            held.append(batch.slice(0, int(at[0])))
            yield pa.Table.from_batches([x for x in held if x.num_rows])
            held = [batch.slice(int(at[0]))]
        else:
            held.append(batch)
        if len(held) == 1 and len(at):  # all but the last group of this batch are whole
            first = int(at[0]) if held[0].num_rows < batch.num_rows else 0
            if at[-1] > first:
                yield pa.Table.from_batches([batch.slice(first, int(at[-1]) - first)])
                held = [batch.slice(int(at[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, links): what each class links within each pair of blocks."""
    for whole in _runs(batches, 3):
        whole = whole.combine_chunks()
        group = np.stack([whole[c].to_numpy() for c in ("component", "low", "high")])
        cut = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
        for s, e in zip(cut, [*cut[1:], whole.num_rows], strict=True):
            part = whole.slice(s, e - s)
            ids, n, block = (part[c].to_numpy() for c in ("class_id", "n", "block"))
            for rows, x in _vectors(part["vector"].combine_chunks() if part["vector"].num_chunks != 1 else part["vector"].chunk(0)):
                hit = _cosines(x, x) >= LIMIT
                if group[1, s] != group[2, s]:  # two blocks: only pairs across
                    hit &= block[rows][:, None] != block[rows][None, :]
                np.fill_diagonal(hit, False)
                got = hit @ n[rows]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(got.astype(np.int64))], ["class_id", "links"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Result: vec_id, n_links, component_id, kept."""
    members, classes = classes_of(vectors, key, vector)
    classes = materialise(classes, "classes")
    found = materialise(components(pairs(classes)), "components")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    placed = classes.join(found, classes["class_id"] == found["node"]).join(sizes, "component")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("class_id"), blocks).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class_id", "n", "block", "vector")
    ordered = met.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high", "class_id")
    links = ordered.mapInArrow(_count_blocks, "class_id long, links long").groupBy("class_id").agg(F.sum("links").alias("links"))
    # one narrow row a class; a hot class is split by Spark's skew join, as its rows are on the other side
    figures = classes.select("h1", "h2", "class_id", "n").join(links, "class_id", "left").join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    figures = figures.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    own = members.join(figures, ["h1", "h2"]).groupBy("vec_id").agg(F.min_by(F.struct("n_links", "component_id"), F.struct("h1", "h2")).alias("f")).select("vec_id", "f.*")
    every = vectors.select(F.col(key).cast("long").alias("vec_id"))
    out = every.join(own, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: links, component and verdict of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs and every node reachable from each: the exact result, which the passes find with the stated probability. For small tables.
ORACLE = """with recursive given as (select vec_id, list_transform(embedding, lambda c: coalesce(c, 'nan'::float)::double) v from embeddings),
  valid as (select vec_id, v, sqrt(list_inner_product(v, v)) norm from given where v is not null and len(list_filter(v, lambda c: not isfinite(c))) = 0 and list_inner_product(v, v) > 0),
  links as (select a.vec_id a, b.vec_id b from valid a join valid b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
  reached as (select vec_id, vec_id other from embeddings union select vec_id, b from reached join links on a = other),
  least as (select vec_id, min(other) component_id from reached group by vec_id)
select vec_id, (select count(*) from links where a = vec_id) n_links, component_id, vec_id = component_id kept from least"""
