"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact cosine reranking.

Each of several tables cuts random Gaussian projections of the unit vectors into steps of `width`; the
steps' numbers name a bucket.  Every row is indexed in every table.  A query visits its own bucket and
then perturbed ones in the order of their estimated success (the summed squared distances to the
crossed borders), and candidates of all tables are scored exactly in double precision.  Queries that
found too few candidates are compared with all rows, in blocks.

How many projections a table has is measured, at every size alike: the exact neighbours of a bounded sample
of rows among all rows are looked for under each number of projections, and the largest number that finds
enough of them is taken.  So denser tables get finer buckets.

Rows with equal vectors are one class with its least ids, so hot vectors are indexed and searched once.
Large buckets are dealt out in blocks, of index rows and of queries.
Defined cases: vectors that are null, empty or zero, or hold null or non-finite components take no
part; vectors of different lengths are never compared; ties go to the smaller id; fewer candidates than
asked for are all returned; repeated ids are rows of their own as candidates, and a query leaves out
rows of its own id; an id that repeats with other vectors asks once for each of them; extra columns, whatever
their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import lean, saved, scratch, table

#: Index rows and queries of one block, about; a bucket of more is dealt out to several tasks.
ROWS_A_PART = 100_000
QUERIES_A_PART = 20_000
#: Buckets that are dealt out at most, of each kind: where there would be more, blocks are larger.
MOST_DEALT = 10_000
#: Queries whose best candidates one task holds before it hands them on.
HELD_QUERIES = 50_000
#: Rows whose exact neighbours are looked up to choose the number of projections, and the share that must be found.
SAMPLE_ROWS = 128
SAMPLE_RECALL = 0.94
PROJECTIONS = (24, 20, 16, 14, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2)


@dataclass(frozen=True)
class Settings:
    tables: int = 4
    projections: int = 6
    width: float = 2.0
    probes: int = 64
    seed: int = 11


@lru_cache(maxsize=16)
def projections(settings: Settings, size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng([settings.seed, size])
    n = settings.tables * settings.projections
    return random.normal(size=(size, n)), random.uniform(0, settings.width, n)


def steps(vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(whole steps, the rest from 0 to 1) of each row, table and projection."""
    a, b = projections(settings, vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    f = ((unit @ a + b) / settings.width).reshape(len(vectors), settings.tables, settings.projections)
    whole = np.floor(f)
    return whole.astype(np.int64), f - whole


def bucket_names(whole: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name for the bucket of each (row, table); rows of other sizes have other names."""
    name = np.arange(whole.shape[1], dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
    for k in range(whole.shape[2]):
        name = (name ^ whole[:, :, k].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


@lru_cache(maxsize=16)
def perturbations(k: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Sets of places in a sorted list of 2k border distances, in the order of their expected sums.

    Place j and place 2k - 1 - j are the two borders of one projection, so no set holds both.
    """
    expected = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) for j in range(k)]
    expected += [1 - (2 * k - j) / (k + 1) + (2 * k - j) * (2 * k - j + 1) / (4 * (k + 1) * (k + 2)) for j in range(k, 2 * k)]
    out, heap = [()], [(expected[0], (0,))]
    while heap and len(out) < probes:
        cost, places = heapq.heappop(heap)
        last = places[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost - expected[last] + expected[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (cost + expected[last + 1], (*places, last + 1)))
        if not any(2 * k - 1 - p in places for p in places):
            out.append(places)
    return tuple(out)


def probe_steps(whole: np.ndarray, rest: np.ndarray, settings: Settings) -> np.ndarray:
    """Steps of the buckets to visit: (row, probe, table, projection)."""
    k = settings.projections
    distance = np.concatenate([rest, 1 - rest], 2)  # to the border below, then above
    order = np.argsort(distance[..., :], axis=2, kind="stable")
    sets = perturbations(k, settings.probes)
    out = np.repeat(whole[:, None], len(sets), 1)
    rows, tables = np.indices(whole.shape[:2])
    for i, places in enumerate(sets):
        for p in places:
            at = order[:, :, p]
            out[rows, i, tables, at % k] += np.where(at < k, -1, 1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x) for x in batch.column("vec")])
    for size in np.unique(sizes).tolist():
        yield batch.filter(pa.array(sizes == size))


@dataclass(frozen=True)
class Blocks:
    """Of each bucket that is dealt out: in how many parts its index rows come, and in how many its queries."""

    buckets: np.ndarray
    rows: np.ndarray
    queries: np.ndarray

    def of(self, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.ones(names.shape, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, names), len(self.buckets) - 1)
        return np.where(self.buckets[at] == names, counts[at], 1)


def bucket_counts(classes: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, rows) of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_size(whole):
                vec = _matrix(batch.column("vec"))
                yield pa.RecordBatch.from_arrays([pa.array(bucket_names(steps(vec, settings)[0], vec.shape[1]).ravel())], ["bucket"])

    return classes.select("vec").mapInArrow(lean(run), "bucket long").groupBy("bucket").agg(F.count("*").alias("rows"))


def probed(classes: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, rep) of each query class and visited bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_size(whole):
                for lo in range(0, batch.num_rows, 64):
                    some = batch.slice(lo, 64)
                    vec = _matrix(some.column("vec"))
                    at = probe_steps(*steps(vec, settings), settings)
                    names = bucket_names(at.reshape(-1, settings.tables, settings.projections), vec.shape[1])
                    rep = some.column("rep").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), pa.array(np.repeat(rep, names.size // len(rep)))], ["bucket", "rep"])

    return classes.select("rep", "vec").mapInArrow(lean(run), "bucket long, rep long")


def blocks_of(counts: DataFrame, asked: DataFrame) -> Blocks:
    """counts (bucket, rows), asked (bucket, queries); at most MOST_DEALT buckets of each kind reach the driver."""
    all_rows, all_asked = (d.agg(F.sum(c)).first()[0] or 0 for d, c in ((counts, "rows"), (asked, "queries")))
    row_limit, query_limit = max(ROWS_A_PART, all_rows // MOST_DEALT), max(QUERIES_A_PART, all_asked // MOST_DEALT)
    found: dict[int, list[int]] = {}
    for k, (d, c, limit) in enumerate(((counts, "rows", row_limit), (asked, "queries", query_limit))):
        for r in d.where(F.col(c) > limit).collect():
            found.setdefault(r["bucket"], [1, 1])[k] = -(-r[c] // limit)
    names = np.array(sorted(found), np.int64)
    return Blocks(names, *(np.array([found[int(b)][k] for b in names], np.int64) for k in (0, 1)))


def indexed(classes: DataFrame, settings: Settings, blocks: Blocks) -> DataFrame:
    """A row for each class, table and block of queries: bucket, part, block, rep, ids, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_size(whole):
                vec = _matrix(batch.column("vec"))
                all_names = bucket_names(steps(vec, settings)[0], vec.shape[1])
                rep = batch.column("rep").to_numpy()
                for t in range(settings.tables):
                    names = np.ascontiguousarray(all_names[:, t])
                    part, times = rep % blocks.of(names, blocks.rows), blocks.of(names, blocks.queries)
                    row = np.repeat(np.arange(len(names)), times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    more = [batch.column(c).take(pa.array(row)) for c in ("rep", "ids", "vec")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[row]), pa.array(part[row]), pa.array(block), *more],
                        ["bucket", "part", "block", "rep", "ids", "vec"]
                    )

    kind = classes.schema["vec"].dataType.simpleString()
    return classes.mapInArrow(lean(run), f"bucket long, part long, block long, rep long, ids array<long>, vec {kind}")


def dealt(probes: DataFrame, blocks: Blocks) -> DataFrame:
    """probes (bucket, rep) with a row for each part of the bucket's index: bucket, part, block, rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rep = batch.column("bucket").to_numpy(), batch.column("rep").to_numpy()
            block, times = rep % blocks.of(names, blocks.queries), blocks.of(names, blocks.rows)
            row = np.repeat(np.arange(len(names)), times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[row]), pa.array(part), pa.array(block[row]), pa.array(rep[row])],
                ["bucket", "part", "block", "rep"]
            )

    return probes.select("bucket", "rep").mapInArrow(lean(run), "bucket long, part long, block long, rep long")


class Best:
    """The best candidates of each query so far."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, reps: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: list[list[int]], row_reps: np.ndarray) -> None:
        norm_q, norm_r = np.sqrt((queries**2).sum(1)), np.sqrt((rows**2).sum(1))
        rough = queries @ rows.T / norm_q[:, None] / norm_r
        rough[reps[:, None] == row_reps[None]] = -np.inf  # its own class comes by itself
        take = min(rough.shape[1], self.k + 3)
        least = -np.partition(-rough, take - 1, 1)[:, take - 1] - 1e-9  # all rows that may tie with the last one taken stay
        for i, rep in enumerate(reps.tolist()):
            own = self.held.setdefault(rep, {})
            floor = min(own.values()) if len(own) >= self.k else -2.0
            at = np.flatnonzero((rough[i] >= max(least[i], floor - 1e-9)) & (rough[i] > -np.inf))
            if not len(at):
                continue
            exact = (queries[i] * rows[at]).sum(1) / (norm_q[i] * norm_r[at])
            best = np.lexsort((row_reps[at], -exact))[:take]  # a class's least id stands for it among ties
            for j, s in zip(at[best].tolist(), exact[best].tolist(), strict=True):
                for x in ids[j][: self.k]:
                    own[x] = max(s, own.get(x, s))
            if len(own) > self.k:
                self.held[rep] = dict(sorted(own.items(), key=lambda x: (-x[1], x[0]))[: self.k])

    def rows(self) -> pa.RecordBatch:
        found = [(rep, x, s) for rep, own in self.held.items() for x, s in own.items()]
        self.held = {}
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["rep", "vec_id", "score"])


def met(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(rep, vec_id, score): candidates that a query class meets in a bucket, the best of each task."""
    rows = probes.select("bucket", "part", "block", F.lit(0).alias("kind"), "rep", F.array().cast("array<long>").alias("ids"), "vec")
    rows = rows.unionByName(index.select("bucket", "part", "block", F.lit(1).alias("kind"), "rep", "ids", "vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, here, waiting = Best(k), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "part", "block", "kind")], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                part, place = batch.slice(a, b - a), tuple(key[a, :3].tolist())
                if place != here:
                    here, waiting = place, []
                if key[a, 3] == 0:
                    waiting.append((part.column("rep").to_numpy(), _matrix(part.column("vec"))))
                elif waiting:
                    own = _matrix(part.column("vec"))
                    ids = part.column("ids").to_pylist()
                    for reps, queries in waiting:
                        if queries.shape[1] == own.shape[1]:
                            best.add(reps, queries, own, ids, part.column("rep").to_numpy())
                    if len(best.held) > HELD_QUERIES:
                        yield best.rows()
        yield best.rows()

    return rows.repartition("bucket", "part", "block").sortWithinPartitions("bucket", "part", "block", "kind").mapInArrow(lean(run), "rep long, vec_id long, score double"
    )


def first(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k best of each; a candidate that several tasks have met counts once."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    rows = rows.groupBy(by, "vec_id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact_pairs(classes: DataFrame, k: int, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vector, one of its k nearest) of a sample of at most `rows` classes against all classes."""
    some = classes.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(rows).collect()
    shared = classes.sparkSession.sparkContext.broadcast([(r["rep"], np.array(r["vec"], float)) for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_size(whole):
                vec, rep = _matrix(batch.column("vec")), batch.column("rep").to_numpy()
                asked = [(r, q) for r, q in shared.value if len(q) == vec.shape[1]]
                if not asked or not len(vec):
                    continue
                reps, q = np.array([r for r, _ in asked]), np.stack([x for _, x in asked])
                score = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (vec / np.linalg.norm(vec, axis=1, keepdims=True)).T
                score[reps[:, None] == rep[None]] = -np.inf
                best = np.argsort(-score, 1, kind="stable")[:, :k]
                row = best.ravel()
                found = np.take_along_axis(score, best, 1).ravel()
                kept = np.flatnonzero(np.isfinite(found))
                out = [
                    pa.array(np.repeat(reps, best.shape[1])[kept]), pa.array(rep[row[kept]]), pa.array(found[kept]),
                    batch.column("vec").take(pa.array(row[kept]))
                ]
                yield pa.RecordBatch.from_arrays(out, ["query", "rep", "score", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    near = classes.select("rep", "vec").mapInArrow(lean(run), f"query long, rep long, score double, vec {kind}")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("query", "vec").collect()
    by_rep = dict(shared.value)
    return [(by_rep[r["query"]], np.array(r["vec"], float)) for r in near]


def recall_of(pairs: list[tuple[np.ndarray, np.ndarray]], settings: Settings) -> float:
    """The share of pairs of which the first vector visits a bucket that the second is in."""
    hits = 0
    for size in {len(q) for q, _ in pairs}:
        q, v = (np.stack([p[k] for p in pairs if len(p[0]) == size]) for k in (0, 1))
        at = probe_steps(*steps(q, settings), settings)
        visited = bucket_names(at.reshape(-1, settings.tables, settings.projections), size).reshape(len(q), -1, settings.tables)
        hits += int((visited == bucket_names(steps(v, settings)[0], size)[:, None]).any((1, 2)).sum())
    return hits / max(len(pairs), 1)


def measured(classes: DataFrame, k: int, settings: Settings = Settings(), rows: int = SAMPLE_ROWS, least: float = SAMPLE_RECALL) -> Settings:
    """The settings with the most projections that still find `least` of the sample's exact neighbours."""
    pairs = exact_pairs(classes, k, rows)
    tries = (replace(settings, projections=n) for n in PROJECTIONS)
    return next((s for s in tries if recall_of(pairs, s) >= least), replace(settings, projections=PROJECTIONS[-1]))


def search(vectors: DataFrame, queries: F.Column, k: int = 5, settings: Settings | None = None) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score; queries: a condition on vec_id."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"  # single precision travels as it is
    vec = F.col("embedding").cast(f"array<{element}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where("vec_id is not null").where(F.coalesce(ok, F.lit(False))).withColumn(
        "vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(element))
    )
    asked = rows.where(queries)
    with scratch() as keep:
        # The least ids of equal vectors: limited per deal of a class, then per class, before anything is gathered.
        few = rows.withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
        for keys in (("vec", "deal"), ("vec",)):
            few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
        classes = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        classes = keep(classes.select(F.col("ids")[0].alias("rep"), "ids", "vec"))
        named = keep(asked.join(classes.select("vec", "rep", "ids"), "vec").select(F.col("vec_id").alias("query_id"), "rep", "ids"))
        wanted = keep(classes.join(named.select("rep").distinct(), "rep", "left_semi"))
        settings = settings or measured(classes, k)

        counts = keep(bucket_counts(classes, settings))
        probes = keep(probed(wanted, settings).join(counts.select("bucket").hint("merge"), "bucket", "left_semi"))
        blocks = blocks_of(counts, probes.groupBy("bucket").agg(F.count("*").alias("queries")))
        with_vectors = dealt(probes, blocks).join(wanted.select("rep", "vec").hint("merge"), "rep")
        found = keep(first(met(indexed(classes, settings, blocks), with_vectors, k), "rep", k).select("rep", "vec_id", "score"))
        short = found.groupBy("rep").count().where(F.col("count") >= k)
        short = keep(wanted.join(short, "rep", "left_anti"))
        asking = short.count()
        if asking:
            n = counts.agg(F.sum("rows")).first()[0] // settings.tables
            parts, groups = max(8, n // ROWS_A_PART), max(1, asking // QUERIES_A_PART)
            deal = lambda count: F.pmod(F.xxhash64("rep"), F.lit(count))
            each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))
            size = F.size("vec").cast("long").alias("bucket")  # vectors of one length meet
            all_rows = classes.select(size, deal(parts).alias("part"), each(groups).alias("block"), "rep", "ids", "vec")
            queries_ = short.select(size, each(parts).alias("part"), deal(groups).alias("block"), "rep", "vec")
            exact = first(met(all_rows, queries_, k), "rep", k).select("rep", "vec_id", "score")
            found = keep(found.join(short.select("rep"), "rep", "left_anti").unionByName(exact))
        # Rows of the query's own class: the cosine of a vector with itself, as it is computed.
        own = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        selves = wanted.select("rep", F.explode("ids").alias("vec_id"), (own / (F.sqrt(own) * F.sqrt(own))).alias("score"))
        lists = found.unionByName(selves).groupBy("rep").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")).alias("near"))
        near = named.join(keep(lists), "rep").withColumn(
            "near", F.slice(F.array_sort(F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))), 1, k)
        )
        out = near.select("query_id", F.posexplode("near").alias("at", "one"))
        return saved(
            out.select(
                "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"),
                (-F.col("one.minus")).alias("score")
            )
        )


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
