"""N-gram Jaccard join by a partitioned universe, exact.

A document is its set of distinct word shingles.  Two sets with a Jaccard similarity of at least
`percent` in a hundred differ in at most H = (|r| + |s|) * (100 - percent) / (100 + percent) shingles.
Sizes fall into bands so narrow that linked sets are in the same or in neighbouring bands; each pair of
neighbouring bands has a scheme, which cuts the universe of shingle hashes into segments.  A segment is
indexed as it is (weight 1: it serves pairs that agree on it) or with its one-deletion neighbourhood
(weight 2: it serves pairs that differ there in one shingle at most).  Weights add up to more than H, so
linked sets share several signatures, `need` at least.  Each set then leaves out its need - 1 signatures
with the longest lists, by the lists' measured lengths: as all sets rank signatures alike, the one with
the shortest list of those that two linked sets share stays with both.  Empty segments and segments of
passages that very many documents have are the ones that go.  How many segments get a neighbourhood is
chosen per scheme by cost, from the number of documents in its bands.

Equal sets are one class before anything is indexed, so copies are never paired.  Of each bucket of
classes with a common signature, the least is the hub; classes that share a hub are a group, in parts
of a bounded number of members and of shingles.  A part streams by: members linked to the hub need not be
compared with one another, but the others are, with all members of the part, by their differences from the
hub, giving one link for two components.  Connected components follow, and only groups of several parts that still
hold several components are searched further, part against part.  Every comparison is exact on the sets of
64-bit shingle hashes.

Defined cases: null text and text without words have an empty set and are linked with nothing; with
fewer words than a shingle the whole sequence is the one shingle; rows that repeat an id and text are
one document; an id that repeats with other texts is one document too, linked to whatever any of its
texts is, and only the number of shingles is each row's own; rows without an id take the component of their equals, else null; extra columns, whatever their
names, are not read; a text may be of any length; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import chunks, lean, saved, scratch, table
from parley.llm.components import connected_components
from parley.llm.textkernel import CODES, LOWER, U, mix, shingles, span_hashes, words

#: Members of a hub that are compared with it, and with one another, in one go; and their shingles together, about.
GROUP = 512
PART_SHINGLES = 1 << 20
#: Rows of an Arrow batch where each holds a whole set.
SET_ROWS = 256
#: Cost model, in signatures: a comparison; and the share of a scheme's pairs that are taken to differ twice as much as is allowed.
COMPARISON = 0.05
NEAR_SHARE = 1e-5


def sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, doc = words(data, offsets)
    hashes = span_hashes(CODES[LOWER[data]], starts, ends)
    grams = shingles(hashes, width)
    at = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield shingles(hashes[a:b], b - a) ^ U(b - a)
        else:
            yield np.zeros(0, U)


@lru_cache(maxsize=8)
def band_starts(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Least size of each band; sizes of linked sets are at most one band apart."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return np.array(out)


def band_of(n: int, percent: int) -> int:
    return int(np.searchsorted(band_starts(percent), n, "right")) - 1


def most_differences(scheme: int, percent: int) -> int:
    """H of the pairs of a scheme: sets of bands scheme - 1 and scheme, one of them at least in the latter."""
    largest = int(band_starts(percent)[scheme + 1]) - 1
    return 2 * largest * (100 - percent) // (100 + percent)


def needed(h: int, q: int) -> int:
    """How many signatures linked sets share at least: weights add up to h + 2 + h // 6, a shared one has weight 2 at most."""
    spare = 2 + h // 6
    return -(-spare // 2) if q else spare


def at_least(need: int, mean: float) -> float:
    """About the chance that a Poisson number of that mean is `need` or more (Chernoff's bound)."""
    return 1.0 if mean >= need else float(np.exp(need - mean - need * np.log(need / max(mean, 1e-300))))


def allocate(counts: dict[int, int], percent: int) -> dict[int, tuple[int, int]]:
    """(segments, those with one-deletion neighbourhoods) of each scheme, by least estimated cost.

    Cost: the signatures of all its documents, and comparisons of pairs that agree by accident: on segments
    that are empty or nearly so, or because they differ just too much.
    """
    out = {}
    for scheme in {b + k for b in counts for k in (0, 1)}:
        n = counts.get(scheme, 0) + counts.get(scheme - 1, 0)
        h, size = most_differences(scheme, percent), int(band_starts(percent)[scheme])
        whole = h + 2 + h // 6
        best = None
        for q in sorted({0, *(round(whole * k / 16) for k in range(1, 9))}):
            if q > whole // 2:
                continue
            m, need = whole - q, needed(h, q)

            def shared(mean: float, m=m, q=q) -> float:
                return np.exp(-mean) * (m + q * mean)

            poor = shared(size / m)
            near = at_least(need, shared(2 * h / m))
            cost = n * (m + q * size / m) + n * n * (COMPARISON * at_least(need, poor) * poor / m + NEAR_SHARE * near)
            if best is None or cost < best[0]:
                best = (cost, m, q)
        out[scheme] = best[1:]
    return out


@lru_cache(maxsize=4096)
def _segments(scheme: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each segment, and a number that marks the segment's signatures."""
    starts = np.array([(i << 64) // m for i in range(m)], U)
    with np.errstate(over="ignore"):
        return starts, mix(np.arange(m, dtype=U) + U(scheme + 1) * U(0x9E3779B97F4A7C15))


def scheme_signatures(u: np.ndarray, scheme: int, m: int, q: int) -> np.ndarray:
    """The distinct signatures of a sorted set under a scheme."""
    codes = mix(u)
    sums = np.zeros(len(u) + 1, U)
    np.cumsum(codes, out=sums[1:])
    starts, marks = _segments(scheme, m)
    at = np.append(np.searchsorted(u, starts), len(u))
    whole = sums[at[1:]] - sums[at[:-1]]
    out = [mix(whole + marks)]
    if q:  # the first q segments: the sums without each one of their shingles
        part = slice(0, int(at[q]))
        segment = np.repeat(np.arange(q), np.diff(at[: q + 1]))
        out.append(mix(whole[segment] - codes[part] + marks[segment]))
    return np.unique(np.concatenate(out))


def signatures(u: np.ndarray, plan: dict[int, tuple[int, int]], percent: int) -> np.ndarray:
    """The distinct signatures of a sorted set under its band's scheme and the next one's."""
    band = band_of(len(u), percent)
    return np.unique(np.concatenate([scheme_signatures(u, k, *plan[k]) for k in (band, band + 1)]))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and two sums over the set that tell equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                n, a, b = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, U), np.zeros(hi - lo, U)
                for i, u in enumerate(sets(data, offsets, width)):
                    n[i] = len(u)
                    if len(u):
                        x = mix(u)
                        a[i], b[i] = x.sum(), mix(x ^ U(0x5851F42D4C957F2D)).sum()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    ["doc_id", "n", "fp1", "fp2"]
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, fp1 long, fp2 long")


def signature_lists(docs: DataFrame, plan: dict[int, tuple[int, int]], width: int, percent: int) -> DataFrame:
    """doc_id, scheme, sigs: a row for each of the two schemes that a text's set is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                row, scheme, got = [], [], [np.zeros(0, U)]
                for i, u in enumerate(sets(data, offsets, width)):
                    if len(u):
                        band = band_of(len(u), percent)
                        row += [lo + i] * 2
                        scheme += [band, band + 1]
                        got += [scheme_signatures(u, k, *plan[k]) for k in (band, band + 1)]
                ends = np.cumsum(list(map(len, got)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(got).view(np.int64)))
                ids = batch.column("doc_id").take(pa.array(row, pa.int64())).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(scheme, pa.int32()), lists], ["doc_id", "scheme", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, scheme int, sigs array<long>")


def candidates(lists: DataFrame, plan: dict[int, tuple[int, int]], percent: int, keep) -> DataFrame:
    """(node, hub, size) of classes that share a signature that both have kept; size bounds the node's set.

    Both tables of signatures grow with the input, so neither is ever broadcast.
    """
    signed = lists.select(F.col("doc_id").alias("node"), "scheme", F.explode("sigs").alias("sig"))
    often = keep(signed.groupBy("sig").agg(F.count("*").alias("length")).where("length > 1"))
    shared = signed.join(often.hint("merge"), "sig")
    longest = Window.partitionBy("node", "scheme").orderBy(F.desc("length"), "sig")
    of_scheme = lambda values: F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v))), F.col("scheme"))
    need = of_scheme({k: needed(most_differences(k, percent), q) for k, (_, q) in plan.items()})
    size = of_scheme({k: int(band_starts(percent)[k + 1]) - 1 for k in plan})
    shared = shared.withColumn("nth", F.row_number().over(longest)).where(F.col("nth") >= need)
    shared = keep(shared.select("sig", "node", size.cast("long").alias("size")))
    hubs = shared.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("sig", "hub")
    return keep(shared.join(hubs.hint("merge"), "sig").where("node <> hub").groupBy("node", "hub").agg(F.max("size").alias("size")))


def differ_little(differ, total, percent: int):
    """Whether sets whose sizes add up to `total` and that differ in `differ` shingles are linked."""
    return (100 + percent) * differ <= (100 - percent) * total


def reachable(linked: np.ndarray) -> np.ndarray:
    """The least vertex that each one reaches in a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            new = root < 0
            new[:i] = False
            new[i + 1 :] = False
            while new.any():
                root[new] = i
                new = linked[new].any(0) & (root < 0)
    return root


def intersections(lists: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """How many hashes any two of the lists have in common; with `first`, the first ones with all, a row for each."""
    _, ids, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(lists)), list(map(len, lists)))
    several = count > 1  # what one list has alone is in no intersection
    places = np.cumsum(several) - 1
    who, ids = who[several[ids]], places[ids[several[ids]]]
    order = np.argsort(ids, kind="stable")
    who, ids = who[order], ids[order]
    inter = np.zeros((len(lists[:first]), len(lists)), np.float32)
    for lo in range(0, int(several.sum()), 2048):
        some = slice(*np.searchsorted(ids, (lo, lo + 2048)))
        dense = np.zeros((len(lists), 2048), np.float32)
        dense[who[some], ids[some] - lo] = 1
        inter += dense[:first] @ dense.T
    return inter


def spanning_links(
    n: np.ndarray, part: np.ndarray, aparts: list[np.ndarray], across: np.ndarray | None, percent: int, first: int | None = None
) -> list[tuple[int, int]]:
    """Links (positions) that join whatever linked members join, from differences from one hub: a tree of them.

    Two sets differ in as many shingles as their differences from a third set do.  `part`: what is joined
    before.  With `across`, only members with other values there are compared; with `first`, only pairs with one
    of the first members.
    """
    sizes = np.array(list(map(len, aparts)))
    ok = differ_little(sizes[:first, None] + sizes[None] - 2 * intersections(aparts, first), n[:first, None] + n[None], percent)
    if across is not None:
        ok &= across[:first, None] != across[None]
    joined = part[:, None] == part[None]
    joined[:first] |= ok
    joined[:, :first] |= ok.T
    root = reachable(joined)
    found = {(part[i], part[root[i]]): (int(i), int(root[i])) for i in np.flatnonzero(part != part[root])}
    return list(found.values())


VERIFIED = "a long, b long, hub long, part long, n long, apart array<long>"
MEMBER_KINDS = [pa.int64()] * 5 + [pa.list_(pa.int64())]


def member_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), MEMBER_KINDS, strict=True)],
        ["a", "b", "hub", "part", "n", "apart"]
    )


def with_sets(docs: DataFrame, sent: DataFrame, width: int) -> DataFrame:
    """sent (doc_id and more) with the shingles of each id's texts."""
    names = sent.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                got = list(sets(data, offsets, width))
                ends = np.cumsum([0, *map(len, got)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(got).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), lists], [*names, "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sent.hint("merge"), "doc_id").select(*names, "text")
    return texts.mapInArrow(lean(run), ", ".join(f"{c} long" for c in names) + ", shingles array<long>")


def in_parts(pairs: DataFrame, keep) -> DataFrame:
    """(hub, node, part, parts): the members of each hub, in parts of bounded size."""
    sized = pairs.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / PART_SHINGLES)).alias("parts"))
    return keep(pairs.join(sized.hint("merge"), "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), "parts"))


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int, keep) -> DataFrame:
    """Links (a, b) between each hub and its members (node, hub), and between members of equal parts: as many as join what is linked.

    Members of hubs with several parts also come as rows without b: with their part, size and the
    hashes in just one of their and their hub's sets.
    """
    cut = in_parts(pairs, keep)
    sent = cut.select(F.col("node").alias("doc_id"), "hub", "part", "parts").unionByName(
        cut.select(F.col("hub").alias("doc_id"), "hub", "part", "parts").distinct()
    )
    names = ["doc_id", "hub", "part", "parts"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own, held, near = None, None, [], []  # the part at hand, its hub's set, members that aren't linked to the hub, those that are

        def ended() -> list[tuple]:
            if not held or len(held) + len(near) < 2:
                return []
            nodes, sizes, aparts = zip(*held, *near, strict=True)
            joined = np.minimum(np.arange(len(nodes)), len(held))  # all of `near` are, by the hub
            links = spanning_links(np.array(sizes), joined, list(aparts), None, percent, len(held))
            return [(nodes[i], nodes[j], None, None, None, None) for i, j in links]

        for batch in batches:
            node, hub, part, parts = (batch.column(c).to_numpy() for c in names)
            lists = batch.column("shingles")
            flat, at, rows = lists.values.to_numpy(zero_copy_only=False).view(U), lists.offsets.to_numpy(), []
            for i in range(len(node)):
                mine = flat[at[i] : at[i + 1]]
                if (hub[i], part[i]) != here:
                    rows += ended()
                    here, own, held, near = (hub[i], part[i]), mine.copy(), [], []  # the hub sorts before its members
                    continue
                if not len(mine):  # another row of an id, without words
                    continue
                apart = np.setxor1d(mine, own, assume_unique=True)
                if differ_little(len(apart), len(mine) + len(own), percent):
                    rows.append((int(hub[i]), int(node[i]), None, None, None, None))
                    near.append((int(node[i]), len(mine), apart))
                else:
                    held.append((int(node[i]), len(mine), apart))
                if parts[i] > 1:
                    rows.append((int(node[i]), None, int(hub[i]), int(part[i]), len(mine), apart.view(np.int64)))
            if rows:
                yield member_rows(rows)
        if rows := ended():
            yield member_rows(rows)

    # Of a hub's texts, where its id has several, the same one comes first in every part: differences from it meet in further_links.
    order = ["hub", "part", F.col("doc_id") != F.col("hub"), "doc_id", F.desc("shingles")]
    dealt = with_sets(docs, sent, width).repartition("hub", "part").sortWithinPartitions(*order)
    return keep(dealt.mapInArrow(lean(compare), VERIFIED), SET_ROWS)


def further_links(members: DataFrame, near: DataFrame, percent: int, keep) -> DataFrame:
    """Links (a, b) between members of different parts of a hub that are in different components yet."""
    placed = members.join(near.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    split = placed.groupBy("hub").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), (F.max("part") + 1).alias("parts")
    ).where("least <> most")
    rest = placed.join(split.select("hub", "parts").hint("merge"), "hub")
    rest = rest.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != F.col("part"))))
    rest = rest.select("hub", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "a", "n", "component", "apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def ended() -> pa.RecordBatch:
            n, component, part, aparts = zip(*held, strict=True)
            component = np.array(component)
            found = spanning_links(np.array(n), component, list(aparts), np.array(part), percent)
            return pa.RecordBatch.from_arrays([pa.array([component[x[k]] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("hub", "x", "y", "n", "component", "part")]
            lists = batch.column("apart")
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (hub, x, y, n, component, part) in enumerate(zip(*(c.tolist() for c in columns), strict=True)):
                if here != (hub, x, y):
                    if held:
                        yield ended()
                    here, held = (hub, x, y), []
                held.append((n, component, part, flat[at[i] : at[i + 1]].copy()))
        if held:
            yield ended()

    return keep(rest.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y").mapInArrow(lean(run), "a long, b long"), SET_ROWS)


def several_texts(prints: DataFrame, classes: DataFrame, keep) -> DataFrame:
    """(doc_id, node): the classes of each id that several rows have."""
    ids = prints.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id")
    some = prints.where("n > 0").join(ids.hint("merge"), "doc_id", "left_semi")
    return keep(some.join(classes, ["n", "fp1", "fp2"]).select("doc_id", "node").distinct())


def classes_and_candidates(docs: DataFrame, width: int, percent: int, keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints of all rows; classes of equal sets with their least id; pairs (node, hub, size) to look at)."""
    prints = keep(fingerprints(docs, width))
    classes = keep(prints.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("node")))
    starts = band_starts(percent).tolist()
    band = F.array_size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("n"))) - 1
    counts = {
        r["band"]: r["count"] for r in classes.groupBy("n").count().withColumn("band", band).groupBy("band").agg(F.sum("count").alias("count")).collect()
    }
    plan = allocate(counts, percent)
    if not plan:
        return prints, classes, keep(classes.select("node", F.col("node").alias("hub"), F.col("n").alias("size")).where("false"))
    # Rows without an id are in no class, so the plan needn't have their band.
    wanted = classes.select(F.col("node").alias("doc_id")).hint("merge")
    lists = keep(signature_lists(docs.where("doc_id is not null"), plan, width, percent).join(wanted, "doc_id", "left_semi"))
    return prints, classes, candidates(lists, plan, percent, keep)


def links_of(docs: DataFrame, width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) with a < b between classes by their least ids, and (doc_id, class_id, n_links) of each row.

    n_links: ids that a row's text is linked with, equal texts of other ids among them; rows without words or
    id have no class and none.  Every two members of a hub are compared, part with part, so unlike components
    this costs time and rows with the square of a group of different texts that are all linked: its links are so many.
    """
    with scratch() as keep:
        prints, classes, pairs = classes_and_candidates(docs, width, percent, keep)
        cut = in_parts(pairs.unionByName(pairs.groupBy("hub").agg(F.max("size").alias("size")).withColumn("node", F.col("hub"))), keep)
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
        sent = cut.select(F.col("node").alias("doc_id"), "hub", "part", blocks)
        sent = sent.select("doc_id", "hub", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, held = None, []

            def ended() -> pa.RecordBatch:
                node, part, lists = zip(*held, strict=True)
                node, part, n = np.array(node), np.array(part), np.array(list(map(len, lists)))
                ok = differ_little(
                    n[:, None] + n[None] - 2 * intersections(list(lists)), n[:, None] + n[None], percent
                ) & (node[:, None] < node[None])
                if here[1] != here[2]:
                    ok &= part[:, None] != part[None]
                a, b = np.nonzero(ok)
                return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

            for batch in batches:
                columns = [batch.column(c).to_numpy().tolist() for c in ("hub", "x", "y", "doc_id", "part")]
                lists = batch.column("shingles")
                flat, at = lists.values.to_numpy(zero_copy_only=False).view(U), lists.offsets.to_numpy()
                for i, (hub, x, y, node, part) in enumerate(zip(*columns, strict=True)):
                    if here != (hub, x, y):
                        if held:
                            yield ended()
                        here, held = (hub, x, y), []
                    if at[i + 1] > at[i]:
                        held.append((node, part, flat[at[i] : at[i + 1]].copy()))
            if held:
                yield ended()

        dealt = with_sets(docs, sent, width).repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")
        met = keep(dealt.mapInArrow(lean(compare), "a long, b long"), SET_ROWS)
        links = saved(met.distinct())
        members = keep(
            prints.where("n > 0 and doc_id is not null").join(classes, ["n", "fp1", "fp2"]).select(
                "doc_id", F.col("node").alias("class_id")
            ).distinct()
        )
        sizes = members.groupBy("class_id").agg(F.count("*").alias("ids"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("ids").alias("more"))
        named = classes.join(sizes.withColumnRenamed("class_id", "node"), "node").join(others.withColumnRenamed("class_id", "node"), "node", "left")
        named = named.select("n", "fp1", "fp2", F.col("node").alias("class_id"), (F.col("ids") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
        rows = prints.withColumn("known", F.col("doc_id").isNotNull()).join(
            named.withColumn("known", F.lit(True)), ["n", "fp1", "fp2", "known"], "left"
        )
        return links, saved(rows.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def components_of(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; component_id is the least id reachable by links."""
    with scratch() as keep:
        prints, classes, pairs = classes_and_candidates(docs, width, percent, keep)
        checked = verified(docs, pairs, width, percent, keep)
        several = several_texts(prints, classes, keep)
        least = several.groupBy("doc_id").agg(F.min("node").alias("a"))
        same_id = several.join(least, "doc_id").select("a", F.col("node").alias("b"))
        links = checked.where("b is not null").select("a", "b").unionByName(same_id)
        near = keep(connected_components(links))
        merged = keep(connected_components(further_links(checked.where("b is null"), near, percent, keep)))

        final = near.join(merged.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
        final = final.select("node", F.coalesce("least", "component").alias("component"))
        alone = merged.join(near, "node", "left_anti").select("node", "component")
        by_class = keep(
            classes.join(final.unionByName(alone), "node", "left").select(
                "node", "n", "fp1", "fp2", F.coalesce("component", "node").alias("component_id")
            )
        )
        out = prints.where("n > 0").join(by_class.drop("node"), ["n", "fp1", "fp2"], "left").select("doc_id", "n", "component_id")
        of_id = least.join(by_class.select(F.col("node").alias("a"), "component_id").distinct(), "a").select("doc_id", "component_id")
        bare = prints.where("n = 0").join(of_id, "doc_id", "left").select("doc_id", "n", "component_id")
        out = out.unionByName(bare)
        return saved(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose id is their component's; one of rows that repeat an id; rows without an id stay."""
    parts = components_of(docs, width, percent)
    kept = saved(parts.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    named = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    if kept.where("rows > 1").limit(1).count():
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"), 3, 90)
