"""Near-duplicate detection by DartMinHash.

Each text is a weighted set of hashed word shingles. DartMinHash (Christiani
2020) sketches it by throwing darts: every element owns a fixed random set of
darts over the plane (weight x rank), cut into regions of doubling size whose
dart counts are Poisson draws hashed from element and region. A text keeps the darts
below its elements' weights; each dart has one of k coordinates, and per coordinate the dart of
least rank is the signature. Two texts agree in a coordinate with the probability
of their weighted Jaccard similarity, and a sketch costs about k ln k darts whatever
the text's length.

Signatures are cut into bands; texts that share a band are candidates, which are
verified exactly on their whole texts. What is returned are the components of
the graph of verified links. Copies of one shingle set are one node, and a
band's members are first compared with a leader, not with each other. What is
still in different components afterwards is compared in blocks that hold the
shingle sets, and a block emits no pairs but the links that join two components,
fewer than its rows.

With 32 bands of 4, a pair of similarity 0.8 shares no band once in 2 * 10**7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from ._bytes import CHUNK, LOWER, SPACE, Hasher, chunks, mix, release, runs, small_batches
from ._joins import spread

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Up to this many ids of texts to verify are broadcast, so that other texts aren't shuffled.
MAX_BROADCAST_IDS = 2_000_000
#: Rows of a block in which the rest of a band is compared, and shingles of its sets, on average.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Pairs of one text that are verified in one task.
PAIR_ROWS = 4096
#: Standard deviations of the signatures' agreement that a pair at the similarity may fall short in blocks: once in 300,000 pairs.
DEVIATIONS = 4.5
#: Texts that are sketched in one pass; each takes some 1,300 darts of about 100 bytes.
SKETCH_ROWS = 512
#: Rank from which regions double; below is one region.
FIRST_RANK = -10
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of each row's distinct word shingles, rows in order.

    Words are what ASCII white space parts, A-Z lower-cased. A row with fewer words than the width has one shingle of all its
    words (a row without words that of no words).
    """
    n = len(offsets) - 1
    starts, ends, rows = runs(~SPACE[data], offsets)
    keys = hasher(LOWER[data], starts, ends)
    per_row = np.bincount(rows, minlength=n)
    first = np.cumsum(per_row) - per_row
    full = np.flatnonzero(rows[: max(0, len(keys) - width + 1)] == rows[width - 1 :]) if len(keys) >= width else np.zeros(0, np.int64)
    total = np.zeros(len(full), _U)
    for j in range(width):
        total = total * _U(0x9E3779B97F4A7C15) + keys[full + j]
    few = np.flatnonzero(per_row < width)
    short = (per_row[few] + 1).astype(_U) * _U(0xD6E8FEB86659FD93)
    for j in range(width - 1):
        has = per_row[few] > j
        short[has] = short[has] * _U(0x9E3779B97F4A7C15) + keys[first[few[has]] + j]
    hashes, row = np.concatenate([mix(total), mix(short)]), np.concatenate([rows[full], few])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return hashes[at], row[at], np.diff(np.append(at, len(hashes)))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


class _Poisson:
    """Counts by inverting the distribution's cumulative sums."""

    def __init__(self):
        self.tables: dict[float, np.ndarray] = {}

    def __call__(self, mean: float, u: np.ndarray) -> np.ndarray:
        if mean not in self.tables:
            k = np.arange(int(mean + 12 * np.sqrt(mean) + 40))
            self.tables[mean] = np.cumsum(np.exp(-mean + np.cumsum(np.log(np.concatenate([[1.0], mean / k[1:]])))))
        return np.searchsorted(self.tables[mean], u, side="right")


def signatures(hashes: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, k: int, poisson: _Poisson | None = None) -> np.ndarray:
    """n_rows x k dart ids (unsigned 32-bit). Rows must have an element; weights are positive."""
    poisson = poisson or _Poisson()
    mass = np.bincount(rows, weights=weights, minlength=n_rows)
    reach = (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-300)
    rank, dart = np.full(n_rows * k, np.inf), np.zeros(n_rows * k, _U)
    heaviest, octave = weights.max(initial=0), FIRST_RANK
    open_rows = np.ones(n_rows, bool)
    while len(hashes):
        low = 0.0 if octave == FIRST_RANK else 2.0**octave
        wide = 2.0 ** (octave + 1) - low
        # a row is done when its region is covered and all its coordinates are taken
        open_rows = open_rows & ((reach > low) | np.isinf(rank.reshape(n_rows, k)).any(1))
        if not open_rows.any():
            break
        use = open_rows[rows]
        h, w, r = hashes[use], weights[use], rows[use]
        floor, level = 0.0, 0
        while floor < heaviest:
            top = 1.0 if level == 0 else 2.0**level
            some = w > floor
            seed = mix(h[some] ^ mix(np.array([(octave + 64) * 128 + level], _U)))
            n = poisson(wide * (top - floor), _unit(seed))
            owner = np.repeat(np.flatnonzero(some), n)
            i = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            ids = mix(np.repeat(seed, n) + (i + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
            if heaviest > 1:
                under = floor + (top - floor) * _unit(mix(ids + _U(1))) < w[owner]
                owner, ids = owner[under], ids[under]
            coordinate = ((ids & _U(0xFFFFFFFF)) * _U(k)) >> _U(32)
            place = r[owner] * k + coordinate.astype(np.int64)
            at = low + wide * _unit(mix(ids + _U(2)))
            np.minimum.at(rank, place, at)
            won = at == rank[place]
            dart[place[won]] = ids[won]
            floor, level = top, level + 1
        octave += 1
    return (mix(dart) >> _U(32)).astype(np.uint32).reshape(n_rows, k)


def sketches(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """(id, one, two, n, sig) of each document: two hashes of its shingle set, its mass, its signature.

    weighting: "set" (every shingle weighs 1) or "count" (as often as it occurs).
    """
    k = bands * rows

    def run(batches):
        hasher, poisson = Hasher(6), _Poisson()
        for part, data, offsets in chunks(batches, "text", rows=SKETCH_ROWS):
            h, row, count = shingles(data, offsets, hasher, width)
            w = count.astype(float) if weighting == "count" else np.ones(len(h))
            sig = signatures(h, w, row, part.num_rows, k, poisson)
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            tagged = h + w.astype(_U) * _U(0xA24BAED4963EE407)
            sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(tagged ^ _U(salt)))]) for salt in (0x51ED270B, 0xB492B66F)]
            one, two = ((s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums)
            n = np.bincount(row, weights=w, minlength=part.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(one), pa.array(two), pa.array(n), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "one", "two", "n", "sig"])

    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, one bigint, two bigint, n bigint, sig binary")


def _verifying(width: int, least: float, weighting: str):
    def run(batches):
        hasher = Hasher(6)
        for batch in batches:
            at = 0
            sizes = sum(np.diff(np.frombuffer(batch.column(c).buffers()[1], np.int32)[batch.column(c).offset :][: batch.num_rows + 1]) for c in (2, 3)) if batch.num_rows else np.zeros(0)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, side="right")) - 1)
                part = batch.slice(at, to - at)
                at = to
                sets = []
                for c in ("text_x", "text_y"):
                    _, data, offsets = next(chunks(iter([part.select([c])]), c, limit=1 << 62))
                    h, row, count = shingles(data, offsets, hasher, width)
                    sets.append((h, row, count if weighting == "count" else np.ones(len(h), np.int64)))
                h, row, w = (np.concatenate(z) for z in zip(*sets, strict=True))
                order = np.lexsort((h, row))
                h, row, w = h[order], row[order], w[order]
                same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
                common = np.bincount(row[same], weights=np.minimum(w[same], w[same + 1]), minlength=part.num_rows)
                total = np.bincount(row, weights=w, minlength=part.num_rows) - common
                linked = common >= least * total - 1e-9
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(linked)), part.column(1).filter(pa.array(linked))], names=["x", "y"])
            release()

    return run


def _texts(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """(id, text) of the documents with these ids, filtered where they are read if the ids are few enough to broadcast."""
    needed = ids.distinct()
    if needed.count() <= MAX_BROADCAST_IDS:
        needed = F.broadcast(needed)
    return docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(needed, "id", "left_semi")


def _busy(pairs: DataFrame, side: str) -> DataFrame:
    """(side, members, parts): texts of more than PAIR_ROWS pairs, and how many tasks their pairs are dealt over."""
    each = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > PAIR_ROWS)
    return written(each.withColumn("parts", F.ceil(F.col("members") / PAIR_ROWS).cast("int")), "busy")


def verified(pairs: DataFrame, docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = SHINGLE, least: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """The pairs (x, y) whose texts have a similarity of at least ``least``, exactly. Pairs should be a table that is cheap to read again.

    A text x of many pairs is sent to a task for every PAIR_ROWS of them; y should be the side of few pairs.
    """
    texts = _texts(docs, pairs.select(F.col("x").alias("id")).union(pairs.select("y")), text, key)
    kind, busy = pairs.schema["x"].dataType.simpleString(), _busy(pairs, "x")
    one, other = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "xy")
    # the hint keeps small and large inputs on one plan: texts are never broadcast
    if busy.isEmpty():
        both = pairs.join(one.hint("merge"), "x")
    else:
        dealt = spread(pairs, busy, ["x"]).withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int")).drop("parts")
        dealt = dealt.unionByName(pairs.join(busy.select("x").hint("merge"), "x", "left_anti").withColumn("part", F.lit(0)))
        copied = one.join(busy.select("x", "parts").hint("merge"), "x", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        both = dealt.join(copied.hint("merge"), ["x", "part"]).drop("part")
    both = both.join(other.hint("merge"), "y")
    return both.select("x", "y", "text_x", "text_y").mapInArrow(_verifying(width, least, weighting), f"x {kind}, y {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id that each linked id reaches; ids without links are absent.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until every id hangs on its root; each round is written to the shared folder.
    """
    edges = written(links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        children = edges.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if children[0] == children[1] and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("members")), "hubs")
        large = spread(both.where("b > a"), hubs, ["a"], total=children[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        hubs = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("members")), "hubs")
        small = spread(large, hubs, ["a"])
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "edges")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct()


def _promising(k: int, rows_of_band: int, least: float, deviations: float | None):
    """Rows of a block that share this band first with a row of another component whose signature agrees as much as a similar text's must."""
    enough = 0 if deviations is None else least * k - deviations * np.sqrt(least * (1 - least) * k)

    def run(group, rows):
        sig = np.stack([np.frombuffer(s, np.uint32) for s in rows.column("sig").to_pylist()])
        n, root, chunk = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n", "root", "chunk"))
        one_block, b = group[1].as_py() == group[2].as_py(), rows.column("b")[0].as_py()
        hit = np.zeros(len(sig), bool)
        for i in range(len(sig) - 1):
            others = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (one_block | (chunk[i + 1 :] != chunk[i])) & (np.minimum(n[i + 1 :], n[i]) >= least * np.maximum(n[i + 1 :], n[i]) - 1e-9))
            same = sig[others] == sig[i]
            near = same.sum(1) >= enough
            same = same[near]
            first = same.reshape(len(same), k // rows_of_band, rows_of_band).all(2).argmax(1) == b
            hit[others[near][first]] = True
            hit[i] |= first.any()
        return rows.select(["band", "rep", "n", "root"]).filter(pa.array(hit))

    return run


def _joined(least: float):
    """Links between a block's components, found by comparing shingle sets; rows that a link has put together aren't compared again."""

    def run(group, rows):
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        counts = [np.ones(len(x), np.int64) if c is None else np.frombuffer(c, np.int64) for x, c in zip(sets, rows.column("counts").to_pylist(), strict=True)]
        _, part = np.unique(rows.column("root").to_numpy(zero_copy_only=False), return_inverse=True)
        names, token = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(x) for x in sets])
        edges = np.concatenate([[0], np.cumsum(size)])
        weight = np.concatenate(counts)
        mass = np.add.reduceat(weight, edges[:-1])
        held, xs, ys = np.zeros(len(names), np.int64), [], []
        for i in range(len(sets) - 1):
            own = slice(edges[i], edges[i + 1])
            others = i + 1 + np.flatnonzero((part[i + 1 :] != part[i]) & (np.minimum(mass[i + 1 :], mass[i]) >= least * np.maximum(mass[i + 1 :], mass[i]) - 1e-9))
            if not len(others):
                continue
            held[token[own]] = weight[own]
            length = size[others]
            at = np.cumsum(length) - length
            cells = np.repeat(edges[others] - at, length) + np.arange(int(length.sum()))
            common = np.add.reduceat(np.minimum(held[token[cells]], weight[cells]), at)
            held[token[own]] = 0
            for j in others[common >= least * (mass[i] + mass[others] - common) - 1e-9]:
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    xs.append(i)
                    ys.append(int(j))
        column = rows.column("rep")
        return pa.table({"x": column.take(pa.array(xs, pa.int64())), "y": column.take(pa.array(ys, pa.int64()))})

    return run


def _shingled(width: int, weighting: str):
    def run(batches):
        hasher = Hasher(6)
        for part, data, offsets in chunks(batches, "text"):
            h, row, count = shingles(data, offsets, hasher, width)
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
            counts = cut(count.astype(np.int64)) if weighting == "count" else pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), cut(h), counts], names=["rep", "set", "counts"])

    return run


def _dealt(rows: DataFrame, block: int, shingles: int | None = None) -> DataFrame:
    """rows with a band's members dealt into blocks, and each block with each: columns i, j, chunk. Blocks are known from partial counts before any row moves."""
    need = F.ceil(F.count(F.lit(1)) / block)
    need = need if shingles is None else F.greatest(need, F.ceil(F.sum("n") / shingles))
    size = written(rows.groupBy("band").agg(need.cast("int").alias("blocks"), F.count(F.lit(1)).alias("members")), "blocks")
    own = spread(rows, size, ["band"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("blocks", "other")


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighting: str = "set", deviations: float | None = DEVIATIONS) -> DataFrame:
    """(key, class_id): one row for each row of docs; class_id is the least key of its component.

    Nodes are documents, links are pairs of at least the similarity (Jaccard, of sets or of counts of word shingles).
    Texts with the same few words (fewer than the width), and all texts without words (null, empty, blank), are copies of each other.
    Rows with a null key have a null class; rows that share a key are one document, linked to whatever one of its texts is linked to.
    Other columns of docs are neither read nor returned. An empty table gives no rows.

    deviations: in what leaders leave apart, pairs whose signatures agree less than ``least`` minus so many standard deviations are passed over;
    None passes over none that share a band.
    """
    small_batches(docs.sparkSession)
    options = {"text": text, "key": key, "width": width, "weighting": weighting}
    own = docs.select(key, text)
    seen = written(sketches(own, bands=bands, rows=rows, **options), "sketches")
    total = seen.count()
    same = ["one", "two", "n"]
    copies = written(seen.groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")), "copies")
    first = copies.select(*same, F.col("rep").alias("id"))
    nodes = written(seen.join(first.hint("merge"), [*same, "id"], "left_semi").select(F.col("id").alias("rep"), "n", "sig").distinct(), "nodes")

    size = rows * 4
    bands_of = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.cast("tinyint").alias("b"), F.xxhash64(b, F.substring("sig", b * size + 1, F.lit(size))).alias("band")))).alias("at")
    each = nodes.select("rep", "n", bands_of).select("rep", "n", "at.b", "at.band")
    # every member meets its band's first
    heads = written(each.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"), "heads")
    shared = written(spread(each, heads.withColumn("size", F.col("members")), ["band"], total=nodes.count() * bands), "bands")

    def near(a: str, b: str):
        return F.least(a, b) >= least * F.greatest(a, b) - 1e-9

    pairs = shared.where(near("n", "head.n")).select(F.col("rep").alias("x"), F.col("head.rep").alias("y"))
    links = written(verified(written(_ordered(pairs), "pairs"), own, least=least, **options), "links")
    repeated = written(seen.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if not repeated.isEmpty():  # a document of several texts links what they belong to
        texts = seen.join(repeated.hint("merge"), "id", "left_semi").select("id", *same).distinct()
        links = written(links.unionByName(spread(texts, copies, same, total=total).select(F.col("id").alias("x"), F.col("rep").alias("y")).where("x <> y")), "links")
    root = components(links)

    # bands that still hold several components; a band of two has met its only pair
    placed = shared.where("size > 2").drop("head", "size").join(root.select(F.col("id").alias("rep"), "root").hint("merge"), "rep", "left")
    placed = written(placed.withColumn("root", F.coalesce("root", "rep")), "placed")
    mixed = written(placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").drop("lo", "hi"), "mixed")
    if not mixed.isEmpty():
        apart = written(spread(placed, mixed, ["band"]), "apart")
        kind = own.schema[key].dataType.simpleString()
        blocks = _dealt(apart, BLOCK).join(nodes.select("rep", "sig").hint("merge"), "rep")
        found = blocks.groupBy("band", "i", "j").applyInArrow(_promising(bands * rows, rows, least, deviations), f"band bigint, rep {kind}, n bigint, root {kind}")
        found = written(found.distinct(), "promising")
        sets = _texts(own, found.select(F.col("rep").alias("id")), text, key).mapInArrow(_shingled(width, weighting), f"rep {kind}, set binary, counts binary")
        blocks = _dealt(found, BLOCK, BLOCK_SHINGLES).join(sets.hint("merge"), "rep")
        more = blocks.groupBy("band", "i", "j").applyInArrow(_joined(least), f"x {kind}, y {kind}")
        root = components(links.unionByName(written(more.distinct(), "more-links")))
    named = copies.join(root.select(F.col("id").alias("rep"), "root").hint("merge"), "rep", "left").withColumn("class_id", F.coalesce("root", "rep"))
    # all copies of a text may be a third of all rows: they are met by a broadcast
    whole = spread(seen.select("id", *same), written(named.select(*same, "members", "class_id"), "classes"), same, total=total).select(F.col("id").alias(key), "class_id")
    return whole.unionByName(docs.where(F.col(key).isNull()).select(key, F.col(key).alias("class_id")))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """docs without all but the first document (least key) of each class; rows with a null key stay.

    Rows that share a key are one document, of which one row stays: that of the least hash of all its columns.
    Every column of docs is kept, whatever its name.
    """
    keep = classes(docs, key=key, **options).where(F.col(key) == F.col("class_id")).select(key).distinct()
    repeated = written(docs.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") > 1)).select(key), "repeated")
    unkeyed = docs.where(F.col(key).isNull())
    if repeated.isEmpty():
        return docs.join(keep, key, "left_semi").unionByName(unkeyed)
    keep = written(keep, "kept")
    several = docs.join(keep.join(repeated, key, "left_semi"), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return docs.join(keep.join(repeated, key, "left_anti"), key, "left_semi").unionByName(several).unionByName(unkeyed)


def query(spark, sf_dir):
    """op1: all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
