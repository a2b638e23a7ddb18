"""N-gram Jaccard join by count vectors in R-trees.

Two documents link when the Jaccard similarity of their shingle sets is at
least ``percent`` / 100.  Equal sets are one class and are compared once.

1. Every class is a point: its shingles are hashed into groups (more for larger
   sets) and counted.  The overlap of two sets is at most the sum of the coordinate-wise
   minima of their points, and over two boxes at most the sum of the minima of
   their upper corners.
2. An R-tree over all points prunes nothing: hashed counts of unrelated texts
   of one size differ by noise in every coordinate, so all boxes overlap.  The
   points are therefore dealt to R-trees by shared rare shingles: two sets
   that link must share one of their ``n - ceil(percent n / 100) + 1`` rarest
   shingles under any order common to all sets.  The order is the frequency
   in a count sketch of all shingles, so passages that many documents share
   come last.
3. A block is named by its smallest class; shingles with the same smallest
   class share one block.  First every point is compared with that class
   (linear however large the block): pairs pass the count bound and then the
   real sets are intersected.  Blocks that the verified links leave in several
   components are searched with an R-tree, first for the best partners of each
   point, in the end for all; a block too large for a task is cut into slices,
   and every pair of slices is searched.  Only pairs of different components
   survive, so a group of thousands of near copies does not give all its
   pairs, and no pair that could join two components is left untried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import prepare, staged, text_of
from .textwords import U64, Hasher, mix, shingle_sets

#: Coordinates of a point by set size (up to, number); a larger number is a multiple, so points can be folded.
GROUPS = ((1024, 512), (8192, 2048), (None, 8192))
#: Coordinates compared at once.
COMPARED = 1 << 21
#: Buckets of the count sketch: fixed, so its size does not grow with the data.
SKETCH_BITS, SKETCH_CHUNKS = 20, 256
#: A sketch bucket counted this many times the mean (plus HOT_LEAST) is taken for a hot shingle.
HOT_FACTOR, HOT_LEAST = 8, 4096
#: Largest bitmap of wanted ids, and the chunks it is put together in.
BITMAP_BITS, CHUNKS = 26, 64
#: Entries that one block task should hold.
BLOCK_ENTRIES = 400_000
#: Members of a slice of a block that is too large for one R-tree.
SLICE = 1024
#: Blocks of so many classes share a tree with others, up to so many rows.
SMALL, SMALL_ROWS = 64, 8192
#: Best partners in other components that are tried for each class, round by round, before all that survive;
#: a round that has left none out is the last.
BEST = (32,)
#: Class ids of sets whose documents all have a null id start here.
NO_ID = 1 << 62


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set, independent of order."""
    first, second = mix(shingles).sum(dtype=U64), mix(shingles * U64(0xC2B2AE3D27D4EB4F) + U64(7)).sum(dtype=U64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def _needed(n: int, percent: int) -> int:
    """Rarest shingles of a set of n of which a linked set must share one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _profiles(width: int):
    """(doc_id, text) -> per document its set's size and key, and the task's sketch in chunks."""
    def run(batches):
        hasher = Hasher()
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        names = ["doc_id", "n_shingles", "k1", "k2", "chunk", "counts"]
        for batch in batches:
            sizes, firsts, seconds = [], [], []
            for s in shingle_sets(batch.column(1), width, hasher):
                k1, k2 = _set_key(s)
                sizes.append(len(s))
                firsts.append(k1)
                seconds.append(k2)
                np.add.at(sketch, (s >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
            m = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()),
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        parts = sketch.reshape(SKETCH_CHUNKS, -1)
        kept = np.flatnonzero(parts.any(axis=1))
        m = len(kept)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64())] * 4
            + [pa.array(kept, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in kept], pa.binary())], names=names)
    return run


def _sum_counts(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(zlib.decompress(c), dtype=np.int64) for c in frame["counts"]], axis=0)
    return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def _rarest(width: int, percent: int, order):
    """(doc_id, text) -> the set's key and its rarest shingles."""
    def run(batches):
        hasher = Hasher()
        counts = order.value
        for batch in batches:
            k1s, k2s, sizes, blobs = [], [], [], []
            for s in shingle_sets(batch.column(1), width, hasher):
                k1, k2 = _set_key(s)
                rank = counts[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                k1s.append(k1)
                k2s.append(k2)
                sizes.append(len(s))
                blobs.append(s[np.argsort(rank, kind="stable")[:_needed(len(s), percent)]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()),
                 pa.array(blobs, pa.binary())], names=["k1", "k2", "doc_id", "n", "rare"])
    return run


def _deal(buckets: int, salts: int, hot):
    """(cid, n, rare) -> packed entries (shingle, class, size) by bucket of the shingle.

    Entries of hot shingles go to salted buckets by class, behind the others.
    """
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        is_hot = hot.value

        def flush():
            token, cid, n = (np.concatenate(x) for x in zip(*held))
            bucket = ((token >> U64(20)) % U64(buckets)).astype(np.int64)
            hot_ones = is_hot[(token >> U64(64 - SKETCH_BITS)).astype(np.int64)]
            bucket[hot_ones] = buckets + (mix(cid[hot_ones].view(U64)) % U64(salts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, cid, n, bucket = token[order], cid[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(bucket)]
            for x in range(0, len(starts), 1000):
                part = list(zip(starts[x:x + 1000], ends[x:x + 1000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts[x:x + 1000]], pa.int64())]
                    + [pa.array([v[a:b].tobytes() for a, b in part], pa.binary()) for v in (token, cid, n)],
                    names=["bucket", "tokens", "cids", "sizes"])

        for batch in batches:
            cids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for cid, n, blob in zip(cids, sizes, batch.column(2)):
                token = np.frombuffer(blob.as_buffer(), dtype=U64)
                held.append((token, np.full(len(token), cid, np.int64), np.full(len(token), n, np.int64)))
                count += len(token)
            if count >= 2_000_000:
                yield from flush()
                held.clear()
                count = 0
        if count:
            yield from flush()
    return run


def _shared(buckets: int, percent: int):
    """Of a bucket's entries those whose shingle is also in a class of a size that can link; all of a salted bucket."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        token, cid, n = (np.concatenate([np.frombuffer(x, dtype=d) for x in frame[c]])
                         for c, d in (("tokens", np.int64), ("cids", np.int64), ("sizes", np.int64)))
        if frame["bucket"].iloc[0] < buckets:
            order = np.lexsort((cid, n, token))
            token, cid, n = token[order], cid[order], n[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])]
            token, cid, n = token[new], cid[new], n[new]
            # sorted by size, a class has a partner exactly when one of its neighbours is one
            close = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            kept = np.r_[close, False] | np.r_[False, close]
            token, cid, n = token[kept], cid[kept], n[kept]
        return pd.DataFrame({"token": token, "cid": cid, "n": n})
    return run


def _mark(bits: int):
    """(id) -> the task's bitmap of hashed ids, in chunks."""
    def run(batches):
        seen = np.zeros(bits, dtype=bool)
        for batch in batches:
            seen[_bit(batch.column(0).to_numpy(), bits)] = True
        parts = np.packbits(seen).reshape(-1, bits // 8 // CHUNKS)
        kept = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([parts[i].tobytes() for i in kept], pa.binary())],
                                         names=["chunk", "marks"])
    return run


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(U64)) & U64(bits - 1)).astype(np.int64)


def _either(frame: pd.DataFrame) -> pd.DataFrame:
    marks = np.bitwise_or.reduce([np.frombuffer(m, dtype=np.uint8) for m in frame["marks"]])
    return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "marks": [marks.tobytes()]})


def _maybe(marks, bits: int, then):
    """(doc_id, text) -> ``then`` of the rows whose id is marked: all that are wanted and, by chance, a few more."""
    def run(batches):
        seen = np.unpackbits(marks.value).view(bool)

        def marked():
            for batch in batches:
                ids = batch.column(0)
                ok = seen[_bit(ids.fill_null(0).to_numpy(), bits)] | ids.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(ok))
        yield from then(marked())
    return run


def _sieved(source: DataFrame, wanted: DataFrame, rows: int, then, schema: str) -> DataFrame:
    """``then`` of the rows of (doc_id, text) with a wanted id (``rows`` at most), and by chance a few more; texts are not shuffled for it.

    Both steps are one Python function, so that a task has one Python process and not two.

    The bitmap has eight bits for each wanted id but at most 2 ** BITMAP_BITS
    (8 MB), beyond which it only lets more texts through.  Null ids pass.
    """
    wanted = staged(wanted, "wanted", rows)
    bits = 1 << max(16, min(BITMAP_BITS, (8 * wanted.count()).bit_length()))
    rows = (wanted.mapInArrow(_mark(bits), "chunk int, marks binary").groupBy("chunk")
            .applyInPandas(_either, "chunk int, marks binary").collect())
    marks = np.zeros((CHUNKS, bits // 8 // CHUNKS), dtype=np.uint8)
    for row in rows:
        marks[row["chunk"]] = np.frombuffer(row["marks"], dtype=np.uint8)
    return source.mapInArrow(_maybe(source.sparkSession.sparkContext.broadcast(marks.ravel()), bits, then), schema)


def _members(width: int, with_sets: bool):
    """(doc_id, text) -> class id, size and count vector, or set."""
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids, sizes, points, sets = [], [], [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width, hasher)):
                if len(s):
                    ids.append(doc_id if doc_id is not None else _unnamed(_set_key(s)[0]))
                    sizes.append(len(s))
                    if with_sets:
                        sets.append(s.view(np.int64))
                    else:
                        groups = _groups(len(s))
                        counts = np.bincount((s % U64(groups)).astype(np.int64), minlength=groups).astype("<i4")
                        points.append(zlib.compress(counts.tobytes(), 1))  # mostly zeros and ones
            last = pa.array(sets, pa.list_(pa.int64())) if with_sets else pa.array(points, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), last],
                                             names=["cid", "n", "shingles" if with_sets else "point"])
    return run


def _groups(n: int) -> int:
    return next(g for most, g in GROUPS if most is None or n <= most)


def _unnamed(k1: int) -> int:
    return NO_ID | (k1 & (NO_ID - 1))


def _folded(points: list, groups: int) -> np.ndarray:
    """Points of ``groups`` coordinates or more as a matrix of ``groups`` columns."""
    out = np.empty((len(points), groups), dtype=np.int32)
    for k, p in enumerate(points):
        out[k] = np.frombuffer(zlib.decompress(p), dtype="<i4").reshape(-1, groups).sum(axis=0)
    return out


def _passing(percent: int):
    """Pairs with sizes and points of both -> the pairs whose bound reaches the needed overlap."""
    def run(batches):
        for batch in batches:
            a, b, n_a, n_b, point_a, point_b = (batch.column(c) for c in range(6))
            sizes = zip(n_a.to_pylist(), n_b.to_pylist(), point_a, point_b)
            ok = []
            for x, y, p, q in sizes:
                groups = _groups(min(x, y))
                bound = int(np.minimum(*_folded([p.as_buffer(), q.as_buffer()], groups)).sum())
                ok.append((100 + percent) * bound >= percent * (x + y))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


class RTree:
    """Points packed into boxes by block, size and then their most spread coordinates, level by level.

    A box has the upper corner of its points and the ranges of their sizes
    and blocks.  Two points can meet only in one block.
    """

    FANOUT = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, blocks: np.ndarray | None = None) -> None:
        blocks = np.zeros(len(sizes), np.int64) if blocks is None else blocks
        spread = np.argsort(-points.std(axis=0), kind="stable")[:3]
        order = np.lexsort((*(points[:, c] for c in spread[::-1]), sizes // max(1, int(sizes.max()) // 16), blocks))
        self.order = order
        level = (points[order], sizes[order], sizes[order], blocks[order], blocks[order])
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), self.FANOUT)
            level = tuple(f.reduceat(x, cuts) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)

    def pairs(self, other: RTree, percent: int):
        """Yield (rows here, rows there, bounds) of the points whose bound reaches the needed overlap.

        Of a tree with itself every pair is met once, and no point with itself.
        """
        depth = max(len(self.levels), len(other.levels)) - 1
        here, there = np.zeros(1, np.int64), np.zeros(1, np.int64)
        step = max(16, COMPARED // self.levels[0][0].shape[1])
        for level in range(depth, -1, -1):
            a, b = self._level(level), other._level(level)
            if level < depth:
                here, there = self._children(here, there, len(a[0]), len(b[0]))
            keep = (a[3][here] <= b[4][there]) & (b[3][there] <= a[4][here])
            if other is self:
                keep &= here < there if level == 0 else here <= there
            here, there = here[keep], there[keep]
            keep = np.zeros(len(here), dtype=bool)
            for x in range(0, len(here), step):
                i, j = here[x:x + step], there[x:x + step]
                bound = np.minimum(a[0][i], b[0][j]).sum(axis=1)
                # the smallest sizes that the boxes allow, and sizes too far apart
                ok = (100 + percent) * bound >= percent * (a[1][i] + b[1][j])
                ok &= (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
                if level == 0 and ok.any():
                    yield self.order[i[ok]], other.order[j[ok]], bound[ok]
                keep[x:x + step] = ok
            here, there = here[keep], there[keep]

    def _level(self, level: int):
        return self.levels[min(level, len(self.levels) - 1)]

    def _children(self, here, there, n_here: int, n_there: int):
        f = self.FANOUT
        i = (here[:, None] * f + np.arange(f)).ravel() if n_here > 1 else np.zeros(len(here), np.int64)
        j = (there[:, None] * f + np.arange(f)).ravel() if n_there > 1 else np.zeros(len(there), np.int64)
        ki, kj = (f if n_here > 1 else 1), (f if n_there > 1 else 1)
        i = np.repeat(i.reshape(-1, ki), kj, axis=1).ravel()
        j = np.tile(j.reshape(-1, kj), (1, ki)).ravel()
        ok = (i < n_here) & (j < n_there)
        return i[ok], j[ok]


def _search(percent: int, best: int | None):
    """Surviving pairs of different components: of a tree of many small blocks, of a slice of a large one, or of two slices."""
    def run(table: pa.Table) -> pa.Table:
        block, cid, n, label, part, i, j, small = (
            table.column(c).to_numpy() for c in ("block", "cid", "n", "label", "slice", "i", "j", "small"))
        raw = table.column("point").to_pylist()
        level = np.array([_groups(x) for x in n])

        def candidates():
            # pairs of the points' own coordinates, or folded to those of the smaller of two sizes
            for groups in np.unique(level):
                rows = np.flatnonzero(level >= groups)
                points = _folded([raw[k] for k in rows], groups)
                if small[0] or i[0] == j[0]:
                    tree = RTree(points, n[rows], block[rows])
                    found, one, two = tree.pairs(tree, percent), rows, rows
                else:
                    at_i, at_j = np.flatnonzero(part[rows] == i[0]), np.flatnonzero(part[rows] == j[0])
                    if not len(at_i) or not len(at_j):
                        continue
                    found = RTree(points[at_i], n[rows][at_i]).pairs(RTree(points[at_j], n[rows][at_j]), percent)
                    one, two = rows[at_i], rows[at_j]
                for x, y, bound in found:
                    x, y = one[x], two[y]
                    own = np.minimum(level[x], level[y]) == groups
                    yield x[own], y[own], bound[own]

        kept, rows, cut = [], 0, False
        for x, y, bound in candidates():
            ok = label[x] != label[y]
            x, y, bound = x[ok], y[ok], bound[ok]
            kept.append(pd.DataFrame({"a": np.minimum(cid[x], cid[y]), "b": np.maximum(cid[x], cid[y]),
                                      "score": bound / (n[x] + n[y] - bound)}))
            rows += len(kept[-1])
            if rows > 200_000:
                kept, fewer = _best_of(pd.concat(kept), best)
                kept, rows, cut = [kept], len(kept) // 2, cut or fewer
        if not kept:
            kept = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "score": np.zeros(0)})]
        pairs, fewer = _best_of(pd.concat(kept), best)
        a, b = pairs["a"].tolist(), pairs["b"].tolist()
        more = [None] if cut or fewer else []  # a row without pair says that some are left for later
        return pa.table({"a": pa.array(a + more, pa.int64()), "b": pa.array(b + more, pa.int64())})
    return run


def _best_of(pairs: pd.DataFrame, best: int | None) -> tuple[pd.DataFrame, bool]:
    """Of the pairs (a, b, score) those that are among the best of either end, and whether that left any out."""
    pairs = pairs.drop_duplicates(["a", "b"])
    if best is None or pairs.empty:
        return pairs, False
    ranked = pairs.sort_values(["score", "a", "b"], ascending=[False, True, True])
    chosen = ranked[(ranked.groupby("a").cumcount() < best) | (ranked.groupby("b").cumcount() < best)]
    return chosen, len(chosen) < len(ranked)


class JaccardJoin:
    """The join's results: ``documents`` (doc_id, n_shingles, component_id) and ``links`` (a, b, overlap).

    ``links`` holds verified links between classes, named by their smallest
    document, that join the components; a link between two classes that
    earlier links already join is not listed.
    """

    def __init__(self, documents: DataFrame, links: DataFrame) -> None:
        self.documents, self.links = documents, links


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = 5, percent: int = 75) -> JaccardJoin:
    """Join documents whose shingle sets have a Jaccard similarity of at least ``percent`` %.

    Null, empty and blank texts have no shingles and link with nothing; they
    are their own component.  Rows with one id are one document to the links;
    rows with a null id join components, whose id is null when no row of it
    has an id.  Repeated rows are kept, each with the same result.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))

    profile = staged(source.mapInArrow(
        _profiles(width), "doc_id long, n_shingles long, k1 long, k2 long, chunk int, counts binary"), "profiles")
    members = profile.where("chunk is null").select("doc_id", "n_shingles", "k1", "k2")
    order, hot, entries, hot_entries = _order(profile, percent)

    keys = source.mapInArrow(_rarest(width, percent, order), "k1 long, k2 long, doc_id long, n long, rare binary")
    unnamed = F.col("k1").bitwiseAND(F.lit(NO_ID - 1)).bitwiseOR(F.lit(NO_ID))
    classes = (keys.where("n > 0").groupBy("k1", "k2")
               .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("rare").alias("rare"))
               .select(F.coalesce("doc_id", unnamed).alias("cid"), "n", "rare"))
    buckets, salts = max(16, entries // BLOCK_ENTRIES), max(1, hot_entries // BLOCK_ENTRIES)
    dealt = classes.mapInArrow(_deal(buckets, salts, hot), "bucket long, tokens binary, cids binary, sizes binary")
    shared = staged(dealt.groupBy("bucket").applyInPandas(_shared(buckets, percent), "token long, cid long, n long"), "shared")

    # a block is the classes that share a rare shingle with the smallest class of any of that shingle's classes
    lead = shared.groupBy("token").agg(F.min("cid").alias("block"), F.max("cid").alias("z")).where("block <> z")
    # a row for each row of ``shared`` at most: a file for each of many tasks would cost more than its rows,
    # a process of the executor that sets its mode among it
    blocks = staged(shared.join(lead.select("token", "block"), "token").select("block", "cid").distinct(), "blocks", shared.count())
    stars = blocks.where("cid <> block").select(F.col("block").alias("a"), F.col("cid").alias("b"))
    n_pairs = blocks.count()
    points = _sieved(source, blocks.select(F.col("cid").alias("doc_id")).distinct(), n_pairs,
                     _members(width, False), "cid long, n long, point binary")
    points = staged(points.dropDuplicates(["cid"]), "points", n_pairs)

    links = staged(_verified(stars, points, source, width, percent, n_pairs), "links", n_pairs)
    n_links = links.count()
    labels = connected_components(links, rows=n_links)
    for best in (*BEST, None):
        found = _residual(blocks, points, labels, percent, best, n_pairs)
        if found is None:
            break
        more = found.where("a is not null")
        n_more = more.count()
        links = staged(links.unionByName(_verified(more, points, source, width, percent, n_more)).dropDuplicates(["a", "b"]), "links",
                       n_links + n_more)
        n_links = links.count()
        labels = connected_components(links, rows=n_links)
        if found.where("a is null").isEmpty():  # all surviving pairs have been tried
            break

    named = members.where("n_shingles > 0").groupBy("k1", "k2").agg(F.coalesce(F.min("doc_id"), unnamed).alias("cid"))
    named = (named.join(labels.toDF("cid", "label"), "cid", "left")
             .select("k1", "k2", F.coalesce("label", "cid").alias("label")))
    documents = members.join(named, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        .otherwise(F.when(F.col("label") < NO_ID, F.col("label"))).alias("component_id"))
    return JaccardJoin(documents, links)


def _order(profile: DataFrame, percent: int):
    """The sketch as a broadcast array (2 ** SKETCH_BITS counts, whatever the data), and which buckets are hot."""
    spark = profile.sparkSession
    rows = (profile.where("chunk is not null").groupBy("chunk")
            .applyInPandas(_sum_counts, "chunk int, counts binary").collect())
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64).reshape(SKETCH_CHUNKS, -1)
    for row in rows:
        counts[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    counts = counts.ravel()
    hot = counts > HOT_FACTOR * counts.mean() + HOT_LEAST
    share = (100 - percent) / 100
    total, hot_total = int(counts.sum() * share), int(counts[hot].sum() * share)
    context = spark.sparkContext
    return context.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32)), context.broadcast(hot), total, hot_total


def _verified(pairs: DataFrame, points: DataFrame, source: DataFrame, width: int, percent: int, n_pairs: int) -> DataFrame:
    """Of the pairs, ``n_pairs`` at most, those whose bound, and then whose sets, reach the similarity."""
    def side(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.select(F.col("cid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    close = (pairs.join(side(points, "a", "n", "point"), "a").join(side(points, "b", "n", "point"), "b")
             .where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))))
    passed = staged(close.select("a", "b", "n_a", "n_b", "point_a", "point_b").mapInArrow(
        _passing(percent), "a long, b long"), "passed", n_pairs)
    ends = passed.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _sieved(source, ends, 2 * n_pairs, _members(width, True), "cid long, n long, shingles array<long>")
    sets = staged(sets, "sets")
    overlap = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (passed.join(side(sets, "a", "n", "shingles"), "a").join(side(sets, "b", "n", "shingles"), "b")
            .select("a", "b", "n_a", "n_b", overlap.cast("long").alias("overlap"))
            .where((100 + percent) * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b")))
            .select("a", "b", "overlap").dropDuplicates(["a", "b"]))


def _residual(blocks: DataFrame, points: DataFrame, labels: DataFrame, percent: int, best: int | None, n_blocks: int):
    """Surviving pairs of different components in blocks that hold several; None without such a block.

    A row of nulls says that ``best`` has left some out.  ``n_blocks``: rows of ``blocks``.
    """
    member = blocks.join(labels.toDF("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    several = staged(member.groupBy("block").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low <> high"), "several", n_blocks)
    if several.isEmpty():
        return None
    rows = several.agg(F.sum(F.when(F.col("m") <= SMALL, F.col("m")))).first()[0] or 0
    small = F.col("m") <= SMALL
    several = several.select("block", small.alias("small"),
                             F.when(small, 1).otherwise(F.ceil(F.col("m") / SLICE)).cast("int").alias("slices"))
    spread = (member.join(several, "block").join(points.select("cid", "n", "point"), "cid")
              .withColumn("slice", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("slices")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
              .withColumn("i", F.least("slice", "other")).withColumn("j", F.greatest("slice", "other")))
    heap = F.when(F.col("small"), F.pmod(F.xxhash64("block"), F.lit(max(8, rows // SMALL_ROWS)))).otherwise(F.col("block"))
    found = spread.groupBy("small", heap, "i", "j").applyInArrow(_search(percent, best), "a long, b long")
    return staged(found.distinct(), "survivors", n_blocks)
