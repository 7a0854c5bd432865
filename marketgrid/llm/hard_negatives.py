"""Hard negatives by exact search with lists that anchor clusters share.

An anchor's positives are its nearest rows of the same label; a hard negative
is a row of another label whose score lies in a window below the positive's.
Scores are integer inner products of the quantised vectors.

Rows are dealt into shards and anchors into parts, and every (part, shard) cell
is one task's group of bounded size.  Anchors of a part are clustered by
direction (spherical k-means).  In a cell, each cluster sorts the shard's rows
once by an upper bound that holds for all its members: with t the angle between
row and centroid and r the largest angle between a member and the centroid, no
member's score exceeds |member| |row| cos(max(0, t - r)).  Every member walks
that list until the bound shows that nothing behind can enter its result:

* positives: the bound is below the k-th best score found so far;
* negatives: for each of its windows, the bound is below the window or below
  the k-th best score found in it.

Best rows of the cells are merged by rank.  The walk comes twice, since windows
depend on the positives of all shards.  Cells compare stated queries with all
rows; nothing is sampled and no list is cut.

Of rows with the same label and vector only the first few by vec_id can be in a
result (their scores tie, and ties go to smaller ids), so the others are left
out of the lists, exactly; a group of copies weighs no more than that.

Edge cases: rows with a null vec_id, label or vector, or with a null or
non-finite component take no part.  Rows equal in vec_id, label and vector
count as one; rows that share an anchor's vec_id are never beside it.  Shorter
vectors are filled up with zeros.  Scores beyond a long are taken as its end.
An anchor without positives, or a positive without negatives in its window, has
no rows.  Other columns never reach the operator; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialize

#: Anchors per part, rows per shard, anchors per cluster (about), rows per step of a walk.
PART, SHARD, CLUSTER, STEP = 2_048, 4_096, 16, 512
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ROW = "vec_id bigint, label bigint, vector array<double>"


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (rows.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                        F.col("label").cast("bigint").alias("label"),
                        F.col("embedding").cast("array<double>").alias("vector"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                    & F.col("vector").isNotNull() & F.forall("vector", finite))
            .select("vec_id", "label", F.transform("vector", lambda x: F.floor(x * scale).cast("double"))
                    .alias("vector"))
            .distinct())


# -- numpy, within a cell ------------------------------------------------------

def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row per vector, filled up with zeros."""
    vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widest(*columns: pa.ChunkedArray) -> int:
    return max([1, *(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for v in columns for c in v.chunks)])


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits their ends."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) \
        @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(exact, _LOW, _HIGH).astype(np.int64)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1)[:, None], size


def clusters(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Cluster of every row by direction; the same for the same rows."""
    directions, _ = unit(x)
    k = -(-len(x) // CLUSTER)
    centres = directions[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(directions @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, directions)
        moved, size = unit(sums)
        centres = np.where((size > 0)[:, None], moved, centres)
    return np.argmax(directions @ centres.T, axis=1)


class SharedList:
    """The rows of a shard in the order of a cluster's bound."""

    def __init__(self, members: np.ndarray, rows: np.ndarray):
        own, self.norms = unit(members)
        centre, size = unit(own.sum(axis=0)[None])
        centre = centre[0] if size[0] > 0 else own[0]
        directions, norms = unit(rows)
        def angle(y):
            return np.arccos(np.clip(y @ centre, -1, 1))
        reach = np.maximum(0, angle(directions) - angle(own).max())
        bound = norms * np.cos(reach)
        self.order = np.argsort(-bound, kind="stable")
        # room for the rounding of sums, roots and arcs
        self.bound, self.room = bound[self.order], 1e-6 * norms.max(initial=0)

    def above(self, members: np.ndarray, at: int) -> np.ndarray:
        """No score from place ``at`` on exceeds this, per member."""
        return self.norms[members] * (self.bound[at] + self.room) + 1


class Best:
    """The k best (score, id) per line; ``row`` is -1 where there are fewer."""

    def __init__(self, lines: int, k: int):
        self.score = np.full((lines, k), _LOW)
        self.id = np.full((lines, k), _HIGH)
        self.row = np.full((lines, k), -1)

    def least(self) -> np.ndarray:
        """What a score must reach: that of the k-th best, if there is one."""
        return np.where(self.row[:, -1] >= 0, self.score[:, -1], _LOW).astype(np.float64)

    def offer(self, lines: np.ndarray, scores: np.ndarray, may: np.ndarray, ids: np.ndarray,
              rows: np.ndarray) -> None:
        hit = (may & ((scores >= self.score[lines, -1:]) | (self.row[lines, -1:] < 0))).any(axis=1)
        lines, scores, may = lines[hit], scores[hit], may[hit]
        if not len(lines):
            return
        n, k = len(lines), self.score.shape[1]
        s = np.concatenate([self.score[lines], np.where(may, scores, _LOW)], axis=1)
        i = np.concatenate([self.id[lines], np.where(may, ids, _HIGH)], axis=1)
        r = np.concatenate([self.row[lines], np.where(may, rows, -1)], axis=1)
        # ~s is -s - 1, which no score overflows
        first = np.lexsort((i, ~s, r < 0), axis=1)[:, :k]
        at = np.arange(n)[:, None]
        self.score[lines], self.id[lines], self.row[lines] = s[at, first], i[at, first], r[at, first]


def nearest(ids, labels, x, row_ids, row_labels, rows, k: int) -> Best:
    """k best rows of the same label for the members of one cluster."""
    shared, best = SharedList(x, rows), Best(len(x), k)
    for label in np.unique(labels):
        walk = shared.order[row_labels[shared.order] == label]
        place = np.flatnonzero(row_labels[shared.order] == label)
        active = np.flatnonzero(labels == label)
        for at in range(0, len(walk), STEP):
            active = active[shared.above(active, place[at]) >= best.least()[active]]
            if not len(active):
                break
            now = walk[at:at + STEP]
            best.offer(active, inner(x[active], rows[now]),
                       row_ids[now] != ids[active, None], row_ids[now], now)
    return best


def within(ids, labels, x, low, high, row_ids, row_labels, rows, k: int) -> list[Best]:
    """Per window (columns of ``low`` and ``high``) the k best rows of other
    labels whose scores lie in it."""
    shared = SharedList(x, rows)
    best = [Best(len(x), k) for _ in range(low.shape[1])]
    active = np.flatnonzero((low <= high).any(axis=1))
    for at in range(0, len(rows), STEP):
        above = shared.above(active, at)
        open_ = [(low[active, w] <= high[active, w])
                 & (above >= np.maximum(low[active, w].astype(np.float64), best[w].least()[active]))
                 for w in range(len(best))]
        keep = np.logical_or.reduce(open_)
        active, open_ = active[keep], [o[keep] for o in open_]
        if not len(active):
            break
        now = shared.order[at:at + STEP]
        scores = inner(x[active], rows[now])
        other = (row_labels[now] != labels[active, None]) & (row_ids[now] != ids[active, None])
        for w, o in enumerate(open_):
            if o.any():
                mine = active[o]
                best[w].offer(mine, scores[o], other[o] & (scores[o] >= low[mine, w, None])
                              & (scores[o] <= high[mine, w, None]), row_ids[now], now)
    return best


# -- Spark ---------------------------------------------------------------------

def _parts(anchors: DataFrame, n: int, size: int) -> DataFrame:
    """``anchors`` with ``part`` and ``cluster``: labels stay together, larger
    ones are split."""
    parts = max(1, -(-n // size))
    per_label = anchors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    split = F.pmod(F.xxhash64("anchor"), F.greatest(F.lit(1), F.ceil(F.col("n") / size)))
    dealt = anchors.join(per_label, "label").withColumn("part", F.pmod(F.xxhash64("label", split), F.lit(parts)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("anchor")
        x = matrix(rows["vector"], widest(rows["vector"]))
        return rows.append_column("cluster", pa.array(clusters(x), pa.int64()))

    dealt = dealt.select("part", "anchor", "vec_id", "label", "vector")
    return dealt.groupBy("part").applyInArrow(run, f"part bigint, anchor bigint, {_ROW}, cluster bigint")


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, size: tuple[int, int],
           walk, fields: str) -> DataFrame:
    """``walk(members, row ids, row labels, row matrix)`` for each cluster of
    every (part, shard) cell; all anchors of a part meet all rows."""
    parts, shards = max(1, -(-n_anchors // size[0])), max(1, -(-n_rows // size[1]))
    cell = (F.col("part") * shards + F.col("shard")).alias("cell")
    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    right = (rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))))
    left = left.select(cell, *[c for c in anchors.columns if c != "part"])
    right = right.select(cell, "vec_id", "label", "vector")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(key, members: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if members.num_rows and found.num_rows:
            found = found.sort_by("vec_id")
            width = widest(members["vector"], found["vector"])
            ids, labels = (found[c].to_numpy() for c in ("vec_id", "label"))
            y = matrix(found["vector"], width)
            members = members.sort_by("anchor")
            cluster = members["cluster"].to_numpy()
            for c in np.unique(cluster):
                own = members.take(pa.array(np.flatnonzero(cluster == c)))
                out += walk(own, matrix(own["vector"], width), ids, labels, y)
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64())
                         for n, c in zip(names, list(zip(*out)) or [[]] * len(names))})

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, fields)


def first_by(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each key by score, then id, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
         high: int = 95, scale: int = 256, size: tuple[int, int] = (PART, SHARD)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``rows``: vec_id, label, embedding; ``anchor``: condition on vec_id; the
    window of a positive with score s is low * s <= 100 * score <= high * s."""
    rows = materialize(quantised(rows, scale))
    anchors = materialize(rows.filter(anchor).select(F.monotonically_increasing_id().alias("anchor"),
                                                     "vec_id", "label", "vector"))
    copies = Window.partitionBy("label", "vector").orderBy("vec_id")
    rows = (rows.withColumn("copy", F.row_number().over(copies))
            .filter(F.col("copy") <= max(positives + 1, negatives + 1)).drop("copy"))
    rows = materialize(rows)
    n_anchors, n_rows = anchors.count(), rows.count()     # from file footers
    anchors = materialize(_parts(anchors, n_anchors, size[0]))

    def walk_positives(own, x, ids, labels, y):
        best = nearest(own["vec_id"].to_numpy(), own["label"].to_numpy(), x, ids, labels, y, positives)
        line, at = np.nonzero(best.row >= 0)
        return [(own["anchor"].to_numpy()[line], best.id[line, at], best.score[line, at])]

    found = _cells(anchors, rows, n_anchors, n_rows, size, walk_positives,
                   "anchor bigint, id bigint, score bigint")
    found = first_by(found, ["anchor"], positives)
    # at most ``positives`` of them
    windows = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    targets = materialize(anchors.join(windows, "anchor").select(
        "*", F.col("p.id").alias("p_id"), F.col("p.score").alias("p_score")).drop("p"))

    def walk_negatives(own, x, ids, labels, y):
        score = own["p_score"].to_pylist()
        lo, hi = (np.full((len(score), positives), e) for e in (1, 0))     # low > high: no window
        for k, s in enumerate(score):
            lo[k, :len(s)] = [-(-low * v // 100) for v in s]
            hi[k, :len(s)] = [high * v // 100 for v in s]
        out, anchor_ids = [], own["anchor"].to_numpy()
        for w, best in enumerate(within(own["vec_id"].to_numpy(), own["label"].to_numpy(), x, lo, hi,
                                        ids, labels, y, negatives)):
            line, at = np.nonzero(best.row >= 0)
            out.append((anchor_ids[line], np.full(len(line), w), best.id[line, at], best.score[line, at]))
        return out

    hard = _cells(targets, rows, n_anchors, n_rows, size, walk_negatives,
                  "anchor bigint, place bigint, id bigint, score bigint")
    hard = first_by(hard, ["anchor", "place"], negatives)
    named = targets.select("anchor", F.col("vec_id").alias("anchor_id"),
                           F.posexplode(F.arrays_zip("p_id", "p_score")).alias("place", "p"))
    return hard.join(named, ["anchor", "place"]).select(
        "anchor_id", F.col("p.p_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.p_score").alias("positive_score"), F.col("score").alias("negative_score"))
