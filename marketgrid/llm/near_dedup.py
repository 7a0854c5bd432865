"""Near-duplicate documents by set sketches.

Sets: the distinct ``n``-word shingles of a lower-cased text.

1. A set's sketch has ``REGISTERS`` registers.  Each is the smallest of
   exponentially distributed hash values of the elements, kept as the step
   floor(1 - log_b(value * RATE)) of an exponentially spaced scale, cut to
   0 .. STEPS + 1.  Sketches merge by the larger register, and the share of
   equal registers grows with the similarity of two sets.
2. Equal sets are one class.  For the smallest document of each class, runs
   of ``ROWS`` registers are hashed into ``BANDS`` bucket keys.
3. Within a bucket every document is compared with one leader, the document
   that meets most others in all its buckets (the middle of a group of near
   copies).  The counts of larger, smaller and equal registers and the two set
   sizes give the likelihood of every similarity; where it is greatest below
   ``LOOSE`` the similarity is only bounded, otherwise it is counted on the
   full sets.
4. Links make components.  Buckets that still hold more than one component
   are opened: documents of different components are compared too, except
   where sizes or the distances to the leader rule a link out (one minus the
   Jaccard index is a metric: two documents are no nearer than the difference
   of their distances).  In buckets of up to ``SMALL`` documents the pairs are
   joined.  In larger ones the documents outside the bucket's main component
   are held against all others in blocks of ``BLOCK`` by ``BLOCK``, on sets cut
   to 32 bits an element (which can only raise a similarity), and just the
   pairs that reach the limit there go on.  So no confirmed link between
   documents of a common bucket is lost.

With the defaults two sets at the limit of 0.8 share no bucket with a chance
of 3e-6, at 0.85 of 1e-8.  Everything that grows with the data stays in
tables; sketches, sets and links never reach the driver.

Edge cases: a null or empty text, or one without words, has the empty set and
no links; with fewer than ``n`` words the whole sequence is the one shingle;
ties go to the smaller doc_id; rows that repeat a doc_id count as one
document; rows without a doc_id have no links and no component and are kept;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import materialize, materialize_small
from . import hashing
from .common import id_and_text, raw_texts, slices
from .components import components

SHINGLE = 5
PERCENT = 80                       # similarity limit
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, STEPS = 1.02, 20.0, 4000
SMALL, BLOCK = 24, 2000
LOOSE, MARGIN = 0.45, 0.2       # likely similarity, and over five standard deviations of it

_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(
    1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, counts = hashing.word_hashes([t.lower() for t in texts])
    windows = hashing.window_sums(h, n)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            found = np.sort(windows[at:at + c - n + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif c:
            out.append(hashing.mix(np.array([c], np.uint64) + hashing.window_sums(h[at:at + c], c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) sketch of non-empty sets."""
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    least = np.empty((len(sets), REGISTERS), np.uint64)
    spare = np.empty_like(every)
    for j, m in enumerate(_MULTIPLIERS):
        np.multiply(every, m, out=spare)
        least[:, j] = np.minimum.reduceat(spare, first)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / RATE
    step = np.floor(1 - np.log(np.maximum(value, 1e-300)) / np.log(BASE))
    return np.clip(step, 0, STEPS + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def likely_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray
                      ) -> np.ndarray:
    """Maximum-likelihood Jaccard index of pairs of sketches with known sizes.
    A register of a is the larger one with chance p(u - vJ), the smaller one
    with p(v - uJ), where p(x) = -log_b(1 - x(b-1)/b) and u, v are the sizes'
    shares; the log likelihood is concave in J, so its slope is bisected."""
    up = (a > b).sum(1).astype(float)
    down = (a < b).sum(1).astype(float)
    same = a.shape[1] - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u
    c, log_b = (BASE - 1) / BASE, np.log(BASE)

    def slope(j):
        xu, xv = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        pu, pv = -np.log1p(-c * xu) / log_b, -np.log1p(-c * xv) / log_b
        du, dv = -v * c / (1 - c * xu) / log_b, -u * c / (1 - c * xv) / log_b
        return up * du / pu + down * dv / pv - same * (du + dv) / np.maximum(1 - pu - pv, 1e-12)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        mid = (low + high) / 2
        rising = slope(mid) > 0
        low, high = np.where(rising, mid, low), np.where(rising, high, mid)
    return (low + high) / 2


def sketch(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, key_a and key_b (digest of the set; null for the
    empty set), keys (bucket keys of its sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = raw_texts(b)
            for lo, hi in hashing.chunks(raw):
                sets = shingle_sets(raw[lo:hi], n)
                full = [s for s in sets if len(s)]
                regs = registers(full) if full else np.zeros((0, REGISTERS), np.uint16)
                keys = bands(regs)
                digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                           for s in full]
                at = iter(range(len(full)))
                rows = [next(at) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([None if k is None else int(digests[k][0]) for k in rows], pa.int64()),
                     pa.array([None if k is None else int(digests[k][1]) for k in rows], pa.int64()),
                     pa.array([None if k is None else keys[k] for k in rows], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "keys"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, key_a bigint, key_b bigint, keys array<bigint>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, elements (binary, sorted unsigned 64-bit), short (their low 32
    bits, sorted), regs (the sketch); for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = raw_texts(b)
            for lo, hi in hashing.chunks(raw):
                sets = shingle_sets(raw[lo:hi], n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([np.sort(s.astype(np.uint32)).tobytes() for s in sets], pa.binary()),
                     pa.array([r.tobytes() for r in registers(sets)], pa.binary())],
                    names=["doc_id", "elements", "short", "regs"])

    return docs.mapInArrow(run, "doc_id bigint, elements binary, short binary, regs binary")


def _with(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of both documents of each pair, as a_* and b_*."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("doc_id").alias(side),
                                        *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both, either: sizes of intersection and union of the full sets,
    for pairs whose likely similarity is at least ``LOOSE``; no others."""

    def sizes(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return both, len(x) + len(y) - both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "a_elements"):
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16)
                    .reshape(-1, REGISTERS) for k in (2, 3)]
            x, y = ([np.frombuffer(e, np.uint64) for e in b.column(k).to_pylist()] for k in (4, 5))
            n_x, n_y = (np.array([len(e) for e in side], float) for side in (x, y))
            near = likely_similarity(*regs, n_x, n_y) >= LOOSE
            found = np.array([sizes(x[k], y[k]) for k in np.flatnonzero(near)],
                             np.int64).reshape(-1, 2)
            kept = pa.array(near)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(kept), b.column(1).filter(kept),
                 pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b", "both", "either"])

    return (_with(pairs, sets, ["regs", "elements"])
            .select("a", "b", "a_regs", "b_regs", "a_elements", "b_elements")
            .mapInArrow(run, "a bigint, b bigint, both bigint, either bigint"))


def _size_step(n: Column, percent: int) -> Column:
    """Sets whose sizes differ by more than one step cannot reach the limit."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def joined_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in a bucket that sizes and
    distances allow, by a join; for small buckets."""
    names = ("doc_id", "component", "low", "high")
    x = rows.select("key", "step", *[F.col(c).alias("x_" + c) for c in names])
    y = rows.select("key", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)).alias("step"),
                    *[F.col(c).alias("y_" + c) for c in names])
    reach = 1 - percent / 100 + 1e-9
    met = x.join(y, (x["key"] == y["key"]) & (x["step"] == y["step"])
                 & (F.col("x_doc_id") < F.col("y_doc_id"))
                 & (F.col("x_component") != F.col("y_component"))
                 & (F.col("x_low") - F.col("y_high") <= reach)
                 & (F.col("y_low") - F.col("x_high") <= reach))
    return met.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct()


def blocked_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for large buckets, and only pairs whose cut sets reach the
    limit.  A bucket's main component is its most frequent one; every link
    across components has an end outside it, so those ends are held against
    all documents, block by block."""
    counts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"),
                                     F.sum("n").alias("n"))
    main = main.select("key", F.col("top.component").alias("main"),
                       F.ceil(F.col("n") / BLOCK).cast("int").alias("i_many"),
                       F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("top.n")) / BLOCK))
                       .cast("int").alias("j_many"))
    full = (rows.join(main, "key").join(sets.select("doc_id", "short"), "doc_id")
            .withColumn("h", F.xxhash64("doc_id")))

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    columns = ["key", "i", "j", "asks", "doc_id", "component", "low", "high", "short"]
    data = (full.withColumn("i", F.pmod("h", F.col("i_many")).cast("int"))
            .withColumn("j", F.explode(upto("j_many"))).withColumn("asks", F.lit(False)))
    asks = (full.filter("component <> main").withColumn("i", F.explode(upto("i_many")))
            .withColumn("j", F.pmod("h", F.col("j_many")).cast("int")).withColumn("asks", F.lit(True)))
    reach = 1 - percent / 100 + 1e-9

    def compare(block: pa.Table) -> pa.Table:
        role = np.asarray(block["asks"])
        doc, component = np.asarray(block["doc_id"]), np.asarray(block["component"])
        low, high = np.asarray(block["low"]), np.asarray(block["high"])
        short = [np.frombuffer(x, np.uint32) for x in block["short"].to_pylist()]
        held = np.flatnonzero(~role)
        size = np.array([len(short[k]) for k in held])
        values = np.concatenate([short[k] for k in held]) if len(held) else np.zeros(0, np.uint32)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(held)), size)[order]
        a, b = [], []
        for k in np.flatnonzero(role):
            begin, end = np.searchsorted(values, short[k]), np.searchsorted(values, short[k], "right")
            many = end - begin
            at = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
            both = np.bincount(owner[at], minlength=len(held))
            both = np.minimum(both, np.minimum(size, len(short[k])))
            fits = ((100 * both >= percent * (size + len(short[k]) - both))
                    & (component[held] != component[k])
                    & (low[held] - high[k] <= reach) & (low[k] - high[held] <= reach))
            hits = doc[held[fits]]
            a.append(np.minimum(hits, doc[k]))
            b.append(np.maximum(hits, doc[k]))
        return pa.table({"a": np.concatenate(a or [doc[:0]]), "b": np.concatenate(b or [doc[:0]])})

    return (data.select(*columns).union(asks.select(*columns)).groupBy("key", "i", "j")
            .applyInArrow(compare, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links), kept (doc_id = component_id)."""
    sketches = materialize(sketch(docs, n))
    known = sketches.filter(F.col("key_a").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(known.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep")))
    # documents of one class have equal sketches; any row of the representative will do
    reps = materialize(known.join(classes.select(F.col("rep").alias("doc_id")).distinct(),
                                  "doc_id", "left_semi").dropDuplicates(["doc_id"])
                       .select("doc_id", "n_shingles", "keys"))
    entries = reps.select(F.explode("keys").alias("key"), "doc_id")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize_small(entries.join(shared, "key"))
    meets = members.groupBy("doc_id").agg(F.sum("n").alias("meets"))
    leaders = (members.join(meets, "doc_id").groupBy("key")
               .agg(F.max(F.struct("meets", (-F.col("doc_id")).alias("minus"))).alias("top"))
               .select("key", (-F.col("top.minus")).alias("leader")))
    led = materialize(members.join(leaders, "key").select("key", "doc_id", "leader"))
    sets = materialize(full_sets(id_and_text(docs).join(meets.select("doc_id"), "doc_id", "left_semi")
                                 .dropDuplicates(["doc_id"]), n))
    is_link = 100 * F.col("both") >= percent * F.col("either")

    # every document against the leaders of its buckets
    with_leader = led.filter("doc_id <> leader").select(F.col("leader").alias("a"),
                                                        F.col("doc_id").alias("b")).distinct()
    stars = materialize_small(compared(with_leader, sets))
    first = stars.filter(is_link).select("a", "b")
    grouped = components(first)

    # buckets that hold more than one component
    labelled = (led.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                .withColumn("component", F.coalesce("component", "doc_id")))
    mixed = (labelled.groupBy("key").agg(F.min("component").alias("low"),
                                         F.max("component").alias("high"))
             .filter("low < high").select("key"))
    away = stars.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"),
                        (1 - F.col("both") / F.col("either")).alias("distance"))
    open_ = materialize(labelled.join(mixed, "key").filter("doc_id <> leader")
                        .join(away, ["leader", "doc_id"], "left")
                        .join(reps.select("doc_id", "n_shingles"), "doc_id")
                        .select("key", "doc_id", "component",
                                _size_step(F.col("n_shingles"), percent).alias("step"),
                                F.coalesce("distance", F.lit(1 - LOOSE - MARGIN)).alias("low"),
                                F.coalesce("distance", F.lit(1.0)).alias("high")))
    sized = open_.join(open_.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    pairs = joined_pairs(sized.filter(F.col("rows") <= SMALL), percent)
    pairs = pairs.union(blocked_pairs(sized.filter(F.col("rows") > SMALL), sets, percent)).distinct()
    more = materialize_small(compared(pairs, sets).filter(is_link).select("a", "b"))
    if not more.isEmpty():                       # links between whole components
        names = grouped.select("node", F.col("component").alias("of"))
        ends = more
        for side in ("a", "b"):
            ends = (ends.join(names.withColumnRenamed("node", side), side, "left")
                    .withColumn(side, F.coalesce("of", side)).drop("of"))
        joined = components(ends)
        lone = joined.select("node", "component").join(grouped.select("node"), "node", "left_anti")
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
        grouped = materialize(grouped.join(joined, "component", "left")
                              .select("node", F.coalesce("to", "component").alias("component"))
                              .union(lone))

    of_class = (classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
                .select("key_a", "key_b", F.coalesce("component", "rep").alias("component_id")))
    return (sketches.select("doc_id", "n_shingles", "key_a", "key_b")
            .join(of_class, ["key_a", "key_b"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` of which one document per group stays."""
    kept = near_duplicates(docs, n, percent).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
