"""N-gram Jaccard join, size-aware with light and heavy sets (operator 10).

A document's set is its distinct n-word shingles.  Equal sets are one node.

* Light sets (small): every subset that is left when as many elements are
  dropped as a partner may lack; two light sets that are similar enough have
  such a subset in common.
* Heavy sets (large): inverted lists over the prefix, the least frequent
  elements of which one at least must be shared.  Frequencies come from a
  fixed-size sketch over all documents; any order is exact, a good one keeps
  frequent shingles out of the lists.  Light sets near the boundary are listed
  too, so that heavy ones meet them.
* The boundary is the size with the least total cost over the sizes found.

Keys shared by several nodes are buckets.  Pairs are not enumerated within a
large bucket:

1. Every bucket has a centre, the member of the most common shingles.  All others
   are compared with it; what is linked is one component from then on.
2. Buckets whose members of different components make few pairs are compared in
   full, the largest component's members only with those of others.
3. In any other bucket each member has a delta, what it has more or less than the
   centre.  Two members that are not both linked with the centre can only be
   similar if their deltas overlap by a number that follows from the sizes, so a
   prefix of each delta, the elements least frequent among these deltas first,
   gives new, much smaller buckets.  The centre is settled.  Members whose sizes
   are far apart are parted by size bands before.

This is repeated until no bucket has two components.  No link between components
is lost, and a group of near copies costs a few comparisons a member.  A candidate
whose histograms of elements allow enough overlap is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import forest
from .store import drop, materialize, release_shuffles
from .textkernel import LOWER, SPACED, Words, inside_one_text, list_array, mix64, ngram_hashes, ordered, signed, string_chunks

SKETCH_BITS = 17
#: Cost of one inverted-list entry, with its scan, in subset keys.
SCAN_COST = 8
#: Largest size that is ever light.
MOST_LIGHT = 64
#: Bins of a set's histogram, which bounds its overlap with another.
BINS = 128
_FULL = 32_767
#: A bucket is compared in full when this many comparisons a member do it.
PER_MEMBER = 16
#: The same for buckets of deltas, which seldom share more than one.
PER_DELTA = 4 * PER_MEMBER
#: Elements before its own that an entry carries, so that a pair with several in common is met about once.
EARLIER = 8
#: Nodes whose texts are looked up by a broadcast; for more, all texts are shuffled.
LOOKED_UP = 1 << 19


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all texts in order, number of each text's)."""
    words = Words(data, offsets, SPACED, LOWER)
    count = words.counts()
    at = inside_one_text(words, size)
    doc, h = [words.doc[at]], [ngram_hashes(words.hash, size)[at] if len(at) else np.zeros(0, np.uint64)]
    for k in range(1, size):
        rows = np.flatnonzero(count == k)
        if len(rows):
            doc.append(rows)
            h.append(ngram_hashes(words.hash, k)[words.first[rows]])
    d, x = np.concatenate(doc), np.concatenate(h)
    order = ordered(d, len(count), x)
    d, x = d[order], x[order]
    new = np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])) if len(d) else np.zeros(0, bool)
    return x[new], np.bincount(d[new], minlength=len(count))


def _dropped(n: int, percent: int) -> int:
    """Most elements of a set of n that a similar set may lack."""
    return n - -(-percent * n // 100)


def _subset_keys(n: int, percent: int) -> int:
    return sum(comb(n, d) for d in range(_dropped(n, percent) + 1))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle counts by slot, documents by set size up to MOST_LIGHT), over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sizes = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(MOST_LIGHT + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in string_chunks(batch.column(0)):
                h, n = shingles(data, offsets, size)
                slots += np.bincount(_slot(h), minlength=len(slots))
                sizes += np.bincount(n[n <= MOST_LIGHT], minlength=len(sizes))
        both = np.concatenate([slots, sizes])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[at])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((1 << SKETCH_BITS) + MOST_LIGHT + 1, np.int64)
    both[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return both[: 1 << SKETCH_BITS], both[1 << SKETCH_BITS :]


def boundary(sizes: np.ndarray, percent: int) -> int:
    """The largest size of light sets, by least total cost: subset keys below it, listed prefixes with their scans above."""
    best, best_cost, light = 0, 0, 0
    for n in range(1, len(sizes)):
        light += int(sizes[n]) * (_subset_keys(n, percent) - SCAN_COST * (_dropped(n, percent) + 1))
        if light < best_cost:
            best, best_cost = n, light
    return best


def _prepare(docs: DataFrame, size: int, percent: int, counts: np.ndarray, light: int) -> DataFrame:
    """doc_id, text_hash, n, node, prefix, subsets, bins, common (how frequent its elements are) of every row."""
    order_key = np.minimum(counts, (1 << 31) - 1)
    frequency = np.log2(np.maximum(counts, 1)).astype(np.float32)
    listed = -(-percent * (light + 1) // 100)  # the smallest set that a heavy one can be similar to

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in string_chunks(batch.column(1)):
                h, n = shingles(data, offsets, size)
                rows = len(n)
                doc = np.repeat(np.arange(rows), n)
                first = np.cumsum(n) - n
                mixed = mix64(h)
                total, other = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                some = np.flatnonzero(n)
                common = np.zeros(rows, np.float32)
                if len(some):
                    common[some] = np.add.reduceat(frequency[_slot(h)], first[some]) / n[some]
                    total[some] = np.add.reduceat(mixed, first[some])
                    other[some] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), first[some])
                node = mix64(total ^ mix64(other) ^ n.astype(np.uint64))
                order = ordered(doc << 31 | order_key[_slot(h)], rows << 31, h)
                take = np.where(n >= max(listed, 1), n - (percent * n + 99) // 100 + 1, 0)
                prefix = h[order][np.arange(len(h)) - np.repeat(first, n) < np.repeat(take, n)]
                keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * rows
                for k in np.unique(n[(n > 0) & (n <= light)]).tolist():
                    at = np.flatnonzero(n == k)
                    m = mixed[first[at][:, None] + np.arange(k)]
                    got = []
                    for d in range(_dropped(k, percent) + 1):
                        for gone in ([()] if not d else combinations(range(k), d)):
                            got.append(mix64((total[at] - m[:, list(gone)].sum(axis=1, dtype=np.uint64)) ^ np.uint64(k - d)))
                    for row, own in zip(at.tolist(), np.column_stack(got), strict=True):
                        keys[row] = own
                per = np.array([len(x) for x in keys], dtype=np.int64)
                bins = np.minimum(np.bincount(doc * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), minlength=rows * BINS), _FULL).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n.astype(np.int64)),
                        pa.array(signed(node), mask=n == 0), list_array(signed(prefix), take, pa.int64()), list_array(signed(np.concatenate(keys)) if rows else np.zeros(0, np.int64), per, pa.int64()),
                        list_array(bins, np.full(rows, BINS), pa.int16()),
                        pa.array((common * 1024).astype(np.int32)),
                    ],
                    ["doc_id", "text_hash", "n", "node", "prefix", "subsets", "bins", "common"],
                )

    schema = "doc_id long, text_hash long, n long, node long, prefix array<long>, subsets array<long>, bins array<smallint>, common int"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(cut, schema)


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in string_chunks(column):
        h, n = shingles(data, offsets, size)
        out += np.split(h, np.cumsum(n)[:-1])
    return out


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v, text_u, text_v of those pairs u, v of nodes; pairs are read twice."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if wanted.limit(LOOKED_UP + 1).count() <= LOOKED_UP:
        texts = texts.join(F.broadcast(wanted), "node", "left_semi")
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """u, v: those pairs u, v of nodes whose whole sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.zeros(len(u), dtype=bool)
            for k, (x, y) in enumerate(zip(_sets(batch.column(2), size), _sets(batch.column(3), size), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], ["u", "v"])

    return _with_texts(pairs, texts).mapInArrow(compare, "u long, v long")


def _deltas(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """u, v, n_u, n_v, delta: the elements that only one of both sets has."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            left, right = _sets(batch.column(2), size), _sets(batch.column(3), size)
            deltas = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)]
            sizes = [pa.array(np.array([len(x) for x in own], dtype=np.int64)) for own in (left, right)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *sizes, list_array(signed(np.concatenate(deltas)), np.array([len(x) for x in deltas]), pa.int64())],
                ["u", "v", "n_u", "n_v", "delta"],
            )

    return _with_texts(pairs, texts).mapInArrow(differ, "u long, v long, n_u long, n_v long, delta array<long>")


def _before(elements: str) -> F.Column:
    """The last of the elements before place pos, EARLIER at most."""
    return F.expr(f"slice({elements}, greatest(pos - {EARLIER}, 0) + 1, greatest(least(pos, {EARLIER}), 0))")


def _delta_keys(deltas: DataFrame, percent: int) -> DataFrame:
    """key, node, w (size of the delta), pos, earlier (the last elements before): by prefixes of the deltas of nodes v from their centres u, where several nodes have the element.

    k = (100 - percent) / (100 + percent): two sets are similar if they differ by
    k (n + m) elements at most, and the deltas of v and w differ by what v and w
    do.  Let a and b be the sizes of the deltas of v and w, which must have
    (a + b - k (n_v + n_w)) / 2 in common.  If v is not linked with the centre
    that is (a - k (n_v + n_u)) / (1 + k) at least, as b is no less than what is
    common and than n_w - n_u; if v is linked, w is not, and it is more than
    (a - k (n_v - n_u)) / 2.
    """
    k = (100 - percent) / (100 + percent)
    a, n_u, n_v = F.size("delta"), F.col("n_u"), F.col("n_v")
    linked = (100 + percent) * a <= (100 - percent) * (n_u + n_v)
    need = F.when(linked, (a - k * (n_v - n_u)) / 2).otherwise((a - k * (n_v + n_u)) / (1 + k))
    take = a - F.greatest(F.ceil(need - 1e-6), F.lit(1)) + 1
    each = materialize(deltas.select("u", "v", a.alias("w"), take.cast("int").alias("take"), F.explode("delta").alias("x")).where("take > 0"), "jaccard-deltas")
    counts = each.groupBy("u", "x").agg(F.count("*").alias("c"))
    ranked = each.join(counts, ["u", "x"]).groupBy("u", "v", "w", "take").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("all"))
    first = ranked.select("u", F.col("v").alias("node"), "w", "all", F.posexplode(F.slice("all", F.lit(1), F.col("take"))).alias("pos", "e")).where("e.c > 1")
    return first.select(F.xxhash64("u", "e.x").alias("key"), "node", "w", "pos", F.transform(_before("all"), lambda y: y["x"]).alias("earlier"))


def _similar_sizes(a: str, b: str, percent: int) -> F.Column:
    """Whether sizes and places in the common order allow a link (place -1: unknown).

    What is ordered, w elements of each, is the set itself or its delta from one
    centre; in both cases (w + w' - k (n + n')) / 2 elements must be common.  A
    pair is judged as if this were its first element in common: a similar one
    passes where that is so, which is enough, and may be refused elsewhere.  It is
    not met again where both carry one of the same earlier elements.
    """
    n, m, i, j, v, w = (F.col(f"{side}{c}") for c in ("n", "pos", "w") for side in (a, b))
    need = F.ceil((v + w - F.lit((100 - percent) / (100 + percent)) * (n + m)) / 2 - F.lit(1e-6))
    most = 1 + F.least(v - i - 1, w - j - 1)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((i < 0) | (j < 0) | (most >= need)) & ~F.coalesce(F.arrays_overlap(f"{a}earlier", f"{b}earlier"), F.lit(False))


def _may_overlap(pairs: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """Those pairs u, v whose histograms allow enough common elements."""
    left = bins.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("bins").alias("b_u"))
    right = bins.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("bins").alias("b_v"))
    most = F.aggregate(F.zip_with("b_u", "b_v", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda s, x: s + x)
    open_ended = (F.array_max("b_u") == _FULL) | (F.array_max("b_v") == _FULL)
    need = F.lit(percent) * (F.col("n_u") + F.col("n_v")) / F.lit(100 + percent)
    return pairs.join(left, "u").join(right, "v").where(open_ended | (most >= need - F.lit(1e-9))).select("u", "v")


def _open(buckets: DataFrame, stars: DataFrame | None, percent: int, per_member: int) -> DataFrame:
    """The members, with their component's label, of buckets of several components; centre, most frequent label, and kind of the bucket."""
    if stars is None:
        labelled = buckets.withColumn("label", F.col("node"))
    else:
        labels = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    heads = labelled.groupBy("key", "label").agg(F.max(F.struct("common", "node", "n")).alias("best"), F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
    per_key = (
        heads.groupBy("key")
        .agg(
            F.max(F.struct("best", "label")).alias("top"), F.max(F.struct("size", "label")).alias("major"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.sum("size").alias("members"), F.sum(F.col("size") * F.col("size")).alias("squares"), F.count("*").alias("labels"),
        )
        .where("labels > 1")
    )
    few = (F.col("members") * F.col("members") - F.col("squares")) / 2 <= per_member * F.col("members")
    wide = F.col("high") * (percent / 100) ** 2 > F.col("low") * 1.001
    kind = F.lit("new") if stars is None else F.when(few, "few").when(wide, "wide").otherwise("many")
    centre = F.col("top.best")
    chosen = per_key.select("key", centre["node"].alias("centre"), centre["n"].alias("centre_n"), F.col("top.label").alias("centre_label"), F.col("major.label").alias("major"), kind.alias("kind"))
    return materialize(labelled.join(chosen, "key"), "jaccard-open")


def _with_earlier(few: DataFrame, nodes: DataFrame) -> DataFrame:
    """few with earlier: where it is not known yet, from the node's prefix.  Whole beginnings would grow with the square of a text's length."""
    own = nodes.select("node", "prefix").join(few.select("node").distinct(), "node", "left_semi")
    return few.join(own, "node").withColumn("earlier", F.when(F.col("pos") >= 0, F.coalesce("earlier", _before("prefix")))).drop("prefix")


def _within(few: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of nodes of different components in each bucket whose sizes and places allow a link; at few of their common elements."""
    columns = ("node", "n", "w", "pos", "earlier", "label")
    few = _with_earlier(few.select("key", *columns, "major"), nodes)
    others = few.where("label <> major").select("key", *[F.col(c).alias(f"u_{c}") for c in columns], "major")
    every = few.select("key", *[F.col(c).alias(f"v_{c}") for c in columns])
    once = (F.col("v_label") == F.col("major")) | (F.col("u_node") < F.col("v_node"))
    return others.join(every, "key").where((F.col("u_label") != F.col("v_label")) & once & _similar_sizes("u_", "v_", percent)).select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))


def _links(nodes: DataFrame, texts_of, size: int, percent: int) -> DataFrame:
    """u, v: a forest that connects all linked nodes.  nodes: node, n, prefix, subsets, bins, common, a row each."""
    spark = nodes.sparkSession
    listed = nodes.select("node", "n", "common", F.posexplode("prefix").alias("pos", "key"))
    entries = listed.unionByName(nodes.select("node", "n", "common", F.lit(-1).alias("pos"), F.explode("subsets").alias("key")))
    shared = entries.groupBy("key").count().where("count > 1").select("key")
    buckets = materialize(entries.join(shared, "key").select("key", "node", F.col("n").cast("int"), F.col("n").cast("int").alias("w"), F.col("pos").cast("int"), F.lit(None).cast("array<long>").alias("earlier"), "common"), "jaccard-buckets")
    del entries, shared
    release_shuffles(spark)
    texts = materialize(texts_of(buckets.select("node").distinct()), "jaccard-texts")
    release_shuffles(spark)
    stars, per_member = None, PER_MEMBER
    fields = ("key", "node", "n", "w", "pos", "earlier", "common")
    while True:
        rest = _open(buckets, stars, percent, per_member)
        drop(buckets)
        kinds = {r.kind for r in rest.select("kind").distinct().collect()}
        if not kinds:
            break
        met = rest.where(F.col("kind").isin("new", "many") & (F.col("node") != F.col("centre")))
        alike = F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent
        pairs = met.where((F.col("label") != F.col("centre_label")) & alike).select(F.col("centre").alias("u"), F.col("node").alias("v"))
        if "few" in kinds:
            pairs = pairs.unionByName(_within(rest.where("kind = 'few'"), nodes, percent))
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        likely = materialize(_may_overlap(pairs, nodes, percent), "jaccard-pairs")
        release_shuffles(spark)
        found = _verify(likely, texts, size, percent)
        known, stars = stars, forest(found if stars is None else found.unionByName(stars))
        drop(likely, known)
        release_shuffles(spark)
        parts = []
        if "new" in kinds:
            parts.append(rest.where("kind = 'new' and node <> centre").select(*fields))
        if "wide" in kinds:
            band = F.floor(F.log(F.col("n")) / float(np.log(100 / percent))).cast("int")
            parts.append(rest.where("kind = 'wide'").withColumn("band", F.explode(F.array(band, band + 1))).withColumn("key", F.xxhash64("key", "band")).select(*fields))
        if "many" in kinds:
            centred = met.where("kind = 'many'").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
            centred = materialize(centred, "jaccard-centred")
            keys = _delta_keys(_deltas(centred, texts, size), percent)
            drop(centred)
            parts.append(keys.join(nodes.select("node", F.col("n").cast("int").alias("n"), "common"), "node").select(*fields))
            per_member = PER_DELTA
        if not parts:
            break
        buckets = parts[0]
        for part in parts[1:]:
            buckets = buckets.unionByName(part)
        buckets = materialize(buckets, "jaccard-buckets")
        drop(rest)
        release_shuffles(spark)
    drop(rest, texts)
    return stars if stars is not None else spark.createDataFrame([], "u long, v long")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row.

    Two rows link when 100 * intersection >= percent * union of their sets of
    ``size``-word shingles; component_id is the least doc_id that links reach.
    A text with fewer words has them all as its one shingle; null, empty and
    blank texts have an empty set and link with nothing.  A row with a null
    doc_id links with nothing and has a null component.  Rows that share a
    doc_id are told apart by text.  An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    counts, sizes = _sketch(known, size)
    sets = materialize(_prepare(docs, size, percent, counts, boundary(sizes, percent)), "jaccard-sets")
    rows = materialize(sets.select("doc_id", "text_hash", "n", "node"), "jaccard-rows")
    some = rows.where("n > 0 and doc_id is not null")
    low = some.groupBy("node").agg(F.min("doc_id").alias("low"))
    # an equality with low would be a key of the join, and whole sets would be shuffled again for what follows by node
    whole = sets.where("n > 0 and doc_id is not null").join(low, "node").where("doc_id <= low")
    single = some.groupBy("doc_id").count().where("count > 1").isEmpty()
    one_each = (lambda rows: rows) if single else (lambda rows: rows.dropDuplicates(["node"]))
    nodes = materialize(one_each(whole.select("node", "n", "prefix", "subsets", "bins", "common")), "jaccard-nodes")
    drop(sets)
    del whole
    release_shuffles(docs.sparkSession)

    def texts_of(wanted: DataFrame) -> DataFrame:
        ids = some.select("node", "doc_id", "text_hash").join(low, "node").where("doc_id = low").join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x"))
        ids = ids.select("node", F.col("x.doc_id").alias("doc_id"), F.col("x.text_hash").alias("text_hash"))
        found = known.withColumn("text_hash", F.xxhash64("text")).join(ids, ["doc_id", "text_hash"]).select("node", "text")
        return one_each(found)

    stars = _links(nodes, texts_of, size, percent)
    joined = low.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    of_node = materialize(joined.join(least, "root").select("node", "component_id"), "jaccard-components")
    out = rows.join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component_id"), F.col("doc_id")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that are linked with one of a smaller doc_id, with all columns.

    Of each component the row of its least doc_id stays, once if it is there
    several times.  Rows with a null doc_id or without words stay.
    """
    groups = materialize(similar_groups(docs, size, percent), "jaccard-groups")
    gone = groups.where("doc_id is not null and doc_id <> component_id").select("doc_id", "text_hash").distinct()
    keys = [docs["doc_id"].cast("long") == gone["doc_id"], F.xxhash64(docs["text"].cast("string")) == gone["text_hash"]]
    kept = docs.join(gone, keys, "left_anti")
    again = groups.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return kept
    repeated = [docs["doc_id"].cast("long") == again["doc_id"]]
    return kept.join(again, repeated, "left_anti").unionByName(kept.join(again, repeated, "left_semi").dropDuplicates(["doc_id"]))
