"""N-gram Jaccard join: a blocked product of the sparse document by shingle matrix.

Equal shingle sets are one class from the start. The first product looks at each set's rarest shingles only: with similarity
s and n shingles, a partner must share k of the first n - ceil(s*n) + k (or, for a partner at least as large, of the
first n - ceil(2s/(1+s)*n) + k), in any order of all shingles, where k is asked_of(n) of the smaller set. A k of one would
do for right results, but as the corpus grows documents share single shingles by chance, and their parts grow
together to one that holds most of it. The order is by the counts of a sketch of fixed size
over the whole corpus, so passages that many documents share come last. It runs in blocks of
columns (ranges of shingle hashes). Columns with few rows count their pairs if the sizes allow a link, and pairs whose counts reach k over all blocks are kept; longer
ones, sorted by size and cut where neighbours' sizes allow none, give a star for each piece that holds a prefix of the second kind. Their connected parts are the row blocks of the second product, which counts the exact overlaps over
all shingles, a few thousand columns at a time, and discards rows whose counts can no longer reach the bound set by
the two sizes. A part with many rows is cut into chunks by size, a task for each pair of chunks whose sizes allow links. A block returns each
row's number of links and a spanning forest, never its pairs; components are found by contraction.

Two documents link when 100 * |intersection| >= 75 * |union| (for similarity 0.75). Null and empty text, and text without words, has no shingles and links with
nothing. Repeated rows are documents with equal sets. Rows that share a doc_id count as one document of several texts: the
texts whose classes it represents share a component, and n_links is of the row's own text. An empty table gives an empty result. Null doc_ids get no component of their own: they carry the smallest id of their class."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import free_shuffles
from .common import broadcast_if_small, documents, lean, materialise, small
from .graph import FILTER_KEYS, components, in_filter, key_filter, merged_slices, sliced, without
from .shingles import shingle_sets

PERCENT = 75
#: The sketch's counters; the rows of a column up to which all its pairs are counted; rows and shingles of a chunk; columns multiplied at once.
SKETCH, SHORT, ROWS, SHINGLES, COLUMNS = 1 << 24, 64, 1024, 1 << 20, 2048
#: Prefix entries and counted pairs that a task holds before it sends them; chunks of a size class are numbered below STEP.
HELD, STEP = 1 << 18, 1 << 22


def ceil_div(a, b):
    return -(-a // b)


def asked_of(n, percent: int):
    """How many shingles of its prefix a set of n shares with each partner at least as large; grows with n, and is no more than the overlap."""
    return np.minimum(ceil_div(percent * n, 100), 4 + n // 64)


def summaries(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, d0, d1: size and digest of its set), and the slices of each task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, dtype=np.uint8)  # a task's, up to 255; all tasks' are added in wide numbers
        shift = np.uint64(64 - SKETCH.bit_length() + 1)
        for batch in small(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
            first = np.unique(digests, axis=0, return_index=True)[1]  # copies in one batch count once
            slot, found = np.unique((np.concatenate([sets[i] for i in first]) >> shift).astype(np.int32), return_counts=True)
            counts[slot] = np.minimum(counts[slot] + found, 255)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=NAMES)
        for i, blob in sliced(counts):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([i], pa.int32()), pa.array([blob], pa.binary())], names=NAMES)

    return materialise(docs.mapInArrow(lean(run), "doc_id long, n long, d0 long, d1 long, slice int, blob binary"), "set_summaries")


NAMES = ["doc_id", "n", "d0", "d1", "slice", "blob"]


def commonness(parts: DataFrame) -> np.ndarray:
    """A level for each counter of the sketch: half steps of the logarithm of the count over the mean."""

    def levels(x: np.ndarray) -> np.ndarray:
        return np.minimum(2 * np.log2(1 + x / max(1.0, np.median(x))), 255).astype(np.uint8)

    return merged_slices(parts, SKETCH, np.uint8, np.add, levels)


def prefix_entries(docs: DataFrame, levels: np.ndarray, percent: int, buckets: int) -> DataFrame:
    """(bucket, entries) with the hash, the class's key and size of each prefix shingle, packed by range of hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, shift, down = sent.value, np.uint64(64 - SKETCH.bit_length() + 1), np.uint64(64 - buckets.bit_length() + 1)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int, int]] = []

        def send() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([x[0] for x in held])
            size = np.array([len(x[0]) for x in held])
            key = np.repeat(np.array([x[1] for x in held], dtype=np.int64), size)
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            meta = (np.repeat(np.array([x[2] for x in held]), size) * 2 + (place < np.repeat(np.array([x[3] for x in held]), size))).astype(np.uint32)
            order = np.argsort(h)
            h, key, meta = h[order], key[order], meta[order]
            at = np.searchsorted(h >> down, np.arange(buckets + 1))
            rows = [(b, h[lo:hi].tobytes() + key[lo:hi].tobytes() + meta[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "entries"])

        total = 0
        for batch in small(batches):
            for s in shingle_sets(batch.column("text").to_pylist()):
                n = len(s)
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True)
                if not n or key in seen:
                    continue
                seen.add(key)
                more = int(asked_of(n, percent))
                probe, index = n - ceil_div(percent * n, 100) + more, n - ceil_div(2 * percent * n, 100 + percent) + more
                level = levels[(s >> shift).astype(np.int64)]
                held.append((s[np.argsort(level, kind="stable")[:probe]], key, n, index))
                total += probe
                if total > HELD:
                    yield from send()
                    total = 0
        if held:
            yield from send()

    return docs.select("text").mapInArrow(lean(run), "bucket int, entries binary")


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the keys of classes that may link: of those that a task is sure of, a spanning forest; of others, those whose counts in all tasks suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.empty((0, 2), dtype=np.int64)]
        open_ = [np.empty((0, 4), dtype=np.int64)]  # a, b, shared so far, asked

        def settle() -> None:
            """Sums up the open pairs; those that share enough are found, those whose ends found edges connect need no count."""
            pairs = np.concatenate(open_)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            if len(pairs):
                at = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(1)]))
                shared = np.add.reduceat(pairs[:, 2], at)
                pairs = pairs[at]
                pairs[:, 2] = shared
            enough = pairs[:, 2] >= pairs[:, 3]
            tree = forest(np.concatenate([*found, pairs[enough, :2]]))
            pairs = pairs[~enough]
            if len(tree) and len(pairs):
                order = np.argsort(tree[:, 1])
                node, top = tree[order, 1], tree[order, 0]
                at = np.minimum(np.searchsorted(node, pairs[:, :2]), len(node) - 1)
                root = np.where(node[at] == pairs[:, :2], top[at], pairs[:, :2])
                pairs = pairs[root[:, 0] != root[:, 1]]
            found[:], open_[:] = [tree], [pairs]

        def rows(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T], names=["a", "b", "shared", "asked"])

        def buckets() -> Iterator[list[bytes]]:  # rows come sorted by bucket; a worker holds one
            at, held = None, []
            for batch in batches:
                for b, x in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                    if b != at and held:
                        yield held
                        held = []
                    at = b
                    held.append(x)
            if held:
                yield held

        for some in buckets():
            n = [len(x) // 20 for x in some]
            h = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(some, n, strict=True)])
            key = np.concatenate([np.frombuffer(x, np.int64, k, 8 * k) for x, k in zip(some, n, strict=True)])
            meta = np.concatenate([np.frombuffer(x, np.uint32, k, 16 * k) for x, k in zip(some, n, strict=True)]).astype(np.int64)
            order = np.lexsort((key, meta >> 1, h))
            h, key, size, index = h[order], key[order], meta[order] >> 1, (meta[order] & 1).astype(bool)
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
            h, key, size, index = h[new], key[new], size[new], index[new]
            bounds = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            length = np.repeat(np.diff(bounds), np.diff(bounds))
            end = np.repeat(bounds[1:], np.diff(bounds))
            at = np.flatnonzero((length > 1) & (length <= SHORT))
            for lag in range(1, SHORT):
                at = at[at + lag < end[at]]
                if not len(at):
                    break
                to = at + lag
                may = (100 * size[at] >= percent * size[to]) & (index[at] | ((size[at] == size[to]) & index[to]))
                i, j = at[may], to[may]
                open_.append(np.column_stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), np.ones(len(i), np.int64), asked_of(size[i], percent)]))
            star = np.flatnonzero(length > SHORT)
            if len(star):
                h, key, size, index = h[star], key[star], size[star], index[star]
                cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (100 * size[:-1] < percent * size[1:])]))
                width = np.diff(np.append(cut, len(h)))
                keep = np.repeat((width > 1) & np.logical_or.reduceat(index, cut), width)
                hubs = np.repeat(np.minimum.reduceat(key, cut), width)[keep]
                found.append(np.unique(np.column_stack([hubs, key[keep]]), axis=0))
            if sum(map(len, found)) + sum(map(len, open_)) > HELD:
                settle()
                if len(open_[0]) > HELD // 2:
                    yield rows(open_[0])
                    open_[:] = [open_[0][:0]]
        settle()
        yield rows(open_[0])
        yield rows(np.column_stack([found[0], np.zeros_like(found[0])]))

    counted = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "a long, b long, shared long, asked long")
    return counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("asked").alias("asked")).filter("shared >= asked").select("a", "b")


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges from each node to the smallest of its component."""
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    label = np.arange(len(nodes))
    while len(at):
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        before = label.copy()
        for side in (0, 1):
            np.minimum.at(label, at[:, side], low)
            np.minimum.at(label, before[at[:, side]], low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return np.column_stack([nodes[label[keep]], nodes[keep]])


def links_of(sets: list[np.ndarray], left: int, percent: int) -> np.ndarray:
    """Whether each of the first `left` sets links with each of the others (with each other, if there are no others).

    Overlaps are summed over blocks of columns; rows whose counts can't reach the sizes' bound any more are dropped."""
    size = np.array(list(map(len, sets)), dtype=np.int64)
    rows = np.arange(left)
    cols = np.arange(left, len(sets)) if left < len(sets) else rows
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    column = np.cumsum(np.concatenate([[0], shingle[1:] != shingle[:-1]]))
    often = np.bincount(column)
    keep = often[column] > 1
    column, owner = column[keep], owner[keep]
    # The commonest columns last: rare ones split rows sooner.
    rank = np.argsort(np.argsort(often, kind="stable"), kind="stable")[column]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    rank = np.cumsum(np.concatenate([[0], rank[1:] != rank[:-1]])) if len(rank) else rank
    total = size[rows][:, None] + size[cols][None]
    need = ceil_div(percent * total, 100 + percent)  # overlap >= s/(1+s) * (n + m)
    need[np.minimum(size[rows][:, None], size[cols][None]) * 100 < np.maximum(size[rows][:, None], size[cols][None]) * percent] = np.iinfo(np.int64).max
    count = np.zeros(need.shape, dtype=np.int64)
    rest = np.bincount(owner, minlength=len(sets))
    alive_r, alive_c = np.ones(len(rows), bool), np.ones(len(cols), bool)
    place = np.full(len(sets), -1)
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        a, b = np.searchsorted(rank, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(rank[-1]) + 1 - lo)), dtype=np.float32)
        part[owner[a:b], rank[a:b] - lo] = 1
        r, c = rows[alive_r], cols[alive_c]
        count[np.ix_(alive_r, alive_c)] += np.rint(part[r] @ part[c].T).astype(np.int64)
        rest -= np.bincount(owner[a:b], minlength=len(sets))
        may = count + np.minimum(rest[rows][:, None], rest[cols][None]) >= need
        alive_r, alive_c = may.any(1), may.any(0)
        if not alive_r.any():
            break
    link = count >= need
    if left == len(sets):
        np.fill_diagonal(link, False)
    return link


def block_result(ids: np.ndarray, keys: np.ndarray, weight: np.ndarray, chunk: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, key of the class, smallest id that the block links the id with, documents that the class links with)."""
    order = np.lexsort((keys, ids))
    order = order[np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])])]
    order = order[np.argsort(chunk[order], kind="stable")]
    ids, keys, weight, chunk, sets = ids[order], keys[order], weight[order], chunk[order], [sets[i] for i in order]
    left = int((chunk == chunk.min()).sum())
    link = links_of(sets, left, percent)
    if left < len(ids):
        counts = np.concatenate([link @ weight[left:], weight[:left] @ link])
        a, b = np.nonzero(link)
        b = b + left
    else:
        counts = link @ weight
        a, b = np.nonzero(np.triu(link))
    nodes, at = np.unique(ids, return_inverse=True)  # the classes of one id are one node
    root = nodes.copy()
    tree = forest(np.column_stack([ids[a], ids[b]]))
    root[np.searchsorted(nodes, tree[:, 1])] = tree[:, 0]
    return ids, keys, root[at], counts


def chunked(members: DataFrame, percent: int) -> DataFrame:
    """members(part, rep, d0, n, size) with chunk, and the chunks of the part that hold sets of a size that may link.

    A large part is cut by size class, each of which spans a factor of 100 / percent, so that links never reach
    farther than to the next one; a large class is cut by hash. So a set meets its own class and two more, not the whole part."""
    many = (F.count("*") > ROWS) | (F.sum("n") > SHINGLES)
    kind = F.floor(F.log("n") / (np.log(100 / percent) + 1e-9)).cast("int")
    members = materialise(members.select("part", "rep", "d0", "n", "size"), "part_members")
    large = materialise(members.groupBy("part").agg(many.alias("many")).filter("many"), "large_parts")  # one for each ROWS members at most
    members = members.join(broadcast_if_small(large), "part", "left").withColumn("kind", F.when(F.col("many"), kind).otherwise(0))
    pieces = members.filter("many").groupBy("part", "kind").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("k"))
    pieces = pieces.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("kind", "k"))).alias("pieces"))  # a few dozen kinds
    alone = F.create_map(F.lit(0), F.lit(1))  # a part in one chunk
    members = members.join(broadcast_if_small(pieces), "part", "left").withColumn("pieces", F.coalesce("pieces", alone))
    of = lambda c: F.try_element_at("pieces", c)
    near = F.filter(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1), lambda c: of(c).isNotNull())
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), of(c) - 1), lambda j: c * STEP + j)))
    own = F.col("kind") * STEP + F.pmod(F.xxhash64("rep"), of(F.col("kind"))).cast("int")
    return members.select("part", "rep", "d0", "size", own.alias("chunk"), others.alias("others"))


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, class_size of each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = summaries(docs)
    rows = table.filter("slice is null").select("doc_id", "n", "d0", "d1")
    levels = commonness(table.filter("slice is not null"))
    buckets = max(256, 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    edges = candidates(prefix_entries(docs, levels, percent, buckets), percent)
    part = components(edges, "candidate_parts").withColumnsRenamed({"node": "d0", "root": "part"})
    free_shuffles(spark)  # of the sketch, the prefix entries and the pairs
    classes = materialise(rows.groupBy("d0", "d1", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    members = classes.filter("n > 0 and rep is not null").join(part, "d0")
    members = materialise(chunked(members, percent), "members")
    n = members.count()
    sent = spark.sparkContext.broadcast(key_filter(members.select("rep"), n)) if n <= FILTER_KEYS else None
    asked = docs if sent else docs.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            if sent:
                batch = batch.filter(pa.array(in_filter(sent.value, np.asarray(batch.column("doc_id")))))
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist())]
            keys = [int.from_bytes(hashlib.blake2b(s, digest_size=16).digest()[:8], "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["rep", "d0", "shingles"])

    sets = asked.mapInArrow(lean(fetch), "rep long, d0 long, shingles binary").join(broadcast_if_small(members), ["rep", "d0"])
    # A part in one chunk is one block; of several, each pair of chunks that may hold a link is (a chunk meets itself in a block of its own).
    dealt = sets.withColumn("other", F.explode("others")).select("part", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rep", "d0", "size", "chunk", "shingles")
    dealt = dealt.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def done() -> pa.RecordBatch:
            ids, keys, weight, chunk = (np.array([h[k] for h in held], dtype=np.int64) for k in range(4))
            found = block_result(ids, keys, weight, chunk, [np.frombuffer(h[4], dtype=np.uint64) for h in held], percent)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "d0", "b", "links"])

        def whole() -> bool:  # a pair of chunks one of which is empty has nothing to count
            return bool(held) and len({h[3] for h in held}) == 1 + (block[1] != block[2])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if row[:3] != block:
                    if whole():
                        yield done()
                    block, held = row[:3], []
                held.append(row[3:])
        if whole():
            yield done()

    found = materialise(dealt.mapInArrow(lean(multiply), "a long, d0 long, b long, links long"), "links")
    free_shuffles(spark)  # of the sets
    roots = components(found.select("a", "b"), "components")
    links = found.groupBy(F.col("a").alias("rep"), "d0").agg(F.sum("links").alias("links"))
    known = classes.join(links, ["rep", "d0"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("d0", "d1", "size", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.join(known, ["d0", "d1"])
    alone = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("root")).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("size") - 1).alias("n_links"), F.when(alone, 1).otherwise(F.col("size")).alias("class_size"))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without those that have a smaller doc_id in their component; of rows that repeat a doc_id with one text, one stays."""
    groups = materialise(ngram_join(docs, percent), "near_groups")
    left = without(docs, groups.filter("component_id <> doc_id").select("doc_id").distinct())
    again = groups.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return left if again else left.dropDuplicates(["doc_id", "text"])


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sets),
e AS (SELECT doc_id, unnest(s) AS x FROM sets),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a),
z AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY list_sort(s)) END AS class_size FROM sets)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links, z.class_size
FROM n JOIN c USING (doc_id) JOIN z USING (doc_id) LEFT JOIN k USING (doc_id)
"""
