"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Each 100-byte string has an anchor: the KMER-byte string in it with the smallest hash. Strings that follow each
other with one anchor make a span, so spans part the strings of a text, and equal strings have equal anchors. Spans are
shuffled by anchor. Of equal spans all but the first are removed as a whole (inside a task before anything is
shuffled, which keeps hot passages small). An anchor with very many different spans is split: its spans are dealt
anew by their own hash.

Where an anchor has several different spans, their strings are grouped by how many bytes stand before the anchor:
strings of one range of such distances share the bytes around the anchor that all of them cover. Each group becomes a
collection whose Burrows-Wheeler transform and common prefixes are built column by column; suffixes whose common prefix is 100
bytes or more are equal strings, of which all but the first are removed. A group with more texts than GROUP is split into
two narrower ranges until it is small; a range of one distance is one string, whose first place is found by a
partial aggregate; a group's rows are written anew at each of at most seven such splits. So no task holds more than a group, whatever a passage's number of surroundings is,
and rounds are bounded by the length of two strings whatever a document's length is.

Earlier means a smaller doc_id, or the same document and an earlier start; matches never cross documents. Null
text is empty. If doc_ids are null or repeat, rows are ordered by (doc_id, text), nulls last, and a
repeated row is a later document. Texts below 100 bytes stay as they are. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection_bwt import repeated
from .common import broadcast_if_small, documents, global_rank, lean, materialise, small
from .graph import FILTER_KEYS, in_filter, key_filter
from .shingles import _powers, mixed

LENGTH, KMER = 100, 32
#: Bytes of text worked on at once (places in them take PLACE bits), entries held before they are sent, texts of a block of the transform and of a group.
PLACE, HELD, BLOCK, GROUP = 18, 1 << 19, 4096, 1 << 15
#: Different spans of an anchor among the entries held, from which on they are dealt by span; the same for those of all tasks.
MANY, VERY_MANY = 64, 1 << 16
_RANDOM = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def spans(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches of (index of the text, first and last start of a string, anchor hash, span hash, anchor's distance from the first start)."""
    batch, size = [], 0
    limit = (1 << PLACE) - 2
    for i, text in enumerate(texts):
        step = limit - LENGTH
        for at in range(0, max(len(text) - LENGTH + 1, 0), step):  # long texts in parts that share LENGTH - 1 bytes
            part = text[at : at + step + LENGTH - 1]
            if batch and size + len(part) > limit:
                yield _spans(batch)
                batch, size = [], 0
            batch.append((i, at, part))
            size += len(part)
    if batch:
        yield _spans(batch)


def _spans(batch: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    b = np.frombuffer(b"".join(p for _, _, p in batch), dtype=np.uint8)
    up, down = _powers(1 << (PLACE + 1))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_RANDOM[b] * up[: len(b)], dtype=np.uint64)])
    kmer = mixed((total[KMER:] - total[:-KMER]) * down[: len(b) - KMER + 1])
    mask = np.uint64((1 << PLACE) - 1)
    low = (kmer & ~mask) | np.arange(len(kmer), dtype=np.uint64)
    width, done = LENGTH - KMER + 1, 1
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    at = (low & mask).astype(np.int64)  # of the string's anchor
    sizes = np.array([len(p) for _, _, p in batch])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(batch)), sizes)[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= (begin + sizes)[owner]
    first = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    ends = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~inside[1:], [True]]))
    where = owner[first]
    span = mixed((total[ends + LENGTH] - total[first]) * down[first] + (ends - first).astype(np.uint64))
    shift = np.array([a for _, a, _ in batch])[where] - begin[where]
    return np.array([i for i, _, _ in batch])[where], first + shift, ends + shift, kmer[at[first]], span, at[first] - first


def utf8(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


ENTRY = np.dtype([("anchor", "<u8"), ("span", "<u8"), ("key", "<i8"), ("first", "<i4"), ("n", "u1")])
FIELDS = ENTRY.names


def pack(e: np.ndarray) -> bytes:
    """Column after column, which compresses better."""
    return b"".join(np.ascontiguousarray(e[f]).tobytes() for f in FIELDS)


def unpack(blobs: list[bytes]) -> np.ndarray:
    sizes = [len(b) // ENTRY.itemsize for b in blobs]
    out = np.empty(sum(sizes), dtype=ENTRY)
    at = 0
    for blob, n in zip(blobs, sizes, strict=True):
        offset = 0
        for f in FIELDS:
            out[f][at : at + n] = np.frombuffer(blob, ENTRY[f], n, offset)
            offset += n * ENTRY[f].itemsize
        at += n
    return out


def split_equal(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of (anchor, span, key, first), which are first of their span, and which are not."""
    e = e[np.lexsort((e["first"], e["key"], e["span"], e["anchor"]))]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["span"][1:] != e["span"][:-1])
    return e, new, ~new


def runs_batch(e: np.ndarray, **more) -> pa.RecordBatch:
    """Entries as rows (key, first, last) of starts of strings to remove; with variant=True, of spans to compare byte by byte."""
    first = e["first"].astype(np.int32)
    arrays = [pa.array(e["key"].astype(np.int64)), pa.array(first), pa.array(first + e["n"]), pa.array(np.full(len(e), more.get("variant", False)))]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "first", "last", "variant"])


def by_bucket(e: np.ndarray, hashes: np.ndarray, buckets: int, first: int = 0) -> list[tuple[int, bytes]]:
    """Entries packed by range of the hash, with the number of the range, counted from `first`."""
    order = np.argsort(hashes, kind="stable")
    e = e[order]
    at = np.searchsorted(hashes[order] >> np.uint64(64 - buckets.bit_length() + 1), np.arange(buckets + 1))
    return [(first + b, pack(e[lo:hi])) for b, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]


def crowded(e: np.ndarray, most: int) -> np.ndarray:
    """Anchors with more than `most` of the entries, which are sorted by anchor."""
    at = np.flatnonzero(np.append(True, e["anchor"][1:] != e["anchor"][:-1])) if len(e) else np.empty(0, dtype=np.int64)
    return e["anchor"][at][np.diff(np.append(at, len(e))) > most]


def anchored(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, entries) of the first of each task's equal spans, packed by range of the anchor's hash (anchors
    themselves are small, being least among many), or (from bucket
    number `buckets` on) by range of span where the task has many of an anchor; or, with a null bucket, spans that the
    task itself found repeated. A row's `split` names the anchors of its bucket that some task deals by span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            e, new, again = split_equal(np.concatenate(held))
            held.clear()
            rows = [(None, pack(e[again]), None)] if again.any() else []
            e = e[new]
            many = crowded(e, MANY)
            apart = np.isin(e["anchor"], many)
            rows += [(b, x, None) for b, x in by_bucket(e[~apart], mixed(e["anchor"][~apart]), buckets)]
            rows += [(b, x, None) for b, x in by_bucket(e[apart], e["span"][apart], buckets, buckets)]
            where = (mixed(many) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)
            rows += [(int(b), None, many[where == b].tobytes()) for b in np.unique(where)]
            arrays = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "entries", "split"])

        total = 0
        for batch in small(batches):
            key = np.asarray(batch.column("key"))
            for i, first, last, anchor, span, _ in spans(utf8(batch.column("text"))):
                e = np.empty(len(i), dtype=ENTRY)
                e["anchor"], e["span"], e["key"], e["first"], e["n"] = anchor, span, key[i], first, last - first
                held.append(e)
                total += len(e)
                if total > HELD:
                    yield from send()
                    total = 0
        if held:
            yield from send()

    return docs.select("key", "text").mapInArrow(lean(run), "bucket int, entries binary, split binary")


RUNS = "key long, first int, last int, variant boolean"
DEALT = RUNS + ", bucket int, entries binary"


def dealt_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Packed entries that go on by span, as rows of DEALT without a run."""
    none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.bool_())]
    return pa.RecordBatch.from_arrays([*none, pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["key", "first", "last", "variant", "bucket", "entries"])


def with_nulls(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names=[*batch.schema.names, "bucket", "entries"])


def compare_spans(entries: DataFrame, buckets: int) -> DataFrame:
    """DEALT rows: runs of all spans that repeat an earlier one, and of the first of each span whose anchor has others.

    Rows come sorted by bucket, so a worker holds one bucket at a time. Entries of anchors that are dealt by span, as
    the bucket's `split` or its own count says, go on without being held."""

    def finish(e: np.ndarray, apart: np.ndarray) -> Iterator[pa.RecordBatch]:
        e, new, again = split_equal(e)
        yield with_nulls(runs_batch(e[again]))
        e = e[new]
        on = np.isin(e["anchor"], apart)
        if on.any():
            yield dealt_batch(by_bucket(e[on], e["span"][on], buckets))
            e = e[~on]
        same = e["anchor"][1:] == e["anchor"][:-1]
        yield with_nulls(runs_batch(e[np.append(same, False) | np.insert(same, 0, False)] if len(e) else e, variant=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, apart, n, enough = None, [], np.empty(0, dtype=np.uint64), 0, VERY_MANY
        for batch in batches:
            for b, x, split in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b is None:
                    yield with_nulls(runs_batch(unpack([x])))
                    continue
                if b >= buckets:
                    yield dealt_batch([(b - buckets, x)])
                    continue
                if b != bucket:
                    if held:
                        yield from finish(np.concatenate(held), apart)
                    bucket, held, apart, n, enough = b, [], np.empty(0, dtype=np.uint64), 0, VERY_MANY
                if split is not None:
                    apart = np.union1d(apart, np.frombuffer(split, np.uint64))
                    continue
                held.append(unpack([x]))
                n += len(held[-1])
                if n > enough:  # what repeats, and anchors that have become crowded, leave
                    e, new, again = split_equal(np.concatenate(held))
                    yield with_nulls(runs_batch(e[again]))
                    e = e[new]
                    apart = np.union1d(apart, crowded(e, VERY_MANY // 4))
                    on = np.isin(e["anchor"], apart)
                    if on.any():
                        yield dealt_batch(by_bucket(e[on], e["span"][on], buckets))
                    held, n = [e[~on]], int((~on).sum())
                    enough = max(VERY_MANY, 2 * n)
        if held:
            yield from finish(np.concatenate(held), apart)

    # Repeats that a task has found need no place; they go to any.
    dealt = entries.repartition(F.coalesce("bucket", (-F.rand(7) * 1e6).cast("int"))).sortWithinPartitions("bucket")
    return dealt.mapInArrow(lean(run), DEALT)


def compare_dealt(entries: DataFrame) -> DataFrame:
    """RUNS of spans dealt by span: those that repeat an earlier one, and the first of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            e, new, again = split_equal(unpack(held))
            yield runs_batch(e[again])
            yield runs_batch(e[new], variant=True)

        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket:
                    if held:
                        yield from done()
                    bucket, held = b, []
                held.append(x)
        if held:
            yield from done()

    return entries.select("bucket", "entries").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), RUNS)


def variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(at, key, first, part): bytes of the spans in wanted (and of a few more, which do no harm), and where in them the anchor stands."""
    place = F.shiftleft("key", 20).bitwiseXOR(F.col("first").cast("long"))
    n = wanted.count()
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(place.alias("k")), n)) if n <= FILTER_KEYS else None
    rows = docs.select("key", "text")
    if sent is None:  # beyond the filter's size each document meets its own spans
        rows = rows.join(wanted.groupBy("key").agg(F.collect_list("first").alias("firsts")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            key, texts = np.asarray(batch.column("key")), utf8(batch.column("text"))
            firsts = [set(x) for x in batch.column("firsts").to_pylist()] if sent is None else None
            for i, first, last, _, _, at in spans(texts):
                keep = np.array([f in firsts[k] for k, f in zip(i, first, strict=True)], dtype=bool) if sent is None else in_filter(sent.value, (key[i] << 20) ^ first)
                if not keep.any():
                    continue
                i, first, last, at = (x[keep] for x in (i, first, last, at))
                part = [texts[k][f : e + LENGTH] for k, f, e in zip(i, first, last, strict=True)]
                arrays = [pa.array(at.astype(np.int32)), pa.array(key[i]), pa.array(first.astype(np.int32)), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["at", "key", "first", "part"])

    return rows.mapInArrow(lean(run), "at int, key long, first int, part binary")


#: Distances of the anchor from the start of a string: two ranges at first.
WIDTH = LENGTH - KMER
RANGES = [(0, WIDTH // 2), (WIDTH // 2 + 1, WIDTH)]


def in_ranges(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """rows cut to the strings whose anchor stands low to high bytes after their start, with h, the hash of the bytes
    that all such strings cover. Rows without such a string go."""
    cut = rows.withColumns({"lo": low, "hi": high})
    begin, end = F.greatest(F.lit(0), F.col("at") - F.col("hi")), F.least(F.octet_length("part"), F.col("at") - F.col("lo") + LENGTH)
    cut = cut.withColumns({"_b": begin, "_e": end}).filter(F.col("_e") - F.col("_b") >= LENGTH)
    shared = F.substring("part", F.col("at") - F.col("lo") + 1, LENGTH - (F.col("hi") - F.col("lo")))
    return cut.select(
        F.xxhash64(shared).alias("h"), "lo", "hi", (F.col("at") - F.col("_b")).alias("at"), "key", (F.col("first") + F.col("_b")).alias("first"),
        F.substring("part", F.col("_b") + 1, F.col("_e") - F.col("_b")).alias("part"))


def compare_variants(rows: DataFrame) -> DataFrame:
    """RUNS of strings in the variants that stand earlier in another (or in the same) one."""
    limits = F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in RANGES]))
    left = rows.select("*", limits.alias("r"))
    left = in_ranges(left, F.col("r.lo"), F.col("r.hi"))
    found = None
    while True:
        left = materialise(left, "variants")
        crowds = materialise(left.groupBy("h", "lo").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("h", "lo"), "crowds")
        hot = broadcast_if_small(crowds)
        some = compare_bytes(left.join(hot, ["h", "lo"], "left_anti"))
        found = some if found is None else found.unionByName(some)
        if crowds.isEmpty():
            return found
        crowd = left.join(hot, ["h", "lo"], "left_semi")
        whole = crowd.filter("lo = hi")  # each row is one string
        first = whole.groupBy("part").agg(F.min(F.struct("key", "first")).alias("f"))
        again = whole.join(broadcast_if_small(first), "part").filter((F.col("key") != F.col("f.key")) | (F.col("first") != F.col("f.first")))
        found = found.unionByName(again.select("key", "first", F.col("first").alias("last"), F.lit(False).alias("variant")))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
        parted = crowd.filter("lo < hi").withColumn("r", F.explode(halves)).select("at", "key", "first", "part", "r")
        left = in_ranges(parted, F.col("r.lo"), F.col("r.hi"))


def compare_bytes(rows: DataFrame) -> DataFrame:
    """RUNS of repeated strings in groups of equal h, none of which is larger than GROUP, by the transform."""

    def block(key: np.ndarray, first: np.ndarray, part: list[bytes]) -> pa.RecordBatch:
        group, text, offset = repeated(part, LENGTH)
        key, start = key[text], first[text].astype(np.int64) + offset
        order = np.lexsort((start, key, group))
        group, key, start = group[order], key[order], start[order]
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
        head_at = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else head
        again = ~((key == key[head_at]) & (start == start[head_at])) if len(head) else head
        key, start = key[again], start[again]
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        cut = np.ones(len(key), dtype=bool)
        cut[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], len(key)) - 1
        e = np.empty(len(lo), dtype=[("key", "<i8"), ("first", "<i8"), ("n", "<i8")])
        if len(lo):
            e["key"], e["first"], e["n"] = key[lo], start[lo], start[hi] - start[lo]
        arrays = [pa.array(e["key"]), pa.array(e["first"].astype(np.int32)), pa.array((e["first"] + e["n"]).astype(np.int32)), pa.array(np.zeros(len(e), dtype=bool))]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "first", "last", "variant"])

    def alone(h: np.ndarray) -> np.ndarray:  # whose text repeats nothing
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        return ~(same[: len(h)] | same[1 : len(h) + 1])

    def blocks(held: pa.Table) -> Iterator[pa.RecordBatch]:
        held = held.filter(pa.array(~alone(held.column("h").to_numpy())))
        h, key, first, part = held.column("h").to_numpy(), held.column("key").to_numpy(), held.column("first").to_numpy(), held.column("part").to_pylist()
        seen: set[tuple[int, bytes]] = set()
        again = np.zeros(len(h), dtype=bool)  # equal texts of one group: the first stands for all
        for i, x in enumerate(zip(h.tolist(), part, strict=True)):
            again[i] = x in seen
            seen.add(x)
        if again.any():
            size = np.array([len(part[i]) for i in np.flatnonzero(again)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key[again]), pa.array(first[again]), pa.array(first[again] + size - LENGTH), pa.array(np.zeros(len(size), dtype=bool))], names=["key", "first", "last", "variant"])
        left = np.flatnonzero(~again)
        left = left[~alone(h[left])]
        h, key, first, part = h[left], key[left], first[left], [part[i] for i in left]
        lo = 0
        while lo < len(part):  # blocks end between groups
            hi = min(lo + BLOCK, len(part))
            while hi < len(part) and h[hi] == h[hi - 1]:
                hi += 1
            yield block(key[lo:hi], first[lo:hi], part[lo:hi])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:  # sorted by h, then place: a worker holds a few blocks and the group at their end
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * BLOCK:
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(table.column("h").to_numpy(), table.column("h")[-1].as_py()))
            if cut:
                yield from blocks(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield from blocks(pa.Table.from_batches(held))

    return rows.select("h", "key", "first", "part").repartition("h").sortWithinPartitions("h", "key", "first").mapInArrow(lean(run), RUNS)


def removed(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes covered by the strings that start from first to last."""
    order = np.argsort(first, kind="stable")
    first, end = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + LENGTH)
    new = np.concatenate([[True], first[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return first[at], end[np.append(at[1:], len(end)) - 1]


def substring_dedup(docs: DataFrame, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each maximal removed run), kept_sha256 of each row of docs; with kept=True also the bytes left."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = docs.filter("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    keyed = docs.withColumn("key", F.col("doc_id")) if odd else global_rank(docs, [F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce("text", F.lit(""))], "keyed", "key").withColumn("key", F.col("key").cast("long"))
    buckets = max(256, 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    spans_ = materialise(compare_spans(anchored(keyed, buckets), buckets), "equal_spans")
    found = spans_.filter("entries is null").select("key", "first", "last", "variant").unionByName(compare_dealt(materialise(spans_.filter("entries is not null"), "dealt_spans")))
    more = compare_variants(variants(keyed, found.filter("variant")))
    runs = found.filter("not variant").unionByName(more).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = keyed.join(runs, "key", "left").select("doc_id", "text", F.col("runs.first").alias("first"), F.col("runs.last").alias("last"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            firsts, lasts = batch.column("first"), batch.column("last")
            for i, text in enumerate(utf8(batch.column("text"))):
                if not firsts[i].is_valid:
                    out.append((len(text), [], text))
                    continue
                lo, hi = removed(np.asarray(firsts[i].values), np.asarray(lasts[i].values))
                edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), [{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], left))
            arrays = [batch.column("doc_id"), pa.array([n for n, _, _ in out], pa.int64()), pa.array([s for _, s, _ in out], SPANS), pa.array([hashlib.sha256(x).hexdigest() for _, _, x in out], pa.string())]
            names = ["doc_id", "n_bytes", "spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for _, _, x in out], pa.binary())] if kept else arrays, names=[*names, "kept"] if kept else names)

    return joined.mapInArrow(lean(cut), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * kept)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def op9_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


OP9_SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(n - 99)) AS i, x FROM d WHERE n >= 100),
w AS (SELECT doc_id, i, hash(substring(x, 2 * i + 1, 200)) AS h FROM p),
f AS (SELECT h, min(CAST(doc_id AS HUGEINT) * 4294967296 + i) AS f FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (h) WHERE CAST(doc_id AS HUGEINT) * 4294967296 + i <> f.f),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
t AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM t),
k AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, list({'a': a, 'since': since} ORDER BY a) AS gaps FROM g GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN gaps IS NULL THEN x ELSE array_to_string(list_transform(gaps, lambda q: substring(x, 2 * q.since + 1, 2 * (q.a - q.since))), '') || substring(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
