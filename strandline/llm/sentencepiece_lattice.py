"""SentencePiece encoding and decoding over a relational lattice.

The corpus's frequent words (found by bounded summaries of all texts) are encoded in Spark: every substring up
to the longest piece's length is exploded, equi-joined to the piece table, the edges are grouped by word, and
a higher-order aggregate folds each word's lattice. A unigram model's fold is Viterbi's. A BPE model's pieces
come from merges, which the best-scored path does not reproduce, so its fold applies the lattice's edges in
merge order; ids then equal the library's. The resulting dictionary has a fixed bound and is broadcast.
Words beyond it, and words longer than MAX_WORD, are folded by the same rule in the worker that meets them,
so no word depends on the bound. (All distinct words in the lattice would cost more than the whole operator may; the README has the figures.)

Texts are normalised as the model says: a dummy space in front, spaces as U+2581, nothing else (models with a
character map are refused). Characters without a piece become byte pieces. Null or empty text has no ids and
decodes to empty text. A text that holds U+2581 itself decodes with a space there, as in the library; the
column `exact` tells. Rows are independent; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, documents, lean, local_rows, materialise

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: A worker's own words, kept from task to task, and the model that they are of.
_own: dict[str, bytes] = {}
_own_of: list = []
#: Words in the broadcast dictionary, characters of a word there, and entries of a worker's own cache.
WORDS, MAX_WORD, CACHE = 1 << 16, 32, 1 << 15
UNIGRAM, BPE = 1, 2
#: More than the ids of any model; the rank of two pieces that don't merge.
SPAN, NEVER = 1 << 20, 1 << 30


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protobuf message: the wire format, for varints and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """A model's piece table: at most some ten thousand rows, a fixed size."""

    kind: int
    prefix: bool
    text: list[str]
    score: dict[str, tuple[float, int]] = field(default_factory=dict)  # of ordinary pieces
    bytes_: list[int] = field(default_factory=list)  # the id of each byte's piece
    unknown: int = 0
    _folder: list = field(default_factory=list, repr=False)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        spec: dict[int, dict] = {2: {}, 3: {}}
        for number, value in fields(data):
            if number in spec:
                spec[number] |= dict(fields(value))
        if spec[3].get(2) or spec[3].get(4, 1) or not spec[3].get(5, 1):
            raise ValueError("only models without a character map that keep white space are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(sp.get_piece_size())
        out = cls(spec[2].get(3, UNIGRAM), bool(spec[3].get(3, 1)), [sp.id_to_piece(i) for i in ids], unknown=sp.unk_id())
        out.score = {out.text[i]: (sp.get_score(i), i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        where = {out.text[i]: i for i in ids if sp.is_byte(i)}
        out.bytes_ = [where[f"<0x{b:02X}>"] for b in range(256)] if len(where) == 256 else []
        return out

    def words(self) -> Callable[[str], list[str]]:
        """Splits normalised text where no piece can stand across."""
        across = any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in self.score)
        return re.compile("(?s).+" if across else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n").findall

    def normalise(self, text: str | None) -> str:
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else ""

    def fallback(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode("utf-8", "replace")] if self.bytes_ else [self.unknown]

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            found = self.score.get(p)
            out += [found[1]] if found else self.fallback(p)
        return out

    def _merged_by_heap(self, word: str) -> list[str]:
        """The pieces of one word's BPE fold (merges of the best score first, leftmost among equals), in time that grows little faster than its length."""
        score, text = self.score, list(word)
        left, right = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap = [(-score[p][0], i, i + 1, p) for i in range(len(text) - 1) if (p := text[i] + text[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if not text[i] or right[i] != j or j >= len(text) or text[i] + text[j] != p:
                continue
            text[i], text[j], right[i] = p, "", right[j]
            if right[i] < len(text):
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(text) and (q := text[a] + text[b]) in score:
                    heapq.heappush(heap, (-score[q][0], a, b, q))
        return [t for t in text if t]

    def viterbi(self, word: str) -> list[str]:
        """The unigram fold of one word; an unknown character costs 10 more than the worst piece, as in the library."""
        longest, bad = max(map(len, self.score)), min(s for s, _ in self.score.values()) - 10
        best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                found = self.score.get(word[start:end])
                cost = found[0] if found else bad if end - start == 1 else None
                if cost is not None and best[start][0] + cost > best[end][0]:
                    best[end] = (best[start][0] + cost, start)
        out, at = [], len(word)
        while at:
            out.append(word[best[at][1] : at])
            at = best[at][1]
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        return self.ids(self._merged_by_heap(word) if self.kind == BPE else self.viterbi(word))

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word as bytes of 32-bit numbers: short words of known characters by Folder, others one by one."""
        if not self._folder and self.kind == BPE:
            self._folder.append(Folder(self))
        some = [w for w in words if len(w) <= MAX_WORD] if self.kind == BPE else []
        found = self._folder[0].fold(some) if some else {}
        return found | {w: array("i", self.encode_word(w)).tobytes() for w in words if w not in found}

    def decoder(self) -> Callable[[np.ndarray], str]:
        raw = [p.encode() for p in self.text]
        for b, i in enumerate(self.bytes_):
            raw[i] = bytes([b])

        def decode(ids: np.ndarray) -> str:
            text = b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
            return text[1:] if self.prefix and text[:1] == " " else text

        return decode


class Folder:
    """The BPE fold of many words at once, over arrays of ids: each round makes every word's best merge, leftmost among equals."""

    def __init__(self, pieces: Pieces):
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        order = sorted({s for s, _ in pieces.score.values()}, reverse=True)
        rank = {s: n for n, s in enumerate(order)}  # pieces of the best score first
        pairs = {}
        for p, (s, i) in pieces.score.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
            for k in range(1, len(p)):
                left, right = pieces.score.get(p[:k]), pieces.score.get(p[k:])
                if left and right:
                    pairs[left[1] * SPAN + right[1]] = (rank[s], i)
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)  # open addressing: the next free place to the right
        self.rank, self.merged = np.full(1 << self.bits, NEVER, dtype=np.int32), np.zeros(1 << self.bits, dtype=np.int32)
        homes = self._home(np.array(list(pairs), dtype=np.int64)).tolist()
        taken = bytearray(1 << self.bits)
        for at, (key, (r, i)) in zip(homes, pairs.items(), strict=True):
            while taken[at]:
                at = (at + 1) % len(taken)
            taken[at] = 1
            self.key[at], self.rank[at], self.merged[at] = key, r, i

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each two pieces merge into; NEVER if they don't."""
        keys = left.astype(np.int64) * SPAN + right
        at = self._home(keys)
        have = self.key[at]
        going = np.flatnonzero((have != keys) & (have >= 0))
        while len(going):
            at[going] = (at[going] + 1) & (len(self.key) - 1)
            have[going] = self.key[at[going]]
            going = going[(have[going] != keys[going]) & (have[going] >= 0)]
        hit = have == keys
        return np.where(hit, self.rank[at], NEVER), self.merged[at]

    def fold(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word all of whose characters have a piece, as bytes of 32-bit numbers."""
        size = np.array(list(map(len, words)), dtype=np.int64)
        ids = self.chars[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        known = np.logical_and.reduceat(ids >= 0, np.cumsum(size) - size)
        words = [w for w, k in zip(words, known.tolist(), strict=True) if k]
        if not words:
            return {}
        ids, size = ids[np.repeat(known, size)], size[known]
        owner = np.repeat(np.arange(len(size)), size)

        def pairs_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank, merged = np.full(len(at), NEVER, dtype=np.int32), np.zeros(len(at), dtype=np.int32)
            inside = np.flatnonzero(owner[np.minimum(at + 1, len(owner) - 1)] == owner[at])
            inside = inside[at[inside] + 1 < len(owner)]
            rank[inside], merged[inside] = self.look_up(ids[at[inside]], ids[at[inside] + 1])
            return rank, merged

        rank, merged = pairs_at(np.arange(len(ids)))
        while True:
            best = np.minimum.reduceat(rank, np.cumsum(size) - size)
            if not (best < NEVER).any():
                break
            at = np.flatnonzero((rank < NEVER) & (rank == np.repeat(best, size)))
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            ids[at] = merged[at]
            left = np.ones(len(ids), dtype=bool)
            left[at + 1] = False
            size[owner[at]] -= 1
            ids, owner, rank, merged = ids[left], owner[left], rank[left], merged[left]
            at -= np.arange(len(at))  # each merge before it has moved it by one
            for near in (at, at[at > 0] - 1):
                rank[near], merged[near] = pairs_at(near)
        data, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(size)).tolist()
        return {w: data[a:b] for w, a, b in zip(words, [0, *ends[:-1]], ends, strict=True)}


def frequent_words(docs: DataFrame, pieces: Pieces, words: int = WORDS) -> DataFrame:
    """The words (at most `words`) that the partitions' bounded counts, pruned by Misra-Gries, rank first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, kept = pieces.words(), Counter()
        for batch in by_size(batches):
            for text in batch.column("text").to_pylist():
                kept.update(split(pieces.normalise(text)))
                if len(kept) > 4 * words:
                    less = kept.most_common(2 * words)[-1][1]
                    kept = Counter({k: n - less for k, n in kept.items() if n > less})
        top = [(w, n) for w, n in kept.most_common(2 * words) if len(w) <= MAX_WORD and "\ud800" not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    counts = docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(words).select("word")


def lattice(words: DataFrame, pieces: Pieces, longest: int | None = None) -> DataFrame:
    """(word, edges): a map from 1000 * start + end to struct(score, id) of the pieces that stand in the word."""
    spark = words.sparkSession
    longest = longest or max(map(len, pieces.score))
    table = local_rows(spark, [(p, float(s), i) for p, (s, i) in pieces.score.items()], "piece string, score double, id int")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    ends = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("size"))
    parts = ends.withColumn("piece", F.col("word").substr(F.col("start"), F.col("size")))
    edges = parts.join(F.broadcast(table), "piece")  # the table's size is the model's
    key = (F.col("start") - 1) * 1000 + F.col("start") - 1 + F.col("size")  # start and end from 0
    grouped = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.struct("score", "id").alias("v")))).alias("edges"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<struct<score:double,id:int>>"))
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", none).alias("edges"))


def fold_merges(word: Column, edges: Column) -> Column:
    """The bounds of the word's pieces. Each step of the aggregate makes the best merge that the lattice has."""

    def step(bounds: Column, _: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(bounds) - 3, F.lit(0))), lambda i: F.size(bounds) >= i + 3)
        merges = F.transform(places, lambda i: F.struct(F.try_element_at(edges, F.get(bounds, i) * 1000 + F.get(bounds, i + 2))["score"].alias("score"), (-i).alias("i")))
        best = F.array_max(F.filter(merges, lambda m: m["score"].isNotNull()))
        drop = F.get(bounds, 1 - best["i"])
        return F.when(best.isNull(), bounds).otherwise(F.filter(bounds, lambda b: b != drop))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), F.sequence(F.lit(0), F.length(word)), step)


def fold_viterbi(word: Column, edges: Column, longest: int, bad: float) -> Column:
    """The bounds of the best path. The aggregate's state holds, for each end so far, the best score and its path's bounds."""
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))

    def step(done: Column, end: Column) -> Column:
        def reach(size: Column) -> Column:
            back = F.get(done, end - size)
            cost = F.coalesce(F.try_element_at(edges, (end - size) * 1000 + end)["score"], F.when(size == 1, F.lit(bad)))
            return F.struct((back["score"] + cost).alias("score"), size.alias("size"), F.concat(back["path"], F.array(end)).alias("path"))

        ways = F.filter(F.transform(F.sequence(F.lit(1), F.least(end, F.lit(longest))), reach), lambda w: w["score"].isNotNull())
        best = F.array_max(ways)
        return F.concat(done, F.array(F.struct(best["score"].alias("score"), best["path"].alias("path"))))

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(word)), first, step), -1)["path"]


def dictionary(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of each word."""
    word, edges = F.col("word"), F.col("edges")
    if pieces.kind == BPE:
        bounds = fold_merges(word, edges)
    else:
        bounds = fold_viterbi(word, edges, max(map(len, pieces.score)), min(s for s, _ in pieces.score.values()) - 10)
    folded = lattice(words, pieces).withColumn("bounds", bounds)
    byte_ids = F.array(*map(F.lit, pieces.bytes_ or [pieces.unknown]))

    def ids(i: Column) -> Column:
        lo, hi = F.get("bounds", i), F.get("bounds", i + 1)
        found = F.try_element_at(edges, lo * 1000 + hi)["id"]
        digits = F.hex(F.encode(word.substr(lo + 1, hi - lo), "UTF-8"))
        of_bytes = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda at: F.get(byte_ids, F.conv(digits.substr(at, F.lit(2)), 16, 10).cast("int")))
        return F.when(found.isNotNull(), F.array(found)).otherwise(of_bytes if pieces.bytes_ else byte_ids)

    return folded.select("word", F.flatten(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), ids)).alias("ids"))


def encode(docs: DataFrame, pieces: Pieces, words: int = WORDS, text: bool = True) -> DataFrame:
    """doc_id of each row of docs with ids, n_tokens, the text that the ids decode to (null without `text`), and whether it is the text."""
    found = dictionary(materialise(frequent_words(docs, pieces, words), "frequent_words"), pieces)
    known = {r["word"]: np.array(r["ids"], dtype="<i4").tobytes() for r in found.collect()}  # at most `words` rows
    sent = docs.sparkSession.sparkContext.broadcast((known, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pieces = sent.value
        split, decode, own = pieces.words(), pieces.decoder(), _own
        if _own_of and _own_of[0].text == pieces.text:  # the worker's last model, with what it has made
            pieces = _own_of[0]
        else:
            own.clear()
            _own_of[:] = [pieces]
        get, again = known.get, own.get
        for batch in by_size(batches):
            some = batch.column("text").to_pylist()
            words = [split(pieces.normalise(t)) for t in some]
            flat = [w for x in words for w in x]
            found = [get(w) or again(w) for w in flat]
            rare = [i for i, x in enumerate(found) if x is None]
            if rare:
                new = pieces.encode_words(list({flat[i]: None for i in rare}))
                for i in rare:
                    found[i] = new[flat[i]]
                if len(own) + len(new) > CACHE:
                    own.clear()
                own.update(new)
            ends = np.cumsum([len(x) for x in words]).tolist()
            ids = [np.frombuffer(b"".join(found[a:b]), dtype="<i4") for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            back = [decode(x) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            arrays = [
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32())), pa.array([len(x) for x in ids], pa.int64()),
                pa.array(back, pa.string()) if text else pa.nulls(len(some), pa.string()), pa.array([b == (t or "") for b, t in zip(back, some, strict=True)], pa.bool_()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "ids", "n_tokens", "decoded", "exact", "ids_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, ids array<int>, n_tokens long, decoded string, exact boolean, ids_sha256 string")


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(documents(spark, sf_dir), Pieces.load())
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "exact")
