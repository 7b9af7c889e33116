"""Language ID by bit-sliced Bloom filters of character n-grams.

Training counts, over a bounded sample of labelled documents, in how many of a language's documents each
n-gram stands; a language's most frequent ones go into its Bloom filter. The filters of all languages share
one array of slots and one set of hash functions: bit l of a slot belongs to language l. So the `and` of an
n-gram's slots is the set of all languages that contain it. A slot has a 64-bit column for each 64 languages, so
that no language is left out. For a document the bits are counted for each language; a
filter whose share of set bits is b passes b^hashes of foreign n-grams, which is taken off; the
largest corrected count decides, and its share of the document's n-grams is the score.

Every text is read whole, in pieces of bounded size. Null text, text without a letter, or text whose corrected
counts are 0 for all languages, is `und` with score 0; so is all text if nothing was learnt. Equal counts go to the first language by code point. Rows are
independent, so repeated rows repeat their result (rows with a null doc_id are in the sample or out of it together); other columns are not
looked at; an empty table gives an empty one. The sample's bound
is LEARN_DOCS documents a language, drawn by a hash of the id; LEARN_GRAMS bounds a language's n-grams. Those in fewer
than LEAST_DOCS documents are left out, but only of a language with ENOUGH_DOCS that gave n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lean, local_rows, small

N, HASHES = 4, 3
LEARN_DOCS, LEARN_GRAMS, LEAST_DOCS, ENOUGH_DOCS = 1000, 1 << 15, 3, 100
#: Languages of a column of the slots.
WIDTH = 64
#: Characters worked on at once.
PIECE = 1 << 18
UNKNOWN = "und"
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def pieces(texts) -> Iterator[list[tuple[int, str]]]:
    """Batches of (index of the text, lower-case piece) of bounded size; pieces of a long text overlap by N - 1."""
    batch, size = [], 0
    for i, text in enumerate(texts):
        text = text.lower() if text else ""
        for at in range(0, max(len(text), 1), PIECE):
            part = text[max(0, at - N + 1) : at + PIECE]
            if size + len(part) > PIECE and batch:
                yield batch
                batch, size = [], 0
            batch.append((i, part))
            size += len(part)
    if batch:
        yield batch


def ngrams(batch: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash at each place, and each piece's range of places. Other characters than letters count as one space."""
    lengths = np.array([len(p) + 2 for _, p in batch])
    code = np.frombuffer("".join(f" {p} " for _, p in batch).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of a run of others
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keep[starts] = True
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    kept = np.concatenate([[0], np.cumsum(keep)])
    lo, hi = kept[starts], kept[starts + lengths]
    h = np.zeros(max(len(code) - N + 1, 0), dtype=np.uint64)
    for i in range(N):
        h = h * np.uint64(ODD[3]) + code[i : len(code) - N + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(ODD[0])
    return h, np.minimum(lo, len(h)), np.clip(hi - N + 1, np.minimum(lo, len(h)), len(h))


class Model:
    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs = langs
        columns = max(1, -(-len(langs) // WIDTH))
        sizes = [len(grams[lang]) for lang in langs]
        # Ten slots for each n-gram of all languages; with more columns fewer, so that all of them stay as large as one was.
        self.bits = max(10, int(np.ceil(np.log2(10 * max(1, max(sizes, default=0), sum(sizes) // columns**2)))))
        self.kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= min(max(1, len(langs)), WIDTH))
        self.slots = np.zeros((columns, 1 << self.bits), dtype=self.kind)
        full = []
        for i, lang in enumerate(langs):
            set_bits = np.unique(np.concatenate(list(self.places(grams[lang]))))
            self.slots[i // WIDTH, set_bits] |= self.kind(1 << i % WIDTH)
            full.append(len(set_bits) / (1 << self.bits))
        self.false = np.array(full) ** HASHES

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(HASHES):
            yield ((h * np.uint64(ODD[i])) >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, h: np.ndarray, column: int = 0) -> np.ndarray:
        """The column's languages that contain each n-gram, a bit each."""
        slots, found = self.slots[column], None
        for at in self.places(h):
            found = slots[at] if found is None else found & slots[at]
        return found

    def counts(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the corrected count for each language, the number of n-grams, and whether it has a letter."""
        n = len(texts)
        count, total = np.zeros((n, len(self.langs))), np.zeros(n)
        some = np.zeros(n, dtype=bool)
        for batch in pieces(texts):
            h, lo, hi = ngrams(batch)
            at = np.array([i for i, _ in batch])
            np.add.at(total, at, hi - lo)
            for i in range(len(self.langs)):
                if i % WIDTH == 0:
                    mask = self.masks(h, i // WIDTH)
                upto = np.concatenate([[0], np.cumsum((mask >> self.kind(i % WIDTH)) & self.kind(1), dtype=np.int64)])
                np.add.at(count[:, i], at, upto[hi] - upto[lo])
            for i, part in batch:
                some[i] |= any(map(str.isalpha, part))
        return np.maximum(0, (count - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999))), total, some

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        right, total, some = self.counts(texts)
        best = right.argmax(1)
        some &= right.max(1) > 0
        score = np.where(some, right[np.arange(n), best] / np.maximum(total, 1), 0.0)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.clip(score, 0, 1)


def learn(docs: DataFrame) -> Model:
    """The model of the documents that aren't held out and have a language."""
    known = docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return Model([], {})
    share = local_rows(docs.sparkSession, [(r["lang"], min(1.0, LEARN_DOCS / r["count"])) for r in counts], "lang string, share double")
    part = (F.xxhash64("doc_id") % 1_000_000 + 1_000_000) % 1_000_000 / 1_000_000
    sample = known.join(F.broadcast(share), "lang").filter(part < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                found, learnt = [], set()
                for some in pieces(rows["text"]):
                    h, lo, hi = ngrams(some)
                    found += [np.unique(h[a:b]) for a, b in zip(lo, hi, strict=True)]
                    learnt.update(i for (i, _), a, b in zip(some, lo, hi, strict=True) if b > a)
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": pd.array(gram.view(np.int64), dtype="Int64"), "n": n})
                yield pd.DataFrame({"lang": [lang], "gram": pd.array([None], dtype="Int64"), "n": [len(learnt)]})  # the documents

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "grams": [rows["gram"].to_numpy(dtype=np.int64).tobytes()]})

    grams = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    docs_of = F.max(F.when(F.col("gram").isNull(), F.col("n"))).over(Window.partitionBy("lang"))
    grams = grams.withColumn("docs", docs_of).filter(F.col("gram").isNotNull() & ((F.col("n") >= LEAST_DOCS) | (F.col("docs") < ENOUGH_DOCS)))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("r", order).filter(F.col("r") <= LEARN_GRAMS).select("lang", "gram")
    packed = dict(top.groupBy("lang").applyInPandas(pack, "lang string, grams binary").collect())
    langs = sorted(r["lang"] for r in counts)
    return Model(langs, {x: np.frombuffer(packed.get(x, b""), dtype=np.uint64) for x in langs})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lang, score = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that have a letter and evidence for a language.

    Evidence isn't asked for where there can be none: if nothing was learnt, or nothing of the language a document is labelled with."""
    learnt = {x for x, n in zip(model.langs, model.false, strict=True) if n > 0}
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            right, _, some = sent.value.counts(batch.column("text").to_pylist())
            unlearnt = np.array([x is not None and x not in learnt for x in batch.column("lang").to_pylist()], dtype=bool)
            yield batch.filter(pa.array(some & (right.any(axis=1) | unlearnt | (not learnt))))

    return docs.mapInArrow(lean(run), docs.schema)


def op2_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
