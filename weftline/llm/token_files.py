"""Token-id files in Simple-8b: 64-bit words of a 4-bit selector and as many ids as fit its width.

A file holds a run of documents in ascending doc_id order. Ids are first replaced by codes, frequent ids by small
ones (the file's own table, from its first block), then packed block by block: each word takes the longest run of
codes that fits one of the widths below; a code that fits none of them but the widest takes a word alone, the
escape. Blocks start at a word and their offsets stand in the footer, so any block can be decoded by itself, and a
block is decoded with one vectorised step for each selector.

    magic | blocks of words | footer: code table, doc ids, ids of each document, block offsets | footer size | magic

Null text counts as empty (the end id alone); an empty table writes no file and gives no rows; rows that repeat a
doc_id are ordered by their text; texts of any length are written whole; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import io
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common, tokens

MAGIC = b"S8BIDS01"
#: Codes in a word and bits of each, for selectors 1 to 14; selector 15 is the escape, one code of up to 60 bits.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
BLOCK_IDS, END_ID = 1 << 16, 2
#: Pieces that a worker keeps here: their caches and one batch's pieces leave an executor room for a heap that has grown to its limit.
FILE_PIECES = 900_000
#: Characters from which on texts are encoded together.
BATCH_CHARS = 6_000_000
_counts = np.array([0, *(c for c, _ in WIDTHS), 0, 1], np.int64)  # by selector; 0 and 14 are free


def pack_words(codes: np.ndarray) -> np.ndarray:
    """The words of one block of codes (unsigned integers below 2 ** 60)."""
    codes = codes.astype(np.uint64)
    n = len(codes)
    selector = np.full(n, ESCAPE, np.int64)
    low, wide = np.minimum(codes, np.uint64(1 << 30)).astype(np.uint32), np.zeros(n + 1, np.int32)  # the widest width has 30 bits
    for s in range(len(WIDTHS), 0, -1):
        count, bits = WIDTHS[s - 1]
        if count > n:
            continue
        np.cumsum(low >= 1 << bits, out=wide[1:])
        fits = wide[count:] == wide[: n + 1 - count]
        if not fits.any():
            break  # narrower widths with more codes can't fit either
        np.putmask(selector[: n + 1 - count], fits, s)
    steps, at, i = _counts[selector].tolist(), [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    starts = np.array(at, np.int64)
    chosen = selector[starts] if n else starts
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        count, bits = (1, 60) if s == ESCAPE else WIDTHS[s - 1]
        mine = chosen == s
        lanes = codes[starts[mine][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
        words[mine] |= np.bitwise_or.reduce(lanes, axis=1)
    return words


def unpack_words(words: np.ndarray) -> np.ndarray:
    """The codes of one block of words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = _counts[selector]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selector):
        count, bits = (1, 60) if s == ESCAPE else WIDTHS[s - 1]
        mine = selector == s
        lanes = (words[mine][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        out[(ends - counts)[mine][:, None] + np.arange(count)] = lanes
    return out


class Codes:
    """Frequent ids take the small codes; an id beyond the table is its own code."""

    def __init__(self, table: np.ndarray) -> None:
        self.id_of = table.astype(np.uint64)
        self.code_of = np.empty(len(table), np.uint64)
        self.code_of[table] = np.arange(len(table), dtype=np.uint64)

    @classmethod
    def learn(cls, ids: np.ndarray, vocabulary: int) -> Codes:
        seen = np.bincount(ids[ids < vocabulary], minlength=vocabulary)
        return cls(np.argsort(-seen, kind="stable"))

    @staticmethod
    def _through(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        inside = values < len(table)
        if inside.all():
            return table[values]
        out = values.astype(np.uint64)
        out[inside] = table[values[inside]]
        return out

    def encode(self, ids: np.ndarray) -> np.ndarray:
        return self._through(self.code_of, ids)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self._through(self.id_of, codes)


class Writer:
    """Writes one file; documents come in ascending order."""

    def __init__(self, sink, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
        self.sink, self.vocabulary, self.block_ids, self.codes = sink, vocabulary, block_ids, None
        self.docs, self.sizes, self.blocks, self.held, self.n_held = array("q"), array("q"), array("q"), [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        """One document's ids as little-endian unsigned 32-bit integers."""
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        if self.codes is None:
            self.codes = Codes.learn(ids[: self.block_ids], self.vocabulary)
        i = 0
        while len(ids) - i >= self.block_ids or (all_of_it and i < len(ids)):
            part = ids[i : i + self.block_ids]
            words = pack_words(self.codes.encode(part))
            self.sink.write(words.astype("<u8").tobytes())
            self.blocks.extend((len(part), len(words)))
            i += len(part)
        self.held, self.n_held = [ids[i:].tobytes()], len(ids) - i

    def close(self) -> None:
        self._flush(True)
        footer = io.BytesIO()
        np.savez(footer, table=self.codes.id_of.astype("<u4"), docs=np.array(self.docs, "<i8"), sizes=np.array(self.sizes, "<i8"), blocks=np.array(self.blocks, "<i8").reshape(-1, 2))
        self.sink.write(footer.getvalue() + np.array([footer.tell()], "<u8").tobytes() + MAGIC)


class Reader:
    """Reads a file that can be sought."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or cut off")
        length = int(np.frombuffer(tail[:8], "<u8")[0])
        source.seek(size - 16 - length)
        footer = np.load(io.BytesIO(source.read(length)))
        self.codes, self.docs, self.sizes, self.blocks = Codes(footer["table"].astype(np.int64)), footer["docs"], footer["sizes"], footer["blocks"]
        self.offsets = len(MAGIC) + 8 * np.concatenate(([0], np.cumsum(self.blocks[:, 1])))

    def block(self, k: int) -> np.ndarray:
        """The ids of block k."""
        self.source.seek(int(self.offsets[k]))
        words = np.frombuffer(self.source.read(int(8 * self.blocks[k, 1])), "<u8")
        return self.codes.decode(unpack_words(words)).astype("<u4")

    def documents(self) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """(doc_id, runs of its ids) in file order; a document's runs must be read before the next document's."""
        state = {"k": 0, "ids": np.empty(0, "<u4"), "at": 0}

        def runs(left: int) -> Iterator[np.ndarray]:
            while left:
                if state["at"] == len(state["ids"]):
                    state.update(ids=self.block(state["k"]), at=0, k=state["k"] + 1)
                part = state["ids"][state["at"] : state["at"] + left]
                state["at"] += len(part)
                left -= len(part)
                yield part

        for doc, n in zip(self.docs.tolist(), self.sizes.tolist()):
            yield doc, runs(n)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI of any store that Arrow knows, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def many(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """doc_ids and texts of batches, put together up to BATCH_CHARS: a piece that many of them have is looked up once."""
    docs, texts, held = [], [], 0
    for b in batches:
        docs += b.column("doc_id").to_pylist()
        texts += (new := b.column("text").to_pylist())
        held += sum(map(len, new))
        if held >= BATCH_CHARS:
            yield docs, texts
            docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write every document's ids, and end_id after each, to files in the shared folder; returns their list.

    The list (part, file, n_docs, n_ids, n_bytes) is in doc_id order by part. A file appears under its name only
    when it is whole, so a task that is lost or run twice leaves no half of one.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    @common.task("tokens")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.PieceEncoder(path, tokens.as_bytes, b"".join, kept=FILE_PIECES)
        task = TaskContext.get()
        store, at = open_folder(folder)
        name, mine = f"part-{task.partitionId():06d}.s8b", f"{at}/.{task.partitionId()}-{task.taskAttemptId()}"
        sink = writer = None
        for docs, texts in many(batches):
            for doc, ids in zip(docs, encode(texts)):
                if writer is None:
                    store.create_dir(at, recursive=True)
                    sink = store.open_output_stream(mine)
                    writer = Writer(sink, tokens.load(path).get_vocab_size())
                writer.add(doc, ids + end)
        if writer is None:
            return
        writer.close()
        sink.close()
        store.move(mine, f"{at}/{name}")
        n_bytes = store.get_file_info(f"{at}/{name}").size
        row = {"part": [task.partitionId()], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [sum(writer.sizes)], "n_bytes": [n_bytes]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    ordered = common.id_text(docs).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    listed = ordered.mapInArrow(run, "part int, file string, n_docs long, n_ids long, n_bytes long")
    # one row for each file, so one table file holds them all; on a local file system each one may make an executor start processes
    listed.repartition(1).write.parquet(f"{folder}/_list")
    return spark.read.schema(listed.schema).parquet(f"{folder}/_list")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    listed = spark.read.parquet(f"{folder}/_list")
    # one row for each file: the only step that one task does for all
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = listed.select("part", "file", "n_bytes", before.alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_folder(folder)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(f"{at}/{row['file']}") as source:
                    reader, start = Reader(source, row["n_bytes"]), row["start"]
                    crcs = []
                    for _, runs in reader.documents():
                        crc = 0
                        for ids in runs:
                            crc = zlib.crc32(ids.tobytes(), crc)
                        crcs.append(crc)
                    first = start + np.concatenate(([0], np.cumsum(reader.sizes)[:-1]))
                    for i in range(0, len(crcs), 50_000):
                        part = slice(i, i + 50_000)
                        yield pa.RecordBatch.from_arrays([pa.array(reader.docs[part]), pa.array(first[part]), pa.array(reader.sizes[part]), pa.array(crcs[part], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for FILE_ROWS documents, but two for each core at least, and no more than there are files
    files, rows = listed.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    n = max(1, min(files, max(2 * spark.sparkContext.defaultParallelism, -(-rows // common.FILE_ROWS))))
    dealt = starts.repartitionById(n, F.pmod("part", F.lit(n)).cast("int"))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
