"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to every worker; tier two is
the cache each worker fills by calling the tokenizers library for pre-tokens it meets for the first time. Every
document is counted where it is read: the plan has no exchange of pre-tokens or of texts.

Null text counts as empty (0 tokens); an empty table gives no rows; repeated rows are counted each; very long
texts are counted whole; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common, tokens

#: Rows that seed the table of frequent pre-tokens, their size, and the table's. The table is a cache that is filled beforehand:
#: which rows seed it changes how often a worker calls the library, never a count.
SEED_ROWS, SEED_BYTES, TABLE_PIECES = 1024, 1 << 16, 20_000
#: Pre-tokens of more tokens than this are left to tier two, so that a length takes one byte.
LONGEST = 255


def frequent(docs: DataFrame, seed_rows: int = SEED_ROWS, table_pieces: int = TABLE_PIECES) -> list[str]:
    """The most frequent pre-tokens of a few rows, which Spark takes from as few files as hold them."""

    seen: Counter[str] = Counter()
    for r in docs.select("text").where(F.octet_length("text") <= SEED_BYTES).take(seed_rows):
        seen.update(p for p in tokens.pieces(r.text)[1:] if len(p) <= tokens.CACHE_CHARS and " " not in p)
    return [p for p, n in seen.most_common(table_pieces) if n > 1]


def compact(pieces: list[str], path: str) -> tuple[str, bytes]:
    """The table as one string of pre-tokens with spaces between, and one byte for each one's length."""
    t = tokens.load(path)
    sizes = [len(e.ids) for e in t.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)] if pieces else []
    kept = [(p, n) for p, n in zip(pieces, sizes) if n <= LONGEST and p]
    return " ".join(p for p, _ in kept), bytes(n for _, n in kept)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every document."""
    docs = common.id_text(docs)
    table = docs.sparkSession.sparkContext.broadcast(compact(frequent(docs), path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, sizes = table.value
        known = dict(zip(blob.split(" "), sizes)) if sizes else {}
        encode = tokens.PieceEncoder(path, tokens.as_length, sum, known, key=f"{hash(blob)}")
        for b in batches:
            found = encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
