"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte becomes one printable character and every ranked byte string one piece whose score is its negative
rank, so sentencepiece merges the pair of least rank first, as byte-level BPE does. Normalisation is the identity,
no space is added or escaped, and each match of the pre-token pattern is encoded by itself. Decoding is the
inverse mapping from ids to byte strings.

Null text counts as empty (no ids); an empty table gives no rows; repeated rows are encoded each; very long texts
are encoded whole; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import common, tokens


def byte_characters() -> list[str]:
    """A visible character for every byte: itself if printable Latin-1, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, f)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks must run from 0 without gaps")
    return [ranked[i] for i in range(len(ranked))]


def serialise(ranked: list[bytes]) -> bytes:
    """A sentencepiece BPE model with a piece for every ranked byte string; its id is the rank plus one."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    unknown = model.pieces.add(piece="<unk>", score=0.0)
    unknown.type = pb.ModelProto.SentencePiece.UNKNOWN
    for rank, word in enumerate(ranked):
        model.pieces.add(piece="".join(chars[b] for b in word), score=-float(rank))
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 0, -1, -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class ByteBPE:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.words = read_ranks(path)
        self.whole = {w: i for i, w in enumerate(self.words)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.words))
        self.pattern = regex.compile(pattern)
        chars = byte_characters()
        self.mapped = {b: c for b, c in enumerate(chars)}
        self.decimal = [str(i) for i in range(len(self.words))]
        self.head: dict[str, array] = {}
        self.tail: dict[str, array] = {}

    def _ids(self, texts: list[str]) -> list[array]:
        """Ids of each text, every match of the pattern by itself."""
        cut = [[m.encode() for m in self.pattern.findall(t)] for t in texts]
        new = list({m for c in cut for m in c if m not in self.whole})
        coded = self.model.encode([m.decode("latin-1").translate(self.mapped) for m in new], num_threads=1) if new else []
        ids = {m: [i - 1 for i in found] for m, found in zip(new, coded)}
        # a match that is a ranked byte string is its own id, even if no chain of merges reaches it
        return [array("I", chain.from_iterable([self.whole[m]] if m in self.whole else ids[m] for m in c)) for c in cut]

    def encode(self, texts: list[str]) -> list[array]:
        """Ids of each text; the pieces of tokens.pieces() end where matches of the pattern end."""
        if len(self.head) + len(self.tail) > tokens.CACHE_PIECES:
            self.head.clear()
            self.tail.clear()
        cut = [tokens.pieces(t) for t in texts]
        tails: set[str] = set()
        for c in cut:
            tails.update(c[1:])
        heads = [p for p in {c[0] for c in cut} if p not in self.head]
        self.head.update(zip(heads, self._ids(heads)))
        new = [p for p in tails if p not in self.tail]
        self.tail.update(zip(new, self._ids([" " + p for p in new])))
        out = [array("I", b"".join([self.head[c[0]], *map(self.tail.__getitem__, c[1:])])) for c in cut]
        for p in heads:
            if len(p) > tokens.CACHE_CHARS:
                del self.head[p]
        for p in new:
            if len(p) > tokens.CACHE_CHARS:
                del self.tail[p]
        return out

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


_made: dict[tuple[str, str], ByteBPE] = {}
common.cached_by("byte_bpe", _made.clear)


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of this worker, made once."""
    common.enter("byte_bpe")
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(path, pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            ids = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([list(i) for i in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and content (binary) of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(i or []) for i in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids with spaces between) and decoded_sha256 (of the bytes the ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids = bpe.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([sha(" ".join(map(bpe.decimal.__getitem__, i)).encode()) for i in ids]),
                    pa.array([sha(bpe.decode(i)) for i in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
