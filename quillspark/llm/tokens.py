"""The whole corpus as ids of a public byte-level BPE tokenizer.

A sentencepiece BPE model is serialised directly from the tokenizer's rank file: one piece per token, its
bytes mapped to printable characters, its score the negative rank, identity normalisation. Merging the
neighbours whose union scores highest is then exactly merging by rank. Texts are cut into pre-tokens by the
tokenizer's pattern; decoding maps pieces back to bytes. The model (about 1 MB whatever the corpus) goes to
the tasks inside the function; nothing else does.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER_FOLDER = "/opt/tokenizers"
#: The pre-token pattern of the byte_bpe_50k tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept with their ids by a task; when full, the memory is emptied. It changes speed only.
REMEMBERED = 200_000
#: Texts encoded together; bounds a task's memory only.
_TEXTS_AT_ONCE = 500
_LONGEST_REMEMBERED = 48


def byte_letters() -> str:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a .tiktoken rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model of a rank table whose ids run from 0 without gap."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    letters = byte_letters()
    model = proto.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    trainer, normal = model.trainer_spec, model.normalizer_spec
    trainer.model_type = proto.TrainerSpec.BPE
    trainer.vocab_size = len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(ranks), -1, -1, -1
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor()
        self.processor.LoadFromSerializedProto(model)
        self.split = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = {letter: byte for byte, letter in self.letters.items()}
        self.known: dict[str, bytes] = {}

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, one after the other. Null and empty texts have no ids. Pre-tokens
        not met before are encoded in one call; ids are kept as packed integers and joined as bytes."""
        pieces = [self.split(t) if t else [] for t in texts]
        known = self.known
        new = list({p for ps in pieces for p in ps if p not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known = self.known = {p: known[p] for ps in pieces for p in ps if p in known}
            found = self.processor.encode([p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for p in new], num_threads=1)
            known.update((p, np.array(ids, dtype=np.int32).tobytes()) for p, ids in zip(new, found))
        packed = [b"".join(map(known.__getitem__, ps)) for ps in pieces]
        for p in new:
            if len(p) > _LONGEST_REMEMBERED:
                del known[p]
        offsets = np.zeros(len(packed) + 1, dtype=np.int32)
        np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
        return offsets, np.frombuffer(b"".join(packed), dtype=np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[1].tolist()

    def decode(self, ids: list[int]) -> str:
        letters = "".join(self.processor.IdToPiece(int(i)) for i in ids)
        return bytes(self.bytes[c] for c in letters).decode("utf-8", "surrogatepass")


def default_model(folder: str = TOKENIZER_FOLDER, name: str = "byte_bpe_50k") -> bytes:
    return piece_model(read_ranks(f"{folder}/{name}.tiktoken"))


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: bytes | None = None) -> DataFrame:
    """documents -> id_column, ids (array<int>), one row per row of documents, in one pass without shuffle.

    Defined cases: null and empty texts have an empty list; blank texts are encoded like any other;
    strings that look like special tokens are ordinary text; texts of any length are encoded whole;
    repeated rows stay repeated; a null id stays null; other columns are ignored.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for part in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                own = batch.slice(part, _TEXTS_AT_ONCE)
                offsets, flat = codec.encode_many(own.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_column, "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", model: bytes | None = None) -> DataFrame:
    """The inverse: id_column, text. Null and empty lists give the empty text."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, text string")


def token_counts(documents: DataFrame, columns: list[str], text: Column, folder: str = TOKENIZER_FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """columns and ``tokens``, the length of each text in ids; null and empty texts have 0. The ids are
    those of encode_corpus; here they are only counted, by the tokenizer library itself, which is faster."""
    ranks = read_ranks(f"{folder}/{name}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sizes = pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*columns, "tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)
    return documents.select(*columns, text.alias("_text")).mapInArrow(run, f"{kinds}, tokens bigint")
