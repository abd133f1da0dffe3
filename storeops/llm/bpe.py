"""Operator 7: byte-level BPE with the tiktoken library and a local file of ranks.

A long text is cut before it is encoded, only where a match of the pattern
must end, so that the parts' ids in a row are the whole text's ids while the
library never holds more than one part. Decoding joins raw bytes; ids that
end within a character lose nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm import arrays as A
from storeops.llm.shared import importable, passed, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters that are encoded at once, about.
PART = 1 << 16
#: Characters of which it is sure what the pattern takes them for: letters, and marks that are neither letters, digits nor white space.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
MARK, WHITE = r"!-&(-/:-@\[-`{-~“”…–—、。〈-】！（），：；？", r" \t\n\r\u3000"
#: A match of the pattern ends after the letters, digits or marks of a run and before anything else. Only an apostrophe may go on with letters.
SAFE = re.compile(rf"(?<=[{LETTER}])(?=[0-9'{MARK}{WHITE}])|(?<=[0-9])(?=[{LETTER}'{MARK}{WHITE}])|(?<=[{MARK}])(?=[{LETTER}0-9{WHITE}])|(?<=')(?=[{WHITE}])")


@lru_cache(maxsize=2)
def encoding(ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """One per worker process and file."""
    with open(ranks, "rb") as file:
        table_ = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


def parts(text: str, most: int = PART) -> Iterator[str]:
    """The text in parts that end at the next place after ``most`` characters where a match of the pattern must end; without such a place, the rest is one part."""
    at = 0
    while len(text) - at > most and (safe := SAFE.search(text, at + most)):
        yield text[at : safe.start()]
        at = safe.start()
    yield text[at:]


def encode_text(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    """The ids as little-endian unsigned 32-bit integers."""
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in parts(text)])


def decode_ids(ids: bytes, enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _encode(ranks: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            column = batch.column(1)
            for at, to, _, _ in A.chunks(column):
                ids = [encode_text(t or "", enc) for t in column.slice(at, to - at).to_pylist()]
                raw = [x.tobytes() for x in ids]
                out = [batch.column(0).slice(at, to - at), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())]
                names = ["id", "n_tokens", "ids"]
                if decoded:
                    out.append(pa.array([decode_ids(x, enc) for x in raw], pa.binary()))
                    names.append("decoded")
                yield pa.record_batch(out, names=names)

    return run


def encode(docs: DataFrame, decoded: bool = False, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (binary: little-endian unsigned 32-bit), and with ``decoded`` their bytes.

    Special tokens are ordinary text. A null text counts as empty and has no
    ids. Rows keep their number, repeated ones too, and ids of any type or
    null pass through; an empty table gives an empty result; other columns
    are not looked at. A very long text is encoded in parts of about PART
    characters; a single match of the pattern, such as letters without end, is
    one part however long. ``ranks`` must lie at that path on every executor.
    """
    importable(docs.sparkSession)
    schema = passed(docs.schema[id_col].dataType, "n_tokens bigint, ids binary" + ", decoded binary" * decoded)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(ranks, decoded), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and ``decoded``, the bytes of its ids; null ids give empty bytes."""
    importable(encoded.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            out = [decode_ids(x or b"", enc) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, passed(encoded.schema[id_col].dataType, "decoded binary")).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of :func:`encode` with ``decoded``."""
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), decoded=True))
