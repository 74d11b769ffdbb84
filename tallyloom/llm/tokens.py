"""Token counts: pieces are counted once per distinct pre-token and summed over documents.

A pre-token is a stretch of text between places that no piece of the vocabulary crosses:
before a run of spaces, and around a line feed.  Merges never pass such a place, so a text's
tokens are the sum of its pre-tokens' tokens.

Documents come in blocks, one Arrow batch each.  For each block a task emits its distinct
pre-tokens, and for each document the positions and frequencies of its own in that list
(packed, not exploded).  All blocks' pre-tokens meet in one shuffle by pre-token, where each
is encoded once; the counts go back to their blocks and are joined to the frequencies there.
No ids are kept, and nothing but counts leaves a task.

The input is read twice, and blocks are named by partition and batch, so it should be a
table or a materialised frame, whose partitions come out alike each time.  Both readings send
a checksum of each block's pre-tokens; blocks that differ raise an error.

Defined results: null and empty texts have no bytes and no tokens; repeated rows are
counted one by one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096

#: A line feed; or a run of spaces (U+2581 is the vocabulary's own sign for one) with what follows it.
PRE_TOKEN = re.compile("\n|[ ▁]+[^\n ▁]*|[^\n ▁]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bits of a place (block, position) for the position, and of a block for the batch.
_POSITION, _BATCH = 28, 15
#: Bits of a position with its count for the count.
_COUNT = 32
#: The position of a block's checksum, which stands among its counts.
_MARK = (1 << _POSITION) - 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    part = TaskContext.get().partitionId()
    for n, batch in enumerate(batches):
        if n >> _BATCH:
            raise ValueError(f"a partition of more than {1 << _BATCH} batches")
        yield (part << _BATCH) + n, batch


def _packed(at: np.ndarray, often: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    """Ascending positions as steps, and frequencies, byte plane by byte plane."""
    both = np.concatenate([np.diff(at, prepend=np.int32(0)), often]).astype("<u4")
    return packer.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes, unpacker: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(unpacker.decompress(raw), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _frequencies(texts: list[str | None]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """The distinct pre-tokens of some texts; for each text, positions in that list and how often."""
    # the encoder puts one space before a text
    place: dict[str, int] = {}
    at: list[np.ndarray] = []
    often: list[np.ndarray] = []
    for text in texts:
        found = [place.setdefault(p, len(place)) for p in PRE_TOKEN.findall(" " + text)] if text else []
        own, n = np.unique(np.array(found, np.int32), return_counts=True)
        at.append(own)
        often.append(n.astype(np.int32))
    return list(place), at, often


def _checksum(tokens: list[str]) -> int:
    """Of a block's distinct pre-tokens in their order; none of them holds what parts them here."""
    return zlib.crc32("\n\n".join(tokens).encode("utf-8", "surrogatepass"))


def _pre_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, batch in _blocks(batches):
        if not batch.num_rows:
            continue
        tokens, _, _ = _frequencies(batch.column("text").to_pylist())
        if len(tokens) >= _MARK:
            raise ValueError(f"a block of {len(tokens)} pre-tokens")
        places = (block << _POSITION) + np.append(np.arange(len(tokens), dtype=np.int64), _MARK)
        tokens.append(str(_checksum(tokens)))
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(places)], ["pre_token", "place"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for block, batch in _blocks(batches):
        if not batch.num_rows:
            continue
        texts = batch.column("text")
        tokens, at, often = _frequencies(texts.to_pylist())
        size = pa.array([len(t.encode()) if t else 0 for t in texts.to_pylist()], pa.int64())
        packed = [_packed(a, b, packer) for a, b in zip(at, often, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), size, pa.array(np.full(len(texts), block, np.int64)), pa.array(np.full(len(texts), _checksum(tokens), np.int64)), pa.array(packed, pa.binary())],
            ["doc_id", "n_bytes", "block", "mark", "packed"],
        )


def _counted(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        feed = len(model.encode("\n"))
        known = ("", 0)
        for batch in batches:  # sorted by pre-token
            tokens = batch.column("pre_token").to_pylist()
            fresh = [t for t, before in zip(tokens, [known[0], *tokens[:-1]], strict=True) if t != before]
            # what has no space before it is encoded behind a line feed, which nothing merges with
            bare = [t[1:] if t[0] in " ▁" else "\n" + t for t in fresh]
            sizes = [len(ids) - (0 if t[0] in " ▁" else feed) for t, ids in zip(fresh, model.encode(bare, num_threads=1), strict=True)]
            # a lone space is the sign alone, which an empty text would not give
            counts = iter([1 if t in (" ", "▁") else n for t, n in zip(fresh, sizes, strict=True)])
            places = batch.column("place").to_numpy()
            out, before, n = [], *known
            for t, mark in zip(tokens, ((places & _MARK) == _MARK).tolist(), strict=True):
                if t != before:
                    before, n = t, next(counts)
                out.append(int(t) if mark else n)
            known = (before, n)
            counted = ((places & ((1 << _POSITION) - 1)) << _COUNT) + np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> _POSITION), pa.array(counted)], ["block", "counted"])

    return count


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    unpacker = zstandard.ZstdDecompressor()
    counted = counts["counted"].to_numpy()
    place, number = counted >> _COUNT, counted & ((1 << _COUNT) - 1)
    marks = {*number[place == _MARK].tolist()}
    if marks != {*documents["mark"].to_pylist()} or len(np.unique(place)) != len(place):
        raise ValueError("the input came out differently when it was read again; write it first")
    pieces = np.zeros(len(counts), np.int64)
    own = place != _MARK
    pieces[place[own]] = number[own]
    totals = []
    for raw in documents["packed"].to_pylist():
        at, often = _unpacked(raw, unpacker)
        totals.append(int(pieces[at] @ often))
    return pa.table({"doc_id": documents["doc_id"], "n_bytes": documents["n_bytes"], "n_tokens": pa.array(totals, pa.int64())})


def token_counts(df: DataFrame, path: str | None = None) -> DataFrame:
    """For each row of ``df`` its ``doc_id``, UTF-8 bytes and tokens of the piece vocabulary at ``path``."""
    spark = df.sparkSession
    docs = df.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    pre_tokens = docs.mapInArrow(_pre_tokens, "pre_token string, place long")
    counts = (
        pre_tokens.repartition(partitions(spark), "pre_token")
        .sortWithinPartitions("pre_token")
        .mapInArrow(_counted(path or vocabulary_path()), "block long, counted long")
    )
    frequencies = docs.mapInArrow(_documents, f"doc_id {kind}, n_bytes long, block long, mark long, packed binary")
    return (
        frequencies.groupBy("block")
        .cogroup(counts.groupBy("block"))
        .applyInArrow(_summed, f"doc_id {kind}, n_bytes long, n_tokens long")
    )


def op2_pre_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over the limit."""
    counted = token_counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
