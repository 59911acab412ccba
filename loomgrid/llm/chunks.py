"""Texts as streams of word numbers, in chunks with a dictionary of their own.

A corpus has more different words than a task can hold. So each task numbers the words
of some megabytes of text for itself and writes down one row a chunk: its words, their
counts, and the stream of their numbers. What is known of a word corpus-wide then comes
to the chunks by a join of words, one row for each word and chunk, and nothing that grows
with the corpus is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Bytes of text in a chunk; a longer text is a chunk alone.
CHUNK_BYTES = 16 << 20
#: Bytes of text that are split into words at once.
SPLIT_BYTES = 1 << 20
#: Rows that leave a task at once.
ROWS = 1 << 16
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_UPPER = _LOWER.upper()
#: In a stream: no word. A break between pieces.
BREAK = 0
_CHUNKS = "chunk long, part string, n_words long, words binary, counts binary, stream binary, doc_ids array<long>, marks array<boolean>, sizes array<long>"


class _Numbers(dict):
    """Words by number, from 1 on, in the order in which they are first met; a line feed stands for no word."""

    def __init__(self) -> None:
        super().__init__({b"\n": BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.translate(_WORDS).split()


def pieces(text: bytes) -> list[bytes]:
    r"""Words of the pieces between ``[.,;:!?\x0A-\x0D]``, with a line feed for each such sign; A-Z in lower case."""
    return list(filter(None, text.translate(_PIECES).replace(b"\n", b" \n ").split(b" ")))


_WORDS = bytes.maketrans(_UPPER, _LOWER)
_PIECES = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\x0d\x09", _LOWER + b"\n" * 9 + b" ")


def pack(values: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def _encode(split: Callable[[bytes], list[bytes]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("part", pa.string()), ("n_words", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("stream", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64()))])
        first, made = TaskContext.get().partitionId() << 33, 0
        held: dict[str | None, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            for part, rows in held.items():
                numbers, sizes, stream = _Numbers(), [], []
                for _, _, text in rows:
                    found = split(text)
                    sizes.append(len(found))
                    stream.append(np.fromiter((numbers[w] for w in found), np.uint32, len(found)))
                    stream.append(np.zeros(1, np.uint32))
                flat = np.concatenate(stream)
                del numbers[b"\n"]
                counts = np.bincount(flat, minlength=len(numbers) + 1)[1:].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], type=f.type) for v, f in zip([first + made, part, int(counts.sum()), zstandard.ZstdCompressor(level=1).compress(b"\n".join(numbers)), pack(counts), pack(flat), [r[0] for r in rows], [r[1] for r in rows], sizes], schema)],
                    schema=schema,
                )
                made += 1
            held.clear()
            size = 0

        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            for doc_id, mark, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)), (t.as_py() for t in texts)):
                held.setdefault(part, []).append((doc_id, mark, text or b""))
                size += len(text or b"") + 64
                if size >= CHUNK_BYTES:
                    yield from flush()
        yield from flush()

    return run


def encoded(docs: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """Chunks of ``docs`` (doc_id, mark boolean, part string, text), written down.

    Each chunk holds rows of one ``part``. ``words`` joins its different words by line feeds, ``counts`` has
    how often each occurs, ``stream`` the words' numbers (from 1; 0 where ``split`` gave a line
    feed, and after each text), all packed. ``doc_ids``, ``marks`` and ``sizes``
    (tokens) follow the rows. Null texts are empty ones; an empty table has no chunks.
    """
    rows = docs.select("doc_id", "mark", "part", "text")
    return durable(rows.mapInArrow(_encode(split), _CHUNKS), "chunks")


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, part, packed, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            data, n = zstandard.ZstdDecompressor().decompress(packed), unpack(counts, np.int64)
            found = data.split(b"\n") if len(n) else []
            for at in range(0, len(found), ROWS):
                some = found[at : at + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), chunk)), pa.array([part] * len(some), type=pa.string()), pa.array(np.arange(at + 1, at + 1 + len(some), dtype=np.int32)), pa.array(some, type=pa.binary()), pa.array(n[at : at + len(some)])],
                    names=["chunk", "part", "number", "word", "n"],
                )


def dictionary(chunks: DataFrame) -> DataFrame:
    """``chunk, part, number, word (binary), n`` of every word of every chunk."""
    return chunks.select("chunk", "part", "words", "counts").mapInArrow(_dictionary, "chunk long, part string, number int, word binary, n long")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``id``, from 1 without gaps, and written down: places in written partitions, plus the sizes of those before (one row a partition)."""
    rough = durable(rows.withColumn("at", F.monotonically_increasing_id()), name)
    sizes = rough.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("rows"))
    starts, before = {}, 0
    for r in sizes.orderBy("p").collect():  # a row a partition
        starts[r["p"]] = before
        before += r["rows"]
    if before >= 1 << 31:
        raise ValueError("more than 2^31 words occur often: ids of four bytes don't hold them")
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.shiftright("at", 33)) if starts else F.lit(0)
    return rough.withColumn("id", offset.cast("long") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at")
