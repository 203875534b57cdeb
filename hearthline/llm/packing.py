"""Token pieces of documents, packed into sequences of a fixed length by the sum-of-squares rule."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .store import col

BLOCK_DOCS = 100_000  # documents that one task packs together
END = "<|endoftext|>"
PLAIN_CHARS = 0x2070  # texts of alphabetic scripts and common marks
BROKEN = 2_000  # a longer run of white space goes to the slower library


class Encoder:
    """Ids as `tokenizers` gives them with add_special_tokens=False, as unsigned 32-bit numbers.

    Texts below U+2070 go through the same vocabulary in `tiktoken`, which is about four times as fast; the tests hold
    both against each other. Other texts, and those with the end marker or very long white space, go to `tokenizers`.
    """

    def __init__(self, name: str):
        import public_tokenizers as P
        import tiktoken

        self.name, self.slow = name, None
        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})

    def exact(self, text: str) -> np.ndarray:
        if self.slow is None:
            import public_tokenizers as P
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(P.path(f"{self.name}.json"))
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        plain = text.isascii() or max(text) < chr(PLAIN_CHARS)
        if plain and END not in text and " " * BROKEN not in text and "\n" * BROKEN not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return self.exact(text)


def cut(n: int, limit: int) -> list[int]:
    """Where the pieces of n tokens begin, and n: only the first may be shorter than `limit`."""
    head = n % limit or limit
    return [0, *range(head, n, limit), n]


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its token ids, then `end_id`; a null text is an empty one. Documents of more than `limit` tokens are
    cut so that only the first piece may be shorter. No shuffle. Null ids and repeated rows are kept as they are.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            own, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, x in enumerate(batch.column("text")):
                ids = np.append(encode(x.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = cut(len(ids), limit)
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    own.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        parts.append(ids[a:b].astype(np.int32))
            columns = {"doc_id": batch.column("doc_id").take(pa.array(own, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(parts, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(pieces, schema + ", ids array<int>" * with_ids)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given.

    Each goes to the open bin that fits and after which the sum over all residual gaps of the squared number of open
    bins with that gap is smallest (ties: the fuller bin); a bin is opened only where none fits. Full bins are closed.
    """
    count = np.zeros(limit + 1)  # open bins by fill
    count[limit] = -0.5  # closing a bin adds no square: 2 * -0.5 + 1 = 0
    waiting: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        room, fill, where = limit - size, 0, -1
        if room > 0:
            now = count[1 : room + 1]
            change = 2 * count[size + 1 :] - 2 * now
            change[now <= 0] = np.inf
            k = room - 1 - int(np.argmin(change[::-1]))
            if change[k] < np.inf:
                fill = k + 1
                count[fill] -= 1
                where = waiting[fill].pop()
        if where < 0:
            where, opened = opened, opened + 1
        bins[i], offsets[i] = where, fill
        if fill + size < limit:
            count[fill + size] += 1
            waiting[fill + size].append(where)
    return bins, offsets


def pack_pieces(pieces: DataFrame, blocks: int, limit: int = 1024) -> DataFrame:
    """`pieces` (doc_id, piece, length, ids_crc32 and any others) with sequence_id and offset, in sequences of up to `limit`.

    Rows are dealt evenly over `blocks` tasks, whatever their documents or sources, and each packs its own from the
    longest down; whole pieces of `limit` pass straight through. The result does not depend on the order in which rows arrive, so a
    task that runs again places all of its rows as before. Lengths must be 1 to `limit`. An empty table gives none.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, full, waiting = TaskContext.get().partitionId() << 40, 0, []

        def placed(table, sequence, offset):
            return table.append_column("sequence_id", pa.array(base + sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

        for batch in batches:
            whole = np.asarray(batch.column("length")) == limit
            if whole.any():
                yield from placed(pa.Table.from_batches([batch.filter(pa.array(whole))]), (1 << 39) + full + np.arange(whole.sum()), np.zeros(whole.sum())).to_batches()
                full += int(whole.sum())
            if not whole.all():
                waiting.append(batch.filter(pa.array(~whole)))
        if waiting:
            rest = pa.Table.from_batches(waiting)
            rest = rest.take(pc.sort_indices(rest, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
            yield from placed(rest, *sum_of_squares(np.asarray(rest["length"]), limit)).to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(blocks).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, tokenizer: str = "byte_bpe_50k", end_id: int = 2, with_ids: bool = False, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Pieces of all documents with their place. The number of blocks follows the number of documents, so that a task never packs more than about `block_docs` of them."""
    blocks = max(1, -(-docs.select(col(doc_id)).count() // block_docs))
    return pack_pieces(token_pieces(docs, doc_id, text, limit, tokenizer, end_id, with_ids), blocks, limit)
