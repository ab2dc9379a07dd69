"""Packing token pieces into sequences: best fit, then swap-based local search.

Only documents longer than a sequence are cut, into whole sequences and one shorter last piece. The remaining pieces
are dealt by a hash into shards of a bounded number of pieces; each shard is packed by best fit of falling length, and
a local search then exchanges one piece for one, two for one, or moves a piece between underfull bins, always raising
the sum of squared fills, until bins empty. Bins that stay underfull are opened again and their pieces go to the next
round's shards, so that the waste is a few bins in all and not a few bins per shard. The number of rounds is fixed;
shards of the last round keep their bins as they are.

Defined results: a null or empty text is a document of one token (its end mark). Equal lengths are ordered by document
and piece, so the packing is the same on each run. Repeated document ids are packed as separate pieces. A null id keeps
its place too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.bpe import load
from rangeloom.llm.common import written

#: Tokens of a sequence, the id that ends each document, pieces in a shard (a task's memory), and rounds.
LENGTH, END, SHARD, ROUNDS = 4096, 1, 20_000, 4
#: Bins filled to this share are closed between rounds.
CLOSED = 0.995


def document_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece. Only numbers leave the worker."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, mark = load(path), int(end).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text) + mark
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into sizes (falling): each goes where it leaves the least room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for k, s in enumerate(sizes.tolist()):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if left > s:
            insort(room, (left - s, b))
    return bins


def swap_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the least filled bins by moves and exchanges into fuller underfull ones; each step raises squared fill."""
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    under = sorted((b for b in range(len(bins)) if fill[b] < capacity), key=lambda b: (fill[b], b))
    for a in under:
        fuller = [b for b in under if b != a and bins[b]]
        if not bins[a] or sum(capacity - fill[b] for b in fuller) < fill[a]:
            continue  # the others lack the room to take it all
        moved = True
        while moved and bins[a]:
            moved = False
            fuller = sorted((b for b in under if b != a and bins[b] and fill[a] <= fill[b] < capacity), key=lambda b: (-fill[b], b))
            for b in fuller:
                step = _best_step(bins[a], bins[b], size, capacity - fill[b])
                if step:
                    out, back = step
                    for i in out:
                        bins[a].remove(i)
                    if back is not None:
                        bins[b].remove(back)
                        bins[a].append(back)
                    bins[b] += out
                    gain = sum(size[i] for i in out) - (size[back] if back is not None else 0)
                    fill[a], fill[b], moved = fill[a] - gain, fill[b] + gain, True
                    if not bins[a]:
                        break
    return [b for b in bins if b]


def _best_step(own: list[int], other: list[int], size: list[int], room: int) -> tuple[list[int], int | None] | None:
    """The move, one-for-one or two-for-one exchange that fills the other bin most, if any fills it further."""
    best, found = 0, None
    for i in own:
        if best < size[i] <= room:
            best, found = size[i], ([i], None)
    mine = sorted(own, key=lambda i: size[i])
    lengths = [size[i] for i in mine]
    for j in other:
        most = room + size[j]
        k = bisect_right(lengths, most) - 1
        if k >= 0 and best < lengths[k] - size[j]:
            best, found = lengths[k] - size[j], ([mine[k]], j)
        for x in range(len(mine) - 1):
            y = bisect_right(lengths, most - lengths[x]) - 1
            if y > x and best < lengths[x] + lengths[y] - size[j]:
                best, found = lengths[x] + lengths[y] - size[j], ([mine[x], mine[y]], j)
        if best == room:
            break
    return found


def pack(sizes: np.ndarray, capacity: int = LENGTH) -> list[list[int]]:
    """Bins of indices into sizes, which must fall."""
    return swap_search(best_fit(sizes, capacity), sizes, capacity)


def _pack_shard(last: bool, level: int, capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True], ignore_index=True)
        sizes = rows["length"].to_numpy()
        sequence, offset, closed = (np.zeros(len(rows), t) for t in ("int64", "int64", "bool"))
        base = (level << 58) + (int(rows["shard"].iloc[0]) << 20) if len(rows) else 0
        for b, members in enumerate(pack(sizes, capacity)):
            members.sort()
            sequence[members] = base + b
            offset[members] = np.cumsum([0, *sizes[members][:-1]])
            closed[members] = last or sizes[members].sum() >= CLOSED * capacity
        return rows.drop(columns="shard").assign(sequence_id=sequence, offset=offset, closed=closed)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = LENGTH, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    pieces = written(pieces)
    whole = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    done, rest = [whole], pieces.filter(F.col("length") < capacity)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, closed boolean"
    for level in range(1, rounds + 1):
        n = rest.count()
        shards = max(1, -(-n // shard))
        last = shards == 1 or level == rounds
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(level)), F.lit(shards)))
        packed = dealt.groupBy("shard").applyInPandas(_pack_shard(last, level, capacity), schema)
        if last:
            done.append(packed.drop("closed"))
            break
        packed = written(packed)
        done.append(packed.filter("closed").drop("closed"))
        rest = packed.filter("NOT closed").select(*pieces.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, shard: int = SHARD) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack_pieces(document_pieces(docs, path, length, end), length, shard)
