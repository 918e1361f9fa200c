"""SimHash near-duplicates by a grid range-join over counts of set bits.

A fingerprint is cut into segments of two bits; the numbers of set bits of its
32 segments are its place in a space where the Manhattan distance never exceeds
the number of differing bits.  Two fingerprints that differ in at most three
bits are therefore at most 3 apart, hence at most 1 apart in one of the two
halves of 16 segments.  Each half is a grid with cells of width one: every
fingerprint stands in its own cell and in the neighbouring cells one step up,
so a pair at distance 0 or 1 in a half meets in a cell, where the differing bits
are counted exactly.  Equal fingerprints are one class before that; copies are
never paired.

Cells are read in sorted order by tasks that keep at most ``CROWD`` members.  A
fuller cell is dealt again instead of compared: of four parts of the bits that
its members do not surely share, one part must be equal within three
differences, so members go to four finer cells, and so on; a cell of ``m`` open
bits holds at most ``2^m`` fingerprints, so this ends.  Fuller cells of at
most ``CROWD`` members send one edge a member, to the root of those it is
linked with, never all pairs.

Defined results: null text and texts without words have fingerprint zero, which
links like any other; a null id is carried and takes the component of its
fingerprint (null where no document of the component has an id); repeated rows
are all returned; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import id_text, map_texts, shared_table
from parleo.llm.components import components
from parleo.plans.skew import attach

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Members of a cell compared with each other in one task.
CROWD = 1024
#: Members of a cell that are compared by shifting the sorted rows.
SMALL = 8
#: Hashes whose bits are counted at once.
BATCH = 1 << 15
#: Tasks over which the documents of one fingerprint, or the fingerprints of one component, are spread when names are joined to them.
SPREAD = 64
ONES = np.uint64(0x5555555555555555)
SEGMENTS = 32
#: Open bits at which a cell cannot hold more than ``CROWD`` fingerprints.
FEW_BITS = 10
ALL_BITS = (1 << 64) - 1


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all word shingles of a text (unsigned)."""
    words = text.lower().split()  # of bytes: only A-Z change, blanks are \x20 and \x09-\x0D
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    for start in range(0, n, BATCH):
        h = np.array([digest(join(words[i:i + size]), SEED) for i in range(start, min(n, start + BATCH))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint): one row per document, texts are not shuffled; fp holds the 64 bits as a signed number."""
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(t, size) for t in f.text], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f.doc_id, "fp": fp})

    return map_texts(id_text(docs, id_col, text_col), task, "doc_id bigint, fp bigint")


def counts(fp: np.ndarray) -> np.ndarray:
    """Set bits of each two-bit segment, in the segment's own two bits."""
    return fp - ((fp >> np.uint64(1)) & ONES)


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """Spread cell names over 64 bits (multiply and fold); equal names stay equal."""
    with np.errstate(over="ignore"):
        out = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            out = (out ^ np.asarray(p, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
        return out


def grid(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row numbers, cell, own) for both halves: the own cell and those one step up in one segment."""
    place = counts(fp)
    every = np.arange(len(fp))
    for half in (0, 1):
        at = (place >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        yield every, _mix(half, at), True
        for s in range(SEGMENTS // 2):
            up = np.flatnonzero((at >> np.uint64(2 * s)) & np.uint64(3) < 2)
            yield up, _mix(half, at[up] + np.uint64(1 << (2 * s))), False


def quarters(open_bits: int, distance: int = DISTANCE) -> list[int]:
    """``distance + 1`` parts of about equally many of the open bits, as masks; bits are dealt in turn."""
    masks = [0] * (distance + 1)
    for n, bit in enumerate(b for b in range(64) if open_bits >> b & 1):
        masks[n % (distance + 1)] |= 1 << bit
    return masks


def _forest(own: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """(member, root) of the components that the links between own members and all members of a cell form."""
    at = np.flatnonzero(own)
    i, j = np.nonzero(np.bitwise_count(fp[at][:, None] ^ fp[None, :]) <= distance)
    i = at[i]
    apart = i != j
    i, j = i[apart], j[apart]
    root = np.arange(len(fp))
    while len(i):
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    for k in np.flatnonzero(root != np.arange(len(fp))).tolist():
        yield int(fp[k]), int(fp[root[k]])


def _small_cells(f: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the given cells of at most ``SMALL`` rows: each row against those up to ``SMALL - 1`` places on."""
    fp, own = f.fp.to_numpy().view(np.uint64), f.own.to_numpy()
    last = np.zeros(len(f), np.int64)  # end of the cell, 0 outside the given cells
    sizes = ends - starts
    inside = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last[inside] = np.repeat(ends, sizes)
    a, b = [], []
    for step in range(1, SMALL):
        at = np.flatnonzero(last > np.arange(len(f)) + step)
        at = at[(own[at] | own[at + step]) & (np.bitwise_count(fp[at] ^ fp[at + step]) <= distance)]
        a.append(fp[at])
        b.append(fp[at + step])
    return np.concatenate(a), np.concatenate(b)


def _read_cells(distance: int, crowd: int):
    """Task over rows sorted by cell: links of cells with few members, finer cells for the members of full ones.

    A full cell is never held: once more than ``crowd`` members have come, they and
    all later ones are dealt on as they are read.
    """
    def found(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"cell": np.int64(0), "fp": a.view(np.int64), "own": True, "open": np.int64(0), "to": b.view(np.int64), "link": True})

    def finer(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp, cell, open_bits = f.fp.to_numpy().view(np.uint64), int(f.cell.to_numpy().view(np.uint64)[0]), int(f.open.to_numpy().view(np.uint64)[0])
        for mask in quarters(open_bits):
            left = np.full(len(f), open_bits & ~mask, dtype=np.uint64)
            yield pd.DataFrame({"cell": _mix(cell, mask, fp & np.uint64(mask)).view(np.int64), "fp": f.fp.to_numpy(), "own": f.own.to_numpy(), "open": left.view(np.int64), "to": np.int64(0), "link": False})

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        cell, n, full = None, 0, False

        def close() -> Iterator[pd.DataFrame]:
            if n > 1 and not full:
                f = pd.concat(held)
                links = list(_forest(f.own.to_numpy(), f.fp.to_numpy().view(np.uint64), distance))
                if links:
                    yield found(*(np.array(c, dtype=np.uint64) for c in zip(*links)))

        for f in frames:
            cells = f.cell.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            ends = np.append(starts[1:], len(cells))
            small = ends - starts <= SMALL
            small[[0, -1]] = False  # the first and last cell may go on in other frames
            if small.any():
                a, b = _small_cells(f, starts[small], ends[small], distance)
                if len(a):
                    yield found(a, b)
            for s, e in zip(starts[~small].tolist(), ends[~small].tolist()):
                part = f.iloc[s:e]
                if cell != cells[s]:
                    yield from close()
                    held, n, full, cell = [], 0, False, cells[s]
                n += e - s
                if n > crowd and (int(part.open.iloc[0]) & ALL_BITS).bit_count() > FEW_BITS or full:
                    for p in [*held, part]:
                        yield from finer(p)
                    held, full = [], True
                else:
                    held.append(part)
        yield from close()

    return task


ROWS = "cell bigint, fp bigint, own boolean, open bigint, to bigint, link boolean"


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints of ``fps`` just as all pairs with at most ``distance`` differing bits would;
    an edge may stand for a chain of such pairs.

    The grid serves distances up to 3 (one step in one of two halves).
    """
    if not 0 <= distance <= 3:
        raise ValueError("the grid is built for distances of 0 to 3 bits")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f.fp.to_numpy()
            for at, cell, own in grid(fp.view(np.uint64)):
                yield pd.DataFrame({"cell": cell.view(np.int64), "fp": fp[at], "own": own, "open": np.int64(-1)})

    cells = fps.select("fp").mapInPandas(place, "cell bigint, fp bigint, own boolean, open bigint")
    found = None
    while True:
        read = shared_table(cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(_read_cells(distance, crowd), ROWS))
        new = read.where("link").select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct()
        found = new if found is None else found.unionByName(new)
        cells = read.where("not link").select("cell", "fp", "own", "open")
        if cells.isEmpty():
            return found.distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every document; see the module's text for odd rows."""
    prints = shared_table(fingerprints(docs, id_col, text_col, size))
    classes = shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    below = components(links(classes, distance, crowd))  # every node but the roots
    nodes = below.unionByName(below.select(F.col("component").alias("node"), "component").distinct())
    joined = shared_table(nodes.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(SPREAD))))
    # only linked fingerprints have a component of their own; its name is the smallest id, which may belong to any of them
    least = joined.join(classes, joined.node == classes.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    named = attach(joined, least, ["component"], "chunk").select(F.col("node").alias("fp"), "component_id")
    per_print = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = attach(prints.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))), per_print, ["fp"], "chunk")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
