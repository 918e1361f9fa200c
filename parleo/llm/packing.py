"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Texts become token ids (each document ends with ``END``), documents longer than
a sequence are cut, and the pieces are dealt evenly into shards of about
``SHARD`` pieces, whatever their ids.  Each shard is packed on ``ISLANDS`` islands, each a
population of packings: a crossover injects well-filled bins of one parent whole
into the other, removes the bins that now hold duplicates, and best-fits the
displaced pieces; a mutation dissolves the emptiest bins.  Between epochs an
island sends its elite to the next one.  The best packing of a shard stays; the
pieces of its loose bins (under ``FULL``) of many shards are packed again together.

Defined results: null and empty texts are one piece that holds only ``END``;
repeated rows are packed like any others; null ids stay null; an empty table
gives no pieces; other columns are ignored.
"""
from __future__ import annotations

import bisect
import json
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parleo.llm.common import give_back, id_text, lean, shared_table

SEQUENCE = 4096
END = 1
SHARD = 1200
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CHILDREN = 12
FULL = 0.995
MERGE = 32
#: Chunks whose ids a worker keeps in each generation.
CACHE = 250_000
#: Bytes of text that are cut into chunks at once.
UNIT = 1 << 23
#: Runs of these after a letter are tokens of their own.
PUNCTUATION = b".,*%#&$!?;:"
#: Bytes of the letters A to Z and U+00C0 to U+00FF.
_LATIN = bytes([*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)])
#: A tokenizer of these steps gives a run of Latin letters, in lower case, to its model as one word, byte by byte.
_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: How the byte-level step writes bytes: printable ones as themselves, the others as the characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LEVEL = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}


class _Words:
    """Ids of white-space separated chunks: the tokenizer drops white space, so a text's ids are those of its chunks.

    Arrow cuts texts into chunks and numbers the distinct ones; each of these is
    looked up once a call, and numpy lays out their ids.  Two generations of
    chunks are kept: when the young one is full it becomes the old one, and what
    is met again moves on.  Chunks of Latin letters go straight to the
    tokenizer's model where its other steps are those of ``_STEPS``.
    """

    def __init__(self):
        self.path, self.tokenizer, self.model, self.four, self.ids, self.old, self.marks = None, None, None, [], {}, {}, {}

    def forget(self) -> None:
        """Drop all that is kept of texts."""
        self.path, self.ids, self.old, self.marks = None, {}, {}, {}

    def _open(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start threads for all
        from tokenizers import Tokenizer
        self.path, self.tokenizer, self.ids, self.old, self.marks = path, Tokenizer.from_file(path), {b"": b""}, {}, {b"": b""}
        steps = tuple(json.loads(x.__getstate__()) if x else None for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        added = any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model if steps == _STEPS and not added else None
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]

    @staticmethod
    def _core(w: bytes) -> tuple[bytes, bytes]:
        """A chunk and the punctuation after its last letter: the tokenizer splits there, and it folds ASCII case."""
        core = w.rstrip(PUNCTUATION)
        last = core[-4:].decode("utf-8", "ignore")[-1:]
        if len(core) == len(w) or not (last.isalpha() and len(last.lower()) == 1):
            core = w
        return core.lower() if core.isalpha() else core, w[len(core):]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    @staticmethod
    def _latin(core: bytes) -> bytes | None:
        """A chunk of Latin letters in lower case; None for any other."""
        if core.isalpha():
            return core.lower()
        if not core or core.translate(None, _LATIN):
            return None
        text = core.decode("utf-8", "replace")
        return text.lower().encode() if text.isalpha() else None

    def _add(self, new: list[bytes]) -> None:
        """Ids of chunks that are in neither generation."""
        ids, old, four, parts = self.ids, self.old, self.four, {}
        for w in new:
            core = w.rstrip(PUNCTUATION)
            marks = w[len(core):]
            core = self._latin(core) if self.model else None
            if core is None:
                parts[w] = self._core(w)
                continue
            got = ids.get(core) or old.get(core)
            if got is None:
                word = core.decode("latin-1")
                got = ids[core] = b"".join([four[t.id] for t in self.model.tokenize(word if core.isascii() else word.translate(_LEVEL))])
            if marks and marks not in self.marks:
                self.marks[marks] = self._encode([marks])[0]
            ids[w] = got + self.marks[marks]
        known = {x: ids.get(x) or old.get(x) for x, _ in parts.values()}
        cores = [x for x, v in known.items() if v is None]
        for i in range(0, len(cores), 5000):
            known.update(zip(cores[i:i + 5000], self._encode(cores[i:i + 5000])))
        marks = list({m for _, m in parts.values()}.difference(self.marks))
        self.marks.update(zip(marks, self._encode(marks)))
        ids.update((w, known[x] + self.marks[m]) for w, (x, m) in parts.items())

    def encode(self, path: str, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.path != path:
            self._open(path)
        if len(self.ids) > CACHE:
            self.ids, self.old = {b"": b""}, self.ids
        if len(self.marks) > 1000:
            self.marks = {b"": b""}
        # only bytes are compared, so that texts need not be valid UTF-8
        chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        flat = chunks.flatten().view(pa.large_binary()).dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w, v in zip(words, map(self.ids.get, words)) if v is None]
        again = [(w, v) for w, v in zip(new, map(self.old.get, new)) if v is not None]
        self.ids.update(again)
        self._add([w for w in new if w not in self.ids] if again else new)
        ids = [self.ids[w] for w in words]
        size = np.fromiter(map(len, ids), "int64", len(ids)) // 4
        at = flat.indices.to_numpy()
        n = size[at]
        end = np.cumsum(n)
        source = np.repeat((np.cumsum(size) - size)[at] - end + n, n)
        source += np.arange(len(source))
        out = np.frombuffer(b"".join(ids), "<u4")[source].tobytes()
        bounds = (4 * np.concatenate([[0], end])[chunks.offsets.to_numpy()]).tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]


_words = _Words()
_END_BYTES = np.array([END], dtype="<u4").tobytes()

PIECES = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of every document; ids travel as text, so that null ids do not change the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            texts = list(b["text"])
            at = 0
            while at < len(texts):
                held, n = at, 0
                while at < len(texts) and (at == held or n < UNIT):
                    n += len(texts[at])
                    at += 1
                for doc_id, raw in zip(b["doc_id"][held:at], _words.encode(tokenizer, texts[held:at])):
                    raw += _END_BYTES
                    for k, a in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[a:a + 4 * size]
                        out.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
                give_back()  # what cutting took, before the next texts
            got = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            got["doc_id"] = got["doc_id"].astype("object")
            yield got
        _words.forget()  # a task has its own copy

    return id_text(docs).withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(lean(run), PIECES)


Bins = list[list[int]]


def best_fit(items: list[int], size: list[int], bins: Bins, capacity: int) -> Bins:
    """Put each item into the fullest bin that still takes it."""
    free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(free, (size[i], -1))
        if at == len(free):
            k, left = len(bins), capacity
            bins.append([])
        else:
            left, k = free.pop(at)
        bins[k].append(i)
        if left > size[i]:
            bisect.insort(free, (left - size[i], k))
    return bins


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the sum of squared fills."""
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(one: Bins, other: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``other`` whole, drop what they duplicate, best-fit the displaced items."""
    good = sorted(other, key=lambda b: -sum(size[i] for i in b))[:max(1, len(other) // 2)]
    injected = [list(b) for b in good if rng.random() < 0.5] or [list(good[0])]
    inside = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in one:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    displaced.sort(key=lambda i: (-size[i], i))
    return best_fit(displaced, size, injected + kept, capacity)


def mutate(bins: Bins, size: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few others, and best-fit their items."""
    order = sorted(range(len(bins)), key=lambda k: sum(size[i] for i in bins[k]))
    n = max(1, len(bins) // 50)
    gone = {*order[:n], *rng.sample(range(len(bins)), min(len(bins), n))}
    items = [i for k in gone for i in bins[k]]
    items.sort(key=lambda i: (-size[i] * rng.uniform(0.9, 1.0), i))
    return best_fit(items, size, [list(b) for k, b in enumerate(bins) if k not in gone], capacity)


def evolve(size: list[int], seeds: list[Bins], capacity: int = SEQUENCE, seed: int = 0, population: int = POPULATION, children: int = CHILDREN) -> Bins:
    """Best packing that an island finds, beginning with the given packings."""
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)
    people = [[list(b) for b in s] for s in seeds]
    spread = 0.0
    while len(people) < population and not any(len(p) <= least for p in people):
        people.append(best_fit(sorted(range(len(size)), key=lambda i: (-size[i] * rng.uniform(1 - spread, 1.0), i)), size, [], capacity))
        spread = 0.2
    rated = sorted(((fitness(p, size, capacity), k, p) for k, p in enumerate(people)), reverse=True)
    for k in range(children):
        if -rated[0][0][0] <= least or len(rated) < 2:
            break
        a, b = rng.sample(rated, 2)
        child = crossover(a[2], b[2], size, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        rated[-1] = max(rated[-1], (fitness(child, size, capacity), len(people) + k, child))
        rated.sort(reverse=True)
    return rated[0][2]


def _of(bin_of: pd.Series) -> Bins:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of):
        out.setdefault(b, []).append(i)
    return list(out.values())


_ITEM = ["doc_id", "piece", "start", "length", "ids_crc32"]
_SHARD = PIECES + ", row_key bigint, shard bigint"


def _assigned(g: pd.DataFrame, bins: Bins) -> pd.DataFrame:
    of = np.zeros(len(g), dtype="int64")
    for k, b in enumerate(bins):
        of[b] = k
    return g.assign(bin=of)


def _island(g: pd.DataFrame) -> pd.DataFrame:
    """One epoch of an island: its own packing and its neighbour's elite are the first members, where there are any."""
    shard, island, epoch = int(g["shard"].iloc[0]), int(g["island"].iloc[0]), int(g["epoch"].iloc[0])
    g = g.sort_values(["migrant", "row_key"], kind="stable")
    own = g[~g["migrant"]]
    seeds = []
    if epoch:
        seeds = [_of(own["bin"]), *([_of(g[g["migrant"]]["bin"])] if g["migrant"].any() else [])]
    return _assigned(own, evolve(own["length"].tolist(), seeds, seed=hash((shard, island, epoch))))


def _best(g: pd.DataFrame) -> pd.DataFrame:
    """The best island of a shard; its loose bins are marked for another round."""
    best, rows = None, None
    for _, own in g.groupby("island"):
        f = fitness(_of(own["bin"]), own["length"].tolist(), SEQUENCE)
        if best is None or f > best:
            best, rows = f, own
    fill = rows.groupby("bin")["length"].transform("sum")
    return rows.assign(loose=fill < FULL * SEQUENCE)


def _placed(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["bin", "row_key"], kind="stable")
    return g.assign(offset=g.groupby("bin")["length"].cumsum() - g["length"])


_ISLAND = _SHARD + ", island int, epoch int, migrant boolean, bin bigint"


def _packed(items: DataFrame, islands: int, epochs: int) -> DataFrame:
    """Pieces with shard -> pieces with bin and ``loose``; every group is one shard."""
    at = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumns(
        {"epoch": F.lit(0), "migrant": F.lit(False), "bin": F.lit(0).cast("bigint")})
    for e in range(epochs):
        if e:
            elite = at.withColumns({"island": (F.col("island") + 1) % islands, "migrant": F.lit(True)})
            at = at.unionByName(elite) if islands > 1 else at
            at = at.withColumn("epoch", F.lit(e))
        at = shared_table(at.groupBy("shard", "island").applyInPandas(_island, _ISLAND))
    return at.groupBy("shard").applyInPandas(_best, _ISLAND + ", loose boolean")


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if size != SEQUENCE:
        raise ValueError(f"sequences hold {SEQUENCE} tokens")
    cut = shared_table(pieces(docs, tokenizer, size))
    n = max(1, round(cut.count() / shard))
    # dealt by place, not by id: repeated ids spread like any others
    key = F.monotonically_increasing_id()
    first = shared_table(_packed(cut.withColumn("row_key", key).withColumn("shard", F.pmod(F.xxhash64("row_key"), F.lit(n))), islands, epochs))
    tight = first.where(~F.col("loose"))
    rest = first.where("loose").select(*_ITEM, "row_key", F.floor(F.col("shard") / MERGE).cast("bigint").alias("shard"))
    again = _packed(rest, islands, epochs)
    both = tight.withColumn("round", F.lit(0)).unionByName(again.withColumn("round", F.lit(1)))
    placed = both.groupBy("round", "shard").applyInPandas(_placed, _ISLAND + ", loose boolean, round int, offset bigint")
    return placed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                         ((F.col("round").cast("bigint") * (1 << 42) + F.col("shard")) * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
