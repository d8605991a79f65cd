"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Documents become token ids inside the task that reads them; only lengths and checksums leave it. Pieces are dealt
by hash to shards of about ``SHARD`` pieces. A shard is solved by ``ISLANDS`` islands, each a task of its own with
its own population of packings. Crossover takes whole well-filled bins of one parent, removes the bins of the
other that hold one of their documents, and puts the displaced documents back by best fit, longest first. After
each epoch the elite of every island moves to the next island of its shard: populations travel as rows, one small
table per epoch, so a lost executor costs one epoch at most. The best packing of a shard's islands is its result.

Defined results: a null text counts as empty; every document ends with one end token, so an empty one has length
1; a document longer than a sequence is cut into full pieces, the first of which may be shorter; repeated rows are
packed as separate documents; an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from haulscope.llm.common import by_bytes, flat_bytes, hash_spans, table
from haulscope.session import stage

CAPACITY = 1024
END = 2
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 8
POPULATION = 5

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
LATIN = 0x250  # below this all Unicode versions agree on what is a letter, a digit or white space


class Words:
    """Token ids of texts, a slice of documents at a time.

    In this vocabulary a space starts a token and never ends one, so a text whose words are single-spaced is
    encoded word by word: each different word of the slice once, all in one call, and ids are put together from
    there. Words beyond Latin letters, texts with other spacing and those that hold a special token go to the
    tokenizer as they are.
    """

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        # the same vocabulary and merges in a library that is faster on long lists of words
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.width = np.zeros(max(merges.values()) + 1, np.int64)
        for token, rank in merges.items():
            self.width[rank] = len(token)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _odd_rows(self, column: pa.Array, data: np.ndarray, at: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Rows that cannot be taken word by word."""
        odd = np.zeros(len(at) - 1, bool)
        for s in self.special:
            odd |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        # a space beside another white space, or at an end of the text
        white = np.zeros(256, bool)
        white[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
        end = np.zeros(len(data) + 1, bool)
        end[at] = True
        before, after = np.maximum(space - 1, 0), np.minimum(space + 1, len(data) - 1)
        bad = end[space] | end[space + 1] | white[data[before]] | white[data[after]]
        odd[np.searchsorted(at, space[bad], side="right") - 1] = True
        return odd

    def _encoded(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end): ids of the words data[start:stop], each after the space before it, and where those of
        a word are; -1 for a word that cannot stand alone."""
        # a word with a byte from which LATIN or a wider white space may follow is taken by itself
        rare = np.concatenate([[0], np.cumsum((data >= 0xC9) | (data == 0xC2))])
        alone = rare[stop] > rare[start]
        many = np.flatnonzero(~alone)
        length = stop[many] - start[many] + 1
        ends = np.cumsum(length)
        at = np.repeat(start[many] - 1 - (ends - length), length) + np.arange(int(length.sum()))
        ids = np.array(self.fast.encode_ordinary(data[at].tobytes().decode()), np.uint32)
        cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        begin, end = np.full(len(start), -1, np.int64), np.full(len(start), -1, np.int64)
        begin[many], end[many] = np.concatenate([[0], cuts[:-1]]), cuts
        more, n = [ids], len(ids)
        for i in np.flatnonzero(alone):
            w = data[start[i] : stop[i]].tobytes().decode()
            if not w[0].isspace() and not w[-1].isspace():
                more.append(self.whole(" " + w))
                begin[i], n = n, n + len(more[-1])
                end[i] = n
        return np.concatenate(more), begin, end

    def ids(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` after it; where those of each text start)."""
        data, at = flat_bytes(column)
        rows = len(at) - 1
        space = np.flatnonzero(data == 0x20)
        odd = self._odd_rows(column, data, at, space) if len(data) else np.zeros(rows, bool)
        owner = np.searchsorted(at, space, side="right") - 1
        good = ~odd[owner]
        space, owner = space[good], owner[good]
        # words that follow a space reach to the next one or to the text's end
        follow = np.append(space[1:], len(data))
        stop = np.minimum(follow, at[owner + 1])
        texts_ = column.to_pylist()
        parts: list[np.ndarray] = []
        if len(space):
            _, one, which = np.unique(hash_spans(data, space + 1, stop), return_index=True, return_inverse=True)
            ids, begin, finish = self._encoded(data, space[one] + 1, stop[one])
            odd[owner[begin[which] < 0]] = True
            keep = ~odd[owner]
            which, owner = which[keep], owner[keep]
            counts = (finish - begin)[which]
            source = np.repeat(begin[which] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            flat = ids[source]
            bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(owner, np.arange(rows + 1))]
        else:
            flat, bounds = np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        last = np.array([end], np.uint32)
        for r in range(rows):
            text = texts_[r] or ""
            if odd[r]:
                parts.append(self.whole(text))
            else:
                first = text.split(" ", 1)[0]
                latin = first.isascii() or ord(max(first)) < LATIN
                parts.append(np.array(self.fast.encode_ordinary(first), np.uint32) if latin else self.whole(first))
                parts.append(flat[bounds[r] : bounds[r + 1]])
            parts.append(last)
        sizes = np.array([len(p) for p in parts])
        where = np.cumsum([0] + [2 if o else 3 for o in odd])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])[where]


@lru_cache(maxsize=2)
def words(path: str, ranks: str) -> Words:
    """One per Python worker."""
    return Words(path, ranks)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first."""
    low, high = 0, n % capacity or capacity
    while low < n:
        yield low, min(high, n) - low
        low, high = high, high + capacity


def _pieces(batches: Iterator[pa.RecordBatch], path: str, ranks: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    coder = words(path, ranks)
    for batch in batches:
        for part in by_bytes(batch, "text", 3 << 20):
            ids, at = coder.ids(part.column("text"), end)
            raw = memoryview(ids.astype("<u4").tobytes())
            out: list[tuple] = []
            for doc, low, high in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                for k, (start_, length) in enumerate(cut(high - low, capacity)):
                    out.append((doc, k, start_, length, zlib.crc32(raw[4 * (low + start_) : 4 * (low + start_ + length)])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


Bins = list[list[int]]
Packing = tuple[Bins, list[int]]  # bins of documents and how full each bin is


def best_fit(bins: Bins, fill: list[int], todo: list[int], length: list[int], capacity: int) -> None:
    """Put each of ``todo`` into the fullest bin that takes it, or into a new one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set while some bin has room r
    for b, f in enumerate(fill):
        if f < capacity:
            room[capacity - f].append(b)
            mask |= 1 << (capacity - f)
    for item in todo:
        n = length[item]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[b].append(item)
            fill[b] += n
        else:
            b = len(bins)
            bins.append([item])
            fill.append(n)
        left = capacity - fill[b]
        if left:
            room[left].append(b)
            mask |= 1 << left


def fitness(fill: list[int], capacity: int) -> float:
    """Fewer and less evenly filled bins are better: mean of squared fill."""
    return sum([f * f for f in fill]) / (len(fill) * capacity * capacity) if fill else 1.0


def crossover(one: Packing, other: Packing, length: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject well-filled bins of ``other`` into ``one``, drop the bins they collide with, best-fit what falls out."""
    given, full = other
    ranked = sorted(range(len(given)), key=full.__getitem__, reverse=True)
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.sample(best, max(1, len(best) // 3))
    bins, fill = [list(given[b]) for b in chosen], [full[b] for b in chosen]
    taken = bytearray(len(length))
    for b in bins:
        for i in b:
            taken[i] = 1
    displaced: list[int] = []
    poor = capacity - capacity // 32
    for b, f in zip(*one):
        hit = False
        for i in b:
            if taken[i]:
                hit = True
                break
        # a badly filled bin that stays would only repeat the parent: half of them are dissolved as well
        if hit:
            displaced += [i for i in b if not taken[i]]
        elif f < poor and rng.random() < 0.5:
            displaced += b
        else:
            bins.append(list(b))
            fill.append(f)
    displaced.sort()
    displaced.sort(key=length.__getitem__, reverse=True)
    best_fit(bins, fill, displaced, length, capacity)
    return bins, fill


def start(length: list[int], capacity: int, rng: random.Random, spread: float) -> Packing:
    """Best fit in falling order of length, disturbed by ``spread``."""
    keys = [n * (1 + spread * rng.random()) for n in length]
    order = sorted(range(len(length)), key=keys.__getitem__, reverse=True)
    bins: Bins = []
    fill: list[int] = []
    best_fit(bins, fill, order, length, capacity)
    return bins, fill


def evolve(population: list[Packing], length: list[int], capacity: int, rng: random.Random, generations: int) -> list[Packing]:
    """The population after some generations, best first; the best never gets lost."""
    ranked = sorted(((-fitness(p[1], capacity), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    need = -(-sum(length) // capacity)
    made = len(ranked)
    for _ in range(generations):
        if len(ranked[0][2][0]) <= need:
            break  # nothing can be better
        parents = rng.sample(ranked, 2) if len(ranked) > 1 else [ranked[0], ranked[0]]
        for a, b in (parents, parents[::-1]):
            child = crossover(a[2], b[2], length, capacity, rng)
            bisect.insort(ranked, (-fitness(child[1], capacity), made, child), key=lambda x: x[:2])
            made += 1
        del ranked[POPULATION:]
    return [p for _, _, p in ranked]


def _coded(bins: Bins, n: int) -> bytes:
    at = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        at[b] = k
    return at.tobytes()


def _decoded(code: bytes) -> Bins:
    at = np.frombuffer(code, np.int32)
    bins: Bins = [[] for _ in range(int(at.max()) + 1)] if len(at) else []
    for i, b in enumerate(at.tolist()):
        bins[b].append(i)
    return bins


ISLAND = "shard long, island int, lengths binary, packings array<binary>, elite binary, score double"


def _island(batches: Iterator[pa.RecordBatch], epoch: int, capacity: int, generations: int) -> Iterator[pa.RecordBatch]:
    """One epoch on each island row; migrants come with the row."""
    for batch in batches:
        rows: list[tuple] = []
        for shard, island, lengths, packings, migrant in zip(
            *(batch.column(c).to_pylist() for c in ("shard", "island", "lengths", "packings", "migrant"))
        ):
            length = np.frombuffer(lengths, np.int32).tolist()
            rng = random.Random(f"{shard} {island} {epoch}")
            if packings:
                codes = [*packings, *([migrant] if migrant is not None else [])]
                population = [(b, [sum([length[i] for i in x]) for x in b]) for b in map(_decoded, codes)]
            else:
                population = [start(length, capacity, rng, 0.02 * island + 0.05 * k) for k in range(POPULATION)]
            population = evolve(population, length, capacity, rng, generations)
            coded = [_coded(bins, len(length)) for bins, _ in population]
            score = fitness(population[0][1], capacity)
            rows.append((shard, island, lengths, coded, coded[0], score))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.float64())
        names = ("shard", "island", "lengths", "packings", "elite", "score")
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _lengths(batches: Iterator[pa.RecordBatch], islands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array([p["length"] for p in pieces], np.int32).tobytes() for pieces in batch.column("pieces").to_pylist()]
        for k in range(islands):
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), pa.array([k] * batch.num_rows, pa.int32()), pa.array(packed, pa.binary())],
                ["shard", "island", "lengths"],
            )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a shard with the sequence and the place that its best packing gives them."""
    for batch in batches:
        for shard, pieces, elite in zip(*(batch.column(c).to_pylist() for c in ("shard", "pieces", "elite"))):
            rows = []
            for k, b in enumerate(_decoded(elite)):
                offset = 0
                for i in b:
                    p = pieces[i]
                    rows.append((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"], (shard << 24) + k, offset))
                    offset += p["length"]
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def tokenized(docs: DataFrame, path: str, ranks: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: place in its ids, length and checksum of the ids."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _pieces(batches, path, ranks, end, capacity), PIECES
    )


def pack(
    docs: DataFrame, path: str | None = None, ranks: str | None = None, end: int = END, capacity: int = CAPACITY, shard: int = SHARD,
    islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS,
) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset; ``path`` and ``ranks`` are files of one vocabulary."""
    if path is None or ranks is None:
        path, ranks = vocabulary()
    pieces = stage(tokenized(docs, path, ranks, end, capacity), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    listed = stage(
        dealt.groupBy("shard").agg(
            F.sort_array(F.collect_list(F.struct("doc_id", "piece", "start", "length", "ids_crc32"))).alias("pieces")
        ),
        "shards",
    )
    # an island is a few hundred kilobytes and seconds of work: deal them evenly instead of by size
    tasks = min(shards * islands, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = listed.mapInArrow(lambda batches: _lengths(batches, islands), "shard long, island int, lengths binary")
    rows = rows.withColumns({"packings": F.lit(None).cast("array<binary>"), "migrant": F.lit(None).cast("binary")})
    for epoch in range(epochs):
        run = rows.repartition(tasks, "shard", "island")
        done = stage(run.mapInArrow(lambda b, e=epoch: _island(b, e, capacity, generations), ISLAND), "islands")
        elite = done.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("migrant"))
        rows = done.drop("elite", "score").join(elite, ["shard", "island"])
    best = done.groupBy("shard").agg(F.max(F.struct("score", "island", "elite")).alias("b")).select("shard", "b.elite")
    return listed.join(best, "shard").mapInArrow(_placed, f"{PIECES}, sequence_id long, offset long")


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
