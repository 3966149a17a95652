"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles, and sets become 64 min-wise samples ("tokens"). A run of the join is a tree
of buckets: in each bucket a shared hash function chooses tokens, about 1.5 / 0.8 of every set's 64, and a set goes on
to the child bucket of each token chosen. Two sets that share a share s of their tokens share 1.5 s / 0.8 children, so
similar sets keep meeting while dissimilar ones part. Small buckets are compared by brute force; large ones are split
again, and what is still large at the last level, dense groups of near copies, is compared by matrices of equal tokens and
bits of shared shingles, in tiles beyond a bound. Runs are repeated until a pair at the threshold is missed with at most
the stated chance.

Identical sets are one node, so copies cost nothing. A pair that meets in several buckets is compared in the smallest
of them only, so links can be counted and summed without ever writing pairs: each bucket gives one row per member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import Scratch, bounded_batches, cut, documents
from .textbytes import LOWER, WORD, Texts, mix64, ngram_hashes, releasing, repeated, slices, span_hashes, spans

SHINGLE, TOKENS = 5, 64
#: Rows of a lookup side that may be broadcast (some 24 bytes each); beyond it the join is a shuffle.
BROADCAST_ROWS = 200_000
#: Groups of more rows are compared by matrices, and with bits for shingles if these take no more bytes than this.
LARGE, BITS_BYTES = 32, 32 << 20


@dataclass(frozen=True)
class ChosenPath:
    """threshold: least Jaccard similarity of a link; recall: chance that a pair at it is found.

    chosen: mean number of tokens that a pair at the threshold goes on by; leaf: largest bucket compared as one;
    dense: a child with such a share of its parent holds sets that are alike, and splitting it again would only repeat
    it; depth: levels of a run; tile, tile_bytes: most rows, and most bytes of shingles, of one side of a tile of a
    large bucket. Beyond them a bucket is compared in several tiles, so no task holds more.
    """

    threshold: float = 0.8
    recall: float = 0.99999
    chosen: float = 1.5
    leaf: int = 32
    dense: float = 0.5
    depth: int = 4
    tile: int = 4096
    tile_bytes: int = 8 << 20

    @property
    def runs(self) -> int:
        """The number of runs for the target recall, if every pair has to go through all levels."""
        met = 1.0
        for _ in range(self.depth):
            met = 1 - math.exp(-self.chosen * met)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - met))

    @property
    def cutoff(self) -> int:
        """The highest hash of a token that is chosen."""
        return int(min(1.0, self.chosen / (self.threshold * TOKENS)) * (2**64 - 1))

    @property
    def least_equal(self) -> int:
        """Equal tokens below which a pair can't reach the threshold: 6.5 standard deviations under its mean."""
        return max(1, math.floor(TOKENS * self.threshold - 6.5 * math.sqrt(TOKENS * self.threshold * (1 - self.threshold))))


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice's rows, and the row of each, rows ascending.

    Words are runs of ASCII letters (in lower case), digits and other characters beyond ASCII. A text of one to four
    words is one shingle; one without words has none.
    """
    w = spans(t, WORD)
    words = span_hashes(LOWER[t.data], w.start, w.end)
    whole = w.of[w.row] if len(words) else w.row
    ends = w.of[w.row + 1] if len(words) else w.row
    at = np.arange(len(words))
    fits = np.flatnonzero(at + SHINGLE <= ends)
    found, rows = [ngram_hashes(words, SHINGLE)[fits]], [w.row[fits]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero((ends - whole == n) & (at == whole))
        if len(short):
            found.append(mix64(ngram_hashes(words, n)[short] ^ np.uint64(n)))
            rows.append(w.row[short])
    hashes, row = np.concatenate(found), np.concatenate(rows)
    if len(found) > 1:
        order = np.argsort(row, kind="stable")
        hashes, row = hashes[order], row[order]
    once = repeated(hashes + mix64(row.astype(np.uint64))) != 2
    return hashes[once], row[once]


_MULTIPLY = mix64(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(1001, 1001 + TOKENS, dtype=np.uint64))


def sketch(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row that has shingles: its number, 128 bits that stand for the whole set, and its min-wise tokens."""
    count = np.bincount(row, minlength=n_rows)
    full = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[full]
    if not len(full):
        return full, np.zeros((0, 2), np.uint64), np.zeros((0, TOKENS), np.uint32)
    both = [np.add.reduceat(mix64(hashes ^ np.uint64(seed)), start) for seed in (0x5151, 0xA7A7)]
    tokens = np.empty((len(full), TOKENS), np.uint32)
    for k in range(TOKENS):
        tokens[:, k] = np.minimum.reduceat(((hashes * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), start)
    return full, np.stack(both, 1), tokens


def _binary(rows: np.ndarray) -> pa.Array:
    """A 2-d array as a binary column, one value per row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of equal lengths and no nulls as a 2-d array."""
    if not len(column):
        return np.zeros((0, width), dtype)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    size = width * np.dtype(dtype).itemsize
    return data[first : first + len(column) * size].view(dtype).reshape(len(column), width)


@releasing
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, locator, text) to (id, locator, rep, number of shingles, tokens); rep and tokens are null without a word."""
    for batch in batches:
        for t in slices(batch.column(2)):
            hashes, row = shingles(t)
            full, rep, tokens = sketch(hashes, row, t.rows)
            take = np.full(t.rows, -1)
            take[full] = np.arange(len(full))
            take = pa.array(take, mask=take < 0)
            count = pa.array(np.bincount(row, minlength=t.rows), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), batch.column(1).slice(t.first, t.rows), _binary(rep).take(take), count, _binary(tokens).take(take)], names=["doc_id", "loc", "rep", "n", "tokens"])


@releasing
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to (rep, shingles), sorted 64-bit hashes."""
    for batch in batches:
        for t in slices(batch.column(1)):
            hashes, row = shingles(t)
            order = np.lexsort((hashes, row))
            offsets = np.searchsorted(row, np.arange(t.rows + 1)) * 8
            sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), t.rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(hashes[order])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, t.rows), sets], names=["rep", "shingles"])


def _step(how: ChosenPath, first: bool):
    """From (rep, tokens, size[, node]) to the rows (node, rep, size) of the next level; size is the parent's."""
    runs = mix64(np.arange(77, 77 + how.runs, dtype=np.uint64))
    place = np.arange(1, TOKENS + 1, dtype=np.uint64) << np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix64(_matrix(batch.column(1), np.uint32, TOKENS).astype(np.uint64) | place)
            nodes = [np.full((len(keys), 1), r) for r in runs] if first else [batch.column(3).to_numpy().astype(np.uint64).reshape(-1, 1)]
            for node in nodes:
                drawn = mix64(keys ^ mix64(node))
                row, token = np.nonzero(drawn <= np.uint64(how.cutoff))
                child = mix64(drawn[row, token] ^ np.uint64(0xC0DE)).view(np.int64)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(child), batch.column(0).take(row), batch.column(2).take(row)], names=["node", "rep", "size"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by its first `keys` columns; many small groups come together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        last = np.logical_and.reduce([c == c[-1] for c in cols])
        begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        # the last group may go on in the next batch
        if begin:
            yield pa.Table.from_batches([*rest, batch.slice(0, begin)]).combine_chunks()
            rest = [batch.slice(begin)]
        elif rest and any(rest[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _edges(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal keys begins, and its size."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    edge = np.flatnonzero(new)
    return edge, np.diff(np.r_[edge, len(new)])


class _Members:
    """What a table of whole (node, tile) groups says of its rows, for finding the pairs that a bucket has to compare: similar
    enough by their tokens, of two sides where the tile has two, and with no smaller bucket in common."""

    def __init__(self, table: pa.Table, how: ChosenPath):
        self.how = how
        self.node, self.tile, self.side = (table.column(k).chunk(0).to_numpy() if table.num_rows else np.zeros(0, np.int64) for k in ("node", "tile", "side"))
        # eight bits of a token are enough to see which pairs can't reach the threshold
        self.tokens = np.ascontiguousarray(_matrix(table.column("tokens").chunk(0), np.uint32, TOKENS).astype(np.uint8))
        lists = table.column("nodes").chunk(0)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(offsets)
        self.known = np.full((len(self.node), int(size.max(initial=1))), np.iinfo(np.int64).max)
        self.known[np.arange(self.known.shape[1])[None, :] < size[:, None]] = flat[offsets[0] : offsets[-1]]
        self.edge, self.size = _edges(self.node, self.tile)

    def first_met(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs have no smaller bucket in common than the one they stand in."""
        out = np.empty(len(i), bool)
        for k in range(0, len(i), 20_000):
            a, b = i[k : k + 20_000], j[k : k + 20_000]
            low = np.full(len(a), np.iinfo(np.int64).max)
            for c in range(self.known.shape[1]):  # lists are sorted: the first common value is the smallest
                x = self.known[a, c]
                low = np.where((self.known[b] == x[:, None]).any(1), np.minimum(low, x), low)
            out[k : k + 20_000] = low == self.node[a]
        return out

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs have enough equal tokens."""
        out = np.empty(len(i), bool)
        for k in range(0, len(i), 20_000):
            out[k : k + 20_000] = (self.tokens[i[k : k + 20_000]] == self.tokens[j[k : k + 20_000]]).sum(1) >= self.how.least_equal
        return out

    def small_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of all groups that aren't large, many groups at once."""
        small = np.repeat(self.size <= LARGE, self.size)
        for gap in range(1, LARGE):
            i = np.flatnonzero(small[: len(self.node) - gap])
            i = i[(self.node[i] == self.node[i + gap]) & (self.tile[i] == self.tile[i + gap])]
            if not len(i):
                break
            i = i[(self.tile[i] <= 0) | (self.side[i] != self.side[i + gap])]
            i = i[self.close(i, i + gap)]
            i = i[self.first_met(i, i + gap)]
            yield i, i + gap

    def large(self) -> np.ndarray:
        """The numbers of the large groups."""
        return np.flatnonzero(self.size > LARGE)

    def pairs_of(self, g: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one large group, block by block. Most members of a dense bucket have met in smaller buckets: one matrix product
        finds such pairs before they are compared."""
        members = np.arange(self.edge[g], self.edge[g] + self.size[g])
        node, square = self.node[members[0]], self.tile[members[0]] <= 0
        ids = self.known[members]
        row, col = np.nonzero(ids < node)
        _, which, often = np.unique(ids[row, col], return_inverse=True, return_counts=True)
        use = often >= max(2, len(members) // 20)
        number, hit = np.cumsum(use) - 1, use[which]
        met = np.zeros((len(members), int(use.sum()) or 1), np.float32)
        met[row[hit], number[which[hit]]] = 1
        rare = np.zeros(len(members), bool)
        rare[row[~hit & (often[which] > 1)]] = True
        by_token = np.ascontiguousarray(self.tokens[members].T)
        side = self.side[members]
        for k in range(0, len(members), 128):
            block = np.arange(k, min(k + 128, len(members)))
            open_ = met[block] @ met.T == 0
            open_ &= block[:, None] < np.arange(len(members))[None, :]
            if not square:
                open_ &= side[block][:, None] != side[None, :]
            n = int(open_.sum())
            if n * 8 > open_.size:
                # most are open: count equal tokens of all at once
                equal = np.zeros(open_.shape, np.uint8)
                for t in by_token:
                    equal += (t[block][:, None] == t[None, :]).view(np.uint8)
                i, j = np.nonzero(open_ & (equal >= self.how.least_equal))
                i, j = members[block[i]], members[j]
            else:
                i, j = np.nonzero(open_)
                i, j = members[block[i]], members[j]
                near = self.close(i, j)
                i, j = i[near], j[near]
            both = np.flatnonzero(rare[i - members[0]] & rare[j - members[0]])
            if len(both):
                keep = np.ones(len(i), bool)
                keep[both] = self.first_met(i[both], j[both])
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self.small_pairs()
        for g in self.large():
            yield from self.pairs_of(g)


def _meet(how: ChosenPath):
    """(node, tile, side, rep, cost, tokens, nodes) to the (node, rep, cost) that have something to compare exactly."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            hit = np.zeros(table.num_rows, bool)
            for i, j in _Members(table, how).pairs():
                hit[i] = hit[j] = True
            if hit.any():
                yield from table.select(["node", "rep", "cost"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


class _Shingles:
    """The shingle sets of a table's rows, sorted in each row."""

    def __init__(self, sets: pa.Array):
        at = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64) // 8
        self.values = np.frombuffer(sets.buffers()[2], np.uint8)[at[0] * 8 : at[-1] * 8].view(np.uint64)
        self.at = at - at[0]
        self.size = np.diff(self.at)

    def common_with(self, a: int, others: np.ndarray) -> np.ndarray:
        """How many shingles one row has in common with each of others."""
        mine, lens = self.values[self.at[a] : self.at[a + 1]], self.size[others]
        begin = np.cumsum(lens) - lens
        theirs = self.values[np.repeat(self.at[others] - begin, lens) + np.arange(int(lens.sum()))]
        return np.add.reduceat(mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs, begin)

    def bits(self, first: int, n: int) -> np.ndarray | None:
        """A row of bits for each of n rows: which of the shingles that two or more of them have it has. None if that is too large."""
        values = self.values[self.at[first] : self.at[first + n]]
        _, which, often = np.unique(values, return_inverse=True, return_counts=True)
        use = often > 1
        width = (int(use.sum()) + 63) // 64 or 1
        if n * width * 8 > BITS_BYTES:
            return None
        keep = use[which]
        column = (np.cumsum(use) - 1)[which[keep]]
        cell = np.repeat(np.arange(n), self.size[first : first + n])[keep] * width + column // 64
        bit = np.uint64(1) << (column % 64).astype(np.uint64)
        out = np.zeros(n * width, np.uint64)
        if len(cell):
            start, _ = _edges(cell)
            out[cell[start]] = np.bitwise_or.reduceat(bit, start)
        return out.reshape(n, width)

    def common(self, i: np.ndarray, j: np.ndarray, bits: np.ndarray | None, first: int) -> np.ndarray:
        """How many shingles the rows of each pair have in common."""
        out = np.empty(len(i), np.int64)
        if bits is None:
            order = np.argsort(i, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else ():
                out[group] = self.common_with(int(i[group[0]]), j[group])
            return out
        step = max(1, (1 << 20) // bits.shape[1])
        for k in range(0, len(i), step):
            out[k : k + step] = np.bitwise_count(bits[i[k : k + step] - first] & bits[j[k : k + step] - first]).sum(1)
        return out


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives all members that links connect the smallest label among them; i and j are linked pairs."""
    apart = np.flatnonzero(label[i] != label[j])
    while len(apart):
        a = i[apart[0]]
        own = np.unique(label[np.r_[a, j[apart[i[apart] == a]]]])
        label[np.isin(label, own)] = own[0]
        apart = apart[label[i[apart]] != label[j[apart]]]


def _verify(how: ChosenPath):
    """The same rows with weight and shingles to (rep, root, links): a member of a bucket, the smallest member it is linked
    to there by any chain, and the weight of those that it is linked to itself."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            rows, sets = _Members(table, how), _Shingles(table.column("shingles").chunk(0))
            weight, reps = table.column("weight").to_numpy(), table.column("rep").to_pylist()
            links = np.zeros(table.num_rows, np.int64)
            # a member's label is its rank by rep, then the lowest rank that it is linked to
            rank = np.argsort(sorted(range(len(reps)), key=reps.__getitem__))
            label = rank.copy()

            def linked(i: np.ndarray, j: np.ndarray, bits: np.ndarray | None = None, first: int = 0, sets=sets, links=links, weight=weight) -> tuple[np.ndarray, np.ndarray]:
                common = sets.common(i, j, bits, first)
                ok = common >= how.threshold * (sets.size[i] + sets.size[j] - common)
                i, j = i[ok], j[ok]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                return i, j

            parent = list(range(len(reps)))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in rows.small_pairs():
                for a, b in zip(*(x.tolist() for x in linked(i, j)), strict=True):
                    x, y = root(a), root(b)
                    if x != y:
                        x, y = (x, y) if rank[x] < rank[y] else (y, x)
                        parent[y] = x
            for k, p in enumerate(parent):
                if p != k:
                    label[k] = rank[root(k)]
            for g in rows.large():
                first, n = int(rows.edge[g]), int(rows.size[g])
                bits, own = sets.bits(first, n), label[first : first + n]
                for i, j in rows.pairs_of(g):
                    i, j = linked(i, j, bits, first)
                    _merge(own, i - first, j - first)
            some = np.flatnonzero(links)
            if len(some):
                by_rank = np.argsort(rank)
                yield pa.RecordBatch.from_arrays([pa.array([reps[k] for k in some], pa.binary()), pa.array([reps[by_rank[label[k]]] for k in some], pa.binary()), pa.array(links[some])], names=["rep", "root", "links"])

    return run


def _lookup(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _tiled(rows: DataFrame, k: Column) -> DataFrame:
    """Rows of a bucket dealt to tiles: k sides by a hash, and one tile for each side and each pair of sides. tile 0 is a bucket
    compared as one; of a larger one, negative tiles have one side each, positive ones two."""
    rows = rows.withColumn("_k", k).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    low, high = F.least("side", "_other"), F.greatest("side", "_other")
    tile = F.when(F.col("_k") == 1, 0).when(low == high, -1 - low).otherwise(1 + low * F.col("_k") + high).cast("int")
    return rows.withColumn("tile", tile).drop("_k", "_other")


def jaccard_join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how: ChosenPath = ChosenPath()) -> DataFrame:
    """doc_id, class_id, n_links, loc: one row per input row.

    class_id is the smallest id among all that chains of links lead to; n_links counts the other rows whose shingle
    sets have at least the threshold's similarity, copies included. Null and empty texts and those without a word are
    linked to nothing and are their own class. Ids may repeat or be null; `loc` hashes the text and tells such rows
    apart, and rows that repeat both are copies of each other. Texts of any length are compared whole. Other columns
    aren't read, so their names don't matter. An empty table gives an empty result.
    """
    return _judged(docs, text_col, id_col, how, Scratch(docs.sparkSession)).drop("keep_loc")


def _judged(docs: DataFrame, text_col: str, id_col: str, how: ChosenPath, scratch: Scratch) -> DataFrame:
    """The columns of jaccard_join and keep_loc: with class_id, the id and text of the one row that stands for the group."""
    bounded_batches(docs.sparkSession)
    written = scratch.written
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("loc"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    signed = written(source.mapInArrow(_sign, f"doc_id {id_type}, loc long, rep binary, n int, tokens binary"), "signed")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "loc", "n", "tokens")  # null ids last
    reps = signed.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("weight"), F.min(one).alias("_one"))
    cost = F.greatest(F.col("_one.n") * 8, F.lit(how.tile_bytes // how.tile)).cast("long")
    reps = written(reps.select("rep", "weight", "_one.doc_id", "_one.loc", cost.alias("cost"), "_one.tokens"), "reps")

    # the tree of buckets, all runs at once: levels go on while any bucket is large and not dense
    rows, leaves = "node long, rep binary, size long", None
    path = reps.select("rep", "tokens", F.lit(reps.count()).cast("long").alias("size")).mapInArrow(_step(how, True), rows)
    for level in range(1, how.depth + 1):
        met = path.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("of")).where("n > 1")
        level_rows = written(path.join(met, "node").select("node", "rep", "n", "of"), "level")
        ends = (F.col("n") <= how.leaf) | (F.col("n") >= how.dense * F.col("of")) | F.lit(level == how.depth)
        done = level_rows.where(ends).select("node", "rep", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = level_rows.where(~ends)
        if level == how.depth or large.isEmpty():
            break
        path = large.select("node", "rep", F.col("n").alias("size")).join(reps.select("rep", "tokens"), "rep").select("rep", "tokens", "size", "node").mapInArrow(_step(how, False), rows)

    # every set with all its buckets, dealt to each of them
    known = leaves.groupBy("rep").agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("_b")).join(reps, "rep")
    known = written(known.withColumn("nodes", F.transform("_b", lambda b: b["node"])), "known")
    scratch.drop("level")
    at = known.select("rep", "cost", "tokens", "nodes", F.explode("_b").alias("b")).select("rep", "cost", "tokens", "nodes", "b.node", "b.n")
    at = _tiled(at, F.greatest(F.lit(1), F.ceil(F.col("n") / how.tile)).cast("int")).select("node", "tile", "side", "rep", "cost", "tokens", "nodes")
    hits = at.repartition("node", "tile").sortWithinPartitions("node", "tile").mapInArrow(_meet(how), "node long, rep binary, cost long")
    hits = written(hits, "hits").distinct()

    # exact check: only the texts of sets that met a similar one are read again, and dealt anew by the bytes of their sets
    wanted = cut(known.join(hits.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "loc"))
    on = source["doc_id"].eqNullSafe(wanted["doc_id"]) & (source["loc"] == wanted["loc"])
    texts = source.join(_lookup(wanted, wanted.count()), on).select(wanted["rep"], source["text"])
    sets = texts.mapInArrow(_sets, "rep binary, shingles binary").dropDuplicates(["rep"])
    members = written(known.select("rep", "weight", "tokens", "nodes").join(sets, "rep"), "members")
    heavy = cut(hits.groupBy("node").agg(F.sum("cost").alias("bytes")).where(F.col("bytes") > how.tile_bytes))
    dealt = hits.select("node", "rep").join(_lookup(heavy, heavy.count()), "node", "left")
    dealt = _tiled(dealt, F.greatest(F.lit(1), F.ceil(F.coalesce("bytes", F.lit(0)) / how.tile_bytes)).cast("int"))
    full = dealt.join(members, "rep").select("node", "tile", "side", "rep", "tokens", "nodes", "weight", "shingles")
    linked = written(full.repartition("node", "tile").sortWithinPartitions("node", "tile").mapInArrow(_verify(how), "rep binary, root binary, links long"), "linked")
    scratch.drop("known", "hits", "members")

    found = components(linked, "rep", "root")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    r = reps.select("rep", "weight", "doc_id", "loc").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    r = r.select("rep", "doc_id", "loc", F.coalesce("root", "rep").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "loc"))
    classes = r.groupBy("root").agg(first.alias("_keep")).select("root", F.col("_keep.doc_id").alias("class_id"), F.col("_keep.loc").alias("keep_loc"))
    r = r.join(classes, "root").select("rep", "class_id", "keep_loc", "n_links")
    out = signed.select("doc_id", "loc", "rep").join(r, "rep", "left")
    return out.select("doc_id", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "loc", "keep_loc")


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", how: ChosenPath = ChosenPath()) -> DataFrame:
    """The rows of `docs` without all but one of each group of linked documents: the one with the smallest id stays.

    Of rows with the same id and text one stays, too. Null and empty texts and those without a word are kept as they are.
    Ids may repeat or be null (as an id, null is the largest): rows are told apart by id and text. Very long texts are
    compared whole. All columns stay, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    judged = scratch.written(_judged(docs, text_col, id_col, how, scratch), "judged")
    scratch.drop("signed", "reps", "linked")
    linked = judged.where("n_links > 0").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("loc") == F.col("keep_loc")))
    pair = [F.col("doc_id").alias("_id"), F.col("loc").alias("_loc")]
    gone = cut(linked.where("NOT stays").select(*pair).distinct())
    # rows that repeat both id and text
    again = cut(linked.where("stays").groupBy("doc_id", "loc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*pair))
    scratch.drop("judged")
    names, key = docs.columns, F.xxhash64(docs[text_col])
    on = lambda of: docs[id_col].eqNullSafe(of["_id"]) & (key == of["_loc"])
    kept = docs.join(_lookup(gone, gone.count()), on(gone), "left_anti")
    n = again.count()
    if not n:
        return kept
    single = kept.join(_lookup(again, n), on(again), "left_anti")
    whole = F.struct(*(docs[c] for c in names))
    # of the rows that repeat id and text, the first by its other columns
    repeats = kept.join(_lookup(again, n), on(again), "left_semi").select(F.struct(docs[id_col].alias("id"), key.alias("at")).alias("_key"), whole.alias("_row"))
    repeats = repeats.groupBy("_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select(*(F.col("_row")[c].alias(c) for c in names))
    return single.unionByName(repeats)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies and its number of links."""
    return jaccard_join(documents(spark, sf_dir)).drop("loc")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
  link AS MATERIALIZED (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8::DOUBLE * (nx.n + ny.n - c)),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS class_id, (SELECT count(*) FROM link WHERE x = d.doc_id)::BIGINT AS n_links FROM d
"""
