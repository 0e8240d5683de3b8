"""Jaccard self-join of documents on word n-gram sets, by vertical partitioning.

A global order of n-grams (rarer first) is cut into fragments. For every candidate pair the
overlap inside each fragment is counted on its own, and the partial overlaps are summed
per pair; the sum decides the link (exactly, up to collisions of 64-bit hashes of n-grams). Fragments that two sets
share whole are known by a summary, so only fragments that differ are ever compared.

Sets and what they share
    One pass computes each document's set (64-bit hashes of n-grams) and a 128-bit key of the
    whole set; documents with equal keys are one class and are never compared. A second pass
    deals the n-grams of one vertical fragment, those whose hash is below a limit (a multiple of
    the share that a linked pair may differ in), by ranges of their hashes and packed into
    blocks, to find those that several sets have. A set that links misses few of its n-grams in
    its partner, so one with more n-grams of the fragment to itself goes no further. Before n-grams are
    dealt, a chunk of sets looks for those that it holds several times itself: their holders
    already know that they are shared and only one mark of the n-gram is dealt, so an n-gram that a
    third of all documents have is a mark a chunk. Sets that could link are then made
    once more from their class's text, which a join on doc_id fetches, and written: all later steps read them.

Order and candidates
    N-grams are counted over these sets, and those with over RARE sets are told to
    their holders. The order is by the binary logarithm of the count, then by hash. Every set gives the
    head of its order that any partner must share; an n-gram that 2**HOT_LEVEL sets or more
    have is dealt in salted shares.

No all-pairs work in a group
    In each n-gram's group a centre, the member with the fewest rarer n-grams, is compared with
    the others (size and position filters apply). Links give components; groups whose
    members are all in one component are done, and a group that is not loses its centre, all of
    whose pairs are now known. Each round has GROWTH times as many centres a group, so a group whose members do not link
    ends after few rounds. A group of thousands of near copies costs one comparison per member, and no link
    between components is lost.

Defined results: null or blank text has an empty set, links with nothing and is its own
component; a text with fewer words than n is one n-gram; equal texts share a component; very long texts count whole;
rows that share a doc_id are judged each by its own text; a row without doc_id has no component; ties
go to the least doc_id; extra columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.wordhash import Words, combine, mix, words
from textloom.operators.components import components
from textloom.session import discard, drop_shuffles, lean, materialize, ship

#: The first fragment has so many times the share of n-grams that a set may miss in a linked one.
FIRST = 2.5
#: N-grams that a chunk of sets holds before it is dealt, and that a part of the n-grams' range has in the mean.
CHUNK = 1 << 19
PART = 1 << 20
#: N-grams with more sets than this are told to their holders and come later in the order, the more the later.
RARE = 8
#: N-grams that 2**HOT_LEVEL sets or more have are dealt in salted shares.
HOT_LEVEL = 12
FRAGMENTS = 32
#: Counts of up to so many n-grams are broadcast; more are joined to their holders. The result is the same.
TOLD = 1 << 20
#: Buckets of doc_ids that hold a set which goes on; a table of them has no more rows, whatever the corpus.
ROUGH = 1 << 21
#: A round has so many times the centres of the one before; in groups of no more members all are centres.
GROWTH = 32


@dataclass(frozen=True)
class JoinSpec:
    """Word n-grams of length ``n``; a link needs den * intersection >= num * union."""

    n: int = 3
    num: int = 90
    den: int = 100

    @property
    def first(self) -> int:
        """N-grams with hashes below this are the first fragment."""
        return min(int(FIRST * (1 - self.num / self.den) * (1 << 64)), (1 << 64) - 1)

    def missed(self, n: str = "n") -> str:
        """SQL for how many of a set's n-grams a linked set may lack; one more is the head that holds one of any partner's."""
        return f"({n} - ({n} * {self.num} + {self.den - 1}) div {self.den})"


def set_rows(group: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each distinct n-gram, sorted by both, and the sizes of all sets."""
    h, doc, count = group.hashes, group.doc, group.count
    parts, docs = [], []
    if len(h) >= n:
        whole = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        parts.append(combine([h[whole + k] for k in range(n)], n))
        docs.append(doc[whole])
    begin = np.cumsum(count) - count
    for short in range(1, n):
        few = np.flatnonzero(count == short)
        if len(few):
            parts.append(combine([h[begin[few] + k] for k in range(short)], short))
            docs.append(few)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(count), np.int64)
    grams, docs = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[fresh], docs[fresh]
    return docs, grams, np.bincount(docs, minlength=len(count))


def set_keys(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two signed integers a row."""
    data, ends = grams.tobytes(), np.cumsum(sizes) * 8
    keys = [hashlib.blake2b(data[e - s * 8 : e], digest_size=16).digest() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


_SCAN = "doc_id long, n long, f long, k1 long, k2 long"


def _scan(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    """One row per document with the size of its set, that of its first fragment and its key."""
    below = np.uint64(spec.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, firsts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
            for group in words(batch.column("text")):
                doc, grams, size = set_rows(group, spec.n)
                sizes.append(size)
                firsts.append(np.bincount(doc[grams < below], minlength=len(size)))
                keys.append(set_keys(grams, size))
            key = np.concatenate(keys)
            yield _batch(_SCAN, batch.column("doc_id"), np.concatenate(sizes), np.concatenate(firsts), key[:, 0], key[:, 1])

    return docs.mapInArrow(lean(run), _SCAN)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


#: Packed rows: for each holder a count, and as many n-grams or none. ``holders`` has the key and the size of each as three
#: 64-bit integers; size 0 marks n-grams without one. Of an n-gram there are 32 bits, others than those that chose the part.
_BLOCKS = "part long, known boolean, holders binary, counts binary, grams binary"


def _blocks_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])


def _tally(part: np.ndarray, holders: np.ndarray, counts: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of the parts that holders' counts go to."""
    order = np.argsort(part, kind="stable")
    part, holders, counts = part[order], holders[order], counts[order].astype("<u4")
    ends = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    yield from _blocks_of([(int(part[a]), known, holders[a:b].tobytes(), counts[a:b].tobytes(), b"") for a, b in zip(ends, ends[1:])])


def _deal(part: np.ndarray, holder: np.ndarray, grams: np.ndarray, holders: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the parts that n-grams of numbered holders go to."""
    if not len(part):
        return
    order = np.lexsort((holder, part))
    part, holder, grams = part[order], holder[order], grams[order]
    change = (part[1:] != part[:-1]) | (holder[1:] != holder[:-1])
    run = np.flatnonzero(np.concatenate([[True], change]))
    ends = np.append(run, len(part))
    n, first = np.diff(ends).astype("<u4"), np.flatnonzero(np.diff(part[run], prepend=-1))
    rows = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(run)], strict=True):
        rows.append((int(part[run[a]]), False, holders[holder[run[a:b]]].tobytes(), n[a:b].tobytes(), grams[ends[a] : ends[b]].tobytes()))
    yield from _blocks_of(rows)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class _Chunk:
    """Sets whose n-grams are dealt together."""

    def __init__(self, parts: int) -> None:
        self.parts, self.grams, self.sizes, self.holders, self.n = parts, [], [], [], 0

    def add(self, grams: np.ndarray, sizes: np.ndarray, holders: np.ndarray) -> None:
        self.grams.append(grams)
        self.sizes.append(sizes)
        self.holders.append(holders)
        self.n += len(grams)

    def deal(self) -> Iterator[pa.RecordBatch]:
        """How many n-grams of each set others of the chunk have, a mark of each of these, and all others to ask about."""
        if not self.n:
            return
        grams, sizes, holders = np.concatenate(self.grams), np.concatenate(self.sizes), np.concatenate(self.holders)
        holder = np.repeat(np.arange(len(sizes)), sizes)
        self.grams, self.sizes, self.holders, self.n = [], [], [], 0
        order = np.argsort(grams, kind="stable")
        grams, holder = grams[order], holder[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        several = np.diff(np.append(first, len(grams))) > 1
        marks = grams[first[several]]
        several = np.repeat(several, np.diff(np.append(first, len(grams))))
        known = np.bincount(holder[several], minlength=len(holders))
        some = np.flatnonzero(known)
        yield from _tally(_part_of(mix(holders[some, 0].astype(np.uint64)), self.parts), holders[some], known[some], True)
        none = len(holders)
        holders = np.concatenate([holders, np.zeros((1, 3), np.int64)])
        asked = mix(np.concatenate([grams[~several], marks]))
        yield from _deal(_part_of(asked, self.parts), np.concatenate([holder[~several], np.full(len(marks), none)]), asked.astype("<u4"), holders)


def _blocks(docs: DataFrame, spec: JoinSpec, parts: int) -> DataFrame:
    """The n-grams of all sets' first fragments, to the parts of their range."""
    below = np.uint64(spec.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = _Chunk(parts), set()
        for batch in batches:
            for group in words(batch.column("text")):
                doc, grams, size = set_rows(group, spec.n)
                if not len(grams):
                    continue
                key = set_keys(grams, size)
                new = np.zeros(len(size), bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                for i, k in enumerate(map(bytes, key)):  # copies within a task need to be dealt once; others are found later
                    if size[i] and k not in seen:
                        seen.add(k)
                        new[i] = True
                some = new[doc] & (grams < below)
                chunk.add(grams[some], np.bincount(doc[some], minlength=len(size))[new], np.column_stack([key, size])[new])
                if chunk.n >= CHUNK:
                    yield from chunk.deal()
        yield from chunk.deal()

    return docs.mapInArrow(lean(run), _BLOCKS)


@dataclass
class _Rows:
    """The rows of some blocks."""

    grams: np.ndarray
    counts: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(blocks: list[tuple[bytes, bytes, bytes]]) -> _Rows:
        holders, counts, grams = (b"".join(b[k] for b in blocks) for k in range(3))
        return _Rows(np.frombuffer(grams, "<u4"), np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(holders, np.int64).reshape(-1, 3))


def _by_part(blocks: DataFrame, each, schema: str) -> DataFrame:
    """``each`` of all blocks of a part; a task holds the blocks of one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            for part, known, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield from each(*map(_Rows.of, held))
                    now, held = part, ([], [])
                held[known].append(block)
        if now is not None:
            yield from each(*map(_Rows.of, held))

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(lean(run), schema)


_SHARED = "k1 long, k2 long, shared long"


def _answers(blocks: DataFrame, parts: int) -> DataFrame:
    """How many n-grams of a part each set shares with others, of those that it asked about or knew; to the parts of the sets.

    Copies that tasks dealt on their own ask alike, so the most of them counts. Where 32 bits agree by chance a set
    seems to share more than it does, and never less.
    """

    def each(asked: _Rows, known: _Rows) -> Iterator[pa.RecordBatch]:
        shared = np.zeros(len(asked.holders), np.int64)
        if len(asked.grams):
            holder = np.repeat(np.arange(len(asked.holders)), asked.counts)
            order = np.argsort(asked.grams, kind="stable")
            grams, holder = asked.grams[order], holder[order]
            key, mark = asked.holders[holder, 0], asked.holders[holder, 2] == 0
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            low, high = np.minimum.reduceat(key, first), np.maximum.reduceat(key, first)
            several = (low != high) | np.logical_or.reduceat(mark, first)
            several = np.repeat(several, np.diff(np.append(first, len(grams)))) & ~mark
            shared = np.bincount(holder[several], minlength=len(asked.holders))
        for holders, n in ((asked.holders, shared), (known.holders, known.counts)):
            some = np.flatnonzero(n)
            if len(some):
                keys, which = np.unique(holders[some], axis=0, return_inverse=True)
                most = np.zeros(len(keys), np.int64)
                np.maximum.at(most, which.ravel(), n[some])
                yield from _tally(_part_of(mix(keys[:, 0].astype(np.uint64)), parts), keys, most, False)

    return _by_part(blocks, each, _BLOCKS)


def _sums(answers: DataFrame) -> DataFrame:
    """The n-grams that each set shares, over all parts."""

    def each(rows: _Rows, _: _Rows) -> Iterator[pa.RecordBatch]:
        keys, which = np.unique(rows.holders, axis=0, return_inverse=True)
        shared = np.bincount(which.ravel(), weights=rows.counts, minlength=len(keys)).astype(np.int64)
        yield _batch(_SHARED, keys[:, 0], keys[:, 1], shared)

    return _by_part(answers, each, _SHARED)


_SETS = "rep long, n int, times long, grams array<long>"


def _sets(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    """The sets of rows whose text has the key that is looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = np.column_stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()])
            rep, times = batch.column("rep").to_numpy(), batch.column("times").to_numpy()
            for group in words(batch.column("text")):
                doc, grams, size = set_rows(group, spec.n)
                mine = slice(group.first, group.last)
                good = (set_keys(grams, size) == want[mine]).all(axis=1)
                size, grams = size[good], grams[good[doc]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(grams.view(np.int64)))
                yield _batch(_SETS, rep[mine][good], size.astype(np.int32), times[mine][good], lists)

    return docs.mapInArrow(lean(run), _SETS)


def _pivots(mass: dict[int, float]) -> np.ndarray:
    """Cuts of the global order (level, then hash) into FRAGMENTS parts of about equal mass; ``mass`` is by level."""
    weights = np.array([mass.get(k, 0.0) for k in range(max(mass, default=0) + 1)])
    upto = np.concatenate([[0], np.cumsum(weights)])
    cuts = []
    for j in range(1, FRAGMENTS):
        goal = upto[-1] * j / FRAGMENTS
        level = min(int(np.searchsorted(upto, goal, "right")) - 1, len(weights) - 1)
        part = min((goal - upto[level]) / weights[level], 0.999) if weights[level] else 0.0
        cuts.append((level << 56) + int(part * (1 << 56)))
    return np.array(cuts, np.uint64)


_ORDERED = "rep long, n int, grams array<long>, levels array<int>, sizes array<int>, sums array<long>, xors array<long>"


def _ordered(sets: DataFrame, cuts: np.ndarray, known=None) -> DataFrame:
    """Each set's n-grams in the global order, cut into fragments, with their levels and a summary of every fragment.

    Levels come from ``known``, a broadcast of sorted n-grams and their levels, or a column ``told``; all others are 0.
    """

    def lists(values: np.ndarray, each: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            col = batch.column("grams")
            m = np.diff(col.offsets.to_numpy())
            grams = col.flatten().to_numpy().view(np.uint64)
            doc = np.repeat(np.arange(rows), m)
            level = np.zeros(len(grams), np.int64)
            if known is not None:
                some, levels = known.value
                if len(some):
                    at = np.minimum(np.searchsorted(some, grams), len(some) - 1)
                    level = np.where(some[at] == grams, levels[at], 0)
            else:
                begin = np.cumsum(m) - m
                for i, pairs in enumerate(batch.column("told").to_pylist()):
                    if pairs:
                        mine = grams[begin[i] : begin[i] + m[i]]  # sorted
                        level[begin[i] + np.searchsorted(mine, np.array([p["gram"] for p in pairs], np.int64).view(np.uint64))] = [p["level"] for p in pairs]
            order = np.lexsort((grams, level, doc))
            grams, level, doc = grams[order], level[order], doc[order]
            frag = np.searchsorted(cuts, (level.astype(np.uint64) << np.uint64(56)) + (grams >> np.uint64(8)), "right")
            cell = doc * FRAGMENTS + frag  # in order, as fragments follow the order
            sizes, sums, xors = (np.zeros(rows * FRAGMENTS, t) for t in (np.int32, np.uint64, np.uint64))
            if len(cell):
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                sizes[cell[first]] = np.diff(np.append(first, len(cell)))
                sums[cell[first]] = np.add.reduceat(grams, first)
                xors[cell[first]] = np.bitwise_xor.reduceat(mix(grams), first)
            every = np.full(rows, FRAGMENTS)
            yield _batch(
                _ORDERED, batch.column("rep"), batch.column("n").cast(pa.int32()), lists(grams.view(np.int64), m), lists(level.astype(np.int32), m),
                lists(sizes, every), lists(sums.view(np.int64), every), lists(xors.view(np.int64), every),
            )

    return sets.select("rep", "n", "grams", *(["told"] if known is None else [])).mapInArrow(lean(run), _ORDERED)


def _fits(spec: JoinSpec, n: str, pos: str, m: str, at: str) -> str:
    """SQL for the size filter, and the position filter that the first shared n-gram of a linked pair passes."""
    most = f"(1 + least({n} - {pos} - 1, {m} - {at} - 1))"
    return (
        f"{spec.den} * least({n}, {m}) >= {spec.num} * greatest({n}, {m}) and "
        f"{spec.den} * {most} >= {spec.num} * ({n} + {m} - {most})"
    )


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b and sizes, from rows of (x, nx, y, ny)."""
    low = F.col("x") < F.col("y")
    pick = lambda p, q, name: F.when(low, F.col(p)).otherwise(F.col(q)).alias(name)
    sides = [pick("x", "y", "a"), pick("y", "x", "b"), pick("nx", "ny", "na"), pick("ny", "nx", "nb")]
    return rows.select(*sides).distinct()


def _centre_pairs(live: DataFrame, spec: JoinSpec, many: int) -> tuple[DataFrame, DataFrame]:
    """In each n-gram's group, up to ``many`` centres against members of other components; and the centres."""
    first = F.col("pos").cast("long") * (1 << 32) + F.pmod(F.xxhash64("rep"), F.lit(1 << 32))
    share = F.when(F.col("members") <= many, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep", "gram"), F.lit(many)))
    found = live.withColumn("first", first).withColumn("bucket", share)
    best = F.min(F.struct("first", "rep", "n", "pos", "label", "shares")).alias("h")
    found = found.groupBy("gram", "bucket", "salt").agg(best).groupBy("gram", "bucket").agg(F.min("h").alias("h"))
    centres = materialize(found.select("gram", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("rep", "n", "pos", "label", "shares"))), "centres")
    dealt = centres.withColumn("salt", F.explode(F.expr("sequence(0, h_shares - 1)")))
    met = live.join(dealt, ["gram", "salt"]).where("rep <> h_rep and label <> h_label").where(_fits(spec, "n", "pos", "h_n", "h_pos"))
    return _pairs(met.selectExpr("rep as x", "n as nx", "h_rep as y", "h_n as ny")), centres.selectExpr("gram", "h_rep as rep")


class _Verifier:
    """Sums the overlaps of candidate pairs over fragments, and keeps the pairs that link.

    Fragments that are equal (by size, sum and exclusive or of their n-grams) overlap in full;
    pairs that can't reach the threshold with all others go; only what differs is compared.
    """

    def __init__(self, ordered: DataFrame, spec: JoinSpec) -> None:
        self.ordered, self.spec = ordered, spec

    def __call__(self, pairs: DataFrame) -> DataFrame:
        spec = self.spec
        side = lambda df, x: df.select(*(F.col(c).alias(x if c == "rep" else f"{c}_{x}" if c != "frag" else c) for c in df.columns))
        summaries = self.ordered.select("rep", "sizes", "sums", "xors")
        met = pairs.join(side(summaries, "a"), "a").join(side(summaries, "b"), "b")
        equal = "(sizes_a[i] = sizes_b[i] and sums_a[i] = sums_b[i] and xors_a[i] = xors_b[i])"
        each = f"sequence(0, {FRAGMENTS - 1})"
        met = met.withColumns(
            {
                "same": F.expr(f"aggregate({each}, 0, (s, i) -> s + if({equal}, sizes_a[i], 0))"),
                "most": F.expr(f"aggregate({each}, 0, (s, i) -> s + least(sizes_a[i], sizes_b[i]))"),
                "frags": F.expr(f"filter({each}, i -> not {equal} and sizes_a[i] > 0 and sizes_b[i] > 0)"),
            }
        )
        met = met.where(f"{spec.den} * most >= {spec.num} * (na + nb - most)")
        met = materialize(met.select("a", "b", "na", "nb", "same", "frags"), "met")
        asked = met.select("a", "b", F.explode("frags").alias("frag"))
        wanted = asked.selectExpr("a as rep", "frag").unionByName(asked.selectExpr("b as rep", "frag")).distinct()
        upto = "aggregate(slice(sizes, 1, frag), 0, (s, x) -> s + x)"
        segments = self.ordered.select("rep", "grams", "sizes").join(wanted, "rep").select("rep", "frag", F.expr(f"slice(grams, {upto} + 1, sizes[frag])").alias("seg"))
        segments = materialize(segments, "segments")
        partial = asked.join(side(segments, "a"), ["a", "frag"]).join(side(segments, "b"), ["b", "frag"])
        partial = partial.select("a", "b", F.size(F.array_intersect("seg_a", "seg_b")).alias("o"))
        summed = partial.groupBy("a", "b").agg(F.sum("o").alias("o"))
        found = met.join(summed, ["a", "b"], "left").withColumn("overlap", F.col("same") + F.coalesce("o", F.lit(0)))
        links = materialize(found.where(f"{spec.den} * overlap >= {spec.num} * (na + nb - overlap)").select("a", "b", "overlap"), "links")
        discard(met, segments)
        return links


def _heads(ordered: DataFrame, spec: JoinSpec) -> DataFrame:
    """``gram, salt, shares, rep, n, pos`` of the heads of sets."""
    head = F.expr(f"cast({spec.missed()} + 1 as int)")
    heads = ordered.withColumn("head", head).select("rep", "n", F.expr("slice(grams, 1, head)").alias("gram"), F.expr("slice(levels, 1, head)").alias("level"))
    heads = heads.select("rep", "n", F.posexplode(F.arrays_zip("gram", "level")).alias("pos", "g"))
    shares = F.expr(f"shiftleft(1, greatest(g.level - {HOT_LEVEL} + 1, 0))")
    heads = heads.select(F.col("g.gram").alias("gram"), shares.alias("shares"), "rep", "n", "pos")
    return heads.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int"))


def _open(named: DataFrame) -> DataFrame:
    """Rows of groups that hold several components, with the group's ``members``; counted in shares, then over them."""
    some = named.groupBy("gram", "salt").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("shares").alias("shares"), F.count(F.lit(1)).alias("members"))
    lasting = some.groupBy("gram").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("shares").alias("shares"), F.sum("members").alias("members")).where("lo < hi")
    lasting = lasting.select("gram", "members", F.explode(F.expr("sequence(0, shares - 1)")).alias("salt"))
    return named.join(lasting, ["gram", "salt"])


def jaccard_components(docs: DataFrame, spec: JoinSpec | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the least doc_id reachable by links) for every row."""
    spec = spec or JoinSpec()
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = materialize(_scan(docs, spec), "scan")
    linkable = scan.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "doc_id").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.count(F.lit(1)).alias("times"))
    classes = linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.max("f").alias("f"), F.min_by("times", "doc_id").alias("times"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    parts = int(classes.agg(F.sum("f")).first()[0] or 0) // PART + 1

    docs = docs.where("doc_id is not null")
    shared = _sums(_answers(_blocks(docs, spec, parts), parts))
    good = classes.join(shared, ["k1", "k2"], "left").where(f"coalesce(shared, 0) >= f - {spec.missed()}")
    good = materialize(good.select(F.col("least").alias("doc_id"), "k1", "k2", "rep", "times"), "good")
    drop_shuffles(docs.sparkSession)
    # at most ROUGH buckets of ids leave out most texts before they are dealt by id
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ROUGH))
    some = docs.join(F.broadcast(good.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")
    stored = materialize(_sets(some.join(good, "doc_id").select("text", "k1", "k2", "rep", "times"), spec), "sets")
    # rows that repeat a doc_id and its text
    sets = stored.where("times = 1").unionByName(stored.where("times > 1").dropDuplicates(["rep"])).drop("times")
    grams = sets.select("rep", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(f"n > {RARE}")
    counts = materialize(counts.select("gram", "n", F.ceil(F.log2("n")).cast("int").alias("level")), "counts")
    mass = {r[0]: float(r[1]) for r in counts.groupBy("level").agg(F.sum("n")).collect()}  # a row per level
    mass[0] = float(sets.agg(F.sum(F.size("grams"))).first()[0] or 0) - sum(mass.values())
    if counts.count() <= TOLD:
        rows = counts.select("gram", "level").toArrow()
        some, levels = rows.column("gram").to_numpy().view(np.uint64), rows.column("level").to_numpy().astype(np.int64)
        order = np.argsort(some)
        ordered = materialize(_ordered(sets, _pivots(mass), docs.sparkSession.sparkContext.broadcast((some[order], levels[order]))), "ordered")
    else:
        told = grams.join(counts.select("gram", "level"), "gram").groupBy("rep").agg(F.collect_list(F.struct("gram", "level")).alias("told"))
        ordered = materialize(_ordered(sets.join(told, "rep", "left"), _pivots(mass)), "ordered")
    discard(stored, counts, good)
    drop_shuffles(docs.sparkSession)

    live = _heads(ordered, spec)
    labels = classes.select(F.col("rep").alias("node"), F.col("rep").alias("label")).limit(0)
    verify, tested, links, many, old = _Verifier(ordered, spec), None, None, 1, ()
    while True:
        if links is None:
            named = live.withColumn("label", F.col("rep"))
        else:
            named = live.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        named = materialize(_open(named), "open")
        if named.isEmpty():
            break
        pairs, centres = _centre_pairs(named, spec, many)
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        new = None if pairs.isEmpty() else verify(pairs)
        if new is not None and not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            labels = materialize(components(links.select("a", "b")), "labels")
        tested = pairs if tested is None else tested.unionByName(pairs)
        left = named.drop("label", "members").join(centres, ["gram", "rep"], "left_anti")  # all pairs of a centre are known now
        live, many = materialize(left, "live"), many * GROWTH
        discard(named, *old)
        drop_shuffles(docs.sparkSession)
        old = (live,)
    linked = classes.join(labels.withColumnRenamed("node", "rep"), "rep")
    linked = linked.join(linked.groupBy("label").agg(F.min("least").alias("component_id")), "label")
    named = classes.join(linked.select("rep", "component_id"), "rep", "left").select("k1", "k2", F.coalesce("component_id", "least").alias("component_id"))
    out = scan.join(named, ["k1", "k2"], "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def oracle(spec: JoinSpec) -> str:
    """DuckDB SQL that compares all sets which share an n-gram, and follows the links."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(spec.n))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {spec.n - 2})) AS i FROM d WHERE len(w) >= {spec.n})
      UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {spec.n - 1}),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE {spec.den} * o >= {spec.num} * (na.n + nb.n - o)),
r AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) c USING (doc_id)"""
