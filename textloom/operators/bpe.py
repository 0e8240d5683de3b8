"""Byte-level BPE: pre-tokens, pair counts, training, encoding and decoding.

Words are written as hex bytes in delimiters, ``«74»«68»``: a merge is then a plain text
replacement, which is greedy from the left and never overlaps, and hex strings sort like the
bytes they stand for.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import discard, lean, materialize, ship, unused
from textloom.sources.files import filesystem

#: Fixed value: the public pattern of pre-tokens.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of distinct pre-tokens that the driver may hold for training; above, merges are Spark jobs over blocks of words.
DRIVER_BYTES = 16 << 20


def split_specials(text: Column, specials: Sequence[str]) -> Column:
    """Pieces of a text between special tokens, which stay as pieces of their own; the longest special wins."""
    if not specials:
        return F.array(text)
    ordered = sorted(specials, key=len, reverse=True)
    if not any(a != b and a in b for a in ordered for b in ordered):
        any_of = "|".join("\\Q" + s + "\\E" for s in ordered)
        return F.filter(F.split(text, f"(?={any_of})|(?<={any_of})"), lambda p: p != "")
    cut = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")")

    @F.pandas_udf(returnType=T.ArrayType(T.StringType()))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: [p for p in cut.split(s) if p])

    return pieces(text)


def pretokens(text: Column, specials: Sequence[str] = ()) -> Column:
    """Pre-tokens of a text in order; special tokens stay whole."""
    text = F.coalesce(text, F.lit(""))
    words = lambda p: F.regexp_extract_all(p, F.lit("(?U)(" + PATTERN + ")"), F.lit(1))
    if not specials:
        return words(text)
    return F.flatten(F.transform(split_specials(text, specials), lambda p: F.when(p.isin(*specials), F.array(p)).otherwise(words(p))))


def pretoken_counts(docs: DataFrame, text: str = "text", specials: Sequence[str] = ()) -> DataFrame:
    """``pretoken, n``, by partial counts."""
    return docs.select(F.explode(pretokens(F.col(text), specials)).alias("pretoken")).groupBy("pretoken").agg(F.count(F.lit(1)).alias("n"))


def file_pretoken_counts(spark: SparkSession, paths: str | Sequence[str], end: str) -> tuple[DataFrame, int]:
    """``pretoken, n`` of text files whose documents an end mark parts, and the number of end marks.

    Spark's reader splits files at the mark wherever blocks begin, carrying over what a block cuts; nothing holds a whole file.
    """
    pieces = spark.read.option("lineSep", end).text(paths if isinstance(paths, str) else list(paths))
    pieces = pieces.select("value", F.input_file_name().alias("file"))
    rows = pieces.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    marks = 0
    for r in rows.toLocalIterator():  # a row per file
        marks += r["n"] - 1 + _ends_with(r["file"], end.encode())
    return pretoken_counts(pieces, "value"), marks


def _ends_with(uri: str, end: bytes) -> bool:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as file:
        size = file.size()
        return size >= len(end) and file.read_at(len(end), size - len(end)) == end


def as_word(pretoken: Column) -> Column:
    """``«xx»`` for each UTF-8 byte."""
    return F.regexp_replace(F.lower(F.hex(pretoken.cast("binary"))), "(..)", "«$1»")


def pair_counts(words: DataFrame) -> DataFrame:
    """``left, right, n`` of neighbouring tokens, weighted by the words' counts; ``aaa`` has two pairs."""
    tokens = F.split(F.regexp_replace("word", "^«|»$", ""), "»«")
    pairs = F.transform(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda x, i: F.struct(F.element_at("t", i + 1).alias("left"), x.alias("right")))
    exploded = words.select("n", tokens.alias("t")).select("n", F.explode(pairs).alias("p"))
    return exploded.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def best_pair(counts: DataFrame) -> tuple[str, str, int] | None:
    """The most frequent pair; of equals, the greatest left, then right, in bytes."""
    row = counts.agg(F.max(F.struct("n", "left", "right")).alias("m")).first()["m"]
    return None if row is None else (row["left"], row["right"], row["n"])


def apply_merge(words: DataFrame, left: str, right: str) -> DataFrame:
    return words.withColumn("word", F.replace("word", F.lit(f"«{left}»«{right}»"), F.lit(f"«{left}{right}»")))


def safe_merges(top: Sequence[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """Those of the most frequent pairs, in order, that come next one after the other whatever the merges before do.

    A merge changes only the counts of pairs that share a token with it, and a pair that it
    makes is no more frequent than such a one. So all pairs before the first that shares a token with
    an earlier one are next, as long as they are more frequent than it. A list that was cut off may go on with any.
    """
    out: list[tuple[str, str, int]] = []
    touched: set[str] = set()
    bound = top[-1][2] if top else 0
    for left, right, n in top:
        if left in touched or right in touched:
            bound = n
            break
        out.append((left, right, n))
        touched |= {left, right}
    return [(left, right) for k, (left, right, n) in enumerate(out) if not k or n > bound]


#: Tokens of a block of words in distributed training (an Arrow batch has up to a thousand blocks), and changes of counts that a task adds up at a time.
BLOCK_TOKENS, HELD_CODES = 1 << 14, 1 << 20
_ROUND = "words binary, n binary, left string, right string, delta long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words laid end to end with a mark after each, and their counts, in blocks."""
    tokens, counts, size = [], [], 0
    for batch in batches:
        words, n = batch.column("pretoken").to_pylist(), batch.column("n").to_numpy()
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            token = np.full(int(lengths.sum()) + len(some), -1, np.int32)
            word = np.repeat(np.arange(len(some)), lengths)
            token[np.arange(len(word)) + word] = np.frombuffer(b"".join(some), np.uint8)
            tokens.append(token)
            counts.append(n[at : at + len(some)])
            size += len(token)
            if size >= BLOCK_TOKENS:
                yield np.concatenate(tokens), np.concatenate(counts)
                tokens, counts, size = [], [], 0
    if tokens:
        yield np.concatenate(tokens), np.concatenate(counts)


def _codes(token: np.ndarray, weight: np.ndarray, begins: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs that begin at some places, and their counts."""
    begins = begins[(begins >= 0) & (begins < len(token) - 1)]
    begins = begins[(token[begins] >= 0) & (token[begins + 1] >= 0)]
    return _summed(token[begins].astype(np.int64) << 32 | token[begins + 1], sign * weight[begins])


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, where, values)
    return codes, sums


def _merged_block(token: np.ndarray, n: np.ndarray, merges: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A block after some merges ``left, right, new``, and what they do to the counts of pairs."""
    weight = n[np.cumsum(token == -1) - (token == -1)]
    found = []
    for left, right, new in merges:
        at = _apart(np.flatnonzero((token[:-1] == left) & (token[1:] == right)))
        if not len(at):
            continue
        found.append(_codes(token, weight, np.unique(np.concatenate([at - 1, at, at + 1])), -1))
        token[at] = new
        kept = np.ones(len(token), bool)
        kept[at + 1] = False
        token, weight = token[kept], weight[kept]
        now = at - np.arange(len(at))
        found.append(_codes(token, weight, np.unique(np.concatenate([now - 1, now])), 1))
    return token, found


def _round_rows(blocks: Iterator[tuple[np.ndarray, np.ndarray]], merges: Sequence[tuple[int, int, int]] | None, known: Sequence[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of _ROUND: the blocks after some merges (None: as they are, with all pairs counted), then the task's changes of counts."""
    schema = pa.schema([("words", pa.binary()), ("n", pa.binary()), ("left", pa.string()), ("right", pa.string()), ("delta", pa.int64())])
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for token, n in blocks:
        if merges is None:
            found = [_codes(token, n[np.cumsum(token == -1) - (token == -1)], np.arange(len(token) - 1), 1)]
        else:
            token, found = _merged_block(token, n, merges)
        held += found
        size += sum(len(c) for c, _ in found)
        if size > HELD_CODES:
            held = [_summed(*map(np.concatenate, zip(*held)))]
            size = 0
        yield pa.RecordBatch.from_pylist([{"words": token.astype("<i4").tobytes(), "n": n.astype("<i8").tobytes()}], schema=schema)
    codes, sums = _summed(*map(np.concatenate, zip(*held)))
    rows = [{"left": known[c >> 32].hex(), "right": known[c & 0xFFFFFFFF].hex(), "delta": x} for c, x in zip(codes.tolist(), sums.tolist()) if x]
    for at in range(0, len(rows), 10000):
        yield pa.RecordBatch.from_pylist(rows[at : at + 10000], schema=schema)


def train_distributed(counts: DataFrame, merges: int, every: int = 64, look: int = 256) -> list[tuple[bytes, bytes]]:
    """The first merges over a table of any size. Words are stored as blocks of tokens and pairs counted once; from then on a round is one pass over the blocks.

    A round merges as many of the most frequent pairs as are sure to follow each other, ``every`` at most; each task adds up what that does to its
    counts, and the sums are added to the totals. Only the pairs looked at reach the driver; a task holds one block.
    """
    ship(counts.sparkSession)
    known = [bytes([b]) for b in range(256)]
    number = {t: i for i, t in enumerate(known)}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _round_rows(_packed(batches), None, known)

    words = counts.select(F.col("pretoken").cast("binary").alias("pretoken"), "n")
    state = materialize(words.mapInArrow(lean(first), _ROUND), "words")
    totals, out = None, []
    while len(out) < merges:
        delta = state.where("left is not null").select("left", "right", F.col("delta").alias("n"))
        before = totals
        totals = delta if before is None else before.unionByName(delta)
        totals = materialize(totals.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"), "totals")
        discard(before)
        found = totals.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(look).collect()
        chosen = safe_merges([(r["left"], r["right"], r["n"]) for r in found])[: min(every, merges - len(out))]
        if not chosen:
            break
        steps = []
        for left, right in ((bytes.fromhex(a), bytes.fromhex(b)) for a, b in chosen):
            out.append((left, right))
            if left + right not in number:  # one token can come of several pairs
                number[left + right] = len(known)
                known.append(left + right)
            steps.append((number[left], number[right], number[left + right]))
        if len(out) == merges:
            break

        def merge(batches: Iterator[pa.RecordBatch], steps=steps, known=list(known)) -> Iterator[pa.RecordBatch]:
            blocks = ((np.frombuffer(w, "<i4").copy(), np.frombuffer(n, "<i8")) for batch in batches for w, n in zip(batch.column("words"), batch.column("n")) for w, n in [(w.as_py(), n.as_py())])
            yield from _round_rows(blocks, steps, known)

        old = state
        state = materialize(old.where("words is not null").select("words", "n").mapInArrow(lean(merge), _ROUND), "words")
        discard(old)
    discard(totals, state)
    return out


def train_local(counts: Mapping[bytes, int], merges: int) -> list[tuple[bytes, bytes]]:
    """The same merges over a table of words in memory."""
    words = list(counts)
    return _train_arrays(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)), np.fromiter((counts[w] for w in words), np.int64, len(words)), merges)


def _train_arrays(data: np.ndarray, lengths: np.ndarray, n: np.ndarray, merges: int) -> list[tuple[bytes, bytes]]:
    """All words laid end to end as one array of tokens, with a mark between them. A merge is a scan; only the pairs beside its places are counted anew."""
    token = np.full(len(data) + len(lengths), -1, np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    token[np.arange(len(data)) + word] = data
    weight = np.repeat(n, lengths + 1)
    known = [bytes([b]) for b in range(256)]
    totals: dict[int, int] = {}
    heap: list[_Entry] = []

    def count(begins: np.ndarray, sign: int, changed: set[int]) -> None:
        """Add the pairs that begin at some places."""
        begins = begins[(begins >= 0) & (begins < len(token) - 1)]
        begins = begins[(token[begins] >= 0) & (token[begins + 1] >= 0)]
        codes, where = np.unique(token[begins] << 32 | token[begins + 1], return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, where, weight[begins])
        for code, total in zip(codes.tolist(), sums.tolist()):
            totals[code] = totals.get(code, 0) + sign * total
            changed.add(code)

    def push(changed: set[int]) -> None:
        for code in changed:
            if totals[code] > 0:
                heappush(heap, _Entry(totals[code], (known[code >> 32], known[code & 0xFFFFFFFF]), code))
            else:
                del totals[code]

    changed: set[int] = set()
    count(np.arange(len(token) - 1), 1, changed)
    push(changed)
    out = []
    while heap and len(out) < merges:
        entry = heappop(heap)
        if totals.get(entry.code, 0) != entry.n:  # counted anew since
            continue
        out.append(entry.pair)
        left, right = entry.code >> 32, entry.code & 0xFFFFFFFF
        at = _apart(np.flatnonzero((token[:-1] == left) & (token[1:] == right)))
        changed = set()
        count(np.unique(np.concatenate([at - 1, at, at + 1])), -1, changed)
        token[at] = len(known)
        known.append(entry.pair[0] + entry.pair[1])
        kept = np.ones(len(token), bool)
        kept[at + 1] = False
        token, weight = token[kept], weight[kept]
        now = at - np.arange(len(at))
        count(np.unique(np.concatenate([now - 1, now])), 1, changed)
        push(changed)
    return out


def _apart(at: np.ndarray) -> np.ndarray:
    """Of sorted places of a pair those that merge from the left: in a run of neighbours every second one."""
    if len(at) < 2:
        return at
    begins = np.concatenate([[True], np.diff(at) > 1])
    first = at[begins][np.cumsum(begins) - 1]
    return at[(at - first) % 2 == 0]


@dataclass(slots=True)
class _Entry:
    """A pair's count in the heap: the most frequent comes first, of equals the greatest."""

    n: int
    pair: tuple[bytes, bytes]
    code: int = 0

    def __lt__(self, other: _Entry) -> bool:
        return (self.n, self.pair) > (other.n, other.pair)


def merge_once(tokens: list[bytes], pair: tuple[bytes, bytes]) -> list[bytes]:
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) == pair:
            out.append(tokens[i] + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


#: Words of more characters are merged one by one (by a heap), shorter ones together; the ids are the same.
LONG_WORD = 64


class _WordArrays:
    """Many words merged at once. In a round every word merges its pair of least rank, of equals the first, at all its places; a word without one is done."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        ids = tokenizer.ids
        self.base = np.array([ids.get(bytes([b]), -1 - b) for b in range(256)], np.int64)  # a byte that isn't a token is an error only where it stays one
        number = dict(ids) | {bytes([b]): int(self.base[b]) for b in range(256)}
        missing: dict[bytes, int] = {}
        for pair in tokenizer.rank:
            for t in pair:
                if t not in number and t not in missing:
                    missing[t] = -1000 - len(missing)
        number |= missing
        pairs = sorted((self._code(np.int64(number[a]), np.int64(number[b])), r) for (a, b), r in tokenizer.rank.items())
        self.codes = np.array([c for c, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r in pairs], np.int64)

    @staticmethod
    def _code(left, right):
        return (left + (1 << 20)) << 32 | (right + (1 << 20))

    def merged(self, words: Sequence[bytes]) -> list[list[int]]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        token = self.base[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_tokens, done_words = [token[:0]], [word[:0]]
        while len(token) > 1 and len(self.codes):
            code = self._code(token[:-1], token[1:])
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = (self.codes[at] == code) & (word[1:] == word[:-1])
            places = np.flatnonzero(known)
            if not len(places):
                break
            rank, owner = self.ranks[at[places]], word[places]
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            group = np.cumsum(np.concatenate([[False], owner[1:] != owner[:-1]]))
            least = rank == np.minimum.reduceat(rank, begins)[group]
            places, rank, group = places[least], rank[least], group[least]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            same = code[places] == code[places[first]][group]
            places, rank = places[same], rank[same]
            begins = np.concatenate([[True], np.diff(places) > 1])
            odd = (places - places[begins][np.cumsum(begins) - 1]) % 2 == 1
            places, rank = places[~odd], rank[~odd]
            token[places] = rank
            kept = np.ones(len(token), bool)
            kept[places + 1] = False
            going = np.zeros(len(words), bool)
            going[owner] = True
            active = going[word]
            over = ~active
            done_tokens.append(token[over])
            done_words.append(word[over])
            kept &= active
            token, word = token[kept], word[kept]
        tokens, owners = np.concatenate([*done_tokens, token]), np.concatenate([*done_words, word])
        tokens = tokens[np.argsort(owners, kind="stable")]
        if len(tokens) and tokens.min() < 0:
            raise KeyError("a text has a byte that the vocabulary has no token for")
        ends = np.cumsum(np.bincount(owners, minlength=len(words))).tolist()
        flat = tokens.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def merge_word(tokens: list[bytes], rank: Mapping[tuple[bytes, bytes], int]) -> list[bytes]:
    """Merge the pair of least rank, of equals the first, at all its places from the left, until no pair has a rank.

    Tokens are a linked list and the places of pairs a heap, so a word of n bytes takes n log n steps.
    """
    n = len(tokens)
    if n < 2:
        return tokens
    text: list[bytes | None] = list(tokens)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank[p], k) for k, p in enumerate(zip(tokens, tokens[1:])) if p in rank]
    heapify(heap)

    def pair(k: int) -> tuple[bytes, bytes] | None:
        return (text[k], text[after[k]]) if text[k] is not None and after[k] < n else None

    while heap:
        least, first = heap[0]
        best = pair(first)
        if best is None or rank.get(best) != least:
            heappop(heap)
            continue
        places, others = [], []
        while heap and heap[0][0] == least:
            k = heappop(heap)[1]
            (places if pair(k) == best else others).append(k)
        made = []
        for k in places:
            if pair(k) == best:
                text[k], gone = best[0] + best[1], after[k]
                text[gone] = None
                after[k] = after[gone]
                if after[k] < n:
                    before[after[k]] = k
                made.append(k)
        for k in {j for k in made for j in (before[k], k) if j >= 0}:
            if (p := pair(k)) in rank:
                heappush(heap, (rank[p], k))
        for k in others:
            if (p := pair(k)) is not None and rank.get(p) == least:
                heappush(heap, (least, k))
    return [t for t in text if t is not None]


def train(counts: DataFrame, vocab_size: int, specials: Sequence[str] = ()) -> Tokenizer:
    """Vocabulary of bytes, specials and merges. A table of distinct words that is small enough is merged on the driver."""
    counts = counts.where(~F.col("pretoken").isin(*specials)) if specials else counts
    merges = max(0, vocab_size - 256 - len(specials))
    counts = materialize(counts, "pretokens")
    if (counts.agg(F.sum(F.octet_length("pretoken") + 1)).first()[0] or 0) <= DRIVER_BYTES:
        rows = counts.select(F.col("pretoken").cast("binary").alias("word"), F.octet_length("pretoken").alias("length"), "n").toArrow()
        data = np.frombuffer(b"".join(rows.column("word").to_pylist()), np.uint8)
        found = _train_arrays(data, rows.column("length").to_numpy().astype(np.int64), rows.column("n").to_numpy(), merges)
    else:
        found = train_distributed(counts, merges)
    discard(counts)
    vocab = {i: bytes([i]) for i in range(256)} | {256 + i: s.encode() for i, s in enumerate(specials)}
    for left, right in found:
        vocab[len(vocab)] = left + right
    return Tokenizer(vocab, found, list(specials))


@dataclass
class Tokenizer:
    """Token bytes by id, merges in order, special tokens. A merge's priority is the id of its result."""

    vocab: dict[int, bytes]
    merges: list[tuple[bytes, bytes]]
    specials: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        known = set(self.vocab.values())
        for s in self.specials:
            if s.encode() not in known:
                self.vocab[max(self.vocab, default=-1) + 1] = s.encode()
        self.ids = {t: i for i, t in self.vocab.items()}
        self.rank = {pair: self.ids[pair[0] + pair[1]] for pair in self.merges if pair[0] + pair[1] in self.ids}
        ordered = sorted(self.specials, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self._words = regex.compile(PATTERN)
        self._memo: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        found = self._memo.get(word)
        if found is None:
            found = [self.ids[t] for t in merge_word([bytes([b]) for b in word.encode()], self.rank)]
            if len(self._memo) < 500_000:
                self._memo[word] = found
        return found

    def words_ids(self, words: Sequence[str]) -> list[Sequence[int]]:
        """Ids of distinct pre-tokens, and of special tokens: what isn't remembered is merged all at once, but for long words."""
        out: list[Sequence[int] | None] = [self._memo.get(w) for w in words]
        new = [k for k, ids in enumerate(out) if ids is None and len(words[k]) <= LONG_WORD and words[k] not in self.specials]
        for k, ids in zip(new, self._arrays.merged([words[k].encode() for k in new])):
            out[k] = ids
            if len(self._memo) < 500_000:
                self._memo[words[k]] = ids
        return [([self.ids[w.encode()]] if w in self.specials else self._word(w)) if ids is None else ids for w, ids in zip(words, out)]

    @functools.cached_property
    def _arrays(self) -> _WordArrays:
        return _WordArrays(self)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self._cut.split(text) if self._cut else [text]:
            if piece in self.specials:
                out.append(self.ids[piece.encode()])
            else:
                for word in self._words.findall(piece):
                    out += self._word(word)
        return out

    def encode_iterable(self, texts: Iterator[str]) -> Iterator[int]:
        """Ids of one text after the other; nothing merges across texts."""
        for text in texts:
            yield from self.encode(text)

    def decode(self, ids: Sequence[int]) -> str:
        """Unknown ids raise KeyError; broken UTF-8 becomes replacement characters."""
        return b"".join(self.vocab[i] for i in ids).decode("utf-8", errors="replace")

    def longest(self) -> tuple[int, bytes]:
        """The longest token; of equals, the least id."""
        return min(self.vocab.items(), key=lambda x: (-len(x[1]), x[0]))


_workers: dict[str, Tokenizer] = {}


def _kept(key: str, shared) -> Tokenizer:
    """The worker's tokenizer of a broadcast, with the words that it remembers from earlier tasks."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = Tokenizer(*shared.value)
    return _workers[key]


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each text. Of a batch's pre-tokens each distinct one is encoded once, and workers remember the words they have encoded.

    Pre-tokens are cut in the JVM and laid out as ids by array operations, so no Python runs per token and nothing is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, key = spark.sparkContext.broadcast((tokenizer.vocab, tokenizer.merges, tokenizer.specials)), uuid.uuid4().hex
    words = unused(docs, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _kept(key, shared)
        for batch in batches:
            lists = batch.column(words)
            coded = lists.flatten().dictionary_encode()
            known = own.words_ids(coded.dictionary.to_pylist())
            ids = laid_out(coded.indices.to_numpy(zero_copy_only=False), known, lists.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], out])

    cut = docs.withColumn(words, pretokens(F.col(text), tokenizer.specials))
    return cut.mapInArrow(lean(run), T.StructType([*docs.schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def laid_out(codes: np.ndarray, known: Sequence[Sequence[int]], counts: np.ndarray) -> pa.ListArray:
    """Lists of ids: the words of each list (``counts`` of them) by their codes, each as the ids that are known of it."""
    sizes = np.array([len(x) for x in known] or [0], np.int64)
    flat = np.array([i for x in known for i in x], np.int32)
    each = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(each)])
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    at = np.repeat(begins[codes] - ends[:-1], each) + np.arange(ends[-1]) if len(codes) else np.zeros(0, np.int64)
    offsets = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[at], pa.int32()))


def decode(rows: DataFrame, tokenizer: Tokenizer, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of ids."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            found = [b"".join(vocab[i] for i in x or []).decode("utf-8", errors="replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema, T.StructField(out, T.StringType())]))
