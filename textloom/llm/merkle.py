"""Merkle manifest of a data set: a tree of hashes per group, a tree over the groups' roots, and a proof for every row.

A node is H of its children, H being SHA-256 of their lower-case hex digests laid end to end. Every two consecutive nodes of a level have a
parent, a last node without a neighbour too, until one node remains; a lone leaf is its own root.

Built bottom-up. Leaves are range-sorted by group and order; counts per range and group give each range's place in
its groups (``ranges``). A task builds the complete aligned subtrees of its range: nodes all of whose leaves it has. What it
can't finish are at most two nodes a level at its edges; these ragged nodes are dealt by the coordinate of the block of the tree they are in, and
each block finishes its own levels. A block spans 2^BLOCK_BITS ranges, its top goes to the next round with the others', so the number of rounds is
the logarithm of the number of ranges. The groups' roots are the leaves of a tree of the same make. At last each range gets
what is above its subtrees and returns every leaf's proof.

Scale: what moves between tasks is a leaf's digest and key, and the ragged nodes (the ranges times the logarithm of their rows); a
large group is many ranges, and equal rows are split like others. Nothing but the size of the largest group reaches the driver. A task holds
the digests of its range (``ranges.RANGE_ROWS``) and writes proofs in small batches.

Defined results: nulls are ``-`` in a leaf, an empty text is ``0:``; very long texts are hashed whole; a null group is a group
of its own and comes first; leaves without an id come first, ties go by the leaf, and equal leaves are leaves of their own; an
empty table has no proofs; columns that aren't named in a leaf are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import ranges
from textloom.session import materialize, ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block of the tree spans so many ranges (as a power of two).
BLOCK_BITS = 6
#: Where a sibling stands; a node without one is hashed alone.
LEFT, NONE, RIGHT = -1, 0, 1
STEP = "struct<side: tinyint, digest: binary>"
PROOF_ROWS = 2048


def field(value: Column) -> Column:
    """A value in a leaf: its length in bytes, a colon and itself, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def parent(children: Sequence[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def complete(first: int, leaves: list[bytes], of: int) -> list[tuple[int, list[bytes]]]:
    """Per level the index of the first complete node and the complete nodes, over ``leaves`` from ``first`` on of a group of ``of``."""
    out = [(first, leaves)]
    while of > 1:
        lo, nodes = out[-1]
        own = nodes[lo % 2 :]
        if len(own) % 2 and lo + len(nodes) < of:
            own = own[:-1]
        if not own:
            break
        out.append(((lo + 1) // 2, [parent(own[k : k + 2]) for k in range(0, len(own), 2)]))
        of = (of + 1) // 2
    return out


def ragged(levels: list[tuple[int, list[bytes]]]) -> list[tuple[int, int]]:
    """Level and index of the complete nodes whose parents aren't complete."""
    out = []
    for level, (lo, nodes) in enumerate(levels):
        up, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        out += [(level, k) for k in sorted({lo, lo + len(nodes) - 1}) if not up <= k // 2 < up + len(above)]
    return out


def climb(nodes: dict[tuple[int, int], bytes], of: int, top: int) -> tuple[tuple[int, int, bytes], dict[tuple[int, int], list[tuple[int, bytes]]]]:
    """Finish the block that ``nodes`` fill: its top, and the steps from each node to it. ``top`` is the block's level, or the root's where that is lower."""
    known, steps = dict(nodes), {}
    level = min(level for level, _ in nodes)
    top = min(top, (of - 1).bit_length())
    while level < top:
        width = -(-of >> level)
        for k in sorted(k for at, k in known if at == level and k % 2 == 0):
            pair = [known[level, k]]
            if k + 1 < width:
                pair.append(known[level, k + 1])
                steps[level, k + 1] = (LEFT, pair[0])
            steps[level, k] = (RIGHT, pair[1]) if len(pair) == 2 else (NONE, b"")
            known[level + 1, k // 2] = parent(pair)
        level += 1
    paths = {}
    for at, k in nodes:
        paths[at, k] = [steps[at + up, k >> up] for up in range(max(0, top - at))]
    (at, k) = next(iter(nodes))
    end = (max(at, top), k >> max(0, top - at))
    return (*end, known[end]), paths


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches))


def _groups(rows: pa.Table) -> Iterator[tuple[int, int]]:
    """First and last row of each group's run in sorted rows."""
    names = rows.column("group").to_pylist()
    begin = 0
    for k in range(1, len(names) + 1):
        if k == len(names) or names[k] != names[begin]:
            yield begin, k
            begin = k


def _local(rows: pa.Table) -> Iterator[tuple[int, int, str, int, list[tuple[int, list[bytes]]]]]:
    leaves = rows.column("leaf").to_pylist()
    for begin, end in _groups(rows):
        of = rows.column("of")[begin].as_py()
        yield begin, end, rows.column("group")[begin].as_py(), of, complete(rows.column("index")[begin].as_py(), leaves[begin:end], of)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ragged nodes of a range."""
    rows = _whole(batches).sort_by("at")
    made = []
    for begin, _, group, of, levels in _local(rows):
        for level, k in ragged(levels):
            made.append({"part": rows.column("part")[begin].as_py(), "group": group, "of": of, "level": level, "index": k, "digest": levels[level][1][k - levels[level][0]]})
    schema = pa.schema([("part", pa.int64()), ("group", pa.string()), ("of", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary())])
    for k in range(0, len(made), PROOF_ROWS):
        yield pa.RecordBatch.from_pylist(made[k : k + PROOF_ROWS], schema=schema)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps from each ragged node of a block to the block's top."""
    rows = _whole(batches).to_pylist()
    end, paths = climb({(r["level"], r["index"]): r["digest"] for r in rows}, rows[0]["of"], rows[0]["top_level"])
    made = []
    for r in rows:
        path = [{"side": side, "digest": digest} for side, digest in paths[r["level"], r["index"]]]
        made.append({"group": r["group"], "of": r["of"], "level": r["level"], "index": r["index"], "path": path, "up_level": end[0], "up_index": end[1], "top": end[2]})
    step = pa.struct([("side", pa.int8()), ("digest", pa.binary())])
    schema = pa.schema([("group", pa.string()), ("of", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("path", pa.list_(step)), ("up_level", pa.int32()), ("up_index", pa.int64()), ("top", pa.binary())])
    for k in range(0, len(made), PROOF_ROWS):
        yield pa.RecordBatch.from_pylist(made[k : k + PROOF_ROWS], schema=schema)


class _Proofs:
    """Proofs of consecutive leaves as one Arrow list array."""

    def __init__(self) -> None:
        self.sides: list[np.ndarray] = []
        self.digests: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.rows = 0

    def add(self, sides: np.ndarray, digests: np.ndarray) -> None:
        """``sides`` is leaves by levels, ``digests`` leaves by levels by 32 bytes."""
        self.sides.append(sides.ravel())
        self.digests.append(digests.reshape(-1, 32)[sides.ravel() != NONE])
        self.sizes.append(np.full(len(sides), sides.shape[1], np.int32))
        self.rows += len(sides)

    def take(self) -> pa.Array:
        sides, data, sizes = np.concatenate(self.sides), np.concatenate(self.digests), np.concatenate(self.sizes)
        ends = np.concatenate([[0], np.cumsum(32 * (sides != NONE))]).astype(np.int32)
        digests = pa.Array.from_buffers(pa.binary(), len(sides), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
        steps = pa.StructArray.from_arrays([pa.array(sides, pa.int8()), digests], names=["side", "digest"])
        self.__init__()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), steps)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's leaves, and what is above its subtrees, as the leaves with their proofs, in small batches."""
    both = _whole(batches)
    is_leaf = both.column("level").is_null()
    above = {(r["group"], r["level"], r["index"]): r for r in both.filter(pc.invert(is_leaf)).select(["group", "level", "index", "path", "top", "root"]).to_pylist()}
    rows = both.filter(is_leaf).sort_by("at")
    kept, proofs, tops, roots, done = rows.column("row"), _Proofs(), [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal done, tops, roots
        n = proofs.rows
        own = kept.slice(done, n).combine_chunks()
        own = own if isinstance(own, pa.Array) else own.chunk(0)
        out = pa.RecordBatch.from_arrays([own, proofs.take(), pa.array(tops, pa.binary()), pa.array(roots, pa.binary())], names=["row", "proof", "subroot", "root"])
        done, tops, roots = done + n, [], []
        return out

    for _, _, group, of, levels in _local(rows):
        grids = [np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, 32) for _, nodes in levels]
        for level, k in sorted(ragged(levels), key=lambda x: x[1] << x[0]):
            up = above[group, level, k]
            up_sides = np.array([s["side"] for s in up["path"]], np.int8)
            up_digests = np.frombuffer(b"".join(s["digest"].ljust(32, b"\0") for s in up["path"]), np.uint8).reshape(-1, 32)
            stop = min((k + 1) << level, of)
            for begin in range(k << level, stop, PROOF_ROWS):
                leaves = np.arange(begin, min(begin + PROOF_ROWS, stop))
                sides = np.zeros((len(leaves), level + len(up_sides)), np.int8)
                digests = np.zeros((len(leaves), level + len(up_sides), 32), np.uint8)
                for at in range(level):
                    node = leaves >> at
                    there = (node ^ 1) < -(-of >> at)
                    sides[:, at] = np.where(node % 2 == 1, LEFT, np.where(there, RIGHT, NONE))
                    digests[there, at] = grids[at][(node ^ 1)[there] - levels[at][0]]
                sides[:, level:], digests[:, level:] = up_sides, up_digests
                proofs.add(sides, digests)
                tops += [up["top"]] * len(leaves)
                roots += [up["root"]] * len(leaves)
                if proofs.rows >= PROOF_ROWS:
                    yield flush()
    if proofs.rows:
        yield flush()


def _trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves of ``row, group, place, leaf`` with their indexes, and ``part, group, level, index, path, top`` of every range's subtrees."""
    leaves = materialize(leaves, "leaves")
    ordered = materialize(ranges.in_ranges(leaves, "group", ["place", "leaf"], leaves.count()), "ranges")
    found = materialize(ranges.runs(ordered, "group"), "runs")
    placed = ordered.withColumn("part", ranges.part()).join(found, ["part", "group"]).withColumn("index", ranges.index())
    columns = ["part", "group", "at", "leaf", "index", "of"]
    edges = placed.select(columns).groupBy("part").applyInArrow(_edges, "part long, group string, of long, level int, index long, digest binary")
    edges = materialize(edges, "edges")
    rows, parts, most = found.agg(F.sum("n"), F.countDistinct("part"), F.max("of")).first()
    bits = (max(1, (rows or 0) // max(1, parts)) - 1).bit_length() + BLOCK_BITS
    nodes, paths = edges.drop("part"), None
    while True:
        top = F.greatest(F.col("level"), F.lit(bits))
        block = F.expr(f"shiftright(index, greatest({bits} - level, 0))")
        dealt = nodes.select("*", top.cast("int").alias("top_level"), block.alias("block")).groupBy("group", "top_level", "block")
        steps = dealt.applyInArrow(_block, f"group string, of long, level int, index long, path array<{STEP}>, up_level int, up_index long, top binary")
        steps = materialize(steps, "blocks")
        if paths is None:
            paths = steps
        else:
            more = steps.select("group", F.col("level").alias("up_level"), F.col("index").alias("up_index"), F.col("path").alias("more"), F.col("up_level").alias("l"), F.col("up_index").alias("i"), F.col("top").alias("t"))
            paths = paths.join(more, ["group", "up_level", "up_index"])
            paths = paths.select("group", "level", "index", F.concat("path", "more").alias("path"), F.col("l").alias("up_level"), F.col("i").alias("up_index"), F.col("t").alias("top"))
        if (most or 0) <= 1 << bits:
            break
        nodes = steps.select("group", "of", F.col("up_level").alias("level"), F.col("up_index").alias("index"), F.col("top").alias("digest")).distinct()
        bits += BLOCK_BITS
    paths = edges.select("part", "group", "level", "index").join(paths.select("group", "level", "index", "path", "top"), ["group", "level", "index"])
    return placed, materialize(paths, "paths")


def _with_proofs(placed: DataFrame, paths: DataFrame) -> DataFrame:
    inner = ["part", "group", "at", "leaf", "index", "of"]
    both = placed.select(*inner, "row", F.lit(None).cast("int").alias("level"))
    both = both.unionByName(paths.select("part", "group", "level", "index", "path", "top", "root"), allowMissingColumns=True)
    schema = T.StructType([both.schema["row"], *T.StructType.fromDDL(f"proof array<{STEP}>, subroot binary, root binary")])
    return both.groupBy("part").applyInArrow(_prove, schema)


def prove(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``proof`` (steps from the leaf up: side and digest of the sibling), ``subroot`` and ``root`` to rows with a ``leaf``.

    ``group`` names the column whose values have trees of their own, ``order`` those that order the leaves in it; columns of the new names are replaced.
    """
    ship(leaves.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null has a name too, before all others
    row = F.struct(*(F.col(f"`{c}`") for c in leaves.columns if c.lower() not in ("proof", "subroot", "root")))
    placed, paths = _trees(leaves.select(row.alias("row"), key.alias("group"), F.struct(*(F.col(f"`{c}`") for c in order)).alias("place"), "leaf"))
    roots = paths.select(F.col("group").alias("name"), F.col("top").alias("leaf")).distinct()
    over, ends = _trees(roots.select(F.struct("name").alias("row"), F.lit("").alias("group"), F.struct("name").alias("place"), "leaf"))
    upper = _with_proofs(over, ends.withColumn("root", F.col("top")))
    upper = materialize(upper.select(F.col("row.name").alias("group"), F.col("proof").alias("upper"), "root"), "upper")
    paths = paths.join(upper, "group").select("part", "group", "level", "index", F.concat("path", "upper").alias("path"), "top", "root")
    return _with_proofs(placed, paths).select("row.*", "proof", "subroot", "root")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, lang, leaf`` of documents; with ``tampered``, which rows are changed, also ``changed``, their leaf with one more of n_chars."""
    out = [F.col("doc_id"), F.col("lang"), leaf_digest(*map(F.col, FIELDS)).alias("leaf")]
    if tampered is not None:
        more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
        out.append(F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(*(more.get(c, F.col(c)) for c in FIELDS))).alias("changed"))
    return docs.select(*out)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def fold(leaf: Column, proof: Column) -> Column:
    """The root, as lower-case hex, that a leaf's hex digest and the steps of its proof lead to."""

    def up(below: Column, step: Column) -> Column:
        other = hexed(step["digest"])
        return F.sha2(F.when(step["side"] == LEFT, F.concat(other, below)).when(step["side"] == RIGHT, F.concat(below, other)).otherwise(below).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings' hex digests in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: hexed(s["digest"])), "").cast("binary"), 256)


def verify(proved: DataFrame, leaf: Column) -> DataFrame:
    """Add ``folded_root`` from another leaf digest and the rows' proofs, and ``verified``."""
    folded = proved.withColumn("folded_root", fold(hexed(leaf), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == hexed(F.col("root")))


#: CRC-32 of a short ASCII string in SQL: the reflected polynomial is a fixed value.
def _crc32(text: str) -> str:
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: {step})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {byte}), 4294967295)"


def oracle(modulus: int = 7) -> str:
    """DuckDB SQL of the query's rows."""
    one = lambda e: f"coalesce(strlen({e})::VARCHAR || ':' || {e}, '-')"
    text = lambda n: " || ".join(one(e) for e in ("doc_id::VARCHAR", "source", "lang", n, "text"))
    levels = lambda t, first: f"""{t} AS ({first} UNION ALL
  SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM {t} WHERE n > 1 GROUP BY g, lv, i // 2)"""  # noqa: E731
    steps = lambda rows, t, base: f"""SELECT r.rid, {base} + r.lv AS lv, CASE WHEN r.at % 2 = 1 THEN 'L' WHEN s.h IS NULL THEN 'N' ELSE 'R' END || coalesce(s.h, '') AS s
  FROM (SELECT rid, g, lv, i >> lv AS at FROM (SELECT rid, g, i, unnest(range(0, top)) AS lv FROM {rows})) r LEFT JOIN {t} s ON s.g = r.g AND s.lv = r.lv AND s.i = xor(r.at, 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({text('n_chars::VARCHAR')}) AS leaf,
  CASE WHEN {_crc32('doc_id::VARCHAR')} % {modulus} = 0 THEN sha256({text("(n_chars::HUGEINT + 1)::VARCHAR")}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{levels('t', 'SELECT g, 0::BIGINT AS lv, i, leaf AS h, n FROM l')},
sub AS (SELECT g AS name, '' AS g, h AS leaf, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{levels('u', 'SELECT g, 0::BIGINT AS lv, i, leaf AS h, n FROM sub')},
tops AS (SELECT max(lv) AS top, max_by(h, lv) AS root FROM u),
lt AS (SELECT l.rid, l.g, l.i, m.top FROM l JOIN (SELECT g, max(lv) AS top FROM t GROUP BY g) m USING (g)),
ls AS (SELECT l.rid, sub.g, sub.i, tops.top FROM l JOIN sub ON l.g = sub.name, tops),
st AS ({steps('lt', 't', '0')} UNION ALL {steps('ls', 'u', '1000')}),
pr AS (SELECT rid, list(s ORDER BY lv) AS p FROM st GROUP BY rid),
al AS (SELECT l.doc_id, l.leaf, l.changed, sub.leaf AS subroot, root, coalesce(p, []) AS p FROM l JOIN sub ON l.g = sub.name LEFT JOIN pr USING (rid), tops),
fo AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s[2:]), '')) AS proof_sha256,
  list_reduce(list_concat([coalesce(changed, leaf)], p), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM al)
SELECT *, folded_root = root AS verified FROM fo"""
