"""Merkle manifest of a dataset: roots, and a proof for every row, by a tree reduction
over sparse forests.

Rows become leaves, are ordered by (group, id) with one range shuffle and numbered
from counts, so that every run of siblings has a known number of members. A fragment
is a sparse forest: nodes keyed by (tree, level, index) whose parents are not known
yet. Fragments form a commutative monoid: the sum of two is their union, in which
every run that is complete gives way to its parent (a group's last node, to a leaf
of the tree over the groups). The sum of all is the root alone.

`ascend` adds up the rows' fragments piece by piece and then, in rounds, the pieces of
ever wider ranges; neighbouring ranges leave only O(log n) nodes open, so no task and
not the driver ever holds more than a few such borders. `descend` takes the rounds
back: each hands the siblings on the way to the root to the nodes of the round below,
down to the rows. Every round is a written table, so a lost executor costs one
round's task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored, table

ARITY = 2
#: Rows of one piece: 2 ** PIECE_BITS. A row's proof may have some 2 kB.
PIECE_BITS = 14
#: A round adds up 2 ** FAN_BITS ranges at a time.
FAN_BITS = 6
#: Bits of a row's number below its partition's, by monotonically_increasing_id.
PART_BITS = 33
#: Pieces that a task adds up at a time.
OPEN_PIECES = 16
#: The tree over the groups.
TOP = -1

_NODE = "range long, tree long, size long, trees long, level int, index long, digest binary"
_NODES = pa.schema(
    [("range", pa.int64()), ("tree", pa.int64()), ("size", pa.int64()), ("trees", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary())]
)
_WAY = "range long, tree long, level int, index long, proof string, subroot string, root string"
_WAYS = pa.schema(
    [("range", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("proof", pa.string()), ("subroot", pa.string()), ("root", pa.string())]
)

Key = tuple[int, int, int]  # tree, level, index
Way = tuple[str, str | None, str]  # siblings, subroot, root


def node_hash(digests: Iterable[bytes]) -> bytes:
    """sha256 of the digests' hexadecimal texts, one after the other."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def row_digest(fields: list[Column]) -> Column:
    """sha256 over fields, each `-` if null, else byte count, `:` and value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def level_counts(size: int, arity: int) -> list[int]:
    """Nodes of every level of a tree, from its leaves to its root."""
    found = [size]
    while found[-1] > 1:
        found.append(-(-found[-1] // arity))
    return found


class Forest:
    """A fragment: nodes whose parents are not known yet. `trees` is the number of
    groups. With `log`, it also remembers the runs that it settled."""

    def __init__(self, trees: int, arity: int = ARITY, log: bool = False):
        self.arity = arity
        self.counts = {TOP: level_counts(trees, arity)}
        self.open: dict[Key, bytes] = {}
        self.known: dict[Key, bytes] | None = {} if log else None
        self.parents: dict[Key, tuple[Key, list[Key]]] = {}

    def add(self, key: Key, digest: bytes, size: int) -> None:
        """Put in one node of a tree with `size` leaves, and settle every run that is
        complete with it."""
        if key[0] not in self.counts:
            self.counts[key[0]] = level_counts(size, self.arity)
        while True:
            self.open[key] = digest
            if self.known is not None:
                self.known[key] = digest
            tree, level, index = key
            count = self.counts[tree][level]
            if count > 1:
                first = index - index % self.arity
                run = [(tree, level, i) for i in range(first, min(first + self.arity, count))]
                if any(k not in self.open for k in run):
                    return
                parent = (tree, level + 1, index // self.arity)
                digest = node_hash([self.open[k] for k in run])
            elif tree == TOP:
                return  # the root
            else:
                run, parent = [key], (TOP, 0, tree)
            for k in run:
                del self.open[k]
                if self.known is not None:
                    self.parents[k] = (parent, [x for x in run if x != k])
            key = parent

    def way(self, key: Key, above: dict[Key, Way], memo: dict[Key, Way]) -> Way:
        """(proof, subroot, root) of a node, given those of this forest's open nodes."""
        if key not in self.parents:
            return above[key]
        parent, others = self.parents[key]
        if parent not in memo:
            memo[parent] = self.way(parent, above, memo)
        proof, subroot, root = memo[parent]
        if key[0] != TOP and parent[0] == TOP:
            subroot = self.known[key].hex()
        return "".join([self.known[k].hex() for k in others]) + proof, subroot, root


def fold(leaf: bytes, proof: str, index: int, size: int, tree: int, trees: int, arity: int = ARITY) -> bytes:
    """The root that a leaf and its siblings give."""
    raw, at = bytes.fromhex(proof), 0
    for count, place in ((size, index), (trees, tree)):
        while count > 1:
            first = place - place % arity
            others = min(arity, count - first) - 1
            run = [raw[at + 32 * i : at + 32 * i + 32] for i in range(others)]
            at += 32 * others
            run.insert(place - first, leaf)
            leaf = node_hash(run)
            count, place = -(-count // arity), place // arity
    return leaf


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, group, leaf, ...) with `row`, their number in the order, with gaps
    between partitions; first as a written table, then with index and size within the
    group, tree (the group's number) and trees. Null groups and ids come first; rows
    of equal ids are ordered by their leaf."""
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("_at")]
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.drop("_at").withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    part = F.shiftright("row", PART_BITS)
    # A row for each group of a partition. The windows hold the groups of one
    # partition, the partitions of one group, or one row for each partition.
    runs = ranged.groupBy(part.alias("part"), "group").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    of_group = Window.partitionBy("group")
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(of_group).alias("size"))
    runs = runs.withColumn("begins", (F.col("before") == 0).cast("long"))
    runs = runs.withColumn("nth", F.sum("begins").over(Window.partitionBy("part").orderBy("first")))
    parts = runs.groupBy("part").agg(F.sum("begins").alias("own"))
    parts = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"), F.sum("own").over(Window.partitionBy()).alias("trees"))
    number = F.when(F.col("begins") == 1, F.col("base") + F.col("nth") - 1)
    runs = runs.join(parts, "part").withColumn("tree", F.max(number).over(of_group))
    runs = stored(runs.select(F.col("part").alias("_p"), F.col("group").alias("_g"), "first", "before", "size", "tree", "trees"), "merkle-counts")
    # Spark broadcasts these counts only where their files are small.
    found = ranged.join(runs, (part == F.col("_p")) & F.col("group").eqNullSafe(F.col("_g")))
    index = F.col("row") - F.col("first") + F.col("before")
    return ranged, found.select("row", "id", "leaf", "carried", index.alias("index"), "size", "tree", "trees")


def _rows(t: pa.Table | pa.RecordBatch, names: list[str]) -> list[tuple]:
    return list(zip(*[t[n].to_pylist() for n in names])) if t.num_rows else []


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sum(nodes: Iterable[tuple], arity: int, log: bool = False) -> Forest | None:
    """The sum of fragments given as rows of _NODES."""
    forest = None
    for _, tree, size, trees, level, index, digest in nodes:
        forest = forest or Forest(trees, arity, log)
        forest.add((tree, level, index), digest, size)
    return forest


def _node_rows(forest: Forest, of: int) -> list[tuple]:
    trees = forest.counts[TOP][0]
    return [(of, tree, forest.counts[tree][0], trees, level, index, digest) for (tree, level, index), digest in forest.open.items()]


def ascend(leaves: DataFrame, shifts: list[int], arity: int = ARITY) -> list[DataFrame]:
    """The tree reduction: fragments of pieces, then of each wider range; every round
    is a table of open nodes, the last one holds the root."""

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A sum for each piece that the task meets. Rows come in order, so that
        # nearly all nodes within a piece settle here; what does not, settles later.
        sums: dict[int, Forest] = {}
        for batch in batches:
            for of, tree, size, trees, level, index, digest in _rows(batch, _NODES.names):
                if of not in sums:
                    if len(sums) >= OPEN_PIECES:
                        yield from _table([r for p, f in sums.items() for r in _node_rows(f, p)], _NODES).to_batches()
                        sums = {}
                    sums[of] = Forest(trees, arity)
                sums[of].add((tree, level, index), digest, size)
        yield from _table([r for p, f in sums.items() for r in _node_rows(f, p)], _NODES).to_batches()

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        return _table(_node_rows(_sum(_rows(t, _NODES.names), arity), key[0].as_py()), _NODES)

    piece = F.shiftright("row", PIECE_BITS).alias("range")
    nodes = leaves.select(piece, "tree", "size", "trees", F.lit(0).alias("level"), "index", F.col("leaf").alias("digest"))
    rounds = [stored(nodes.mapInArrow(begun, _NODE), "merkle-nodes")]
    for shift in shifts:
        wide = rounds[-1].withColumn("wide", F.shiftright("range", shift)).groupBy("wide")
        rounds.append(stored(wide.applyInArrow(merged, _NODE), "merkle-nodes"))
    return rounds


def descend(rounds: list[DataFrame], shifts: list[int], arity: int = ARITY) -> DataFrame:
    """The way to the root of every node that a piece leaves open; takes the rounds
    back and deletes their tables."""

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(of, tree, level, index, "", None, digest.hex()) for of, tree, _, _, level, index, digest in _rows(batch, _NODES.names)]
            yield from _table(found, _WAYS).to_batches()

    def handed(below: pa.Table, above: pa.Table) -> pa.Table:
        ranges: dict[int, list[tuple]] = {}
        for r in _rows(below, _NODES.names):
            ranges.setdefault(r[0], []).append(r)
        # Nodes of one range may come from several tasks: first the range's own sum.
        sums = {of: _sum(rs, arity) for of, rs in ranges.items()}
        forest = _sum((r for of, f in sums.items() for r in _node_rows(f, of)), arity, log=True)
        given, memo = {tuple(r[1:4]): tuple(r[4:]) for r in _rows(above, _WAYS.names)}, {}
        return _table([(of, *k, *forest.way(k, given, memo)) for of, f in sums.items() for k in f.open], _WAYS)

    ways = stored(rounds[-1].mapInArrow(rooted, _WAY), "merkle-ways")
    forget(rounds[-1])
    for nodes, shift in zip(reversed(rounds[:-1]), reversed(shifts)):
        below = nodes.withColumn("wide", F.shiftright("range", shift)).groupBy("wide")
        lower = stored(below.cogroup(ways.groupBy("range")).applyInArrow(handed, _WAY), "merkle-ways")
        forget(ways)
        forget(nodes)
        ways = lower
    return ways


def merkle_manifest(
    rows: DataFrame,
    leaf: Column,
    id_col: str = "doc_id",
    group_col: str = "lang",
    arity: int = ARITY,
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each row: id_col, leaf, index and size (place in its group's tree
    and leaves of that), tree and trees (the group's place and the number of groups),
    proof (siblings as hexadecimal text, level by level from the leaf to the root, each
    run's others from left to right), subroot, root, and `carried` (a struct of the
    columns given; null without any).

    leaf is a column of 32 bytes. Leaves of a group ascend by id, null ids first; rows
    of one id are ordered by their leaf, so tables of equal rows have equal roots.
    Groups ascend bytewise, null first. Every `arity` consecutive nodes make their
    parent, the last run with what is left. A group of one row has its leaf as subroot,
    a table of one group that group's subroot as root, and a table without rows gives
    none. Further columns are left out, whatever their names.
    """
    with_rows = F.struct(*[c.alias(n) for n, c in carried.items()]) if carried else F.lit(None).cast("boolean")
    hashed = stored(rows.select(rows[id_col].alias("id"), rows[group_col].alias("group"), leaf.alias("leaf"), with_rows.alias("carried")), "merkle-hashed")
    ranged, leaves = numbered(hashed)
    forget(hashed)
    # As many rounds as the highest row number needs.
    highest = (ranged.agg(F.max("row")).first()[0] or 0) >> PIECE_BITS
    shifts = [PART_BITS - PIECE_BITS]
    while highest >> sum(shifts):
        shifts.append(FAN_BITS)
    ways = descend(ascend(leaves, shifts, arity), shifts, arity)
    kept = ["id", "carried", "leaf", "index", "size", "tree", "trees"]
    types = {f.name: f.dataType.simpleString() for f in leaves.schema}
    out_type = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", proof string, subroot string, root string"

    def proved(own: pa.Table, above: pa.Table) -> pa.Table:
        names = ["row", "tree", "size", "trees", "row", "index", "leaf"]
        nodes = [(None, tree, size, trees, 0, index, digest) for _, tree, size, trees, _, index, digest in _rows(own, names)]
        forest = _sum(nodes, arity, log=True)
        given, memo = {tuple(r[1:4]): tuple(r[4:]) for r in _rows(above, _WAYS.names)}, {}
        found = _table([forest.way((n[1], 0, n[5]), given, memo) for n in nodes], pa.schema([_WAYS.field(c) for c in ("proof", "subroot", "root")]))
        own = own.select(kept)
        for c in found.schema.names:
            own = own.append_column(c, found[c])
        return own

    pieces = leaves.withColumn("range", F.shiftright("row", PIECE_BITS)).groupBy("range")
    done = pieces.cogroup(ways.groupBy("range")).applyInArrow(proved, out_type)
    return done.withColumnRenamed("id", id_col)


def with_folded_root(manifest: DataFrame, leaf: Column, out_col: str = "folded_root", arity: int = ARITY) -> DataFrame:
    """Add the root (hexadecimal text) that a leaf gives with the siblings of its row
    in the manifest; a leaf that is not the row's gives another one. Null leaves give
    null. A column already named out_col is replaced."""

    @F.arrow_udf("string")
    def folded(leaves: pa.Array, proof: pa.Array, index: pa.Array, size: pa.Array, tree: pa.Array, trees: pa.Array) -> pa.Array:
        rows = zip(*[x.to_pylist() for x in (leaves, proof, index, size, tree, trees)])
        return pa.array([None if r[0] is None else fold(*r, arity).hex() for r in rows], pa.string())

    return manifest.withColumn(out_col, folded(leaf, "proof", "index", "size", "tree", "trees"))


def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    leaf = row_digest([docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")])
    more = docs["n_chars"].cast("decimal(20,0)") + 1
    tampered = row_digest([docs["doc_id"], docs["source"], docs["lang"], more, docs["text"]])
    by_7 = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    manifest = merkle_manifest(docs, leaf, carried={"checked": F.when(by_7, tampered).otherwise(leaf)})
    return with_folded_root(manifest, F.col("carried.checked")).select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{chars}", "text")) + ")"
OP11_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
lookup AS (SELECT list(v ORDER BY i) AS v FROM bits),
d AS (SELECT *, row_number() OVER () AS rn, CAST(doc_id AS VARCHAR) AS s FROM documents),
crc(rn, s, pos, c) AS (
  SELECT rn, s, 1, CAST(4294967295 AS BIGINT) FROM d WHERE s IS NOT NULL
  UNION ALL
  SELECT rn, s, pos + 1, xor(CAST((SELECT v FROM lookup)[xor(c & 255, ascii(s[pos])) + 1] AS BIGINT), c // 256) FROM crc WHERE pos <= strlen(s)),
changed AS (SELECT rn FROM crc WHERE pos = strlen(s) + 1 AND (4294967295 - c) % 7 = 0),
hashed AS (SELECT d.rn, doc_id, lang, {_LEAF.format(chars="n_chars")} AS leaf,
    CASE WHEN changed.rn IS NULL THEN {_LEAF.format(chars="n_chars")} ELSE {_LEAF.format(chars="(n_chars + 1)")} END AS checked
  FROM d LEFT JOIN changed USING (rn)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM hashed),
nodes(t, lvl, i, n, h) AS (
  SELECT t, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT t, lvl + 1, i // 2, (n + 1) // 2, h FROM (
    SELECT t, lvl, i, n, sha256(h || coalesce(lead(h) OVER (PARTITION BY t ORDER BY i), '')) AS h FROM nodes WHERE n > 1) WHERE i % 2 = 0),
subroots AS (SELECT t, lvl AS height, h FROM nodes WHERE n = 1),
tops(lvl, i, n, h) AS (
  SELECT 0, t, (SELECT count(*) FROM subroots), h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, h FROM (
    SELECT lvl, i, n, sha256(h || coalesce(lead(h) OVER (ORDER BY i), '')) AS h FROM tops WHERE n > 1) WHERE i % 2 = 0),
step AS (SELECT t, lvl, i, n, h FROM nodes WHERE n > 1
  UNION ALL SELECT -1, lvl, i, n, h FROM tops),
paths AS (
  SELECT l.rn, string_agg(s.h, '' ORDER BY k.up, s.lvl) AS proof,
    list(struct_pack(h := s.h, odd := k.at % 2, lone := s.h IS NULL) ORDER BY k.up, k.lvl) AS steps
  FROM leaves l
  JOIN (SELECT rn, 0 AS up, t, lvl, i AS at FROM (SELECT leaves.rn, leaves.t, x.lvl, leaves.i // CAST(power(2, x.lvl) AS BIGINT) AS i
          FROM leaves JOIN (SELECT DISTINCT t, lvl FROM nodes WHERE n > 1) x ON x.t = leaves.t)
        UNION ALL
        SELECT leaves.rn, 1, -1, x.lvl, leaves.t // CAST(power(2, x.lvl) AS BIGINT)
          FROM leaves, (SELECT DISTINCT lvl FROM tops WHERE n > 1) x) k ON k.rn = l.rn
  LEFT JOIN step s ON s.t = k.t AND s.lvl = k.lvl AND s.i = xor(k.at, 1)
  GROUP BY l.rn),
folded AS (
  SELECT l.rn, coalesce(p.proof, '') AS proof,
    CASE WHEN p.steps IS NULL THEN l.checked ELSE list_reduce([struct_pack(h := l.checked, odd := CAST(0 AS BIGINT), lone := false)] || p.steps,
      lambda a, x: struct_pack(h := sha256(CASE WHEN x.lone THEN a.h WHEN x.odd = 1 THEN x.h || a.h ELSE a.h || x.h END), odd := x.odd, lone := x.lone)).h END AS root
  FROM leaves l LEFT JOIN paths p ON p.rn = l.rn)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.root AS folded_root, f.root = r.h AS verified
FROM leaves l JOIN subroots s ON s.t = l.t JOIN folded f ON f.rn = l.rn, (SELECT h FROM tops WHERE n = 1) r
"""
