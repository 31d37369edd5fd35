"""Merkle dataset manifest in an external-memory node store.

A leaf is the digest of a row's fields (:func:`leaf`). Leaves are dealt out by ranges of (lang, doc_id, leaf)
and sorted, so a part is a sorted run; the counts of the runs' languages give every leaf its position. The
store is Parquet in one partition a level: a row holds up to ``2 ** TIER`` neighbouring nodes of one
language, packed, by coordinate (lang, run). Each level is made from the one below by reading it once, row
by row and without a shuffle; only every ``TIER`` levels, when a row has shrunk to one node, neighbouring
rows are put together again. Subroots make a second, like tree, whose root stands for the data set.

Proofs are extracted from the top down: the levels of a tier are scanned by coordinate and merged into
one row a run, joined with the path of the run's own apex, and handed to the nodes below. So a leaf's path
is put together where its run lies; what is joined are runs, never single leaves.

Nothing of the size of the data meets in one task: a group of ``collect_list`` has ``2 ** TIER`` members at
most, a language of a third of all rows is many runs, and one window a language sees a row a sorted run. The
driver reads the largest number of leaves, which says how many levels there are.

Null fields are written as ``-``; a null lang is a language of its own, first; null doc_ids come first in
their language. Rows of equal doc_id are leaves of their own, in the order of their digests; rows equal in
all fields have equal leaves and are interchangeable. A lone leaf is its own subroot and a lone subroot the
root; proofs of such are empty. Texts of any length are hashed whole. An empty table has no root and gives
no proofs. Only named columns are read, so further ones can't clash; columns to ``keep`` may not have the
names of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fits_broadcast, materialize, new_path, release

#: Levels between two regroupings: a row of the store has 2 ** TIER nodes at most.
TIER = 8
_NODE = 32  # bytes
_NODES = "group string, run long, leaves long, digests binary"
_RESERVED = ("lang", "position", "doc_id", "leaf", "path", "subroot", "root")


def _shift(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Digest of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def document_leaf(n_chars: Column | None = None) -> Column:
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text"))


def _nodes(level: Column | int) -> Column:
    """Nodes that a group has at ``level``: leaves / 2 ** level, rounded up."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), level if isinstance(level, Column) else F.lit(level))
    return _shift(F.col("leaves") + power - 1, level)


def _height() -> Column:
    """Levels above the leaves of a group."""
    return F.when(F.col("leaves") > 1, F.length(F.bin(F.col("leaves") - 1))).otherwise(0)


def _hex(digests: Column, first: Column, nodes: int = 1) -> Column:
    return F.lower(F.hex(F.call_function("substring", digests, (first * _NODE + 1).cast("int"), F.lit(_NODE * nodes))))


def _parents(digests: Column) -> Column:
    """Packed parents of packed nodes; the last may have one child."""
    last = ((F.length(digests) / _NODE - 1) / 2).cast("int")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: digest(_hex(digests, i * 2, 2))), ""))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    other = lambda s: F.substring(s, 2, 2 * _NODE)
    return F.aggregate(path, start, lambda h, s: digest(F.when(s.startswith("l"), F.concat(other(s), h)).when(s.startswith("r"), F.concat(h, other(s))).otherwise(h)))


def siblings(path: Column) -> Column:
    """The digests of a path, from the leaf up, in one text."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 2 * _NODE)), "")


def _joined(left: DataFrame, right: DataFrame, by: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """A written ``right`` is broadcast if its counted rows allow it; else both sides are sorted and merged."""
    return left.join(F.broadcast(right) if fits_broadcast(right.count(), row_bytes) else right, by, how)


@dataclass(frozen=True)
class Tree:
    """A forest of one tree a group, at ``path``: ``members`` (group, run, leaves, docs) and ``level=<k>`` (group, run, leaves, digests)."""

    spark: SparkSession
    path: str

    @property
    def members(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/members")

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(_NODES).parquet(f"{self.path}/nodes/level={k}")

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.schema(f"{_NODES}, level int").parquet(f"{self.path}/nodes")

    def height(self) -> int | None:
        """Of the tallest group; None without groups."""
        return self.members.agg(F.max(_height())).first()[0]

    def tops(self) -> DataFrame:
        """(group, leaves, top): the last node of each group."""
        return self.nodes.where(_nodes(F.col("level")) == 1).select("group", "leaves", F.lower(F.hex("digests")).alias("top"))

    def paths(self, upper: DataFrame) -> DataFrame:
        """(group, position, doc, path, *further) of all leaves. ``upper``: (group, leaves, tail, *further), what is above each group."""
        further = [c for c in upper.columns if c not in ("group", "leaves", "tail")]
        beginning = upper.withColumn("tier", (F.greatest(_height() - 1, F.lit(0)) / TIER).cast("int")).drop("leaves").withColumn("run", F.lit(0).cast("long"))
        above = None
        for tier in range(max((self.height() or 0) - 1, 0) // TIER, -1, -1):
            begun = beginning.where(F.col("tier") == tier).drop("tier")
            apexes = begun if above is None else above.unionByName(begun)
            wanted = self.nodes.where(F.col("level").between(tier * TIER, tier * TIER + TIER - 1) & (_nodes(F.col("level")) > 1))
            merged = wanted.groupBy("group", "run").agg(F.array_sort(F.collect_list(F.struct((F.col("level") - tier * TIER).alias("j"), "digests"))).alias("levels"))  # TIER of them at most
            if tier == 0:
                runs = self.members.join(apexes, ["group", "run"]).join(merged, ["group", "run"], "left")
                leaves = F.transform("docs", lambda d, i: F.struct(d.alias("doc"), F.concat(_climb(i), F.col("tail")).alias("path")))
                found = runs.select("group", "run", *further, F.posexplode(leaves).alias("at", "leaf"))
                return found.select("group", (F.col("run") * 2**TIER + F.col("at")).alias("position"), "leaf.doc", "leaf.path", *further)
            count = (F.length(F.col("levels")[0]["digests"]) / _NODE).cast("int")
            runs = merged.join(apexes, ["group", "run"])
            below = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(_climb(i), F.col("tail")))
            nodes = runs.select("group", "run", *further, F.posexplode(below).alias("at", "tail"))
            above = materialize(nodes.select("group", (F.col("run") * 2**TIER + F.col("at")).alias("run"), "tail", *further), "merkle-paths")


def _climb(i: Column) -> Column:
    """Sides and siblings of a run's node ``i`` through the run's levels: ``l`` or ``r`` and the digest; empty where a node is alone."""

    def step(level: Column) -> Column:
        at = _shift(i, level["j"])
        beside = at.bitwiseXOR(F.lit(1))
        side = F.when(at.bitwiseAND(F.lit(1)) == 1, "l").otherwise("r")
        return F.when((beside + 1) * _NODE <= F.length(level["digests"]), F.concat(side, _hex(level["digests"], beside))).otherwise("")

    return F.coalesce(F.transform("levels", step), F.array().cast("array<string>"))


def build_tree(rows: DataFrame, path: str) -> Tree:
    """The store at ``path`` of ``rows`` (group, key, leaf, kept): leaves of a group ascend by key, then leaf."""
    spark = rows.sparkSession
    order = ("group", F.col("key").asc_nulls_first(), "leaf")
    number = F.monotonically_increasing_id()
    parts = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", number).select("*", _shift(F.col("number"), 33).alias("part"), F.col("number").bitwiseAND(F.lit(2**33 - 1)).alias("row")).drop("number"), "merkle-sorted")
    counts = materialize(parts.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("row").alias("first")), "merkle-counts")
    own = Window.partitionBy("group")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("part", "group", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("begin"), F.sum("n").over(own).alias("leaves")), "merkle-starts")
    placed = _joined(parts, starts, ["part", "group"], 96).withColumn("position", F.col("row") + F.col("begin"))
    docs = F.transform(F.array_sort(F.collect_list(F.struct("position", "key", "leaf", "kept"))), lambda d: F.struct(d["key"].alias("key"), d["leaf"].alias("leaf"), d["kept"].alias("kept")))
    placed.groupBy("group", _shift(F.col("position"), TIER).alias("run"), "leaves").agg(docs.alias("docs")).write.parquet(f"{path}/members")
    release(parts, counts, starts)
    tree = Tree(spark, path)
    packed = F.unhex(F.array_join(F.transform("docs", lambda d: d["leaf"]), ""))
    tree.members.select("group", "run", "leaves", packed.alias("digests")).write.parquet(f"{path}/nodes/level=0")
    for k in range(1, (tree.height() or 0) + 1):
        level = tree.level(k - 1).where(_nodes(k - 1) > 1).withColumn("digests", _parents(F.col("digests")))
        if k % TIER == 0:  # a node a row: neighbours share a row again
            together = F.array_sort(F.collect_list(F.struct("run", F.hex("digests").alias("node"))))
            level = level.groupBy("group", _shift(F.col("run"), TIER).alias("above"), "leaves").agg(F.unhex(F.array_join(F.transform(together, lambda x: x["node"]), "")).alias("digests")).withColumnRenamed("above", "run")
        level.select("group", "run", "leaves", "digests").write.parquet(f"{path}/nodes/level={k}")
    return tree


@dataclass(frozen=True)
class Manifest:
    """A stored manifest: a tree a language in ``documents``, the tree of their subroots in ``top``."""

    documents: Tree
    top: Tree

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Manifest":
        return cls(Tree(spark, f"{path}/documents"), Tree(spark, f"{path}/top"))

    def roots(self) -> DataFrame:
        """(lang, leaves, subroot, root), a row a language."""
        return self._upper().select(_lang(), "leaves", "subroot", "root")

    def _upper(self) -> DataFrame:
        root = self.top.tops().select("group", "leaves", F.array().cast("array<string>").alias("tail"), F.col("top").alias("root"))
        above = self.top.paths(root).select(F.col("doc.key").alias("group"), F.col("path").alias("tail"), "root")
        return self.documents.tops().join(above, "group").withColumnRenamed("top", "subroot")

    def proofs(self, wanted: DataFrame | None = None) -> DataFrame:
        """(lang, position, doc_id, leaf, *kept, path, subroot, root): of all leaves, or of those at the coordinates (lang, position) in ``wanted``.

        A path lists ``l`` or ``r`` (the sibling's side) and the sibling's digest from the leaf up to the root, an empty text where a node is alone."""
        upper = materialize(self._upper(), "merkle-upper")
        found = self.documents.paths(upper)
        if wanted is not None:
            at = wanted.select(_group(F.col("lang")).alias("group"), F.col("position").cast("long").alias("position")).distinct()
            found = found.join(at, ["group", "position"], "left_semi")
        kept = self.documents.members.schema["docs"].dataType.elementType["kept"].dataType.names
        return found.select(_lang(), "position", F.col("doc.key").alias("doc_id"), F.col("doc.leaf").alias("leaf"), *[F.col(f"doc.kept.`{c}`").alias(c) for c in kept if c != "__none"], "path", "subroot", "root")


def _group(lang: Column) -> Column:
    """A name for each language that isn't null and sorts null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def _lang() -> Column:
    return F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias("lang")


def build(rows: DataFrame, path: str, keep: tuple[str, ...] = ()) -> Manifest:
    """Write the manifest of ``rows`` (lang, doc_id, leaf, and columns to ``keep`` beside a leaf) to the new folder ``path``."""
    if clash := [c for c in keep if c in _RESERVED]:
        raise ValueError(f"columns to keep have names of the result: {clash}")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).cast("boolean").alias("__none"))
    leaves = materialize(rows.select(_group(F.col("lang")).alias("group"), F.col("doc_id").cast("long").alias("key"), F.col("leaf"), kept.alias("kept")), "merkle-leaves")
    documents = build_tree(leaves, f"{path}/documents")
    release(leaves)
    subroots = documents.tops().select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("top").alias("leaf"), F.struct(F.lit(None).cast("boolean").alias("__none")).alias("kept"))
    return Manifest(documents, build_tree(subroots, f"{path}/top"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    rows = docs.select("lang", "doc_id", document_leaf().alias("leaf"), F.when(tampered, document_leaf(F.col("n_chars") + 1)).alias("claimed"))
    proofs = build(rows, new_path(spark, "merkle"), ("claimed",)).proofs()
    folded = proofs.withColumn("folded_root", fold(F.coalesce("claimed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of the decimal doc_id is folded bit by bit; 3988292384 is its polynomial.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, COALESCE(doc_id::VARCHAR, '') AS s, 0 AS bit, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, s, bit + 1,
         CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END
  FROM (SELECT *, CASE WHEN bit % 8 = 0 THEN xor(c, ascii(substr(s, bit // 8 + 1, 1))::BIGINT) ELSE c END AS b FROM crc WHERE bit < 8 * length(s))
), marked AS (
  SELECT doc_id, doc_id IS NOT NULL AND xor(c, 4294967295) % 7 = 0 AS tamper FROM crc WHERE bit = 8 * length(s)
), fields AS (
  SELECT d.doc_id, d.lang, m.tamper AND n_chars IS NOT NULL AS tamper,
         COALESCE(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id::VARCHAR, '-') || COALESCE(strlen(source) || ':' || source, '-') || COALESCE(strlen(lang) || ':' || lang, '-') AS before_n,
         COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS n, COALESCE(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS n_plus,
         COALESCE(strlen(text) || ':' || text, '-') AS after_n
  FROM documents d JOIN marked m ON d.doc_id IS NOT DISTINCT FROM m.doc_id
), hashed AS (
  SELECT doc_id, COALESCE('=' || lang, '') AS g, sha256(before_n || n || after_n) AS leaf,
         CASE WHEN tamper THEN sha256(before_n || n_plus || after_n) END AS claimed FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed
), tree AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, level, pos // 2, n
), subroots AS (
  SELECT g, h AS subroot, level AS height, row_number() OVER (ORDER BY g COLLATE "C") - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT l.g, l.pos, t.level, (l.pos >> t.level) & 1 AS odd, t.h
  FROM leaves l JOIN tree t ON t.g = l.g AND t.n > 1 AND t.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.g, l.pos, s.height + t.level, (s.pos >> t.level) & 1, t.h
  FROM leaves l JOIN subroots s ON s.g = l.g JOIN top t ON t.n > 1 AND t.pos = xor(s.pos >> t.level, 1)
), heights AS (
  SELECT s.*, s.height + (SELECT max(level) FROM top) AS levels, (SELECT h FROM top WHERE n = 1) AS root FROM subroots s
), folded AS (
  SELECT l.g, l.pos, 0 AS level, COALESCE(claimed, leaf) AS h, s.levels FROM leaves l JOIN heights s ON s.g = l.g
  UNION ALL
  SELECT f.g, f.pos, f.level + 1, sha256(CASE WHEN x.h IS NULL THEN f.h WHEN x.odd = 1 THEN x.h || f.h ELSE f.h || x.h END), f.levels
  FROM folded f LEFT JOIN steps x ON x.g = f.g AND x.pos = f.pos AND x.level = f.level WHERE f.level < f.levels
), proofs AS (
  SELECT g, pos, sha256(string_agg(h, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY g, pos
)
SELECT l.doc_id, l.leaf, s.subroot, s.root, COALESCE(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = s.root AS verified
FROM leaves l JOIN heights s ON s.g = l.g JOIN folded f ON f.g = l.g AND f.pos = l.pos AND f.level = f.levels
LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos
"""
