"""Merkle manifest of a dataset by concatenated-level strings, in DataFrame functions only.

The leaves of a language stand in id order and are cut into aligned blocks of 2^8. A block is one row: its lowest level is
one string of 64 hex digits a node, and every level above is the string of the hashes of 128-digit substrings of the one
below. Because blocks are aligned, a block's levels are those of the whole tree; its last node is a leaf of the tier above,
which is cut into blocks again until one node of the language remains (four tiers hold 2^32 leaves). The languages' last
nodes are the leaves of one more tree of the same making. Going down again, a node's sibling on each level is the flanking
64 digits of that level's string; a leaf's path is its own block's siblings, then its block's path in the tier above.

Ranks come from one range partition: leaves are written in order with their part and place, and a part's offset in a language
is a running sum over parts. No task holds more of a language than one part or one block, however hot the language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.llm.common import stored, table
from pixsieve.llm.ranks import ranked

BITS = 8
DIGITS = 64
PATH = "path"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value in a leaf: - for null, else its UTF-8 byte count, a colon, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(docs: DataFrame, names: tuple[str, ...], **instead: Column) -> Column:
    return F.sha2(F.concat(*(field(instead.get(c, F.col(f"`{c}`"))) for c in names)), 256)


def parents(level: Column) -> Column:
    """The level above a level's string: the hashes of its 128-digit substrings, the last of which may have 64."""
    pairs = F.ceil(F.length(level) / (2 * DIGITS)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), pairs - 1), lambda i: F.sha2(F.substr(level, i * 2 * DIGITS + 1, F.lit(2 * DIGITS)), 256)), "")


def height(n: Column) -> Column:
    """Levels above a block's lowest: 8 where the group has other blocks, else as many as leave one node."""
    return F.when(n > 1 << BITS, BITS).when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def blocks_of(nodes: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """One row per aligned block: group, n, block, rows (the carried columns in rank order), levels (strings, lowest first)."""
    packed = nodes.groupBy(group, "n", F.shiftright("rank", BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "hash", *carried))).alias("rows")
    )
    lowest = F.array_join(F.transform("rows", lambda r: r["hash"]), "")
    above = F.slice(F.lit(list(range(1, BITS + 1))), F.lit(1), height(F.col("n")))
    return packed.withColumn("levels", F.aggregate(above, F.array(lowest), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1))))))


def siblings(levels: Column, rank: Column) -> Column:
    """For each level of a block but its last the sibling's side and digits: L or R and 64 digits, or - where there is none."""
    local = rank.bitwiseAND((1 << BITS) - 1)

    def one(level: Column, j: Column) -> Column:
        node = F.call_function("shiftright", local.cast("int"), j)
        digits = F.substr(level, node.bitwiseXOR(F.lit(1)) * DIGITS + 1, F.lit(DIGITS))
        return F.when(digits == "", "-").otherwise(F.concat(F.when(node.bitwiseAND(1) == 1, "L").otherwise("R"), digits))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), one)


def climbed(leaves: DataFrame, group: str, carried: list[str]) -> list[DataFrame]:
    """The tiers of blocks over ranked leaves, lowest first; one action tells how many tiers the largest group needs."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    tiers = [stored(blocks_of(leaves, group, carried), "merkle-blocks")]
    while most > 1 << BITS:
        most = -(-most >> BITS)
        nodes = tiers[-1].where(F.col("n") > 1 << BITS).select(
            group, F.ceil(F.col("n") / (1 << BITS)).cast("long").alias("n"), F.col("block").alias("rank"), F.element_at("levels", -1).alias("hash")
        )
        tiers.append(stored(blocks_of(nodes, group, []), "merkle-blocks"))
    return tiers


def roots(tiers: list[DataFrame], group: str) -> DataFrame:
    """group and hash: the node of each group that remains."""
    tops = [t.where(F.col("n") <= 1 << BITS).select(group, F.element_at("levels", -1).alias("hash")) for t in tiers]
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return found


def descended(tiers: list[DataFrame], group: str, above: DataFrame, kept: list[str]) -> DataFrame:
    """The lowest tier's rows with path, from the leaf up: the siblings in its block, in the tiers above, then the group's.

    above: group, path, and the columns kept that every leaf of the group gets.
    """
    over = None
    for tier in reversed(tiers):
        alone = tier.where(F.col("n") <= 1 << BITS).join(above, group)
        inside = [alone] if over is None else [alone, tier.where(F.col("n") > 1 << BITS).join(over, [group, "block"])]
        for blocks in inside:
            paths = F.transform("rows", lambda r: F.struct(r.alias("row"), F.concat(siblings(F.col("levels"), r["rank"]), F.col(PATH)).alias(PATH)))
            rows = blocks.select(group, *kept, F.explode(paths).alias("leaf")).select(group, *kept, "leaf.row.*", f"leaf.{PATH}")
            found = rows if blocks is alone else found.unionByName(rows)
        over = found.select(group, *kept, F.col("rank").alias("block"), PATH)
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def step(node: Column, sibling: Column) -> Column:
        side, digits = F.substr(sibling, F.lit(1), F.lit(1)), F.substr(sibling, F.lit(2))
        return F.sha2(F.when(side == "L", F.concat(digits, node)).when(side == "R", F.concat(node, digits)).otherwise(node), 256)

    return F.aggregate(path, leaf, step)


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves: id, hash, lang and other columns, to which it adds subroot, root and path (siblings with their sides)."""
    carried = [c for c in leaves.columns if c not in ("lang", "hash")]
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))).drop("lang")
    tiers = climbed(ranked(keyed, "tree", ("id", "hash")), "tree", carried)
    tops = roots(tiers, "tree").withColumn("all", F.lit(0))
    # null's key is a hyphen, which sorts before the equals sign of every named language
    forest = climbed(ranked(tops, "all", ("tree",)), "all", ["tree"])
    nothing = F.array().cast("array<string>")
    root = roots(forest, "all").select("all", F.col("hash").alias("root"), nothing.alias(PATH))
    above = descended(forest, "all", root, ["root"]).select("tree", F.col("hash").alias("subroot"), "root", PATH)
    return descended(tiers, "tree", stored(above, "merkle-trees"), ["subroot", "root"])


def proofs(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", names: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings.

    names are the columns that a leaf hashes, in order; tampered replaces some of them in the rows where `where` holds, and
    folded_root is what those leaves and the original siblings give. A null value is a hyphen, a null language a tree of its
    own, the first; null ids stand first in their tree, rows of one id in the order of their leaves (rows equal in all
    hashed columns are equal leaves and have a proof each). An empty table gives no rows. Other columns are not read.
    """
    changed = F.when(where, leaf_hash(docs, names, **tampered)) if tampered else F.lit(None).cast("string")
    leaves = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), leaf_hash(docs, names).alias("hash"), changed.alias("changed"))
    back = folded(F.coalesce("changed", "hash"), F.col(PATH))
    digits = F.array_join(F.transform(PATH, lambda s: F.substr(s, F.lit(2))), "")
    return manifest(leaves).select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(digits, 256).alias("proof_sha256"),
        back.alias("folded_root"), F.size(F.filter(PATH, lambda s: s != "-")).cast("long").alias("n_siblings"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its roots, its proof, and whether the leaf still verifies where 7 divides the id's crc32 and n_chars went up by 1.

    A null id is not tampered with.
    """
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return proofs(docs, tampered={"n_chars": more}, where=seventh)


SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, n_chars,
         [coalesce(strlen(x) || ':' || x, '-') FOR x IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text]] AS parts
  FROM documents),
hashed AS (SELECT *, sha256(array_to_string(parts, '')) AS leaf FROM leaves),
digits AS (
  SELECT doc_id, CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT) AS b, k
  FROM (SELECT doc_id, unnest(range(1, length(CAST(doc_id AS VARCHAR)) + 1)) AS k FROM (SELECT DISTINCT doc_id FROM hashed WHERE doc_id IS NOT NULL))),
crc_of AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(b ORDER BY k)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
    CAST(4294967295 AS BIGINT)) AS crc
  FROM digits GROUP BY doc_id),
level0 AS (
  SELECT h.*, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY h.lang) AS n, coalesce('=' || h.lang, '-') AS tree,
         CASE WHEN c.crc % 7 = 0 AND n_chars IS NOT NULL
              THEN sha256(array_to_string(parts[1:3] || [strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR)] || parts[5:], ''))
              ELSE leaf END AS changed
  FROM hashed h LEFT JOIN crc_of c ON h.doc_id = c.doc_id
  WINDOW w AS (PARTITION BY h.lang ORDER BY h.doc_id NULLS FIRST, leaf)),
nodes(tree, lvl, idx, h, n) AS (
  SELECT tree, 0, idx, leaf, n FROM level0
  UNION ALL
  SELECT tree, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 2, n),
tops AS (SELECT tree, lvl AS high, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
above(lvl, idx, h, n) AS (
  SELECT 0, idx, h, n FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM above WHERE n > 1 GROUP BY lvl, idx // 2, n),
final AS (SELECT lvl AS high, h AS root FROM above WHERE n = 1),
steps AS (
  SELECT l.tree, l.idx AS leaf_at, s.lvl, (l.idx >> s.lvl) % 2 AS right_side, x.h AS sib
  FROM level0 l JOIN tops t ON t.tree = l.tree JOIN (SELECT CAST(range AS INT) AS lvl FROM range(64)) s ON s.lvl < t.high
  LEFT JOIN nodes x ON x.tree = l.tree AND x.lvl = s.lvl AND x.idx = xor(l.idx >> s.lvl, 1)
  UNION ALL
  SELECT l.tree, l.idx, t.high + s.lvl, (t.idx >> s.lvl) % 2, x.h
  FROM level0 l JOIN tops t ON t.tree = l.tree CROSS JOIN final JOIN (SELECT CAST(range AS INT) AS lvl FROM range(64)) s ON s.lvl < final.high
  LEFT JOIN above x ON x.lvl = s.lvl AND x.idx = xor(t.idx >> s.lvl, 1)),
paths AS (
  SELECT tree, leaf_at, sha256(coalesce(string_agg(sib, '' ORDER BY lvl), '')) AS proof, count(sib) AS n_siblings,
         list(CASE WHEN sib IS NULL THEN '-' WHEN right_side = 1 THEN 'L' || sib ELSE 'R' || sib END ORDER BY lvl) AS path
  FROM steps GROUP BY tree, leaf_at)
SELECT l.doc_id, l.leaf, t.h AS subroot, final.root, coalesce(p.proof, sha256('')) AS proof_sha256,
       list_reduce(list_prepend(l.changed, coalesce(p.path, [])), lambda node, s: sha256(
         CASE s[1] WHEN 'L' THEN s[2:] || node WHEN 'R' THEN node || s[2:] ELSE node END)) AS folded_root,
       CAST(coalesce(p.n_siblings, 0) AS BIGINT) AS n_siblings, folded_root = final.root AS verified
FROM level0 l JOIN tops t USING (tree) CROSS JOIN final LEFT JOIN paths p ON p.tree = l.tree AND p.leaf_at = l.idx
"""
QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": SQL}
