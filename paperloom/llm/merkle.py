"""Operator 11: a Merkle manifest of a table, and proofs against it.

Rows are leaves; each group of rows has a tree over its leaves in the order of their ids, and
the tops of the groups have a tree of their own. Leaves are numbered over all tasks, cut into
blocks of arity ** height, and each block collapses its levels inside one array, by sequence,
transform, slice and aggregate. The roots of blocks are the leaves of the next round. Proofs
come down the same way: a block meets the proof of its root once, not once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BEFORE, prefix_sums, staged, table

ARITY, HEIGHT = 2, 10
#: The fields of a document's leaf, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "array<struct<left:string,right:string>>"
GROUP, SIZE, PLACE, BLOCK, NODE, LEVELS, MEMBERS, PROOF = (f"__pl_{x}" for x in ("group", "size", "place", "block", "node", "levels", "members", "proof"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*fields: Column) -> Column:
    """The leaf of a row: each field as `-` if null, else its UTF-8 bytes, `:` and itself."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _collapsed(nodes: Column, whole: Column, arity: int, height: int) -> Column:
    """The levels of a block, from its nodes to its root. A block that is a whole tree stops
    at one node, any other climbs all `height` levels."""

    def step(levels, _):
        now = F.element_at(levels, -1)
        above = F.transform(F.sequence(F.lit(1), F.size(now), F.lit(arity)), lambda i: digest(F.array_join(F.slice(now, i, F.lit(arity)), "")))
        return F.when(whole & (F.size(now) == 1), levels).otherwise(F.concat(levels, F.array(above)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(nodes), step)


def _steps(levels: Column, place: Column, arity: int, height: int) -> Column:
    """The proof of the node at `place` of a block, up to the root of the block."""
    widths = F.array(*[F.lit(arity**k) for k in range(height + 1)])

    def step(level, k):
        own = F.floor(place / F.get(widths, k)).cast("int")
        mine = F.pmod(own, F.lit(arity))
        run = F.slice(level, own - mine + 1, F.lit(arity))
        return F.struct(F.array_join(F.slice(run, F.lit(1), mine), "").alias("left"), F.array_join(F.slice(run, mine + 2, F.lit(arity)), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _trees(nodes: DataFrame, arity: int, height: int, most: int) -> list[DataFrame]:
    """nodes: GROUP, SIZE (of the group), PLACE, NODE and more. Tables of blocks, each built
    over the roots of the one before, until every group is one block."""
    width, out = arity**height, []
    while True:
        carried = [c for c in nodes.columns if c not in (GROUP, SIZE)]
        blocks = nodes.groupBy(GROUP, SIZE, F.floor(F.col(PLACE) / width).alias(BLOCK)).agg(F.sort_array(F.collect_list(F.struct(PLACE, *[c for c in carried if c != PLACE]))).alias(MEMBERS))
        levels = _collapsed(F.transform(MEMBERS, lambda m: m[NODE]), F.col(SIZE) <= width, arity, height)
        out.append(staged(blocks.withColumn(LEVELS, levels).withColumn(NODE, F.element_at(F.element_at(LEVELS, -1), 1)), "merkle"))
        if most <= width:
            return out
        most = -(-most // width)
        nodes = out[-1].select(GROUP, F.ceil(F.col(SIZE) / width).cast("bigint").alias(SIZE), F.col(BLOCK).alias(PLACE), NODE)


def _proofs(trees: list[DataFrame], above: DataFrame, arity: int, height: int) -> DataFrame:
    """above: GROUP, PROOF and more for each group, the proof of its top. Returns the first
    nodes of the trees with their proofs and those further columns."""
    more = [c for c in above.columns if c not in (GROUP, PROOF)]
    above = above.withColumn(BLOCK, F.lit(0).cast("bigint"))
    for k, blocks in enumerate(reversed(trees)):
        rows = blocks.drop(NODE).join(above, [GROUP, BLOCK])
        own = lambda m: F.concat(_steps(F.col(LEVELS), F.pmod(m[PLACE], F.lit(arity**height)), arity, height), F.col(PROOF))
        names = [f.name for f in blocks.schema[MEMBERS].dataType.elementType.fields]
        rows = rows.select(GROUP, *more, F.inline(F.transform(MEMBERS, lambda m: F.struct(*[m[c].alias(c) for c in names], own(m).alias("__pl_steps")))))
        if k + 1 < len(trees):
            above = rows.select(GROUP, *more, F.col("__pl_steps").alias(PROOF), F.col(PLACE).alias(BLOCK))
    return rows


def manifest(docs: DataFrame, leaf: Column, id: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """For each row: id, leaf, subroot (of its group), root (of the table), proof (left and
    right siblings of every level, up to the root) and the columns of `carry`.

    Leaves of a group ascend by id, null first; rows that repeat an id by their leaf, so that
    equal rows are interchangeable. Groups ascend by UTF-8 bytes, null first. A lone leaf is
    its own subroot, a lone subroot the root; an empty table gives no rows. Null and empty
    fields are told apart by leaf_of(). Other columns of docs, however named, play no part."""
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("v"), F.col(f"`{group}`").cast("string")), F.lit("n"))  # null first, and never null
    rows = staged(docs.select(key.alias(GROUP), F.col(f"`{id}`").alias("__pl_id"), leaf.alias(NODE), *[c.alias(f"__pl_c_{n}") for n, c in carry.items()]), "leaves")
    sizes = staged(rows.groupBy(GROUP).agg(F.count("*").alias(SIZE)), "groups")
    most, groups = sizes.agg(F.max(SIZE), F.count("*")).first()
    leaves = prefix_sums(rows, [GROUP], ["__pl_id", NODE], F.lit(1), sizes).withColumnRenamed(BEFORE, PLACE)
    trees = _trees(leaves, arity, height, most or 1)
    tops = staged(trees[-1].select(F.lit("").alias("__pl_all"), GROUP, F.col(NODE).alias(NODE)), "tops")
    tops = prefix_sums(tops, ["__pl_all"], [GROUP], F.lit(1)).select(F.col("__pl_all"), F.lit(groups).cast("bigint").alias(SIZE), F.col(BEFORE).alias(PLACE), NODE, F.col(GROUP).alias("__pl_of"))
    above = _trees(tops.withColumnRenamed("__pl_all", GROUP), arity, height, groups or 1)
    start = above[-1].select(GROUP, F.col(NODE).alias("root"), F.array().cast(STEP).alias(PROOF))
    roots = _proofs(above, start, arity, height).select(F.col("__pl_of").alias(GROUP), F.col(NODE).alias("subroot"), "root", F.col("__pl_steps").alias(PROOF))
    out = _proofs(trees, staged(roots, "roots"), arity, height)
    return out.select(F.col("__pl_id").alias(id), F.col(NODE).alias("leaf"), "subroot", "root", F.col("__pl_steps").alias("proof"), *[F.col(f"__pl_c_{n}").alias(n) for n in carry])


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = leaf_of(*[F.try_add(F.col(c), F.lit(1).cast("bigint")) if c == "n_chars" else F.col(c) for c in FIELDS])
    leaf = leaf_of(*map(F.col, FIELDS))
    found = manifest(docs, leaf, carry={"presented": F.when(tampered, claim).otherwise(leaf)})
    root = folded(F.col("presented"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 by its public rule: a table of 256 remainders, and a fold over bytes.
CRC_TABLE = "[list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) FOR i IN range(256)]"


def crc32_sql(codes: str, table: str) -> str:
    return f"xor(list_reduce({codes}, lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


def _oracle() -> str:
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(n if c == "n_chars" else c) for c in FIELDS) + ")"
    codes = "[CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]"
    tree = lambda name, start: f"""{name}(lvl, g, n, i, h) AS ({start}
  UNION ALL SELECT lvl + 1, g, (n + 1) // 2, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY lvl, g, n, i // 2)"""  # noqa: E731
    proof = lambda name, keys, nodes, own, base: f"""{name} AS (SELECT {keys}, list(CASE WHEN s.h IS NULL THEN 'N' WHEN s.i < p.j THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY p.lvl) AS steps
  FROM (SELECT d.*, t.lvl, CAST({own} // CAST(2 ** t.lvl AS BIGINT) AS BIGINT) AS j FROM {base} d JOIN (SELECT DISTINCT lvl, g FROM {nodes} WHERE n > 1) t ON t.g = d.g) p LEFT JOIN {nodes} s ON s.lvl = p.lvl AND s.g = p.g AND s.i = xor(p.j, 1) GROUP BY {keys})"""  # noqa: E731
    return f"""WITH RECURSIVE k AS (SELECT {CRC_TABLE} AS t),
d AS (SELECT r, doc_id, g, leaf, presented, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce('v' || lang, 'n') AS g, {leaf('n_chars')} AS leaf, CASE WHEN {crc32_sql(codes, 'k.t')} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE {leaf('n_chars')} END AS presented FROM documents, k)),
{tree('t', 'SELECT 0, g, n, place, leaf FROM d')},
s AS (SELECT g AS lang, '' AS g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
{tree('u', 'SELECT 0, g, n, place, h FROM s')},
{proof('a', 'r', 't', 'd.place', 'd')},
{proof('b', 'lang', 'u', 'd.place', 's')},
w AS (SELECT d.doc_id, d.leaf, d.presented, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps FROM d JOIN s ON s.lang = d.g LEFT JOIN a ON a.r = d.r LEFT JOIN b ON b.lang = d.g),
f AS (SELECT *, list_reduce(steps, lambda x, y: sha256(CASE y[1] WHEN 'L' THEN y[2:] || x WHEN 'R' THEN x || y[2:] ELSE x END), presented) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string([x[2:] FOR x IN steps], ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""


ORACLE_SQL = _oracle()
