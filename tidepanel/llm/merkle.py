"""A Merkle manifest of a dataset: content-addressed records, membership proofs by descent, and their recomputation.

``manifest`` hashes every row to a leaf, orders the leaves of each group, and hashes every ``fan`` consecutive nodes to
a parent until one is left for the group (its subroot); the subroots, in the order of their groups, are hashed the same
way to the root. What is stored is a table of records ``digest -> children`` for every height, whose address is their
content, and the leaves in blocks of one parent. ``prove`` descends from the root for all requests at once: requests
that share the digits of their rank so far are one frontier row, each height joins the frontier with the records by
digest, and the child picked by the next digit takes along what was not picked. A path is therefore gathered root
first; it is turned round at the leaf. The long upper part of a path travels once for each block of leaves, never with
each leaf.

Ranks come from a range shuffle of the digests (texts are never shuffled): each shard numbers its rows, and one row for
each shard and group carries the offsets. A group of any size is spread over shards, identical rows too. Heights are
jobs of their own, each a ``fan``-th of the one below.

Null ids come first in their group, a null group is the first group. Rows with equal ids are ordered by their digest;
identical rows have equal leaves and proofs of their own. Empty texts and null columns are hashed like all values
(``-`` for null). A table without rows has no root and no proofs. Very long texts are hashed whole, in the JVM. Other
columns take no part; the operators only use the columns named, so that clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(columns: tuple[str, ...], changed: dict[str, Column] | None = None) -> Column:
    """Digest of a row: each value as byte count, colon and text, or a dash if null. ``changed`` replaces columns."""
    texts = [(changed or {}).get(c, F.col(f"`{c}`")).cast("string") for c in columns]
    return _digest(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with slot (index of its group in the order of groups), rank (index of the row in its group) and n (rows
    of the group). ``df`` is a stored table."""
    placed = df.withColumn("_tie", F.monotonically_increasing_id()) \
        .repartitionByRange(common.tasks(df), group, *order, "_tie") \
        .sortWithinPartitions(group, *order, "_tie").drop("_tie") \
        .withColumn("_shard", F.spark_partition_id()) \
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = common.stored(placed, "ranked")
    spans = placed.groupBy("_shard", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # One row for each shard and group: as small as shards plus groups.
    by_group = Window.partitionBy(group)
    spans = spans.withColumn("_before", F.sum("_rows").over(by_group.orderBy("_shard")) - F.col("_rows")) \
        .withColumn("n", F.sum("_rows").over(by_group)) \
        .withColumn("_begins", (F.col("_before") == 0).cast("long"))
    spans = spans.withColumn("_inside", F.sum("_begins").over(Window.partitionBy("_shard").orderBy(group)))
    shards = spans.groupBy("_shard").agg(F.sum("_begins").alias("_new"))
    shards = shards.select("_shard", (F.sum("_new").over(Window.orderBy("_shard")) - F.col("_new")).alias("_groups"))
    spans = spans.join(shards, "_shard").withColumn("slot", F.max(F.when(
        F.col("_begins") == 1, F.col("_groups") + F.col("_inside") - 1)).over(by_group))
    spans = spans.select(F.col("_shard").alias("_s"), F.col(group).alias("_g"), "_first", "_before", "n", "slot")
    same = (F.col("_shard") == F.col("_s")) & F.col(group).eqNullSafe(F.col("_g"))
    return placed.join(spans, same).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")) \
        .drop("_shard", "_at", "_s", "_g", "_first", "_before")


def _heights(n: int, fan: int) -> int:
    found = 0
    while n > 1:
        n, found = -(-n // fan), found + 1
    return found


def _parents(nodes: DataFrame, fan: int, name: str) -> DataFrame:
    """The next height of nodes (slot, at, n, digest): every ``fan`` consecutive ones of a slot become one."""
    runs = nodes.groupBy("slot", F.floor(F.col("at") / fan).alias("up"), F.ceil(F.col("n") / fan).alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("children"))
    return common.stored(runs.select("slot", F.col("up").alias("at"), "n", F.sha2(
        F.concat_ws("", "children"), 256).alias("digest"), "children"), name)


@dataclass
class Manifest:
    """``leaves``: blocks (slot, at, n, digest, rows) of up to ``fan`` rows (id, leaf and what was kept along);
    ``records``: for each height the table (slot, at, n, digest, children), ``top`` those above the subroots;
    ``groups``: slot, subroot and height of each group."""
    root: str | None
    fan: int
    leaves: DataFrame
    records: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "source", fan: int = 16) -> Manifest:
    """The tree over ``rows``, which hold an id, a group, the column ``leaf`` and any columns to keep along."""
    kept = [c for c in rows.columns if c not in (id_col, group_col, "leaf")]
    stored = common.stored(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("group"), "leaf",
                                       *kept), "leaves")
    placed = ranked(stored, "group", ["id", "leaf"])
    blocks = placed.groupBy("slot", F.floor(F.col("rank") / fan).alias("at"), "n").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "leaf", *kept))).alias("rows"))
    leaves = F.transform("rows", lambda r: r["leaf"])
    blocks = common.stored(blocks.withColumn("digest", F.when(F.col("n") == 1, leaves[0]).otherwise(
        F.sha2(F.concat_ws("", leaves), 256))), "blocks")
    # Height 1; a group of a single leaf has no node.
    level = blocks.where("n > 1").select("slot", "at", F.ceil(F.col("n") / fan).alias("n"), "digest",
                                         F.transform("rows", lambda r: r["leaf"]).alias("children"))
    size = blocks.agg(F.max("n"), F.count_distinct("slot")).first()
    tallest, count = _heights(size[0] or 0, fan), size[1]
    records, alone = [level], [blocks.where("n = 1").select("slot", "digest", F.lit(0).alias("height"))]
    for height in range(1, tallest + 1):
        alone.append(level.where("n = 1").select("slot", "digest", F.lit(height).alias("height")))
        if height < tallest:
            level = _parents(level.where("n > 1"), fan, "nodes")
            records.append(level)
    groups = alone[0]
    for more in alone[1:]:
        groups = groups.unionByName(more)
    groups = common.stored(groups, "subroots")
    level, top = groups.select(F.lit(0).cast("long").alias("slot"), F.col("slot").alias("at"),
                               F.lit(count).cast("long").alias("n"), "digest"), []
    for _ in range(_heights(count, fan)):
        level = _parents(level, fan, "top")
        top.append(level)
    root = level.select("digest").first()
    return Manifest(root and root[0], fan, blocks, records, top, groups)


def _descend(frontier: DataFrame, records: DataFrame, fan: int) -> DataFrame:
    """The children of a frontier (at, digest, path and more), each with a segment of what was not picked. Neither side
    is broadcast: paths of one prefix are small when compressed, but not on the driver."""
    known = records.groupBy("digest").agg(F.first("children").alias("children"))
    rest = [c for c in frontier.columns if c not in ("at", "digest", "path")]
    found = frontier.join(known.hint("merge"), "digest").select(*rest, "at", "path", "children", F.posexplode("children"))
    return found.select(*rest, (F.col("at") * fan + F.col("pos")).alias("at"), F.col("col").alias("digest"),
                        F.array_append("path", _segment("children", F.col("pos"))).alias("path"))


def _segment(children: str, pos: Column) -> Column:
    """What stands left and right of a child among its parent's children."""
    held = F.col(children)
    return F.struct(F.concat_ws("", F.slice(held, F.lit(1), pos)).alias("left"), F.concat_ws(
        "", F.slice(held, pos + 2, F.greatest(F.size(held) - pos - 1, F.lit(0)))).alias("right"))


def prove(tree: Manifest) -> DataFrame:
    """For every row: id, group slot, rank, leaf, kept columns, subroot, and path: (left, right) siblings, leaf first."""
    start = F.expr("CAST(array() AS array<struct<left: string, right: string>>)")
    if tree.top:
        found = tree.top[-1].select("at", "digest", start.alias("path"))
        for level in reversed(tree.top):
            found = _descend(found, level, tree.fan)
        found = found.withColumnRenamed("at", "slot").join(tree.groups.select("slot", "height"), "slot")
    else:
        found = tree.groups.select("slot", "digest", "height", start.alias("path"))
    begun = common.stored(found.withColumn("subroot", F.col("digest")).withColumn("at", F.lit(0).cast("long")), "begun")
    active = None
    for height in range(len(tree.records), 1, -1):
        here = begun.where(F.col("height") == height).drop("height")
        active = here if active is None else active.unionByName(here)
        active = _descend(active, tree.records[height - 1], tree.fan)
    low = begun.where("height = 1").drop("height")
    low = low if active is None else low.unionByName(active)
    # The parents of leaves: their children come from the records, the rows that asked from the blocks.
    known = tree.records[0].groupBy("digest").agg(F.first("children").alias("children"))
    low = low.join(known.hint("merge"), "digest").drop("digest").unionByName(
        begun.where("height = 0").select("slot", "at", "path", "subroot", F.array("digest").alias("children")))
    rows = low.join(tree.leaves.select("slot", "at", "n", "rows").hint("merge"), ["slot", "at"]) \
        .select("slot", "subroot", "path", "children", "n", F.posexplode("rows").alias("pos", "row"))
    segment = F.when(F.col("n") > 1, F.array(_segment("children", F.col("pos")))).otherwise(start)
    return rows.select("slot", "row.*", "subroot", F.reverse(F.concat("path", segment)).alias("path"))


def fold(leaf: Column, path: Column | str) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda held, s: _digest(s["left"], held, s["right"]))


def siblings_digest(path: Column | str) -> Column:
    return F.sha2(F.aggregate(path, F.lit(""), lambda held, s: F.concat(held, s["left"], s["right"])), 256)


def audit(docs: DataFrame, fan: int = 16) -> DataFrame:
    """Proofs of all documents, and what they lead to after the texts of every fifth id's checksum are lower-cased."""
    tampered = row_digest(COLUMNS, {"text": F.translate("text", UPPER, LOWER)})
    rows = docs.select("doc_id", "source", row_digest(COLUMNS).alias("leaf"),
                       F.when(common.crc_of("doc_id") % 5 == 0, tampered).alias("tampered"))
    tree = manifest(rows, fan=fan)
    root = F.lit(tree.root).cast("string")
    out = prove(tree).select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"),
                             siblings_digest("path").alias("proof_sha256"),
                             fold(F.coalesce("tampered", "leaf"), "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def sql(fan: int = 16, heights: int = 4, top: int = 2) -> str:
    """The same by plain grouping, height by height, for up to fan ** heights leaves of a source."""
    def size(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}))::VARCHAR || ':' || {c} END"

    held = [f"{c}::VARCHAR" for c in COLUMNS]
    changed = [*held[:-1], f"translate(text, '{UPPER}', '{LOWER}')"]
    leaf, tampered = ("sha256(" + " || ".join(size(c) for c in cs) + ")" for cs in (held, changed))
    crc = ("xor(list_reduce(list_transform(range(8 * len(k)), lambda i: (ord(k[i // 8 + 1]) >> (i % 8)::INT) & 1), "
           "lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295), 4294967295)")
    parts = ["k AS (SELECT *, coalesce(doc_id::VARCHAR, '') AS k FROM documents)",
             f"l AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {tampered} END AS bad FROM k)",
             "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, "
             "dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS slot FROM l)",
             "a0 AS (SELECT slot, rank AS ix, leaf AS d, count(*) OVER (PARTITION BY slot) AS n FROM r)"]

    def level(name: str, low: str) -> str:
        return (f"{name} AS MATERIALIZED (SELECT slot, ix // {fan} AS ix, CASE WHEN any_value(n) = 1 THEN any_value(d) "
                f"ELSE sha256(string_agg(d, '' ORDER BY ix)) END AS d, (any_value(n) + {fan - 1}) // {fan} AS n, "
                f"any_value(n) = 1 AS done, list(d ORDER BY ix) AS ds FROM {low} GROUP BY slot, ix // {fan})")

    parts += [level(f"a{i}", f"a{i - 1}") for i in range(1, heights + 1)]
    parts.append(f"b0 AS (SELECT 0 AS slot, slot AS ix, d, count(*) OVER () AS n FROM a{heights})")
    parts += [level(f"b{i}", f"b{i - 1}") for i in range(1, top + 1)]
    steps, joins = [], []
    for name, at, slot, count in (("a", "r.rank", "r.slot", heights), ("b", "r.slot", "0", top)):
        for i in range(1, count + 1):
            joins.append(f"JOIN {name}{i} ON {name}{i}.slot = {slot} AND {name}{i}.ix = {at} // {fan ** i}")
            digit = f"({at} // {fan ** (i - 1)} % {fan})"
            side = [f"array_to_string({name}{i}.ds[{a}], '')" for a in (f":{digit}", f"{digit} + 2:")]
            steps.append((f"CASE WHEN {name}{i}.done THEN '' ELSE {side[0]} END",
                          f"CASE WHEN {name}{i}.done THEN '' ELSE {side[1]} END", f"{name}{i}.done"))
    columns = ", ".join(f"{a} AS x{i}, {b} AS y{i}, {c} AS z{i}" for i, (a, b, c) in enumerate(steps))
    parts.append(f"p AS MATERIALIZED (SELECT doc_id, leaf, coalesce(bad, leaf) AS f0, a{heights}.d AS subroot, b{top}.d AS root, "
                 f"{columns} FROM r {' '.join(joins)})")
    last = "p"
    for i in range(len(steps)):
        parts.append(f"f{i + 1} AS MATERIALIZED (SELECT *, CASE WHEN z{i} THEN f{i} ELSE sha256(x{i} || f{i} || y{i}) END AS f{i + 1} "
                     f"FROM {last})")
        last = f"f{i + 1}"
    proof = " || ".join(f"x{i} || y{i}" for i in range(len(steps)))
    end = f"f{len(steps)}"
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, "
            f"{end}.{end} AS folded_root, {end}.{end} = root AS verified FROM {end}")
