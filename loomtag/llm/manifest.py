"""Merkle manifest of a table: leaf places by rank queries on bitmaps, levels reduced by arrays of keyed slots.

A group's ids are a compressed bitmap: one row of 64 bits for each word of 64 ids
that is in use, merged with bit_or before and after the shuffle. The popcount
directory gives every word the number of rows before it in its group: words are
summed into blocks of 2^16 ids, these into spans of 2^32 and 2^48, and each running
sum goes over the children of one parent, at most 2^16 rows, however many rows a
group holds. The rank of an id is the directory's number plus the bits below its own,
so rows are placed without being sorted.

A tree hashes three children into a parent. Rows go to the slots of a keyed array, 729
of them, which are six levels; the arrays' own nodes are the rows of the next tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtag.llm.shared import let, running_sums, saved

#: Children of a node; levels that one array of slots reduces.
FANOUT, TIER = 3, 6
SLOTS = FANOUT**TIER
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DEPTHS = range(40)  # 3^39 is the last power of three in a long


def sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return sha(F.concat(*[field(c) for c in columns]))


def _packed(digest: Column) -> Column:
    return F.unhex(digest)


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def depth_of(n: Column) -> Column:
    """Levels above n nodes: the least d with 3^d >= n."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in _DEPTHS), F.lit(0))


# --- ranks -----------------------------------------------------------------------


def bitmaps(rows: DataFrame) -> DataFrame:
    """(grp, word, bits, n): the ids of each group as words of 64 bits, and the rows of each word; null ids are left out."""
    ids = rows.where("id IS NOT NULL").select("grp", F.shiftright("id", 6).alias("word"), F.expr("shiftleft(1L, CAST(id & 63 AS INT))").alias("bit"))
    return ids.groupBy("grp", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame, nulls: DataFrame) -> DataFrame:
    """words (grp, word, bits, size) with before: the rows of the group on smaller ids; nulls is (grp, nulls), which come first.

    Four levels of running sums, each over the children of one parent.
    """
    level, sums = words.withColumn("key", F.col("word")), []
    for shift in (10, 16, 16):  # words of a block of 2^16 ids, blocks of a span of 2^32, spans of 2^48
        level = level.withColumn("parent", F.shiftright("key", shift))
        order = Window.partitionBy("grp", "parent").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        sums.append(level.withColumn("ahead", F.coalesce(F.sum("size").over(order), F.lit(0))))
        level = level.groupBy("grp", "parent").agg(F.sum("size").alias("size")).withColumnRenamed("parent", "key")
    order = Window.partitionBy("grp").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    above = level.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).select("grp", F.col("key").alias("parent"), "before")
    above = above.join(nulls, "grp", "left").select("grp", "parent", (F.col("before") + F.coalesce("nulls", F.lit(0))).alias("before"))
    for ahead in sums[:0:-1]:
        above = ahead.join(above, ["grp", "parent"]).select("grp", F.col("key").alias("parent"), (F.col("ahead") + F.col("before")).alias("before"))
    return sums[0].join(above, ["grp", "parent"]).select("grp", "word", "bits", (F.col("ahead") + F.col("before")).alias("before"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (grp, id, tie, …) with rank: the place in the group by (id, tie), null ids first.

    Where ids repeat, a word counts rows instead of bits: its ids and their rows are
    summed in an array of at most 64, and the rows of a repeated id are numbered by
    (tie) through running sums over range partitions, a third of all rows too.
    """
    words = saved(bitmaps(rows), "bitmaps")
    # null ids of a group are rows of one repeated id that comes before all others
    nulls = rows.where("id IS NULL").groupBy("grp").agg(F.count("*").alias("nulls"))
    total = words.agg(F.coalesce(F.sum(F.col("n") - F.bit_count("bits")), F.lit(0)).alias("extra")).first()["extra"]
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, CAST(id & 63 AS INT))"))).cast("long")
    met = rows.withColumn("word", F.shiftright("id", 6))
    found = directory(words.withColumn("size", F.col("n")), nulls)
    if not total and not nulls.head(1):
        return met.join(found, ["grp", "word"]).withColumn("rank", F.col("before") + below).drop("word", "bits", "before")
    # repeated ids: rows of each id below the own one in its word, and the number among equals
    ids = saved(rows.groupBy("grp", "id").agg(F.count("*").alias("n")), "ids")
    lower = Window.partitionBy("grp", "word").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ids = ids.withColumn("word", F.shiftright("id", 6)).withColumn("below", F.when(F.col("id").isNotNull(), F.coalesce(F.sum("n").over(lower), F.lit(0))).otherwise(0))
    base = ids.join(found, ["grp", "word"], "left").select("grp", "id", "n", (F.col("below") + F.coalesce("before", F.lit(0))).alias("base"))
    base = saved(base, "bases")
    same = (F.col("r.grp") == F.col("b.grp")) & F.col("r.id").eqNullSafe(F.col("b.id"))
    joined = rows.alias("r").join(base.alias("b"), same).select("r.*", "b.n", "b.base")
    once = joined.where("n = 1").drop("n").withColumn("rank", F.col("base")).drop("base")
    again = joined.where("n > 1").drop("n").withColumn("_own", F.monotonically_increasing_id())
    again = saved(again, "repeated")
    order = [F.col("grp"), F.col("id"), F.col("tie"), F.col("_own")]
    numbered = saved(running_sums(again, order, {"_at": F.lit(1)}, "numbered"), "numbers")
    first = numbered.groupBy("grp", "id").agg(F.min("_at").alias("_first"))
    same = (F.col("r.grp") == F.col("b.grp")) & F.col("r.id").eqNullSafe(F.col("b.id"))
    more = numbered.alias("r").join(first.alias("b"), same).select("r.*", "b._first")
    more = more.withColumn("rank", F.col("base") + F.col("_at") - F.col("_first")).drop("base", "_own", "_at", "_first")
    return once.unionByName(more)


# --- trees -----------------------------------------------------------------------


def _levels(nodes: Column, depth: Column) -> Column:
    """Arrays of the nodes of each level, from the given ones up by depth levels."""
    below = lambda acc: F.element_at(acc, -1)
    up = lambda level: F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), lambda i: sha(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), "")))
    steps = F.filter(F.array(*[F.lit(k) for k in range(TIER)]), lambda k: k < depth)
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(up(below(acc)))))


def _siblings(levels: Column, slot: Column) -> Column:
    """The other nodes of the runs on the way from a slot to the top, left to right, level by level."""
    power = F.array(*[F.lit(FANOUT**k) for k in range(TIER + 1)])
    at = lambda k: F.floor(slot / F.get(power, k)).cast("int")

    def others(level: Column, k: Column) -> Column:
        run = F.slice(level, at(k + 1) * FANOUT + 1, FANOUT)
        return F.array_join(F.filter(run, lambda _, p: p != at(k) % FANOUT), "")

    return F.array_join(F.transform(F.slice(levels, 1, F.size(levels) - 1), others), "")


def _arrays(nodes: DataFrame, depth: Column, done: int) -> DataFrame:
    """(tree, g, slots, levels): arrays of 729 consecutive nodes (tree, rank, digest, …) of a level, and what they reduce to."""
    slot = F.struct((F.col("rank") % SLOTS).cast("int").alias("slot"), *[F.col(c) for c in nodes.columns if c not in ("tree", "tree_size")])
    arrays = nodes.groupBy("tree", F.floor(F.col("rank") / SLOTS).alias("g")).agg(F.sort_array(F.collect_list(slot)).alias("slots"), F.first("tree_size").alias("size"))
    left = F.least(depth - done, F.lit(TIER))
    return arrays.select("tree", "g", "slots", "size", _levels(F.transform("slots", lambda x: _text(x["digest"])), left).alias("levels"))


def hashed(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(tree, root) and the arrays of the lowest tier with the siblings above them: (tree, g, slots, levels, size, above).

    nodes are (tree, rank, digest, tree_size, …), ranks dense from 0 in each tree. Each
    tier reads the nodes of the one below, a 729th; the way back appends to each
    array the siblings of its node.
    """
    most = nodes.agg(F.max("tree_size")).first()[0] or 0
    tiers = [saved(_arrays(nodes, depth_of(F.col("size")), 0), name)]
    done, reach = TIER, SLOTS
    while reach < most:
        tops = tiers[-1].select("tree", F.col("g").alias("rank"), _packed(F.element_at(F.element_at("levels", -1), 1)).alias("digest"), F.col("size").alias("tree_size"))
        tiers.append(saved(_arrays(tops.where(F.col("tree_size") > reach), depth_of(F.col("size")), done), name))
        done, reach = done + TIER, reach * SLOTS
    roots, above = None, None
    for k, tier in reversed(list(enumerate(tiers))):
        top = tier.where(F.col("size") <= SLOTS ** (k + 1))
        own = top.select("tree", F.element_at(F.element_at("levels", -1), 1).alias("root"))
        roots = own if roots is None else roots.unionByName(own)
        tier = tier.withColumn("above", F.lit("")) if above is None else tier.join(above, ["tree", "g"], "left").withColumn("above", F.coalesce("above", F.lit("")))
        if k:
            parts = tier.select("tree", F.explode("slots").alias("s"), "levels", "above")
            above = parts.select("tree", F.col("s.rank").alias("g"), F.concat(_siblings(F.col("levels"), F.col("s.slot")), F.col("above")).alias("above"))
            above = saved(above, name)
    return roots, tier


def _less_than(n: Column):
    return lambda width: width < n


def _climb(proof: Column, rank: Column, n: Column):
    """The step of folded() at nodes that stand for `width` leaves each."""

    def step(acc: Column, width: Column) -> Column:
        place = F.floor(rank / width).cast("long")
        own = (place % FANOUT).cast("int")
        others = F.least(F.ceil(n / width).cast("long") - place + own, F.lit(FANOUT)).cast("int") - 1
        rest = F.substring(proof, acc["at"] + 1, 64 * others)
        both = F.concat(F.substring(rest, F.lit(1), 64 * own), acc["h"], F.substring(rest, 64 * own + 1, F.lit(64 * FANOUT)))
        return F.struct(sha(both).alias("h"), (acc["at"] + 64 * others).alias("at"))

    return step


def folded(start: Column, proof: Column, ways: list[tuple[Column, Column]]) -> Column:
    """The hash that start and the siblings of a proof lead to; ways are (rank, number of leaves) of the trees that it climbs."""
    state = F.struct(start.alias("h"), F.lit(0).alias("at"))
    for rank, n in ways:
        widths = F.filter(F.array(*[F.lit(FANOUT**k) for k in _DEPTHS]), _less_than(n))
        state = F.aggregate(widths, state, _climb(proof, rank, n))
    return state["h"]


def manifest(docs: DataFrame, changed: Column, group: str = "source", id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id_col, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs.

    Groups are trees of their own, a null group too; their roots, in order of the
    groups (null first, bytewise), are the leaves of the tree of the whole table.
    changed is the text that is checked against the manifest: the proof of the row
    is folded from the leaf that it gives, and verified says whether that ends at the root.

    Null ids come first in their group; rows that repeat an id follow one another by
    their leaves, and equal rows take their places in any order, which changes no
    result but which of them has which proof. Nulls in other fields are hashed as
    `-`. Texts are hashed whole. An empty table gives no rows; columns besides the
    fields are ignored. A source may hold any share of the rows, an id too.
    """
    own, other = leaf([F.col(f"`{c}`") for c in fields]), leaf([changed if c == text_col else F.col(f"`{c}`") for c in fields])
    rows = docs.select(F.col(group).alias("name"), F.col(id_col).cast("long").alias("id"), own.alias("leaf"), other.alias("other"))
    rows = saved(rows.select(F.struct(F.col("name").isNotNull().alias("known"), F.coalesce("name", F.lit("")).alias("name")).alias("grp"), "id", _packed(F.col("leaf")).alias("tie"), _packed(F.col("other")).alias("other")), "leaves")
    groups = rows.groupBy("grp").agg(F.count("*").alias("tree_size"))
    groups = saved(running_sums(groups, [F.col("grp")], {"tree": F.lit(1).cast("long")}, "groups"), "numbered-groups")
    placed = ranked(rows).join(groups, "grp")
    nodes = placed.select("tree", "rank", F.col("tie").alias("digest"), "tree_size", "id", "other")
    subroots, arrays = hashed(nodes, "slots")
    subroots = saved(subroots, "subroots")
    tops = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), _packed(F.col("root")).alias("digest"))
    tops = tops.withColumn("tree_size", subroots.agg(F.count("*").alias("n")).scalar())
    roots, above = hashed(tops, "top-slots")
    ways = above.select(F.explode("slots").alias("s"), "levels", "above", "size")
    ways = ways.select(F.col("s.rank").alias("tree"), F.col("size").alias("trees"), _text(F.col("s.digest")).alias("subroot"), F.concat(_siblings(F.col("levels"), F.col("s.slot")), F.col("above")).alias("over"))
    ways = saved(ways.withColumn("root", roots.select("root").scalar()), "ways")
    found = arrays.join(ways, "tree").select("tree", "trees", "size", "subroot", "root", "levels", F.concat("above", "over").alias("above"), F.explode("slots").alias("s"))
    proof = F.concat(_siblings(F.col("levels"), F.col("s.slot")), F.col("above"))
    found = found.select("*", let(proof, lambda p: F.struct(sha(p).alias("proof"), folded(_text(F.col("s.other")), p, [(F.col("s.rank"), F.col("size")), (F.col("tree"), F.col("trees"))]).alias("folded"))).alias("p"))
    return found.select(
        F.col("s.id").alias(id_col), _text(F.col("s.digest")).alias("leaf"), "subroot", "root", F.col("p.proof").alias("proof_sha256"),
        F.col("p.folded").alias("folded_root"), (F.col("p.folded") == F.col("root")).alias("verified"),
    )


def tampered(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without line ends where 2 divides the CRC-32 of the id in decimal."""
    odd = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2
    return F.when(odd == 0, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))


def _sql(levels: int = 14) -> str:
    """DuckDB SQL: every level of both trees as a table of its own; enough for groups of 3^14 rows."""
    def tree(name: str, first: str) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for k in range(levels):  # a tree that has one node left has no further level
            out.append(f"{name}{k + 1} AS (SELECT tree, n, pos // 3 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE n > {3**k} GROUP BY tree, n, pos // 3)")
        out.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT {k} AS level, {3**k}::BIGINT AS width, * FROM {name}{k}" for k in range(levels + 1)) + ")")
        return out

    byte = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = f"list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: {byte}))"
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    hashed_leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    climb = []
    for k in range(levels):
        climb.append(
            f"c{k + 1} AS (SELECT c.doc_id, CASE WHEN any_value(w.n) > {3**k} THEN sha256(string_agg(CASE WHEN t.pos = w.pos // {3**k} THEN c.h ELSE t.h END, '' ORDER BY t.pos)) ELSE any_value(c.h) END AS h "
            f"FROM c{k} c JOIN p w USING (doc_id) LEFT JOIN s{k} t ON w.n > {3**k} AND t.tree = w.tree AND t.pos // 3 = w.pos // {3 ** (k + 1)} GROUP BY c.doc_id)"
        )
    for k in range(levels):
        climb.append(
            f"e{k + 1} AS (SELECT c.doc_id, CASE WHEN any_value(w.trees) > {3**k} THEN sha256(string_agg(CASE WHEN t.pos = w.tree // {3**k} THEN c.h ELSE t.h END, '' ORDER BY t.pos)) ELSE any_value(c.h) END AS h "
            f"FROM {'e' + str(k) if k else 'c' + str(levels)} c JOIN p w USING (doc_id) LEFT JOIN r{k} t ON w.trees > {3**k} AND t.pos // 3 = w.tree // {3 ** (k + 1)} GROUP BY c.doc_id)"
        )
    return ",\n".join([
        f"WITH d AS (SELECT doc_id, source, {hashed_leaf('text')} AS leaf, CASE WHEN {crc} & 1 = 1 THEN {hashed_leaf(chr(39).join(['replace(text, chr(10), ', '', ')']))} ELSE {hashed_leaf('text')} END AS other FROM documents)",
        "g AS (SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree, count(*) AS n, count(*) OVER () AS trees FROM d GROUP BY source)",
        "p AS (SELECT d.*, g.tree, g.n, g.trees, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id) - 1 AS pos FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)",
        *tree("s", "SELECT tree, n, pos, leaf AS h FROM p"),
        "u AS (SELECT tree, arg_max(h, level) AS h FROM s WHERE pos = 0 AND n <= width GROUP BY tree)",
        *tree("r", "SELECT 0 AS tree, (SELECT count(*) FROM u) AS n, tree AS pos, h FROM u"),
        "top AS (SELECT arg_max(h, level) AS root FROM r WHERE pos = 0 AND n <= width)",
        "x AS (SELECT doc_id, 0 AS part, level, t.pos, t.h FROM p JOIN s t ON t.tree = p.tree AND t.pos // 3 = p.pos // (3 * t.width) AND t.pos <> p.pos // t.width AND p.n > t.width"
        " UNION ALL SELECT doc_id, 1, level, t.pos, t.h FROM p JOIN r t ON t.pos // 3 = p.tree // (3 * t.width) AND t.pos <> p.tree // t.width AND p.trees > t.width)",
        "q AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY part, level, pos)) AS proof FROM x GROUP BY doc_id)",
        "c0 AS (SELECT doc_id, other AS h FROM p)", *climb,
    ]) + f"""
SELECT p.doc_id, p.leaf, u.h AS subroot, top.root, coalesce(q.proof, sha256('')) AS proof_sha256, e{levels}.h AS folded_root, e{levels}.h = top.root AS verified
FROM p JOIN u USING (tree) CROSS JOIN top LEFT JOIN q USING (doc_id) JOIN e{levels} USING (doc_id)
"""  # fmt: skip


#: DuckDB SQL for manifest over documents with distinct ids.
SQL = _sql()
