"""Shards of near-equal size that keep linked documents together, by balanced label propagation.

Nodes have sizes, links join two nodes. Linked nodes start with a shard by hash; a few nodes whose stars are
a large share of a shard start in shards that are dealt to them by falling size. Then, in each round:

1. Links meet the shards of their ends; votes are counted per node and shard, combined on the map side.
2. A node whose best shard has more votes than its own wants to move. Odd rounds count votes of smaller
   neighbours only, so that two nodes never just change places; in even rounds all neighbours vote and half
   of the nodes, by hash, may move.
3. Wanted moves are summed by pair of shards and by rank (gain, then hash). From these sums, of which there is a
   fixed number, quotas are found: the best ranks go first, and no shard's linked nodes get beyond its capacity.
   Nodes within the quotas move.

Rounds end when two in a row move nothing. Nodes without links then fill what is left of the shards. At last all
nodes are put in one order, by shard, with linked nodes next to each other and unlinked ones at both ends of their
shard, and the order is cut into pieces of equal size. The cuts are found by descent over the bits of a node's place
in that order: each level sums the few cells that hold a cut. So sizes differ by less than the nodes at a cut, and cuts fall
into unlinked nodes wherever there are any.

Everything is joins, sums and expressions: no Python runs in tasks. What the driver gets (sums per shard pair and
rank, sums per cell) has a fixed size. Link tables are stored before they are joined, so that adaptive
execution can split a node with many links.

Defined results: a null text has no bytes and is equal to an empty one. Rows are kept apart by stored row numbers, so
repeated rows and doc_ids, and null ones, each have their own result. A group of equal texts over the capacity of a
shard is linked in several stars by hash. Ties between shards go to the lower number. Fewer rows than shards
leave shards empty; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.llm.common import stored

SHARDS = 8
ROUNDS = 8
# Stars of at least this share of a shard are dealt by size; the largest, this many per shard.
STAR_SHARE, STARS = 1 / 16, 16
# Ranks of wanted moves: classes of gain by powers of two, each with as many steps by hash.
GAINS, STEPS = 32, 64
# Places have this many bits; each level of the search for cuts reads this many.
PLACE_BITS, LEVEL_BITS = 62, 14
SINGLES = 1 << 20
# Rows of a shard that are numbered together.
NUMBERED = 50_000


def _hash(*columns: Column | str | int) -> Column:
    return F.xxhash64(*(F.lit(c).cast("long") if isinstance(c, int) else c for c in columns))


def _votes(links: DataFrame, labels: DataFrame, smaller: bool) -> DataFrame:
    """Nodes that want to move: ``node, size, shard, to, gain``."""
    given = links.filter("b < a") if smaller else links
    near = given.join(labels.select(F.col("node").alias("b"), F.col("shard").alias("to")), "b")
    votes = near.groupBy("a", "to").agg(F.count(F.lit(1)).alias("n"))
    own = votes.join(labels, votes["a"] == labels["node"])
    # More votes first, then the lower shard; both in one number.
    score = F.shiftleft("n", 16) + F.lit((1 << 16) - 1) - F.col("to")
    best = own.groupBy("node", "size", "shard").agg(
        F.max(score).alias("score"), F.sum(F.when(F.col("to") == F.col("shard"), F.col("n")).otherwise(0)).alias("here")
    )
    to = (F.lit((1 << 16) - 1) - F.col("score").bitwiseAND((1 << 16) - 1)).cast("int")
    gain = F.shiftright("score", 16) - F.col("here")
    return best.select("node", "size", "shard", to.alias("to"), gain.alias("gain")).filter("gain > 0")


def quotas(wanted: dict[tuple[int, int], list[tuple[int, int]]], loads: list[int], capacity: float) -> dict[tuple[int, int], int]:
    """Ranks below which the moves of each pair of shards are let through.

    ``wanted`` has (rank, size) in rising order for each pair; loads of the shards are brought up to date.
    """
    at = dict.fromkeys(wanted, 0)
    waiting = sorted(wanted)
    while waiting:
        moved = []
        for pair in sorted(waiting, key=lambda p: (wanted[p][at[p]][0], p)):
            size = wanted[pair][at[pair]][1]
            if loads[pair[1]] + size <= capacity:
                loads[pair[0]] -= size
                loads[pair[1]] += size
                at[pair] += 1
                moved.append(pair)
        waiting = [p for p in waiting if at[p] < len(wanted[p])] if moved else []
    return {p: wanted[p][n - 1][0] + 1 if n else 0 for p, n in at.items()}


def _starts(linked: DataFrame, shards: int, capacity: float) -> dict[int, int]:
    """Shards of the nodes with the largest stars, by falling size into the emptiest shard."""
    large = linked.filter((F.col("star") >= capacity * STAR_SHARE) & (F.col("node") == F.col("key")))
    top = large.orderBy(F.col("star").desc(), "node").limit(STARS * shards).select("node", "star").collect()
    filled, out = [0] * shards, {}
    for node, star in top:
        out[node] = min(range(shards), key=lambda s: (filled[s], s))
        filled[out[node]] += star
    return out


def _lookup(column: Column, values: dict[int, int], other: Column) -> Column:
    """The value of a few given numbers; ``other`` for all others."""
    for key, value in values.items():
        other = F.when(column == F.lit(key).cast("long"), F.lit(value)).otherwise(other)
    return other


def propagate(nodes: DataFrame, links: DataFrame, shards: int, rounds: int, capacity: float) -> DataFrame:
    """``node, size, key, shard`` of the linked nodes; the key is the least of a node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = stored(both)
    near = both.join(nodes.select(F.col("node").alias("b"), F.col("size").alias("far")), "b")
    stars = stored(near.groupBy("a").agg(F.min("b").alias("least"), F.sum("far").alias("far")))
    linked = stored(nodes.join(stars, nodes["node"] == stars["a"]).select(
        "node", "size", F.least("node", "least").alias("key"), (F.col("size") + F.col("far")).alias("star")
    ))
    start = _lookup(F.col("node"), _starts(linked, shards, capacity), F.pmod(_hash("node"), F.lit(shards)).cast("int"))
    labels, idle = stored(linked.select("node", "size", "key", start.cast("int").alias("shard"))), 0
    for turn in range(1, rounds + 1):
        movers = _votes(both, labels, turn % 2 == 1)
        if turn % 2 == 0:
            movers = movers.filter(F.pmod(_hash("node", turn), F.lit(2)) == 0)
        level = F.least(F.floor(F.log2("gain")), F.lit(GAINS - 1)).cast("int")
        rank = (F.lit(GAINS - 1) - level) * STEPS + F.pmod(_hash("node", turn), F.lit(STEPS)).cast("int")
        movers = stored(movers.withColumn("rank", rank))
        loads = [0] * shards
        for shard, size in labels.groupBy("shard").agg(F.sum("size")).collect():
            loads[shard] = size
        wanted = defaultdict(list)
        # At most shards x shards x GAINS x STEPS sums.
        for shard, to, step, size in movers.groupBy("shard", "to", "rank").agg(F.sum("size")).orderBy("rank").collect():
            wanted[shard, to].append((step, size))
        limits = quotas(wanted, loads, capacity)
        idle = 0 if any(limits.values()) else idle + 1
        if idle == 2:
            break
        if any(limits.values()):
            limit = F.element_at(F.array(*(F.lit(limits.get((s, t), 0)) for s in range(shards) for t in range(shards))), F.col("shard") * shards + F.col("to") + 1)
            going = movers.filter(F.col("rank") < limit).select(F.col("node").alias("mover"), "to")
            moved = labels.join(going, labels["node"] == going["mover"], "left")
            labels = stored(moved.select("node", "size", "key", F.coalesce("to", "shard").alias("shard")))
    return labels


def cuts(placed: DataFrame, targets: list[float]) -> list[int]:
    """Places below which the rows of ``placed(place, size)`` have sizes that add up to the targets, as nearly as rows allow."""
    found, cells, width = [0] * len(targets), {0: (0, list(range(len(targets))))}, PLACE_BITS
    while cells:
        given = placed if width == PLACE_BITS else placed.filter(F.shiftright("place", width).isin(list(cells)))
        width, above = max(width - LEVEL_BITS, 0), width
        sums = defaultdict(list)
        # At most 2 ** LEVEL_BITS cells for each cut.
        for cell, size in given.groupBy(F.shiftright("place", width).alias("cell")).agg(F.sum("size")).orderBy("cell").collect():
            sums[cell >> (above - width)].append((cell, size))
        next_cells: dict[int, tuple[int, list[int]]] = {}
        for parent, (before, own) in cells.items():
            for cell, size in sums[parent]:
                inside = [n for n in own if before <= targets[n] < before + size]
                if inside and width:
                    next_cells[cell] = (before, inside)
                for n in inside if not width else ():
                    found[n] = cell + (targets[n] - before >= size / 2)
                before += size
        cells = next_cells if width else {}
    return found


def even_out(nodes: DataFrame, labels: DataFrame, shards: int, total: int) -> DataFrame:
    """``node, size, shard`` of all nodes, with sizes as equal as nodes allow."""
    loads = dict(labels.groupBy("shard").agg(F.sum("size")).collect())
    gaps = [max(total / shards - loads.get(s, 0), 0) for s in range(shards)]
    share = [round(SINGLES * sum(gaps[: s + 1]) / max(sum(gaps), 1)) for s in range(shards - 1)]
    free = F.pmod(_hash("node", 0), F.lit(SINGLES))
    filling = sum((F.when(free >= s, 1).otherwise(0) for s in share), F.lit(0))
    known = labels.select(F.col("node").alias("linked"), "key", F.col("shard").alias("own"))
    whole = nodes.join(known, nodes["node"] == known["linked"], "left")
    zone = F.when(F.col("linked").isNotNull(), 1).otherwise(2 * F.pmod(_hash("node", -1), F.lit(2)))
    bits = max((shards - 1).bit_length(), 1)
    own = (PLACE_BITS - bits - 2) // 2
    place = F.shiftleft(F.coalesce("own", filling).cast("long"), PLACE_BITS - bits)
    place += F.shiftleft(zone.cast("long"), PLACE_BITS - bits - 2)
    place += F.shiftleft(F.pmod(_hash(F.coalesce("key", "node"), 1), F.lit(1 << own)), own) + F.pmod(_hash("node", 2), F.lit(1 << own))
    placed = stored(whole.select("node", "size", place.alias("place")))
    ends = cuts(placed.select("place", "size"), [total * s / shards for s in range(1, shards)])
    shard = sum((F.when(F.col("place") >= F.lit(e).cast("long"), 1).otherwise(0) for e in ends), F.lit(0))
    return placed.select("node", "size", shard.cast("int").alias("shard"))


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``node, size, shard`` for ``nodes(node, size)`` with distinct nodes and sizes above zero, and ``links(a, b)``."""
    nodes = nodes.select("node", "size")
    total = nodes.agg(F.sum("size")).first()[0] or 0
    labels = propagate(nodes, links, shards, rounds, total / shards)
    return even_out(nodes, labels, shards, total)


def group_links(rows: DataFrame, capacity: float) -> DataFrame:
    """Links from each row to the first of its group, for ``rows(node, size, group)``; large groups have several firsts."""
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass"), F.min("node").alias("first"))
    groups = stored(groups.filter("n > 1").withColumnRenamed("group", "own"))
    met = rows.join(groups, rows["group"] == groups["own"])
    stars = F.ceil(F.col("mass") / F.lit(max(capacity, 1.0)))
    met = stored(met.select("node", "group", "first", F.pmod(_hash("node", 3), stars).cast("int").alias("star"), stars.alias("stars")))
    ordinary = met.filter("stars = 1").select("node", "first")
    # A shard's capacity bounds the number of large groups and, with it, of their stars.
    large = met.filter("stars > 1")
    firsts = large.groupBy(F.col("group").alias("own"), F.col("star").alias("of")).agg(F.min("node").alias("least"))
    split = large.join(F.broadcast(firsts), (large["group"] == firsts["own"]) & (large["star"] == firsts["of"]))
    links = ordinary.unionByName(split.select("node", F.col("least").alias("first")))
    return links.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(node, shard, ...)`` with ``slot``, a number from 0 in each shard."""
    steps = max(64, -(-rows.count() // NUMBERED))
    rows = rows.withColumn("bucket", F.pmod(_hash("node", 4), F.lit(steps)))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = stored(counts.select("shard", "bucket", before.alias("before")))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("node")) - 1
    return rows.withColumn("place", place).join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("place") + F.col("before")).drop("bucket", "place", "before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``; rows with equal texts are linked."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("node"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("group"),
    )
    rows = stored(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    # A star must leave room for its shard's other nodes.
    links = group_links(rows.select("node", "size", "group"), 0.9 * total / shards)
    placed = balanced_shards(rows.select("node", "size"), links, shards, rounds).select("node", "shard")
    whole = stored(rows.select("node", "doc_id", "size", "text_crc32").join(placed, "node"))
    return numbered(whole).select("doc_id", "size", "text_crc32", "shard", "slot")
