"""Shards of documents by balanced label propagation.

Rows of one text are one node, as heavy as its rows. Nodes are linked by what they share: here, long lines. Each node starts
with the shard of its hash. In each round a node hears, over joins, which shards the nodes of its lines are in, a line
counting the less the more nodes have it, and wants to move where most of them are; moves into a shard are let through
by a hash up to its quota of room, half of them at most, so that two neighbours don't swap places for ever.

Then shards are filled to exact quotas of rows. Heavy nodes, of which there is a bounded number, come first, and are split over
shards only if no shard has room for the whole; other nodes take their label's shard while it has room, or another that has.
Rows linked with nothing fill what is left. Rooms, loads and histograms of bounded size are all that the driver sees.

Defined results: a null text is an empty one; rows of equal texts are linked, null ids and repeated rows included; each row of the
input has one shard and slot; counts of shards differ by one at most; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.llm.common import read, stored

SHARDS, ROUNDS = 8, 4
#: Lines of so many characters link documents.
LINE_CHARS = 40
#: A shard may hold so much more than its part while labels move.
SLACK = 1.05
#: Nodes of more than 1 / HEAVY of all rows are placed one by one.
HEAVY = 512
BINS, TRIES = 4096, 6
ROWS_A_BIN, BROADCAST_ROWS = 5_000, 1_000_000


def nodes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, node) of each row; rows of one text have one node."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return own.select("doc_id", (F.octet_length("text") + F.lit(1)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("node"))


def shared_lines(docs: DataFrame, text: str = "text", line_chars: int = LINE_CHARS) -> DataFrame:
    """(node, hub): the long lines that nodes share with others."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= line_chars), lambda x: F.xxhash64(x, F.lit(1))))
    held = stored(docs.select(t.alias("text")).select(F.xxhash64("text").alias("node"), F.explode(lines).alias("hub")).distinct())
    # The least and the greatest node tell whether there are two, without counting them.
    several = held.groupBy("hub").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("hub")
    return held.join(several, "hub").select("node", "hub")


def _share(salt: int, *key: str) -> Column:
    """A number of [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(1 << 30)) / (1 << 30)


def propagate(nodes: DataFrame, links: DataFrame, quota: float, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """nodes (node, n, label) with new labels after rounds of moves to neighbours' shards."""
    each = range(shards)
    for round_ in range(rounds):
        here = links.join(nodes, "node")
        hubs = here.groupBy("hub").agg(F.sum("n").alias("all"), *(F.sum(F.when(F.col("label") == t, F.col("n")).otherwise(0)).alias(f"c{t}") for t in each))
        # Of the others on a line, the part in each shard; a line of two nodes says more than one of thousands.
        others = F.greatest(F.col("all") - F.col("n"), F.lit(1))
        part = lambda t: (F.col(f"c{t}") - F.when(F.col("label") == t, F.col("n")).otherwise(0)) / others / F.log2(1 + others)
        heard = here.join(hubs, "hub").groupBy("node", "n", "label").agg(*(F.sum(part(t)).alias(f"v{t}") for t in each))
        best = F.greatest(*(F.struct(F.col(f"v{t}").alias("v"), (F.col("label") == t).alias("own"), _share(t, "node").alias("tie"), F.lit(t).alias("t")) for t in each))
        wish = stored(heard.select("node", "n", "label", best["t"].alias("wish")).where("wish <> label"))
        load = {r["label"]: r["n"] for r in nodes.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        coming = {r["wish"]: r["n"] for r in wish.groupBy("wish").agg(F.sum("n").alias("n")).collect()}
        let = {t: min(0.5, max(0.0, slack * quota - load.get(t, 0)) / n) for t, n in coming.items()}
        if not any(let.values()):
            break
        passed = F.coalesce(*(F.when(F.col("wish") == t, F.lit(x)) for t, x in let.items()))
        moved = wish.where(_share(100 + round_, "node") < passed).select("node", "wish")
        nodes = stored(nodes.join(moved, "node", "left").select("node", "n", F.coalesce("wish", "label").alias("label")))
    return nodes


def _place_heavy(rows: list, room: list[int]) -> list[tuple[int, int, int, int]]:
    """(node, shard, first, rows) of heavy nodes, the heaviest first; what fits nowhere is split over the roomiest shards."""
    out = []
    for node, n, label in sorted(rows, key=lambda r: (-r[1], r[0])):
        done = 0
        while done < n and any(room):
            left = n - done
            fitting = [t for t in range(len(room)) if room[t] >= left]
            # The tightest of the shards that fit, its own label's before others.
            t = min(fitting, key=lambda t: (t != label, room[t], t)) if fitting else max(range(len(room)), key=lambda t: (room[t], t == label, -t))
            take = min(left, room[t])
            out.append((node, t, done, take))
            room[t] -= take
            done += take
    return out


def _place_others(nodes: DataFrame, room: list[int], tries: int = TRIES) -> DataFrame:
    """(node, shard) of the nodes that find room: by classes of weight and bins of a hash, the heaviest first."""
    shards = len(room)
    placed, left = None, nodes
    for k in range(tries):
        order = F.struct(F.floor(F.log2("n")).alias("class"), F.pmod(F.xxhash64("node", F.lit(k)), F.lit(BINS)).alias("bin"))
        open_ = [t for t in range(shards) if room[t] > 0]
        if not open_:
            break
        other = F.element_at(F.array(*map(F.lit, open_)), (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(len(open_))) + 1).cast("int"))
        asked = left.withColumn("wish", F.when(F.col("label").isin(open_) & F.lit(k == 0), F.col("label")).otherwise(other)).withColumn("o", order)
        # At most shards * 64 * BINS rows, whatever the number of nodes; bins of a class that fits as a whole stay one row.
        classes = asked.groupBy("wish", "o.class").agg(F.sum("n").alias("n")).collect()
        cut = {}
        for t in open_:
            for r in sorted((r for r in classes if r["wish"] == t), key=lambda r: -r["class"]):
                if r["n"] > room[t]:
                    cut[t] = r["class"]
                    break
                room[t] -= r["n"]
        cut_at = F.coalesce(*(F.when(F.col("wish") == t, F.lit(c)) for t, c in cut.items()), F.lit(-1))
        fits = F.col("o.class") > cut_at
        if cut:
            first = {}
            bins = asked.where(F.col("o.class") == cut_at).groupBy("wish", "o.bin").agg(F.sum("n").alias("n")).collect()
            for t in cut:
                for r in sorted((r for r in bins if r["wish"] == t), key=lambda r: r["bin"]):
                    if r["n"] > room[t]:
                        break
                    room[t] -= r["n"]
                    first[t] = r["bin"]
            fits = fits | ((F.col("o.class") == cut_at) & (F.col("o.bin") <= F.coalesce(*(F.when(F.col("wish") == t, F.lit(b)) for t, b in first.items()), F.lit(-1))))
        told = stored(asked.select("node", "n", "label", F.when(fits, F.col("wish")).alias("shard")))
        got = told.where("shard IS NOT NULL").select("node", "shard")
        placed, left = got if placed is None else placed.unionByName(got), told.where("shard IS NULL").select("node", "n", "label")
        if not left.take(1):
            break
    return placed


def ranked(rows: DataFrame, by: str, n: int) -> DataFrame:
    """rows with ``rank`` from 0 within ``by``, without sorting any group in one task; n: about how many rows there are."""
    bins = max(1, n // ROWS_A_BIN)
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("doc_id", "node", F.lit(3)), F.lit(bins)).cast("int"))
    counts = rows.groupBy(by, "bin").agg(F.count("*").alias("c"))
    before = counts.select(by, "bin", (F.sum("c").over(Window.partitionBy(by).orderBy("bin")) - F.col("c")).alias("before"))
    own = F.row_number().over(Window.partitionBy(by, "bin").orderBy("doc_id", "node")) - 1
    before = F.broadcast(before) if bins * 64 <= BROADCAST_ROWS else before
    return rows.withColumn("own", own).join(before, [by, "bin"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "bin", "before")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", links: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    links: (node, hub) rows, a hub being anything that nodes of ``nodes_of`` share; if none are given, their long lines.
    """
    spark = docs.sparkSession
    rows = stored(nodes_of(docs, doc_id, text))
    total = rows.count()
    room = [total // shards + (t < total % shards) for t in range(shards)]
    links = stored(shared_lines(docs, text) if links is None else links.select("node", "hub").distinct())
    counts = rows.groupBy("node").agg(F.count("*").alias("n"))
    linked = counts.where("n > 1").union(counts.where("n = 1").join(links.select("node").distinct(), "node", "left_semi"))
    nodes = stored(linked.withColumn("label", F.pmod("node", F.lit(shards)).cast("int")))
    nodes = propagate(nodes, links, total / shards, shards)
    heavy_from = max(1, total // HEAVY)
    heavy = _place_heavy([tuple(r) for r in nodes.where(F.col("n") > heavy_from).collect()], room)  # fewer than HEAVY rows
    others = _place_others(nodes.where(F.col("n") <= heavy_from), room)

    # A row's part: its shard, or after those a split node, and at last the rows that are free.
    split = sorted({h[0] for h in heavy if sum(x[0] == h[0] for x in heavy) > 1})
    part = {node: shards + i for i, node in enumerate(split)}
    free = shards + len(split)
    whole = spark.createDataFrame([(h[0], part.get(h[0], h[1])) for h in {h[0]: h for h in heavy}.values()], "node long, heavy int")
    rows = rows.join(F.broadcast(whole), "node", "left")
    if others is not None:
        rows = rows.where("heavy IS NOT NULL").withColumn("shard", F.lit(None).cast("int")).unionByName(rows.where("heavy IS NULL").join(others, "node", "left"))
    else:
        rows = rows.withColumn("shard", F.lit(None).cast("int"))
    rows = stored(rows.select("doc_id", "size", "text_crc32", "node", F.coalesce("heavy", "shard", F.lit(free)).cast("int").alias("part")))
    held = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    pieces, next_slot = [], [held.get(t, 0) for t in range(shards)]
    for t in range(shards):
        pieces.append((t, 0, held.get(t, 0), t, 0))
    for node, t, first, n in heavy:
        if node in part:
            pieces.append((part[node], first, first + n, t, next_slot[t]))
            next_slot[t] += n
    quota = [total // shards + (t < total % shards) for t in range(shards)]
    # What is left of split nodes joins the free rows.
    gaps = [[t, quota[t] - next_slot[t]] for t in range(shards)]
    loose = [(part[node], sum(h[3] for h in heavy if h[0] == node), held.get(part[node], 0)) for node in split] + [(free, 0, held.get(free, 0))]
    for of, start, stop in loose:
        while start < stop:
            t, n = next(g for g in gaps if g[1] > 0)
            take = min(n, stop - start)
            pieces.append((of, start, start + take, t, next_slot[t]))
            gaps[t][1] -= take
            next_slot[t] += take
            start += take
    cuts = F.broadcast(spark.createDataFrame(pieces, "part int, lo long, hi long, shard int, slot0 long"))
    placed = ranked(rows, "part", total).join(cuts, "part").where("rank >= lo AND rank < hi")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
