"""Balanced label propagation into shards (1), in DataFrame operations only.

Linked documents (equal texts) should share a shard, while all shards hold the
same number of rows, one more at most.

1. Every row starts in the shard of its hashed id: the votes of its text.
2. A text of a quota's rows or more takes whole shards, as many as it fills; what
   it has beyond them waits.  Other hot texts (over 1/HOT_SHARE of the linked rows,
   so few) are placed whole, the largest first, where they fit most tightly.
3. Rounds: the rows of every other text are labelled with the shards they stand in.
   Each round joins them with their neighbours' labels: all take the label that most
   of them have, of those whose shard has room for the whole text, ties by hash; where
   there is none, a hashed shard that has.  A shard admits whole texts in order of a
   hash up to its room, so no round overfills it; those left out keep the new labels
   and vote again.  Shards with less than 1/SCANT of their quota left are chosen last,
   so the others are not kept waiting for the last gaps.
4. The rounds end when no text left fits any shard; these are fewer than the shards,
   as all that is left has room in all shards together.  A text is split only so.
5. Rows without links fill the shards to their exact quotas.  Ranks are taken in
   blocks of about BLOCK rows and shifted by the sizes of the blocks before, so no
   task sees a whole shard.

Admission goes by buckets that halve every RATIO: a shard finds how far down the order
its room reaches from some thousand counts, to a few per cent of the demand whether
that is ten texts or a billion.  So a round fills a shard that too many want nearly
whole, and the number of rounds grows with the logarithm of the rows.

Texts are read once; the rounds see a narrow table of the linked texts.  What the
driver holds are counts by shard and bucket and the hot texts.

Defined results: a null text counts as empty, with size 1 and checksum 0, and is
linked to other empty texts.  Repeated rows and rows with null ids are placed
each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, hot_left_join, scratch, stored

BLOCK = 2_000
#: Blocks whose sizes are summed in one task.
FAN = 4_096
#: Buckets of admission for each halving of the demand, and halvings.
RATIO, HALVINGS = 32, 40
#: A shard with less than 1/SCANT of its quota left is chosen last.
SCANT = 64
#: Rounds in a row that may place nothing: each draws another order, so more are as good as impossible.
IDLE = 50
CUTS = "array<struct<upto: bigint, shard: int>>"


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


class Rooms:
    """What the shards can still take, and the texts placed on the driver: (key, cuts);
    rows of a text go, by rank, to the shard of the first cut above it."""

    def __init__(self, quotas: list[int]) -> None:
        self.quotas, self.room = quotas, list(quotas)
        self.placed: list[tuple[bytes, list[tuple[int, int]]]] = []
        self.waiting: list[tuple[bytes, int, list[int], list[tuple[int, int]]]] = []

    def _take(self, cuts: list[tuple[int, int]], shard: int, n: int) -> None:
        self.room[shard] -= n
        cuts.append(((cuts[-1][0] if cuts else 0) + n, shard))

    def fill(self, key: bytes, n: int, votes: list[int]) -> None:
        """Whole shards for a text of a quota or more; its remainder waits."""
        cuts: list[tuple[int, int]] = []
        for t in sorted(range(len(votes)), key=lambda t: (-votes[t], t)):
            if self.room[t] == self.quotas[t] and 0 < self.room[t] <= n:
                n -= self.room[t]
                self._take(cuts, t, self.room[t])
        if n:
            self.waiting.append((key, n, votes, cuts))
        else:
            self.placed.append((key, cuts))

    def whole(self, key: bytes, n: int, votes: list[int], cuts: list[tuple[int, int]] | None = None) -> bool:
        """The shard that a text fits most tightly, if there is one."""
        cuts = [] if cuts is None else cuts
        fits = [t for t, room in enumerate(self.room) if room >= n]
        if fits:
            self._take(cuts, min(fits, key=lambda t: (self.room[t], -votes[t], t)), n)
            self.placed.append((key, cuts))
        return bool(fits)

    def place(self, texts: list[tuple[bytes, int, list[int]]]) -> None:
        """Texts (key, rows, votes) whole, the largest first; those that fit nowhere wait."""
        for key, n, votes in sorted(texts, key=lambda x: (-x[1], x[0])):
            if not self.whole(key, n, votes):
                self.waiting.append((key, n, votes, []))

    def close(self) -> None:
        """What waits: whole if it fits, else over the shards with most room."""
        for key, n, votes, cuts in self.waiting:
            if not self.whole(key, n, votes, cuts):
                while n:
                    t = max(range(len(votes)), key=lambda t: (self.room[t], -t))
                    size = min(n, self.room[t])
                    self._take(cuts, t, size)
                    n -= size
                self.placed.append((key, cuts))
        self.waiting = []

    def admit(self, wanted: dict[int, dict[int, int]]) -> list[int]:
        """For rows wanted by goal and bucket, the bucket down to which each goal admits texts, from the last on."""
        limits = []
        for t in range(len(self.room)):
            limit = RATIO * HALVINGS + 1
            for bucket, n in sorted(wanted.get(t, {}).items(), reverse=True):
                if n > self.room[t]:
                    break
                limit = bucket
                self.room[t] -= n
            limits.append(limit)
        return limits


def propagate(texts: DataFrame, quotas: list[int]) -> DataFrame:
    """(key, n, cuts) of linked ``texts`` (key, n, votes: rows by starting shard)."""
    shards, rooms = range(len(quotas)), Rooms(quotas)
    linked = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    is_hot = F.col("n") * HOT_SHARE > F.lit(linked)
    hot = sorted(((bytes(r["key"]), r["n"], r["votes"]) for r in texts.filter(is_hot).collect()), key=lambda x: (-x[1], x[0]))
    full = [x for x in hot if x[1] >= min(quotas)]
    for x in full:
        rooms.fill(*x)
    rooms.place(hot[len(full) :])
    folder, turn, idle = scratch(texts.sparkSession, "settled"), 0, 0
    # (key, n, shard, c): c of a text's n rows are labelled with the shard
    stands = texts.filter(~is_hot).select("key", "n", F.posexplode("votes").alias("shard", "c")).filter("c > 0")
    labels = stored(stands, "labels")
    while not labels.isEmpty():
        room, ample = (F.array(*[F.lit(x) for x in xs]) for xs in (rooms.room, [r * SCANT >= q for r, q in zip(rooms.room, quotas, strict=True)]))
        draw = lambda t: F.xxhash64("key", t, F.lit(turn))  # noqa: E731, B023
        choice = lambda t: F.struct(F.get(ample, t).alias("ample"), draw(t).alias("drawn"), t.cast("int").alias("t"))  # noqa: E731, B023
        fits = lambda t: F.get(room, t) >= F.col("n")  # noqa: E731, B023
        here = F.struct(F.get(ample, F.col("shard")).alias("ample"), "c", draw(F.col("shard")).alias("drawn"), F.col("shard").alias("t"))
        most = labels.filter(fits(F.col("shard"))).groupBy("key").agg(F.max(here)["t"].alias("goal"), F.max(here)["ample"].alias("near"))
        any_ = F.array_max(F.transform(F.filter(F.array(*[F.lit(t) for t in shards]), fits), choice))
        # neighbours' shard, unless that is nearly full and another is not
        goal = F.when(F.col("near") | F.col("goal").isNotNull() & ~F.coalesce(any_["ample"], F.lit(False)), F.col("goal")).otherwise(F.coalesce(any_["t"], F.col("goal")))
        taken = labels.join(most, "key", "left").withColumn("goal", goal).groupBy("key", "n", "goal").agg(F.sum("c").alias("c"))
        drawn = (F.pmod(F.xxhash64("key", F.lit(turn), F.lit("order")), F.lit(1 << HALVINGS)) + 1) / F.lit(1 << HALVINGS)
        aimed = stored(taken.withColumn("bucket", F.floor(-F.log2(drawn) * RATIO).cast("int")), "labels")
        wanted: dict[int, dict[int, int]] = {}
        for r in aimed.filter("goal is not null").groupBy("goal", "bucket").agg(F.sum("n").alias("n")).collect():  # shards x buckets numbers
            wanted.setdefault(r["goal"], {})[r["bucket"]] = r["n"]
        if not wanted:
            break
        limits = rooms.admit(wanted)
        admitted = F.coalesce(F.col("bucket") >= F.get(F.array(*[F.lit(x) for x in limits]), F.col("goal")), F.lit(False))
        settled = aimed.filter(admitted).select("key", "n", F.array(F.struct(F.col("n").alias("upto"), F.col("goal").alias("shard"))).cast(CUTS).alias("cuts"))
        settled.write.mode("append").parquet(folder)
        idle = 0 if any(limit <= RATIO * HALVINGS for limit in limits) else idle + 1
        if idle > IDLE:
            raise RuntimeError(f"no text found a place in {IDLE} rounds")
        labels, turn = aimed.filter(~admitted).select("key", "n", F.coalesce("goal", F.lit(0)).alias("shard"), "c"), turn + 1
    # fewer than there are shards: each is larger than any room left
    rooms.place([(bytes(r["key"]), r["n"], [0] * len(quotas)) for r in labels.select("key", "n").collect()])
    rooms.close()
    rows = [(bytearray(key), cuts[-1][0], cuts) for key, cuts in rooms.placed]
    out = texts.sparkSession.createDataFrame(rows, f"key binary, n long, cuts {CUTS}")
    return cut(out.unionByName(texts.sparkSession.read.schema(out.schema).parquet(folder)) if turn else out)


def ranked(rows: DataFrame, pool: str, total: int) -> DataFrame:
    """``rows`` with ``rank``, gapless from 0 within each ``pool``."""
    blocks = max(1, -(-total // BLOCK))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    sizes = placed.groupBy(pool, "block").agg(F.count("*").alias("size"))
    # prefix sums in two levels: within FAN blocks, and over the sums of these
    sizes = cut(sizes.withColumn("fan", F.floor(F.col("block") / FAN)))
    over = Window.partitionBy(pool).orderBy("fan").rowsBetween(Window.unboundedPreceding, -1)
    fans = sizes.groupBy(pool, "fan").agg(F.sum("size").alias("held"))
    fans = fans.withColumn("start", F.coalesce(F.sum("held").over(over), F.lit(0))).drop("held")
    before = Window.partitionBy(pool, "fan").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))).join(fans, [pool, "fan"])
    sizes = sizes.select(pool, "block", (F.col("start") + F.col("within")).alias("before"))
    within = F.row_number().over(Window.partitionBy(pool, "block").orderBy("row")) - 1
    numbered = placed.withColumn("within", within)
    # a few rows for every BLOCK: sent to all tasks only while that is provably little
    joined = numbered.join(F.broadcast(sizes) if blocks * 16 < 100_000 else sizes, [pool, "block"])
    return joined.withColumn("rank", F.col("before") + F.col("within")).drop("block", "before", "within")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, key, linked, shard, slot) of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut(
        docs.select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"),
        ).withColumn("row", F.struct("doc_id", "key"))
    )
    total = base.count()
    quotas = _quotas(total, shards)
    start = F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards))
    votes = F.array(*[F.count_if(start == k) for k in range(shards)])
    texts = cut(base.groupBy("key").agg(F.count("*").alias("n"), votes.alias("votes")).filter("n > 1"))
    goals = propagate(texts, quotas).withColumn("linked", F.lit(True))
    marked = cut(hot_left_join(base, goals, "key", "n"))
    split = F.coalesce(F.size("cuts") > 1, F.lit(False))
    within = ranked(marked.filter(split), "key", total)
    target = F.filter("cuts", lambda c: c["upto"] > F.col("rank"))[0]["shard"]
    linked = marked.filter(~split & F.col("linked").isNotNull()).withColumn("shard", F.col("cuts")[0]["shard"]).drop("cuts")
    linked = linked.unionByName(within.withColumn("shard", target).drop("cuts", "rank"))
    marked = marked.drop("cuts")
    # pools: the shards of the linked rows, and one of all others
    free = shards
    pools = linked.withColumn("pool", F.col("shard")).unionByName(marked.filter(F.col("linked").isNull()).withColumn("shard", F.lit(None).cast("int")).withColumn("pool", F.lit(free)))
    numbered = cut(ranked(pools.drop("shard"), "pool", total))
    held = {r["pool"]: r["n"] for r in numbered.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    own = [min(held.get(k, 0), quotas[k]) for k in range(shards)]
    # what a shard cannot hold follows the free rows; gaps are filled in order of rank
    after, over_start = held.get(free, 0), []
    for k in range(shards):
        over_start.append(after)
        after += held.get(k, 0) - own[k]
    pool, rank = F.col("pool"), F.col("rank")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)
    stays = (pool < free) & (rank < pick([*own, 0], pool))
    number = F.when(pool == free, rank).otherwise(pick([*over_start, 0], pool) + rank - pick([*own, 0], pool))
    gap_start, chosen = 0, F.lit(None).cast("int")
    first = F.lit(None).cast("long")
    for k in range(shards):
        gap = quotas[k] - own[k]
        inside = (F.col("number") >= gap_start) & (F.col("number") < gap_start + gap)
        chosen = F.when(inside, F.lit(k)).otherwise(chosen)
        first = F.when(inside, F.col("number") - gap_start + own[k]).otherwise(first)
        gap_start += gap
    out = numbered.withColumn("stays", stays).withColumn("number", number)
    return out.select(
        "doc_id", "size", "text_crc32", "key", F.coalesce("linked", F.lit(False)).alias("linked"),
        F.when(F.col("stays"), pool).otherwise(chosen).cast("int").alias("shard"),
        F.when(F.col("stays"), rank).otherwise(first).cast("long").alias("slot"),
    )
