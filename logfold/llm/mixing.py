"""Mixing sources to target weights, in DataFrame operations only.

The words of a source form one stream of fixed-length blocks. A source with target t is due round(t / mean block) slots.
The slots of the mix lie in output shards of ``shard_slots``; every slot draws its source by a hash that falls into the
source's share of the unit interval, so the source counts of a shard are a multinomial draw. Over all shards such counts
miss the dues by about their square root: the slots of a source beyond its due, the last in shard order, go to the
sources that came short. So the totals are exact and all but a few shards keep their draw.

The j-th slot of a source with n blocks takes block P(j mod n), P being the source's own pseudorandom permutation, in
epoch j div n; slots and blocks meet in an equi-join on (source, block). As targets stop at ``cap`` (3) times a source's
size, no block, and so no document, is taken more often than that.

Prefix sums go in two steps of about the square root of the rows each: a source with any share of the rows is summed in
many tasks. Equal rows are one class with a count until they have their places, so no number of copies meets in a task.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source, ranked last; a null doc_id is an
id; repeated rows and ties take places of their own in the stream; if no document has words all targets are 0; extra
columns of any name are ignored by ``mix`` and kept by ``mixture``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.llm.common import boxed, let, text_or_empty, unboxed, written

#: Cells of the unit interval that lead a draw to the few sources it may belong to.
CELLS = 4096
UNIT = 1 << 52


def word_count(column: str | Column = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, sid, source_size, target): shares by weight under the cap.

    Sorted by cap/weight, the sources up to some place stop at their cap and the rest share what is left by weight;
    the place is the first whose successors' shares stay below their caps.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    weighed = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double")).withColumn("most", F.lit(cap) * F.col("source_size"))
    order, everyone = W.orderBy(F.col("most") / F.col("w"), "sid"), W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("most"))
    final = leveled.withColumn("water", F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), "sid", "level"))).over(everyone)["level"])
    return final.select("source", "sid", "source_size", F.least(F.col("most"), F.coalesce(F.col("water") * F.col("w"), F.col("most"))).alias("target"))


def permuted(df: DataFrame, x: str, n: str, key: str, seed: int, out: str) -> DataFrame:
    """Adds ``out``: the image of x in 0..n-1 under a permutation named by key and seed.

    Two passes of a rotation and a two-round Feistel step on the largest a x b rectangle inside n, a the root of n.
    """
    df = df.withColumn(out, F.col(x)).withColumn("_a", F.floor(F.sqrt(F.col(n).cast("double")))).withColumn("_b", F.floor(F.col(n) / F.col("_a")))
    for step in (1, 2):
        name = F.lit(seed * 2 + step)
        df = df.withColumn("_x", F.pmod(F.col(out) + F.pmod(F.xxhash64(key, name), F.col(n)), F.col(n)))
        df = df.withColumn("_l", F.pmod(F.col("_x") + F.pmod(F.xxhash64(F.floor(F.col("_x") / F.col("_a")), key, name), F.col("_a")), F.col("_a")))
        df = df.withColumn("_r", F.pmod(F.floor(F.col("_x") / F.col("_a")) + F.pmod(F.xxhash64("_l", key, name), F.col("_b")), F.col("_b")))
        df = df.withColumn(out, F.when(F.col("_x") < F.col("_a") * F.col("_b"), F.col("_l") + F.col("_a") * F.col("_r")).otherwise(F.col("_x")))
    return df.drop("_a", "_b", "_x", "_l", "_r")


def _running(df: DataFrame, by: str, bucket: str, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same ``by`` before a row in order of (bucket, order)."""
    within = W.partitionBy(by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = df.groupBy(by, bucket).agg(F.sum(amount).alias("_sum"))
    base = sums.select(by, bucket, (F.sum("_sum").over(W.partitionBy(by).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")).alias("_base"))
    return df.withColumn(out, F.sum(amount).over(within) - F.col(amount)).join(base, [by, bucket]).withColumn(out, F.col(out) + F.col("_base")).drop("_base")


def _classes(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, source_size, target, doc_id, h, size, copies, begin): equal rows are one class; begin is its place in the source's stream."""
    classes = sized.groupBy("source", "doc_id", "h", "size").agg(F.count(F.lit(1)).alias("copies"))
    buckets = max(1, round(sized.count() ** 0.5))
    dealt = classes.join(sources, classes.source.eqNullSafe(sources.source)).drop("source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets).cast("long")))
    return _running(dealt.withColumn("amount", F.col("size") * F.col("copies")), "sid", "bucket", ["doc_id", "h", "size"], "amount", "begin").drop("amount", "bucket")


def shard_counts(sources: DataFrame, block: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(dues(sid, blocks, due), counts(sid, shard, n)): for every shard of slots how many fall to each source, multinomially."""
    due = sources.withColumn("blocks", F.ceil(F.col("source_size") / block)).where("blocks > 0")
    due = due.withColumn("due", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.ceil(F.col("target") / F.col("source_size")) * F.col("blocks")))
    due = written(due.where("due > 0").select("sid", "blocks", "due"))
    total = due.agg(F.coalesce(F.sum("due"), F.lit(0))).first()[0]
    upper = F.sum("due").over(W.orderBy("sid")) / F.lit(float(max(1, total))) * F.lit(UNIT)
    shares = due.select("sid", "due", F.round(upper).cast("long").alias("high")).withColumn("low", F.lag("high", 1, 0).over(W.orderBy("sid")))
    cell = lambda x: F.floor(x / (UNIT // CELLS))
    cells = shares.where("low < high").select("sid", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    shards = -(-total // shard_slots)
    spark = sources.sparkSession
    slots = spark.range(0, shards, 1, max(1, min(shards, total >> 18))).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(shard_slots), F.lit(total) - F.col("id") * shard_slots) - 1)).alias("slot"))
    drawn = slots.withColumn("u", F.pmod(F.xxhash64("shard", "slot", F.lit(seed)), F.lit(UNIT).cast("long"))).withColumn("cell", cell(F.col("u")))
    hit = drawn.join(cells, "cell").where("low <= u AND u < high")
    return due, written(hit.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")))


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(sid, block, epoch, shard): every slot of the mix and the block it takes."""
    due, counts = shard_counts(sources, block, shard_slots, seed)
    drawn = due.join(counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").fillna(0, ["drawn"])
    over = F.sum(F.greatest(F.col("drawn") - F.col("due"), F.lit(0))).over(W.orderBy("sid")) - F.greatest(F.col("drawn") - F.col("due"), F.lit(0))
    under = F.greatest(F.col("due") - F.col("drawn"), F.lit(0))
    settled = written(drawn.withColumn("over_before", over).withColumn("under", under).withColumn("under_before", F.sum("under").over(W.orderBy("sid")) - F.col("under")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("shard")).first()
    group = max(1, round(total[1] ** 0.5))
    placed = _running(counts.withColumn("bucket", F.floor(F.col("shard") / group)), "sid", "bucket", ["shard"], "n", "first")
    tasks = max(1, total[0] >> 18)
    rows = placed.select("sid", "shard", "first", "n").repartition(tasks, "sid", "shard").join(settled.select("sid", "blocks", "due", "over_before"), "sid")
    rows = rows.withColumn("j", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    kept = rows.where("j < due").select("sid", "blocks", "j", "shard")
    # the few slots beyond a due, in order, meet the places that other sources lack, in order
    spare = rows.where("j >= due").select("shard", (F.col("over_before") + F.col("j") - F.col("due")).alias("q"))
    lacking = settled.where("under > 0").select("sid", "blocks", F.col("drawn").alias("from"), "under_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("i"))
    moved = spare.join(lacking.withColumn("q", F.col("under_before") + F.col("i")), "q").select("sid", "blocks", (F.col("from") + F.col("i")).alias("j"), "shard")
    deck = kept.unionByName(moved).withColumn("at", F.col("j") % F.col("blocks"))
    return permuted(deck, "at", "blocks", "sid", seed + 1, "block").select("sid", "block", F.floor(F.col("j") / F.col("blocks")).alias("epoch"), "shard")


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """One row per copy of a document and block it reaches into: words skip..skip+words of the document."""
    each = placed.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("begin", F.col("begin") + F.col("copy") * F.col("size"))
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    cut = each.withColumn("block", F.explode(F.sequence(first, last)))
    skip = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
    return cut.withColumn("skip", skip).withColumn("words", F.least((F.col("block") + 1) * block - F.col("begin"), F.col("size")) - F.col("skip"))


def _plan(docs: DataFrame, weights: tuple[int, ...], cap: float) -> tuple[DataFrame, DataFrame]:
    sized = written(docs.select("doc_id", "source", F.xxhash64("text").alias("h"), word_count().alias("size")))
    sources = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    return _classes(sized, sources), sources


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block: int = 64, shard_slots: int = 4096, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard) for every row of ``docs``; first_shard is the first output
    shard that holds words of it, null if none does."""
    placed, sources = _plan(docs, weights, cap)
    placed = written(placed.withColumn("n", F.monotonically_increasing_id()))
    # slots are exploded from small tables: their size misleads the planner into broadcasting them
    taken = slots(sources, block, shard_slots, seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard")).hint("merge")
    sums = _pieces(placed, block).join(taken, ["sid", "block"]).groupBy("n", "copy").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    rows = placed.select("n", "doc_id", "size", "source_size", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return rows.join(sums.hint("merge"), ["n", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_shard")


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, block: int = 512, shard_slots: int = 4096, seed: int = 7, shards_together: int = 1) -> DataFrame:
    """The mix as rows of the same columns: a row per document and epoch that takes words of it, in output shards.

    A document taken whole keeps its text as it is; otherwise its taken runs of words are joined by spaces. ``n_chars``,
    if there, is the new length. All rows of an output shard (the first one that holds words of the row) lie in one
    partition, shard after shard. Rows with equal doc_id and text are one document of several copies; their other
    columns are those of any of them.
    """
    placed, sources = _plan(docs, weights, cap)
    # in one plan all this takes the driver a tenth of a GB while the plan is run; the tables hold no texts
    placed, taken = written(placed), written(slots(sources, block, shard_slots, seed))
    run = F.sort_array(F.collect_list(F.struct("skip", "words")))
    drawn = _pieces(placed, block).join(taken.hint("merge"), ["sid", "block"]).groupBy("doc_id", "h", "size", "copy", "epoch")
    runs = drawn.agg(run.alias("runs"), F.sum("words").alias("words"), F.min("shard").alias("shard")).select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("no_id"), "h", "runs", (F.col("words") == F.col("size")).alias("whole"), "shard")
    runs = written(runs)
    once = boxed(docs, k=F.coalesce("doc_id", F.lit(0)), no_id=F.col("doc_id").isNull(), h=F.xxhash64("text")).dropDuplicates(["k", "no_id", "h"])
    words = F.split(F.regexp_replace(F.col("row.text"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    part = let(words, lambda w: F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, r["skip"].cast("int") + 1, r["words"].cast("int")))), " "))
    text = F.when(F.col("whole"), F.col("row.text")).otherwise(part)
    joined = once.join(runs, ["k", "no_id", "h"]).withColumn("mixed", text)
    files = max(1, sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] // (block * shard_slots * shards_together))
    dealt = joined.select("row", "mixed", "shard").repartition(int(min(files, 1 << 16)) + 1, "shard").sortWithinPartitions("shard")
    return unboxed(dealt, docs, text=F.col("mixed"), n_chars=F.length("mixed"))
