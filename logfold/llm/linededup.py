"""Line dedup over content-defined chunks, in DataFrame operations only.

Non-blank lines are hashed; a rolling hash over ``window`` consecutive line hashes sets a boundary behind a line where it
is less than before it and not more than behind it, and after ``longest`` lines. Boundaries depend on the lines around
them alone, so a passage that texts share is cut alike wherever it stands, but for its edges. Chunks are the lines between
boundaries if they are two or more, the two lines that meet at a boundary (the least chunk, for passages too short to hold
a larger one), and any line of ``passage_words`` words. Only hashes of chunks are grouped over the corpus.

A chunk that occurs again is laid beside its first occurrence (null doc_id, then smallest doc_id, then text hash, then
position), and the match grows line by line to both sides as long as the lines agree. What it then covers goes if it is
two lines or more with ``least_words`` words, or a line of ``passage_words``, and if its bytes are those of the first
occurrence, which stays. So brackets, short answers and the like are left alone, and a repeated passage goes whole.
Blank lines are no part of a chunk; those behind a removed line go with it.

Rows that repeat count once. A hash, or a first text, that more than one in ``hot_share`` of all rows meet is dealt over
``salts`` tasks with as many copies: there are ``hot_share`` such at most, which bounds the broadcast list of them.

Defined cases: null text stays null; a text may become empty, its row stays; rows that repeat (same doc_id and text) are
edited alike, the first ones of a passage all stay; columns of any other name pass through; ``n_chars``, if there, is the
new length of a cut text; a hash collision of different chunks keeps both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import KEY, boxed, key_of, let, unboxed, written

PRIME = 2_147_483_629
SPAN = "struct<first:int,last:int>"


def lines_of(text: Column) -> Column:
    """(at, line) of the non-blank lines, ``at`` counting all lines from 0."""
    found = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(x.rlike(r"\S"), F.struct(i.alias("at"), x.alias("line"))))
    return F.filter(found, lambda x: x.isNotNull())


def _weighted(factor: int):
    return lambda x, y: x + y * factor


def boundaries(hashes: Column, window: int) -> Column:
    """Places (0-based, in order) of the lines that end a chunk: local minima of the rolling hash."""
    nothing = F.array(F.lit(None).cast("long"))

    def rolled(small: Column) -> Column:
        out = small
        for k in range(1, window):
            earlier = F.concat(F.array_repeat(F.lit(None).cast("long"), k), small)
            out = F.zip_with(out, earlier, _weighted(31**k))  # null where the window is not full
        return F.slice(out, 1, F.size(small))

    def least(r: Column) -> Column:
        falls = F.zip_with(r, F.concat(nothing, r), lambda now, before: now < before)
        stays = F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), nothing), lambda now, after: now <= after)
        hit = F.zip_with(falls, stays, lambda a, b: F.coalesce(a & b, F.lit(False)))
        return F.filter(F.transform(hit, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())

    return let(let(F.transform(hashes, lambda x: F.pmod(x, F.lit(PRIME).cast("long"))), rolled), least)


def _spans(n: Column, ends: Column, longest: int) -> Column:
    """The lines between boundaries, cut after ``longest`` lines."""
    def cut(closed: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(closed, lambda i: i + 1))
        spans = F.filter(F.zip_with(starts, closed, lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda s: s["last"].isNotNull())
        return F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(s["first"], s["last"], F.lit(longest)), lambda at: F.struct(at.alias("first"), F.least(s["last"], at + longest - 1).alias("last")))))

    return let(F.array_union(F.filter(ends, lambda i: i < n - 1), F.array(n - 1)), cut)


def units(text: Column, window: int, longest: int, passage_words: int) -> Column:
    """(first, last, hash) of a text's chunks over its non-blank lines."""
    nothing = F.array().cast(f"array<{SPAN}>")

    def of_lines(found: Column) -> Column:
        n = F.size(found)
        wordy = F.transform(found, lambda x, i: F.when((F.length(x["line"]) >= 2 * passage_words - 1) & (F.regexp_count(x["line"], F.lit(r"\S+")) >= passage_words), F.struct(i.alias("first"), i.alias("last"))))

        def of_hashes(hashes: Column) -> Column:
            def of_ends(ends: Column) -> Column:
                chunks = F.filter(_spans(n, ends, longest), lambda s: s["last"] > s["first"])
                meet = F.transform(F.filter(ends, lambda i: i < n - 1), lambda i: F.struct(i.alias("first"), (i + 1).alias("last")))
                every = F.array_union(F.when(n > 1, F.concat(chunks, meet)).otherwise(nothing), F.filter(wordy, lambda x: x.isNotNull()))
                return F.transform(every, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), F.xxhash64(F.slice(hashes, s["first"] + 1, s["last"] - s["first"] + 1)).alias("hash")))

            return let(boundaries(hashes, window), of_ends)

        return let(F.transform(found, lambda x: F.xxhash64(x["line"])), of_hashes)

    return let(lines_of(text), of_lines)


ORIGIN = ["o_has_id", "o_k", "o_h"]


def _grown(own: Column, theirs: Column, delta: Column, words: Column, seeds: Column, least_words: int, passage_words: int) -> Column:
    """(first, last) runs of lines that agree with those ``delta`` places before in the other text, about the seeds, if long enough."""
    low, high = F.greatest(F.lit(0), delta), F.least(F.size(own), F.size(theirs) + delta) - 1
    same = F.transform(F.sequence(low, high), lambda i: F.get(own, i) == F.get(theirs, i - delta))

    def runs(agree: Column) -> Column:
        edge = F.array(F.lit(False))
        begins = F.zip_with(agree, F.concat(edge, agree), lambda now, before: F.coalesce(now & ~before, F.lit(False)))
        ends = F.zip_with(agree, F.concat(F.slice(agree, 2, F.greatest(F.size(agree), F.lit(1))), edge), lambda now, after: F.coalesce(now & ~after, F.lit(False)))
        places = lambda flags: F.filter(F.transform(flags, lambda x, i: F.when(x, i + low)), lambda i: i.isNotNull())
        return F.zip_with(places(begins), places(ends), lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    def long_enough(run: Column) -> Column:
        counts = F.slice(words, run["first"] + 1, run["last"] - run["first"] + 1)
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        return F.exists(seeds, lambda s: (s >= run["first"]) & (s <= run["last"])) & (((run["last"] > run["first"]) & (total >= least_words)) | (total >= passage_words))

    return F.filter(let(same, runs), long_enough)


def repeated_lines(docs: DataFrame, window: int = 2, longest: int = 64, passage_words: int = 50, least_words: int = 20, hot_share: int = 2000, salts: int = 64) -> DataFrame:
    """(has_id, k, h, gone): for the rows of a doc_id and text hash the places of non-blank lines that go."""
    texts = docs.where("text IS NOT NULL").select(*(c.alias(n) for n, c in key_of().items()), "text").dropDuplicates(KEY)
    at = written(texts.select(*KEY, F.explode(units(F.col("text"), window, longest, passage_words)).alias("u")).select(*KEY, "u.*"))
    hot = max(64, at.count() // hot_share)

    def dealt(rows: DataFrame, copied: DataFrame, times: DataFrame, on: list[str]) -> DataFrame:
        """``rows`` joined with ``copied``, of which some meet more than ``hot`` rows by the written ``times`` (on, times)."""
        common = F.broadcast(times.where(F.col("times") > hot).select(*on, F.lit(True).alias("hot")))  # hot_share rows at most
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*KEY, "first"), F.lit(salts).cast("long"))).otherwise(F.lit(0).cast("long"))
        copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        spread = copied.join(common, on, "left").withColumn("salt", F.explode(copies)).drop("hot")
        return rows.join(common, on, "left").withColumn("salt", salt).drop("hot").join(spread.hint("merge"), [*on, "salt"]).drop("salt")

    first = at.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*KEY, "first", "last")).alias("origin")).where("times > 1")
    first = written(first)
    again = dealt(at, first.drop("times"), first, ["hash"]).where(F.struct(*KEY, "first", "last") != F.col("origin"))
    matched = again.select(*KEY, "first", *(F.col(f"origin.{c}").alias(o) for c, o in zip(KEY, ORIGIN, strict=True)), (F.col("first") - F.col("origin.first")).alias("delta"))
    # one row for two texts and their shift, whatever number of chunks tells of it; a shift in one text looks back
    pairs = written(matched.groupBy(*KEY, *ORIGIN, "delta").agg(F.collect_set("first").alias("seeds"), F.min("first").alias("first")))
    met = pairs.select(*KEY).unionByName(pairs.select(*(F.col(o).alias(c) for c, o in zip(KEY, ORIGIN, strict=True)))).distinct()
    asked = texts.join(met.hint("merge"), KEY, "left_semi")
    shape = lambda found: F.struct(F.transform(found, lambda x: F.xxhash64(x["line"])).alias("hashes"), F.transform(found, lambda x: F.regexp_count(x["line"], F.lit(r"\S+"))).alias("words"))
    shapes = written(asked.select(*KEY, let(lines_of(F.col("text")), shape).alias("s")).select(*KEY, "s.*"))
    theirs = shapes.select(*(F.col(c).alias(o) for c, o in zip(KEY, ORIGIN, strict=True)), F.col("hashes").alias("theirs"))
    times = written(pairs.groupBy(*ORIGIN).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > hot))
    beside = dealt(pairs.join(shapes.hint("merge"), KEY), theirs, times, ORIGIN)
    runs = beside.select(*KEY, *ORIGIN, "delta", F.explode(_grown(F.col("hashes"), F.col("theirs"), F.col("delta"), F.col("words"), F.col("seeds"), least_words, passage_words)).alias("r"))
    runs = written(runs.select(*KEY, *ORIGIN, "delta", "r.*"))

    # the bytes of both sides: those of a first text's run are read once, however many texts repeat it
    mine = runs.select(*KEY, "first", "last", F.lit(True).alias("own"))
    kept = runs.select(*(F.col(o).alias(c) for c, o in zip(KEY, ORIGIN, strict=True)), (F.col("first") - F.col("delta")).alias("first"), (F.col("last") - F.col("delta")).alias("last"), F.lit(False).alias("own")).distinct()
    spans = written(mine.distinct().unionByName(kept).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last", "own")).alias("spans")))
    cut = lambda found: F.transform("spans", lambda u: F.struct(u["first"].alias("first"), u["last"].alias("last"), u["own"].alias("own"), F.array_join(F.transform(F.slice(found, u["first"] + 1, u["last"] - u["first"] + 1), lambda x: x["line"]), "\n").alias("chunk")))
    shown = written(texts.join(spans.hint("merge"), KEY).select(*KEY, F.explode(let(lines_of(F.col("text")), cut)).alias("u")).select(*KEY, "u.*"))
    said = shown.where("NOT own").select(*(F.col(c).alias(o) for c, o in zip(KEY, ORIGIN, strict=True)), F.col("first").alias("o_first"), F.col("last").alias("o_last"), F.col("chunk").alias("kept"))
    at_origin = runs.withColumn("o_first", F.col("first") - F.col("delta")).withColumn("o_last", F.col("last") - F.col("delta")).drop("delta")
    place = [*ORIGIN, "o_first", "o_last"]
    times = written(at_origin.groupBy(*place).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > hot))
    same = dealt(at_origin, said, times, place).join(shown.where("own").select(*KEY, "first", "last", "chunk").hint("merge"), [*KEY, "first", "last"]).where(F.col("chunk") == F.col("kept"))
    places = F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last"))))
    return same.groupBy(*KEY).agg(places.alias("gone"))


def drop_repeated_chunks(docs: DataFrame, window: int = 2, longest: int = 64, passage_words: int = 50, least_words: int = 20) -> DataFrame:
    """The same rows and columns, repeated passages cut from the texts."""
    gone = written(repeated_lines(docs, window, longest, passage_words, least_words))
    joined = boxed(docs, **key_of()).join(gone.hint("merge"), KEY, "left")  # no bound holds for its size
    lines = F.split(F.col("row.text"), "\n", -1)

    def rest(s: Column) -> Column:
        found, every = s["found"], s["every"]
        upto = F.concat(F.transform(F.slice(found, 2, F.size(found)), lambda x: x["at"]), F.array(F.size(every)))
        parts = F.zip_with(found, upto, lambda x, end: F.struct(x["at"].alias("at"), (end - x["at"]).alias("n")))

        def pick(part: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(found) - 1), s["gone"])
            head = F.slice(every, 1, found[0]["at"])
            return F.array_join(F.concat(head, F.flatten(F.transform(stay, lambda i: F.slice(every, part[i]["at"] + 1, part[i]["n"])))), "\n")

        return let(parts, pick)

    cut = let(F.struct(lines_of(F.col("row.text")).alias("found"), lines.alias("every"), F.col("gone").alias("gone")), rest)
    edited = joined.withColumn("left", F.when(F.col("gone").isNotNull(), cut))
    length = F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None)
    return unboxed(
        edited, docs, text=F.when(F.col("gone").isNotNull(), F.col("left")).otherwise(F.col("row.text")),
        n_chars=F.when(F.col("gone").isNotNull(), F.length("left")).otherwise(length),
    )
