"""Exact top-k set similarity (Jaccard) without all pairs.

Equal sets are one class that keeps its ``keep`` smallest ids, which is all that a top-k can show of it. Tokens stand rarest
first. Two bounds and one search:

1. Tokens of at most ``hot`` classes are an inverted index: every pair that shares one is compared.
2. What shares commoner tokens only is a class by (those tokens, size). A few min-hash keys, with ``keep`` ids a bucket,
   give each query classes that are much like it: with 1 they bound its k-th likeness from below.
3. A class that reaches the bound shares at least ``bound * size`` tokens with the query, so of the shared tokens, in
   order, the d-th stands at a place that leaves room for the rest. Both sides enumerate such runs of d tokens as keys.
   A key of at most ``hot`` classes is joined. A hotter one gives, for each size, its ``keep`` smallest ids (for pairs that
   share these tokens and no others the size alone decides), and grows by one more token. Tokens that all classes of a
   revision have are no part of keys; they count for every pair.

So a key never joins more than ``hot`` classes or a row a size. The work grows with the keys: it is near the number of
sets where keys turn rare within a few tokens, or where the common part of texts is alike (few classes). It is high for
large sets of many common tokens in ever new combinations of low likeness; the result is exact there too.

Most requests need none of this, since their k-th neighbour differs in a token or two (``closest``). With the tokens of at
most ``RARE`` classes apart, sets are shapes: their other tokens and their size. Shapes meet under what is left of both when
up to d tokens are taken away, with the ``keep`` smallest ids a size. The overlap of any pair is such a rest, and ids beyond
the ``keep`` smallest under a rest and a size rank below them, so the best ids found are exact once no pair of shapes
further apart can reach the k-th of them. For each request that is known from the sizes; what is open after the last d is
searched as above. Rests are known by 128 bits of hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.sources.shared import written

#: Tokens of at most so many classes are an index of their own when shapes meet.
RARE = 8
#: Tokens taken away, and the longest shapes for which all such rests are made (254 or 299 of them at most, or 65).
REACH = {1: 64, 2: 22, 3: 12}
#: Tokens of a min-hash key; keys of each kind.
BANDS = ((1, 4), (2, 6), (3, 6))


def _least(ids: str, n: int) -> Column:
    return F.slice(F.array_sort(F.collect_set(ids)), 1, n)


def _likeness(overlap: Column, n: Column, m: Column) -> Column:
    return overlap / (n + m - overlap)


def _probes(c: Column) -> Column:
    """Min-hash keys of a token set."""
    least = lambda seed: F.array_min(F.transform(c, lambda t: F.xxhash64(t, F.lit(seed))))
    return F.array(*(F.xxhash64(F.lit(b), F.lit(i), *(least(100 * b + 10 * i + j) for j in range(b))) for b, n in BANDS for i in range(n)))


def _bound(found: DataFrame, keep: int) -> DataFrame:
    """(rev, t, bound): the likeness of the ``keep``-th best id found so far."""
    best = found.groupBy("rev", "t", "id").agg(F.max("likeness").alias("likeness"))
    at = F.row_number().over(W.partitionBy("rev", "t").orderBy(F.desc("likeness"), "id"))
    return best.withColumn("at", at).where(F.col("at") == keep).select("rev", "t", F.col("likeness").alias("bound"))


def _steps(keys: DataFrame, depth: int) -> DataFrame:
    """Keys of one more token: at a place behind the last one that leaves room for the tokens still needed."""
    end = F.least(F.size("c"), F.size("c") - F.greatest("need", F.lit(depth)) + depth)
    places = F.when(end > F.col("last"), F.sequence(F.col("last") + 1, end)).otherwise(F.array().cast("array<int>"))
    grown = keys.withColumn("place", F.explode(places))
    return grown.withColumn("key", F.concat_ws("\u0001", "key", F.get("c", F.col("place") - 1))).withColumn("last", F.col("place")).drop("place")


def _counted(sets: DataFrame) -> DataFrame:
    """(rev, token, df): the classes that hold a token."""
    return written(sets.select("rev", F.explode("t").alias("token")).groupBy("rev", "token").agg(F.count(F.lit(1)).alias("df")))


def _sharing_rare(asked: DataFrame, sets: DataFrame, common: DataFrame) -> DataFrame:
    """(rev, t, id, likeness) of all pairs that share a token which is not common."""
    rare = sets.select("rev", F.col("t").alias("r"), "ids", F.explode("t").alias("token")).join(common, ["rev", "token"], "left_anti")
    met = asked.select("rev", "t", F.explode("t").alias("token")).join(rare, ["rev", "token"]).select("rev", "t", "r", "ids").dropDuplicates(["rev", "t", "r"])
    return written(met.select("rev", "t", F.explode("ids").alias("id"), _likeness(F.size(F.array_intersect("t", "r")), F.size("t"), F.size("r")).alias("likeness")))


def _common_part(rows: DataFrame, common: DataFrame, cols: list[str]) -> DataFrame:
    """The rows (rev, *cols) that hold common tokens, with these as ``c``, rarest first."""
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
    return rows.withColumn("token", F.explode("t")).join(common, ["rev", "token"]).groupBy("rev", *cols).agg(rarest.alias("c"))


def _rests(shapes: DataFrame, depth: int) -> DataFrame:
    """The shapes' rows, once for each set of 1 to all tokens that is left when up to ``depth`` tokens of ``c`` are taken
    away: its hashes ``a`` and ``b``, its size ``s``."""
    each = lambda seed: F.transform("c", lambda t: F.xxhash64(t, F.lit(seed)))
    joined = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    rows = shapes.withColumn("ha", each(1)).withColumn("hb", each(2)).withColumn("s", F.size("c")).withColumn("last", F.lit(0)).drop("c")
    rows = rows.withColumn("a", joined(F.col("ha"))).withColumn("b", joined(F.col("hb"))).withColumn("size", F.col("s"))
    out = rows
    for _ in range(depth):
        rows = rows.withColumn("place", F.explode(F.when(F.col("last") < F.col("size"), F.sequence(F.col("last") + 1, F.col("size"))).otherwise(F.array().cast("array<int>"))))
        less = lambda key, hashes: F.col(key).bitwiseXOR(F.get(hashes, F.col("place") - 1))
        rows = rows.withColumn("a", less("a", "ha")).withColumn("b", less("b", "hb")).withColumn("s", F.col("s") - 1).withColumn("last", F.col("place")).drop("place")
        out = out.unionByName(rows)
    return out.where("s > 0").drop("ha", "hb", "last", "size")


def closest(asked: DataFrame, sets: DataFrame, keep: int, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """((rev, t, id, likeness), (rev, t)): what may be among the ``keep`` most alike of ``asked``, as in ``candidates``, and
    the token sets for which that is not all."""
    common = _counted(sets).where(F.col("df") > rare)
    close = _sharing_rare(asked, sets, common)
    shapes = _common_part(sets, common, ["t", "ids"]).select("rev", "c", F.size("t").alias("m"), F.explode("ids").alias("id"))
    at = F.dense_rank().over(W.partitionBy("rev", "c", "m").orderBy("id"))
    shapes = written(shapes.withColumn("at", at).where(F.col("at") <= keep).select("rev", "c", "m", "id").distinct())
    queries = _common_part(asked, common, ["t"]).withColumn("n", F.size("t"))
    of_shape = written(queries.groupBy("rev", "c", "n").agg(F.count(F.lit(1)).alias("sets")).withColumn("q", F.monotonically_increasing_id()))
    queries = written(queries.join(of_shape, ["rev", "c", "n"]).select("rev", "t", "q"))
    lengths = written(shapes.select("rev", F.size("c").alias("v"), "m").distinct())

    left, best, found = of_shape.select("rev", "c", "n", "q"), None, []
    for depth, longest in REACH.items():
        ours = _rests(left.where(F.size("c") <= longest), depth)
        theirs = _rests(shapes.where(F.size("c") <= longest), depth)
        at = F.dense_rank().over(W.partitionBy("rev", "a", "b", "m").orderBy("id"))
        index = theirs.withColumn("at", at).where(F.col("at") <= keep).select("rev", "a", "b", "m", "id")
        near = ours.join(index, ["rev", "a", "b"]).groupBy("q", "id").agg(F.max(_likeness(F.col("s"), F.col("n"), F.col("m"))).alias("likeness"))
        near = near if best is None else near.unionByName(best).groupBy("q", "id").agg(F.max("likeness").alias("likeness"))
        at = F.row_number().over(W.partitionBy("q").orderBy(F.desc("likeness"), "id"))
        best = written(near.withColumn("at", at).where(F.col("at") <= keep).drop("at"))
        bound = best.groupBy("q").agg(F.count(F.lit(1)).alias("held"), F.min("likeness").alias("least")).where(F.col("held") == keep).select("q", "least")
        # pairs of shapes that have not met share at most ``most`` tokens
        size, v, reached = F.col("u"), F.col("v"), F.lit(-1)
        for d in range(1, depth + 1):
            reached = F.when((v <= REACH[d]) & (size <= REACH[d]), F.lit(d)).otherwise(reached)
        most = F.least(size, v, F.greatest(size, v) - reached - 1)
        beyond = F.max(F.when(most > 0, _likeness(most, F.col("n"), F.col("m"))).otherwise(F.lit(0.0)))
        ceiling = left.select("rev", F.size("c").alias("u"), "n").distinct().join(F.broadcast(lengths), "rev").groupBy("rev", "u", "n").agg(beyond.alias("ceiling"))
        still = left.withColumn("u", F.size("c")).join(F.broadcast(ceiling), ["rev", "u", "n"]).join(bound, "q", "left")
        left = written(still.where((F.col("ceiling") > 0) & (F.col("ceiling") >= F.coalesce("least", F.lit(0.0)))).select("rev", "c", "n", "q"))
        if left.isEmpty():
            break
    done = queries.join(best.join(left.select("q"), "q", "left_anti"), "q").select("rev", "t", "id", "likeness")
    return close.unionByName(done), queries.join(left.select("q"), "q", "left_semi").select("rev", "t")


def candidates(asked: DataFrame, sets: DataFrame, keep: int, hot: int) -> DataFrame:
    """(rev, t, id, likeness) of the sets (rev, t, ids) that may be among the ``keep`` most alike of the token sets ``asked`` (rev, t),
    the highest of a pair's rows being its likeness."""
    common = _counted(sets).where(F.col("df") > hot)
    close = _sharing_rare(asked, sets, common)

    if common.isEmpty():
        return close
    with_common = lambda rows, cols: _common_part(rows, common, cols)
    shaped = with_common(sets, ["t", "ids"]).select("rev", "c", F.size("t").alias("m"), F.explode("ids").alias("id")).groupBy("rev", "c", "m").agg(_least("id", keep).alias("ids"))
    shapes = written(shaped)
    queries = written(with_common(asked, ["t"]))

    bucket = lambda rows: rows.withColumn("probe", F.explode(_probes(F.col("c"))))
    at = F.row_number().over(W.partitionBy("rev", "probe").orderBy("m", "ids"))
    buckets = bucket(shapes).withColumn("at", at).where(F.col("at") <= keep).select("rev", "probe", F.col("c").alias("r"), "m", "ids")
    probed = bucket(queries).join(buckets, ["rev", "probe"]).select("rev", "t", F.explode("ids").alias("id"), _likeness(F.size(F.array_intersect("c", "r")), F.size("t"), F.col("m")).alias("likeness"))
    near = written(probed.where("likeness > 0"))

    # levels of the bound, so that both sides leave the same room; tokens of all classes stand apart
    total = shapes.groupBy("rev").agg(F.count(F.lit(1)).alias("total"))
    everywhere = shapes.select("rev", F.explode("c").alias("token")).groupBy("rev", "token").agg(F.count(F.lit(1)).alias("n")).join(total, "rev").where("n = total").groupBy("rev").agg(F.collect_set("token").alias("all"))
    apart = lambda rows: rows.join(everywhere, "rev", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    asks = apart(queries.join(_bound(close.unionByName(near), keep), ["rev", "t"], "left")).withColumn("level", F.coalesce(F.floor(F.col("bound") * 20 - 1e-6), F.lit(0)).cast("int"))
    asks = written(asks.select("rev", "t", "level", F.array_except("c", "all").alias("c"), F.size(F.array_intersect("c", "all")).alias("u"), F.size("t").alias("n")))
    levels = asks.select("rev", "level").distinct()
    room = lambda size, u: F.ceil(F.col("level") / 20 * F.col(size) - 1e-6).cast("int") - F.col(u)
    theirs = apart(shapes).select("rev", F.array_except("c", "all").alias("c"), F.size("all").alias("u"), "m", "ids").join(levels, "rev")
    start = lambda rows, size: rows.withColumn("need", room(size, "u")).where(F.size("c") >= F.col("need")).withColumn("key", F.lit("")).withColumn("last", F.lit(0))
    ours, theirs, found, depth = start(asks, "n"), start(theirs, "m"), [close, near], 0
    by = ["rev", "level", "key"]
    while True:
        theirs = written(theirs.join(ours.select(*by).distinct(), by, "left_semi"))
        hotter = written(theirs.groupBy(*by).agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > hot).select(*by))
        left = ours.drop("last")
        leaf = theirs.join(hotter, by, "left_anti").select(*by, F.col("c").alias("r"), "m", "ids")
        exact = left.join(leaf, by).select("rev", "t", "ids", _likeness(F.col("u") + F.size(F.array_intersect("c", "r")), F.col("n"), F.col("m")).alias("likeness"))
        same = theirs.join(hotter, by, "left_semi").select(*by, "m", F.explode("ids").alias("id")).groupBy(*by, "m").agg(_least("id", keep).alias("ids"))
        least = left.join(same, by).select("rev", "t", "ids", _likeness(F.col("u") + F.lit(depth), F.col("n"), F.col("m")).alias("likeness"))
        found.append(written(exact.unionByName(least).where("likeness > 0").select("rev", "t", F.explode("ids").alias("id"), "likeness").distinct()))
        if hotter.isEmpty():
            break
        depth += 1
        ours, theirs = written(_steps(ours.join(hotter, by, "left_semi"), depth)), _steps(theirs.join(hotter, by, "left_semi"), depth)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def top_k(requests: DataFrame, references: DataFrame, k: int, hot: int) -> DataFrame:
    """(case_id, ref_id, similarity, rank): of requests(case_id, rev, t) the k most alike references(case_id, rev, t) of the
    same revision that share a token, its own id excluded; ``t`` holds sorted tokens without repeats.

    Defined cases: empty sets have no neighbours and are none; ties go to smaller ids; rows that repeat an id with another
    set count by the best of them; null ids take no part.
    """
    keep = k + 1  # one may be the request's own row
    asked = written(requests.select("case_id", "rev", "t").where("case_id IS NOT NULL AND size(t) > 0").distinct())
    sets = written(references.where("case_id IS NOT NULL AND size(t) > 0").groupBy("rev", "t").agg(_least("case_id", keep).alias("ids")))
    near, left = closest(asked.select("rev", "t").distinct(), sets, keep, min(RARE, hot))
    left = written(left)
    if not left.isEmpty():
        near = near.unionByName(candidates(left, sets, keep, hot))
    best = near.groupBy("rev", "t", F.col("id").alias("ref_id")).agg(F.max("likeness").alias("similarity"))
    of_case = asked.join(best, ["rev", "t"]).where("case_id <> ref_id").groupBy("case_id", "ref_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("similarity"), "ref_id"))
    return of_case.withColumn("rank", rank).where(F.col("rank") <= k).select("case_id", "ref_id", "similarity", "rank")
