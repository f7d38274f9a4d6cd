"""Joins, merges, coverage and bins of intervals.

Columns are ``contig``, ``start``, ``end`` (0-based, half-open) and, where they
matter, ``strand``.  Two intervals overlap if ``a.end > b.start`` and
``a.start < b.end``; so an empty interval overlaps only what holds its place
strictly inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.operators import ordered

#: Buckets that an interval may cover at its own level.
FAN = 64


# ---------------------------------------------------------------- overlap join


def _width(bucket: int, level: int) -> int:
    return bucket * FAN**level


def _level(start: str, end: str, bucket: int, levels: int) -> Column:
    """The finest level at which the interval covers at most about ``FAN`` buckets."""
    length = F.col(end) - F.col(start)
    level = F.lit(levels - 1)
    for i in range(levels - 2, -1, -1):
        level = F.when(length <= _width(bucket, i) * (FAN - 1), F.lit(i)).otherwise(level)
    return level


def _key_of(level: int):
    return lambda bucket: F.struct(F.lit(level).alias("_level"), bucket.cast("long").alias("_bucket"))


def _bucketed(df: DataFrame, start: str, end: str, bucket: int, levels: int, side: str) -> DataFrame:
    """Rows by (level, bucket): those of their own level, and of every coarser one."""
    keys = []
    for i in range(levels):
        w = F.lit(_width(bucket, i))
        first, last = F.floor(F.col(start) / w), F.floor(F.greatest(F.col(start), F.col(end) - 1) / w)
        found = F.transform(F.sequence(first, last), _key_of(i))
        keys.append(F.when(F.lit(i) >= F.col(f"_own_{side}"), found).otherwise(F.expr("cast(array() as array<struct<_level:int,_bucket:bigint>>)")) if levels > 1 else found)
    df = df.withColumn(f"_own_{side}", _level(start, end, bucket, levels))
    exploded = df.withColumn("_k", F.explode(F.concat(*keys) if len(keys) > 1 else keys[0]))
    return exploded.withColumn("_level", F.col("_k._level")).withColumn("_bucket", F.col("_k._bucket")).drop("_k")


def _row_keys(df: DataFrame) -> dict[str, Column]:
    """Two hashes that tell rows apart, equal for equal rows, whatever task or attempt makes them."""
    parts = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes]
    return {"_id": F.xxhash64(F.lit(1), *parts), "_id2": F.xxhash64(F.lit(2), *reversed(parts))}


def overlap_join(left: DataFrame, right: DataFrame, on: list[str] | None = None, how: str = "inner", bucket: int = 1 << 12, levels: int = 3, suffix: str = "_r", min_overlap: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals, each once, without a cross product.

    Both sides are dealt into buckets of positions and joined on them; a pair is
    kept only in the bucket where its overlap begins, at the coarser of the two
    intervals' levels, so nothing has to be made distinct.  An interval that
    would cover many buckets goes to a coarser level, so it is never copied more
    than a bounded number of times.  ``how``: inner, left, left_semi, left_anti,
    or first (of each left interval's overlaps the one with the least start, end).
    Columns of the right side that the left has too get ``suffix``.  Intervals
    with a null bound or key overlap nothing.
    """
    on = on or ["contig"]
    keep = ["start", "end", *[c for c in right.columns if c not in on and c not in ("start", "end")]]
    names = {c: c + suffix if c in left.columns or c in ("start", "end") else c for c in keep}
    renamed = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[F.col(c).alias(names[c]) for c in keep])
    rs, re = names["start"], names["end"]
    tagged = left if how == "inner" else left.withColumns(_row_keys(left))
    a = _bucketed(tagged.where(F.col("start").isNotNull() & F.col("end").isNotNull()), "start", "end", bucket, levels, "a")
    b = _bucketed(renamed.where(F.col(rs).isNotNull() & F.col(re).isNotNull()), rs, re, bucket, levels, "b").withColumnsRenamed({"_level": "_level_b", "_bucket": "_bucket_b"})
    same = [F.col(c) == F.col(f"_on{i}") for i, c in enumerate(on)]
    widths = reduce(lambda x, i: F.when(F.col("_level") == i, F.lit(_width(bucket, i))).otherwise(x), range(levels), F.lit(bucket))
    begins = F.floor(F.greatest(F.col("start"), F.col(rs)) / widths)
    rule = [*same, F.col("_level") == F.col("_level_b"), F.col("_bucket") == F.col("_bucket_b"), F.col("end") > F.col(rs), F.col("start") < F.col(re), F.col("_bucket") == begins]
    if levels > 1:
        rule.append(F.col("_level") == F.greatest("_own_a", "_own_b"))
    if min_overlap:
        rule.append(F.least(F.col("end"), F.col(re)) - F.greatest(F.col("start"), F.col(rs)) >= min_overlap)
    pairs = a.join(b, reduce(lambda x, y: x & y, rule))
    out = [*left.columns, *names.values()]
    if how == "inner":
        return pairs.select(*out)
    hit = pairs.select("_id", "_id2").distinct()
    if how == "left_semi":
        return tagged.join(hit, ["_id", "_id2"], "left_semi").select(*left.columns)
    none = tagged.join(hit, ["_id", "_id2"], "left_anti")
    if how == "left_anti":
        return none.select(*left.columns)
    if how == "first":  # equal rows have the same first
        rank = F.row_number().over(Window.partitionBy("_id", "_id2").orderBy(rs, re, *[n for c, n in names.items() if c not in ("start", "end") and not dict(right.dtypes)[c].startswith("map")]))
        best = pairs.select("_id", "_id2", *names.values()).withColumn("_rank", rank).where("_rank = 1")
        return tagged.join(best, ["_id", "_id2"]).select(*out)
    if how == "left":
        return pairs.select(*out).unionByName(none.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in names.items()]))
    raise ValueError(f"unknown how: {how}")


def stranded(queries: DataFrame, strand: str = "strand") -> DataFrame:
    """Queries by each strand they ask for: ``*`` is all, more than one character means any of them."""
    asked = F.when(F.col(strand) == "*", F.array(F.lit("+"), F.lit("-"), F.lit("."))).otherwise(F.array_distinct(F.split(F.col(strand), "(?!^)(?!$)")))
    return queries.withColumn(strand, F.explode(asked))


def intersect_intervals(left: DataFrame, right: DataFrame, on: list[str] | None = None, mode: str = "all", **how) -> DataFrame:
    """The shared part of each overlapping pair; with mode ``first`` one pair at most for each left interval."""
    pairs = overlap_join(left, right, on, "first" if mode == "first" else "inner", **how)
    return pairs.withColumns({"start": F.greatest("start", "start_r"), "end": F.least("end", "end_r")}).drop("start_r", "end_r")


def starts_at(points: DataFrame, intervals: DataFrame, on: list[str] | None = None, position: str = "pos") -> DataFrame:
    """Intervals that begin at each point."""
    on = on or ["contig"]
    return points.join(intervals.withColumnRenamed("start", position).withColumn("start", F.col(position)), [*on, position])


def ends_at(points: DataFrame, intervals: DataFrame, on: list[str] | None = None, position: str = "pos") -> DataFrame:
    """Intervals that end at each point."""
    on = on or ["contig"]
    return points.join(intervals.withColumnRenamed("end", position).withColumn("end", F.col(position)), [*on, position])


# ---------------------------------------------------------------- nearest


def nearest_left(points: DataFrame, intervals: DataFrame, on: list[str] | None = None, point_id: list[str] | None = None, position: str = "pos", most: int = 1_000_000_000, chunk: int = ordered.CHUNK) -> DataFrame:
    """Of the intervals that end at or before each point, the nearest, all ties of them, within ``most``.

    An as-of join: the largest end up to a point comes from a running maximum
    over points and ends together, and an equi-join on that end brings back the
    intervals.  With ``point_id``, rows of ``points`` that share it (one for each
    strand asked for, say) compete, and the least distance among them wins.
    """
    on = on or ["contig"]
    ends = intervals.where(F.col("end").isNotNull()).select(*on, F.col("end").alias("_pos"), F.lit(0).alias("_query"), F.col("end").alias("_end")).distinct()
    asked = points.where(F.col(position).isNotNull()).select(*on, F.col(position).alias("_pos")).distinct()
    both = ends.unionByName(asked.select(*on, "_pos", F.lit(1).alias("_query"), F.lit(None).cast("long").alias("_end")))
    found = ordered.running_max(both, on, "_pos", "_end", "_best", ["_pos", "_query"], chunk=chunk)
    found = found.where((F.col("_query") == 1) & (F.col("_pos") - F.col("_best") <= most)).select(*on, F.col("_pos").alias(position), "_best")
    near = points.join(found, [*on, position])
    if point_id:
        near = near.withColumn("_near", F.max("_best").over(Window.partitionBy(*point_id))).where("_best = _near").drop("_near")
    taken = [c for c in intervals.columns if c in points.columns and c not in on]
    other = intervals.withColumnsRenamed({c: c + "_r" for c in taken}).withColumn("_best", F.col("end_r" if "end" in taken else "end"))
    return near.join(other, [*on, "_best"]).withColumn("distance", F.col(position) - F.col("_best")).drop("_best")


def nearest_right(points: DataFrame, intervals: DataFrame, on: list[str] | None = None, point_id: list[str] | None = None, position: str = "pos", most: int = 1_000_000_000, chunk: int = ordered.CHUNK) -> DataFrame:
    """Of the intervals that start at or after each point, the nearest, all ties of them, within ``most``: ``nearest_left`` mirrored."""
    flipped = points.withColumn(position, -F.col(position))
    mirror = intervals.withColumns({"start": -F.col("end"), "end": -F.col("start")})
    out = nearest_left(flipped, mirror, on, point_id, position, most, chunk)
    s, e = ("start_r" if "start" in points.columns else "start"), ("end_r" if "end" in points.columns else "end")
    return out.withColumns({position: -F.col(position), s: -F.col(e), e: -F.col(s)})


# ---------------------------------------------------------------- merge and coverage


def merge_intervals(df: DataFrame, keys: list[str] | None = None, min_overlap: int = 1, chunk: int = ordered.CHUNK) -> DataFrame:
    """Unions of intervals that overlap by ``min_overlap`` or more, with the number of intervals in each.

    1 merges real overlaps, 0 also intervals that touch, -d those at most d apart.
    """
    keys = keys or ["contig"]
    rows = df.where(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy(*keys, "start", "end").agg(F.count(F.lit(1)).alias("_n"))
    rows = ordered.running_max(rows, keys, "start", "end", "_reach", ["start", "end"], exclusive=True, chunk=chunk)
    new = F.col("_reach").isNull() | (F.col("_reach") - F.col("start") < min_overlap)
    rows = rows.withColumn("_new", new.cast("long"))
    rows = ordered.running_sum(rows, keys, "start", "_new", "_island", ["start", "end"], chunk=chunk)
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("n_merged")).drop("_island")


def coverage(df: DataFrame, keys: list[str] | None = None, zero: bool = False, lengths: DataFrame | None = None, chunk: int = ordered.CHUNK) -> DataFrame:
    """Runs of equal depth: keys, start, end, cov.

    Steps up and down are summed by position and those that cancel go before
    anything is sorted.  With ``zero`` also the runs that nothing covers: between
    others, and, given ``lengths`` (contig, length), up to the contig's ends.
    """
    keys = keys or ["contig"]
    rows = df.where(F.col("start") < F.col("end"))
    step = F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d"))))
    steps = rows.select(*keys, step.alias("s")).groupBy(*keys, F.col("s.p").alias("start")).agg(F.sum("s.d").alias("_d")).where("_d <> 0")
    if zero and lengths is not None:
        edges = lengths.select("contig", F.explode(F.array(F.lit(0).cast("long"), F.col("length"))).alias("start"), F.lit(0).cast("long").alias("_d"))
        others = [k for k in keys if k != "contig"]
        if others:
            edges = edges.join(df.select(*keys).distinct(), "contig").select(*keys, "start", "_d")
        steps = steps.unionByName(edges).groupBy(*keys, "start").agg(F.sum("_d").alias("_d"))
    runs = ordered.running_sum(steps, keys, "start", "_d", "cov", chunk=chunk)
    runs = ordered.next_position(runs, keys, "start", "end", chunk=chunk).where(F.col("end").isNotNull())
    return runs.where(F.lit(True) if zero else F.col("cov") > 0).select(*keys, "start", "end", "cov")


def clip(df: DataFrame, intervals: DataFrame, on: list[str] | None = None, **how) -> DataFrame:
    """The parts of ``df`` inside each of ``intervals``, with the interval's other columns."""
    return intersect_intervals(df, intervals, on, **how)


def mean_coverage(intervals: DataFrame, reads: DataFrame, key: list[str], by: list[str] | None = None, **how) -> DataFrame:
    """Mean depth of each interval: shared bases over length.

    ``reads`` are gap-free blocks.  No sweep is needed: the sum of depths is the
    sum of overlaps.  Intervals without reads have 0; with ``by`` (sample, say)
    there is a row for each interval and each value of it.  Empty intervals have null.
    """
    by = by or []
    shared = F.least("end", "end_r") - F.greatest("start", "start_r")
    hits = overlap_join(intervals.select(*key, "contig", "start", "end"), reads.select(*by, "contig", "start", "end"), **how)
    sums = hits.groupBy(*key, *by).agg(F.sum(shared).alias("bases"))
    frame = intervals if not by else intervals.crossJoin(F.broadcast(reads.select(*by).distinct()))  # by is a handful of samples
    out = frame.join(sums, [*key, *by], "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
    return out.withColumn("mean_cov", F.try_divide(F.col("bases"), F.col("end") - F.col("start")))


def coverage_counts(intervals: DataFrame, reads: DataFrame, max_cov: int | None = None, key: list[str] | None = None, **how) -> DataFrame:
    """Bases at each depth over all intervals: cov, bases.

    Depths over ``max_cov`` count as it; bases that no read covers are the depth
    0; a base in two intervals counts twice.
    """
    runs = clip(coverage(reads), intervals.select("contig", "start", "end"), **how)
    level = F.least("cov", F.lit(max_cov)) if max_cov is not None else F.col("cov")
    found = runs.groupBy(level.alias("cov")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    total = intervals.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("t"))
    covered = found.agg(F.coalesce(F.sum("bases"), F.lit(0)).alias("c"))
    bare = total.crossJoin(covered).select(F.lit(0).cast("long").alias("cov"), (F.col("t") - F.col("c")).alias("bases"))  # one row by one row
    return found.unionByName(bare).groupBy("cov").agg(F.sum("bases").alias("bases"))


def coverage_histogram(counts: DataFrame, max_cov: int) -> DataFrame:
    """From ``coverage_counts``: for c from 0 to ``max_cov``, the share of bases covered at least c times."""
    spark = counts.sparkSession
    levels = spark.range(max_cov + 1).select(F.col("id").alias("cov"))
    capped = counts.groupBy(F.least("cov", F.lit(max_cov)).alias("cov")).agg(F.sum("bases").alias("bases"))
    filled = levels.join(capped, "cov", "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
    above, all_rows = Window.orderBy(F.desc("cov")), Window.orderBy(F.desc("cov")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return filled.select("cov", "bases", (F.sum("bases").over(above) / F.sum("bases").over(all_rows)).alias("fraction"))


def mean_coverage_all(intervals: DataFrame, reads: DataFrame, key: list[str], **how) -> DataFrame:
    """One row: mean depth over all bases of all intervals."""
    each = mean_coverage(intervals, reads, key, **how)
    return each.agg(F.sum("bases").alias("bases"), F.sum(F.col("end") - F.col("start")).alias("length")).withColumn("mean_cov", F.try_divide("bases", "length"))


def independent(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """For each key: do its intervals never overlap?"""
    keys = keys or ["contig"]
    rows = ordered.running_max(df, keys, "start", "end", "_reach", ["start", "end"], exclusive=True)
    return rows.groupBy(*keys).agg(F.every(F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True))).alias("independent"))


def neighbours(df: DataFrame, flank: int, keys: list[str] | None = None, position: str = "pos", name: str = "neighbours") -> DataFrame:
    """How many other rows lie within ``flank`` of each."""
    return ordered.neighbour_count(df, keys or ["contig"], position, flank, name)


# ---------------------------------------------------------------- validity


def check_intervals(df: DataFrame, contigs: DataFrame, closed: bool = False) -> DataFrame:
    """``df`` with ``problem``: why the interval is invalid, or null.

    An interval must name a known contig, begin before it ends (with ``closed``,
    counted from 1 and with its end, not after it) and stay within the contig.
    """
    known = contigs.select(F.col("contig"), F.col("length").alias("_length"))
    low = 1 if closed else 0
    order = F.col("start") > F.col("end") if closed else F.col("start") >= F.col("end")
    problem = (
        F.when(F.col("contig").isNull() | F.col("_length").isNull(), "unknown contig")
        .when(F.col("start").isNull() | F.col("end").isNull(), "missing bound")
        .when(order, "empty")
        .when((F.col("start") < low) | (F.col("end") > F.col("_length")), "outside contig")
    )
    return df.join(known, "contig", "left").withColumn("problem", problem).select(*df.columns, "problem")


def require_valid(df: DataFrame, contigs: DataFrame, closed: bool = False) -> DataFrame:
    """``df``, failing when it runs if an interval is invalid."""
    told = check_intervals(df, contigs, closed)
    message = F.concat(F.lit("invalid interval, "), F.col("problem"), F.lit(": "), F.coalesce("contig", F.lit("?")))
    return told.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("problem")


# ---------------------------------------------------------------- bins and tiles


def tile(regions: DataFrame, size: int, overlap: int = 0, complete: bool = True) -> DataFrame:
    """Tiles of ``size`` whose neighbours share ``overlap``; with ``complete``, fails if they don't span a region exactly."""
    step = size - overlap
    if step <= 0 or overlap < 0:
        raise ValueError("size must exceed overlap, and overlap must not be negative")
    at = F.when(F.col("end") - overlap > F.col("start"), F.sequence(F.col("start"), F.col("end") - overlap - 1, F.lit(step).cast("long")))
    tiles = regions.withColumn("_at", F.explode(at))
    if complete:
        exact = (F.col("end") - F.col("start") - overlap) % step == 0
        tiles = tiles.where(F.when(exact, F.lit(True)).otherwise(F.raise_error(F.lit("tiles don't span the region")).cast("boolean")))
    return tiles.withColumns({"start": F.col("_at"), "end": F.col("_at") + size}).drop("_at")


def bins(contigs: DataFrame, size: int, equal: bool) -> DataFrame:
    """Bins of contigs: contig, start, end, bin (0 up within the contig).

    Equal bins all have ``size`` and are centred; half of what is left over, rounded down, comes before
    the first.  Otherwise a contig has as few bins as do for ``size``, whose sizes
    differ by one at most, larger ones first.
    """
    n = F.expr(f"length div {size}") if equal else F.ceil(F.col("length") / F.lit(size)).cast("long")
    rows = contigs.where("length > 0").withColumn("_n", n).where("_n > 0").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    if equal:
        start = F.expr(f"(length % {size}) div 2 + bin * {size}")
        return rows.select("contig", start.alias("start"), (start + size).alias("end"), "bin")
    rows = rows.withColumn("_big", F.ceil(F.col("length") / F.col("_n")).cast("long"))
    rows = rows.withColumn("_nbig", F.col("_n") - (F.col("_n") * F.col("_big") - F.col("length")))
    start = F.col("bin") * F.col("_big") - F.greatest(F.lit(0), F.col("bin") - F.col("_nbig"))
    end = start + F.col("_big") - (F.col("bin") >= F.col("_nbig")).cast("long")
    return rows.select("contig", start.alias("start"), end.alias("end"), "bin")


def equal_bin(position: Column, length: Column, size: int) -> Column:
    """The equal bin of a position by arithmetic, null outside the bins."""
    offset = F.floor((length % size) / 2)
    index = F.floor((position - offset) / size).cast("long")
    return F.when((position >= offset) & (index < F.floor(length / size)), index)


def bin_of_points(points: DataFrame, bin_table: DataFrame, position: str = "pos") -> DataFrame:
    """Points with ``bin`` and ``outcome``: found, nochr (contig has no bins) or nobin.

    Bins don't overlap, so the one that holds a point is the last that begins at
    or before it: an as-of join.
    """
    known = bin_table.select("contig").distinct().withColumn("_known", F.lit(True))
    starts = bin_table.select("contig", F.col("start").alias("end"), F.col("end").alias("_bin_end"), F.col("bin").alias("_bin"))
    spots = points.select("contig", position).where(F.col(position).isNotNull()).distinct()
    found = nearest_left(spots, starts, position=position).where(F.col(position) < F.col("_bin_end")).select("contig", position, F.col("_bin").alias("bin"))
    out = points.join(found, ["contig", position], "left").join(known, "contig", "left")
    outcome = F.when(F.col("_known").isNull(), "nochr").when(F.col("bin").isNull(), "nobin").otherwise("found")
    return out.withColumn("outcome", outcome).select(*points.columns, "bin", "outcome")


def chromosome_arms(contigs: DataFrame, centromeres: DataFrame, named: bool = False) -> DataFrame:
    """Two arms of each contig that has a centromere (contig, start, end): contig, start, end[, name]."""
    c = centromeres.select("contig", F.col("start").alias("_cs"), F.col("end").alias("_ce"))
    arm = F.explode(
        F.array(
            F.struct(F.lit(0).cast("long").alias("start"), F.col("_cs").alias("end"), F.lit("_ArmL").alias("arm")),
            F.struct(F.col("_ce").alias("start"), F.col("length").alias("end"), F.lit("_ArmR").alias("arm")),
        )
    )
    rows = contigs.join(c, "contig").select("contig", arm.alias("a")).select("contig", "a.start", "a.end", F.concat("contig", "a.arm").alias("name")).where("end > start")
    return rows if named else rows.drop("name")


# ---------------------------------------------------------------- order and samples


def sorted_by_place(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in order of contig and start, in range partitions: a global sort that leaves its partitions to be written side by side."""
    n = [partitions] if partitions else []
    return df.repartitionByRange(*n, "contig", "start", "end").sortWithinPartitions("contig", "start", "end")


def numbered(df: DataFrame, keys: list[str] | None = None, name: str = "index", chunk: int = ordered.CHUNK) -> DataFrame:
    """Rows with their number, from 0, in order of start and end within ``keys``; equal intervals are numbered in any order."""
    keys = keys or ["contig"]
    ones = ordered.running_sum(df.withColumn("_one", F.lit(1).cast("long")), keys, "start", "_one", name, ["start", "end"], chunk)
    return ones.withColumn(name, F.col(name) - 1).drop("_one")


def covered_in_all(wide: DataFrame, samples: list[str], least: float) -> DataFrame:
    """Rows of an interval-by-sample table in which every sample reaches ``least``."""
    return wide.where(F.least(*[F.coalesce(c, F.lit(0)) for c in samples], F.lit(float("inf"))) >= least)


def union_distinct(*sets: DataFrame) -> DataFrame:
    """Distinct rows of several tables of the same columns."""
    return reduce(DataFrame.unionByName, sets).distinct()


def require_subset(part: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    """``part``, failing when it runs on a key that ``whole`` lacks."""
    known = whole.select(*key).distinct().withColumn("_known", F.lit(True))
    message = F.concat(F.lit("not in the whole: "), F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    return part.join(known, key, "left").where(F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_known")


def require_disjoint(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``a``, failing when it runs on a key that ``b`` has too."""
    known = b.select(*key).distinct().withColumn("_known", F.lit(True))
    message = F.concat(F.lit("in both: "), F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    return a.join(known, key, "left").where(F.when(F.col("_known").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_known")
