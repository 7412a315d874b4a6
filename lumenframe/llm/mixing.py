"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, word_count

#: Fractional parts of golden ratio * 1 and * 2^20, fixed values. Splitting a slot's number keeps its point exact to 1e-9.
GOLDEN, GOLDEN_2_20 = 0.6180339887498949, 0.6077874097403510
#: Slots are counted in runs of this many, so that no window holds one source's slots.
RUN = 1 << 14
GRID = 256


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): one row a source, nulls included.

    Sources in order of code points, null last, weigh weights in turn. The target is weight * level, at most `most`
    times the source's size, with the level at which targets sum to share times all sizes: the same as resharing
    what is above by weight until nothing is. The windows run over one row a source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("__w", F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("__i") % len(weights)))
    s = s.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    s = s.withColumn("__all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    s = s.withColumn("__capped", F.coalesce(F.sum("__cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("__open", F.sum("__w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    # the level if this source and all after it stay open; the first one that fits under its own cap is the level
    s = s.withColumn("__level", F.greatest(F.lit(0.0), F.col("__all") - F.col("__capped")) / F.col("__open"))
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct((F.col("__cap") / F.col("__w")).alias("a"), F.col("__i").alias("b"), F.col("__level").alias("c")))
    s = s.withColumn("__first", F.min(fits).over(Window.partitionBy())["c"])
    t = F.when(F.col("__first").isNull(), F.col("__cap")).otherwise(F.least("__cap", F.col("__first") * F.col("__w")))
    return s.select("source", "source_size", t.alias("target"), F.col("__i").alias("source_no"))


def schedule(t: DataFrame, block: int, slots: int) -> DataFrame:
    """(slot, source_no, rank): which source each of `slots` places of the mix takes, and its how manieth slot that is.

    Slot k has the point frac(k * golden ratio); the source is the one whose part of the cumulative targets holds it.
    Points meet parts by an equal join on cells of a grid. Ranks come from counts by run of RUN slots and a window
    within a run, so that a source with most slots is no single task.
    """
    spark = t.sparkSession
    w = Window.orderBy("source_no")
    total = F.sum("target").over(Window.partitionBy())
    parts = t.where("target > 0").select("source_no", (F.sum("target").over(w) / total).alias("hi"), ((F.sum("target").over(w) - F.col("target")) / total).alias("lo"), (F.sum("target").over(w) >= total).alias("last"))
    parts = parts.withColumn("hi", F.when(F.col("hi") >= 1 - 1e-12, F.lit(2.0)).otherwise(F.col("hi"))).drop("last")
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID - 1e-6).cast("int"), F.least(F.lit(GRID - 1), F.floor(F.col("hi") * GRID).cast("int")))))
    k = F.col("slot")
    u = F.shiftright(k, 20) * F.lit(GOLDEN_2_20) + k.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", u - F.floor(u)).withColumn("cell", F.floor(F.col("u") * GRID).cast("int"))
    return _ranked(points.join(cells, "cell").where("u >= lo and u < hi").select("slot", "source_no"))


def _ranked(placed: DataFrame) -> DataFrame:
    placed = cut(placed.withColumn("run", F.floor(F.col("slot") / RUN)))
    counts = placed.groupBy("source_no", "run").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source_no", "run", before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1
    return placed.withColumn("inside", inside).join(starts, ["source_no", "run"]).select("slot", "source_no", (F.col("start") + F.col("inside")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target and taken: how many of its words, repeats counted, the mix takes.

    docs needs doc_id, source and size. A source's documents are put in a shuffled order (by hash, so reruns agree)
    and their words cut into equal blocks of about one slot's words, one block at least; slot of rank r takes block r,
    and starts over after the last one. Slots that would pass the source's target are left out, and the words that are
    missing after the last one are a shorter block of their own, so that a source of any size gives its target, rounded.
    Blocks shrink with the input so that a mix has some thousand slots at least. Equal rows may
    swap places in the order. Documents without words take part with 0. Null sources are a source of their own. Empty
    tables give no rows. Further columns stay as they are; those named like the results, source_no or block are an error.
    """
    if clash := {"source_size", "target", "taken", "source_no", "block"} & set(docs.columns):
        raise ValueError(f"the table already has {sorted(clash)}")
    docs = cut(docs)  # what sizes are counted from is read once
    d = docs.withColumn("__x", F.xxhash64(F.lit(seed), "doc_id")).withColumn("__b", F.shiftrightunsigned("__x", 54))
    sizes = cut(d.groupBy("source", "__b").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    t = cut(targets(sizes, weights, share, most))
    every, words, n = (sizes.agg(F.sum("size"), F.count("*")).first() or (0, 0)) + (t.count(),)
    if not n:
        return docs.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    every = every or 0
    block = max(1, min(2048, every // (4096 * 4)))
    slots = int(every * share / block + 0.5)
    # where each document's words start in its source's order: sums by hash bucket, then within the bucket
    starts = sizes.withColumn("__s", F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("source").alias("__source"), F.col("__b").alias("__bucket"), "__s")
    names = t.select(F.col("source").alias("__name"), "source_no", "source_size", "target")
    inside = Window.partitionBy("source", "__b").orderBy("__x", "doc_id", "size")
    d = d.withColumn("__r", F.row_number().over(inside)).withColumn("__i", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.join(F.broadcast(names) if n <= 10_000 else names, d["source"].eqNullSafe(F.col("__name"))).drop("__name")
    d = d.join(starts, d["source"].eqNullSafe(F.col("__source")) & (F.col("__b") == F.col("__bucket"))).drop("__source", "__bucket")
    d = cut(d.withColumn("__s", F.col("__s") + F.col("__i")))
    small = lambda x: F.broadcast(x) if n <= 10_000 else x
    parts = t.where("source_size > 0").select("source_no", F.col("source_size").alias("__size"), F.round("target").cast("long").alias("__goal"), F.greatest(F.lit(1), F.round(F.col("source_size") / block)).cast("long").alias("__n"))
    # a source's first __long blocks have a word more than the others
    parts = parts.withColumn("__base", F.expr("__size div __n")).withColumn("__long", F.expr("__size % __n"))
    parts = cut(parts)
    slot = schedule(t, block, slots).join(small(parts), "source_no").withColumn("block", F.col("rank") % F.col("__n"))
    slot = slot.withColumn("__end", F.expr("(rank div __n) * __size + (block + 1) * __base + least(block + 1, __long)")).where("__end <= __goal")
    uses = cut(slot.groupBy("source_no", "block").agg(F.count("*").alias("uses"), F.max("__end").alias("__end")))
    held_by = F.expr("CASE WHEN __x < __long * (__base + 1) THEN __x div (__base + 1) ELSE __long + (__x - __long * (__base + 1)) div __base END")
    pieces = d.where("size > 0").select("source_no", "__b", "__r", "__s", (F.col("__s") + F.col("size")).alias("__e")).join(small(parts), "source_no")
    pieces = pieces.withColumn("__x", F.col("__s")).withColumn("__first", held_by).withColumn("__x", F.col("__e") - 1).withColumn("__last", held_by)
    pieces = pieces.withColumn("block", F.explode(F.sequence("__first", "__last")))
    start = F.expr("block * __base + least(block, __long)")
    end = F.expr("(block + 1) * __base + least(block + 1, __long)")
    held = F.least("__e", end) - F.greatest("__s", start)
    taken = pieces.join(uses.drop("__end"), ["source_no", "block"]).groupBy("source_no", "__b", "__r").agg(F.sum(held * F.col("uses")).alias("taken"))
    # the words between the last whole slot and the target, as one block of its own
    done = parts.join(uses.groupBy("source_no").agg(F.max("__end").alias("__done")), "source_no", "left").select("source_no", "__size", "__goal", F.coalesce("__done", F.lit(0)).alias("__done"))
    among = lambda x: F.expr(f"({x} div __size) * size + least(greatest({x} % __size - __s, 0), size)")
    out = d.join(taken, ["source_no", "__b", "__r"], "left").join(small(done), "source_no", "left")
    rest = F.when(F.col("size") > 0, among("__goal") - among("__done"))
    out = out.withColumn("taken", (F.coalesce("taken", F.lit(0)) + F.coalesce(rest, F.lit(0))).cast("long"))
    return out.select(*docs.columns, "source_size", "target", "taken")


def op6_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at 150 % of all words, sources weighing 5, 2, 1 in turn, none taken more than twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
