"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets share the whole by weight; a source's target stops at ``epochs`` times its size and what it leaves goes to the
others by weight, until none is above its cap. Sorted by cap over weight, the capped sources are a prefix, so one pass
over the per-source table finds the level. A source is then taken in whole repetitions plus a seeded fraction: its
documents in md5 order of (seed, id) up to the first that doesn't fit. What is then missing is filled from the largest
size of documents downwards, each as often as it fits, until no document with a repetition left fits; one more of the
smallest is taken if that comes nearer. The list of a source's sizes, which this goes over, is bounded by its longest
document.

Documents of equal key, id and size are one class with a number of rows; a class may be taken in part, and its rows are
then numbered. Running sums go in two steps over classes alone, over 4,096 hash ranges a source (or source and size) and
then inside each range, so a source with a third of all rows is spread over thousands of groups. Texts are never
shuffled, but for rows of classes taken in part: the plan they are joined with has a row a source, holding the place in
the md5 order at which the fraction ends, and a few classes a source.

Edge cases: documents without words (null texts too) are taken once where their source is taken whole, else not; a null
source is a source of its own, last in order; a source without words has target 0; a null doc_id is ordered by its text;
repeated rows are documents of their own; an empty table gives an empty result; other columns pass untouched, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink.session import durable

WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """From (source, source_size): adds weight and target. One row a source."""
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("source")
    filled = (weighted
              .withColumn("rest", F.sum("source_size").over(every) - epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
              .withColumn("share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("open", epochs * F.col("source_size") * F.col("share") >= F.col("rest") * F.col("weight"))
              .withColumn("first", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "rest", "share"))).over(every)))
    level = (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.share")
    capped = (epochs * F.col("source_size")).cast("double")
    return filled.select("source", "source_size", "weight", F.when(F.col("open"), F.least(level, capped)).otherwise(capped).alias("target"))


def _ranked(slots: DataFrame, keys: list[str], wanted: str) -> DataFrame:
    """Rows (keys, layer, range, key, id, slots) that hold the first ``wanted`` slots of their keys, in order of layer, key
    and id, with how many of their slots these are (got): ranges first, then inside the few ranges that matter."""
    w = Window.partitionBy(*keys).orderBy("layer", "range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (slots.groupBy(*keys, "layer", "range").agg(F.sum("slots").alias("range_slots"), F.first(wanted).alias("range_wanted"))
              .withColumn("before", F.coalesce(F.sum("range_slots").over(w), F.lit(0))).where("before < range_wanted"))
    ranges = ranges.select(*(F.col(k).alias(f"at_{k}") for k in [*keys, "layer", "range"]), "before")
    on = [F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in [*keys, "layer", "range"]]
    inside = Window.partitionBy(*keys, "layer", "range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("before") + F.coalesce(F.sum("slots").over(inside), F.lit(0))
    return slots.join(ranges, on).withColumn("got", F.greatest(F.lit(0), F.least(F.col("slots"), F.col(wanted) - earlier))).where("got > 0")


def _fill(hist: DataFrame, bounds: DataFrame) -> DataFrame:
    """source, size, take: how many more repetitions of each size close the gap, largest first."""
    sizes = hist.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "room")), asc=False).alias("sizes"))
    joined = sizes.join(bounds.select(F.col("source").alias("of"), "gap"), F.col("source").eqNullSafe(F.col("of")))
    folded = joined.withColumn("fold", F.expr("""
        aggregate(sizes, named_struct('gap', cast(floor(gap) as bigint), 'taken', array(named_struct('size', 0L, 'take', 0L))), (acc, x) ->
          if(x.size > acc.gap, acc, named_struct(
            'gap', acc.gap - least(x.room, acc.gap div x.size) * x.size,
            'taken', concat(acc.taken, array(named_struct('size', x.size, 'take', least(x.room, acc.gap div x.size)))))))"""))
    spent = "coalesce(aggregate(fold.taken, 0L, (n, y) -> if(y.size = x.size, n + y.take, n)), 0L)"
    left = folded.withColumn("least", F.expr(f"array_min(transform(filter(sizes, x -> x.room > {spent}), x -> x.size))"))
    # what is missing counts with the target's fraction
    rest = "(fold.gap + gap - floor(gap))"
    more = F.expr(f"if(least - {rest} < {rest}, concat(fold.taken, array(named_struct('size', least, 'take', 1L))), fold.taken)")
    return (left.select("source", F.explode(more).alias("x")).select("source", "x.size", "x.take").where("take > 0")
            .groupBy("source", "size").agg(F.sum("take").alias("take")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with mix_size, mix_source_size, mix_target and mix_copies (how often the
    mix takes it)."""
    text, name = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(name, F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))))
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    own = [F.col(source_col).cast("string").alias("source"), digest.alias("key"), name.alias("id"), size.alias("size")]
    classes = durable(docs.select(*own).groupBy("source", "key", "id", "size").agg(F.count("*").alias("n")).withColumn("range", F.substring("key", 1, 3)), "mix-classes")
    ranges = classes.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("range_size"))
    plan = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = durable(plan.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
              .selectExpr("source as at_source", "range as at_range", "range_start"))
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = plan.select(F.col("source").alias("of"), "part")
    placed = (classes.where("size > 0").withColumn("cum", F.sum(F.col("size") * F.col("n")).over(inside))
              .join(starts, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("range") == F.col("at_range")))
              .join(named, F.col("source").eqNullSafe(F.col("of")))
              .select("source", "key", "id", "size", "n", "range", (F.col("range_start") + F.col("cum")).alias("cum"), "part"))
    bounds = (placed.groupBy("source").agg(F.min(F.when(F.col("cum") > F.col("part"), F.struct("key", "id", "size", "n"))).alias("bound"), F.first("part").alias("part"),
                                           F.coalesce(F.max(F.when(F.col("cum") <= F.col("part"), F.col("cum"))), F.lit(0)).alias("have"))
              .withColumn("some", F.coalesce(F.least(F.col("bound.n") - 1, F.floor((F.col("part") - F.col("have")) / F.col("bound.size"))), F.lit(0)))
              .withColumn("gap", F.col("part") - F.col("have") - F.col("some") * F.coalesce("bound.size", F.lit(0))))
    bounds = durable(bounds, "mix-bounds")
    ends = plan.select(F.col("source").alias("of"), "whole").join(bounds.select(F.col("source").alias("of2"), "bound", "some"), F.col("of").eqNullSafe(F.col("of2"))).drop("of2")
    at, bound = F.struct("key", "id", "size"), F.struct("bound.key", "bound.id", "bound.size")
    first = F.when(F.col("bound").isNull() | (at < bound), F.col("n")).when(at == bound, F.col("some")).otherwise(0)
    open_ = (classes.where("size > 0").join(ends, F.col("source").eqNullSafe(F.col("of"))).withColumn("first", first.cast("long"))
             .where(f"whole < {epochs}").select("source", "key", "id", "size", "n", "range", "whole", "first"))
    hist = open_.groupBy("source", "size").agg(F.sum(F.expr(f"n - first + n * ({epochs} - whole - 1)")).cast("long").alias("room")).where("room > 0")
    takes = durable(_fill(hist, bounds), "mix-fill").selectExpr("source as take_source", "size as take_size", "take")
    slots = (open_.join(takes, F.col("source").eqNullSafe(F.col("take_source")) & (F.col("size") == F.col("take_size"))).drop("take_source", "take_size")
             .withColumn("layer", F.explode(F.expr(f"sequence(1, cast({epochs} - whole as int))")))
             .withColumn("slots", F.expr("if(layer = 1, n - first, n)")).where("slots > 0"))
    extra = _ranked(slots, ["source", "size"], "take").select("source", "key", "id", "size", "n", "first", "got")
    edge = bounds.where("some > 0").selectExpr("source", "bound.key", "bound.id", "bound.size", "bound.n", "some as first", "0L as got")
    special = durable(extra.unionByName(edge).groupBy("source", "key", "id", "size", "n").agg((F.max("first") + F.sum("got")).cast("long").alias("more"))
                      .select(F.col("source").alias("special_source"), F.col("key").alias("special_key"), F.col("size").alias("special_size"), F.col("n").alias("special_n"), "more"), "mix-special")
    full = durable(plan.join(bounds.selectExpr("source as bound_source", "bound"), F.col("source").eqNullSafe(F.col("bound_source")), "left")
                   .select(F.col("source").alias("plan_source"), "source_size", "target", "whole", "part", "bound"), "mix-plan")
    every = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *own)
    same = F.col("source").eqNullSafe(F.col("special_source")) & (F.col("key") == F.col("special_key")) & (F.col("size") == F.col("special_size"))
    joined = every.join(full, F.col("source").eqNullSafe(F.col("plan_source"))).join(special, same, "left")
    plain = F.col("whole") + F.when((F.col("part") > 0) & (F.col("bound").isNull() | (at < bound)), 1).otherwise(0)
    out = lambda copies: [F.col("row"), F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"),
                          F.col("target").alias("mix_target"), copies.cast("int").alias("mix_copies")]
    evenly = F.expr("whole + coalesce(more, 0) div special_n")
    copies = F.when(F.col("size") == 0, F.least(F.col("whole"), F.lit(1))).when(F.col("more").isNotNull(), evenly).otherwise(plain)
    split = F.coalesce(F.expr("more % special_n > 0"), F.lit(False))
    if special.where("more % special_n > 0").isEmpty():
        return joined.select(*out(copies))
    turn = F.row_number().over(Window.partitionBy("source", "key", "id", "size").orderBy("row"))
    numbered = joined.where(split).withColumn("turn", turn)
    return joined.where(~split).select(*out(copies)).unionByName(numbered.select(*out(evenly + F.expr("if(turn <= more % special_n, 1, 0)"))))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    return mix(docs, **options).where("mix_copies > 0").select("row", F.explode(F.sequence(F.lit(1), "mix_copies"))).select("row.*")


def op4_mixing_water_filling(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("row.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP4_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, row_number() OVER () AS num, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))) AS key
  FROM documents),
weighted AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS share
  FROM weighted
  WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest::DOUBLE AS rest, share FROM filled WHERE 3 * source_size * share >= rest * weight
  ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
plan AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size * share >= rest * weight
              THEN least((SELECT (filled.weight * l.rest) / l.share FROM level l), 3.0::DOUBLE * source_size)
              ELSE 3.0::DOUBLE * source_size END AS target
  FROM filled),
parts AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole,
         target - CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END * source_size AS part
  FROM plan),
placed AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.part,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size, s.num ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
begun AS (
  SELECT *, whole + CASE WHEN cum <= part THEN 1 ELSE 0 END AS copies,
         part - coalesce(max(CASE WHEN cum <= part THEN cum END) OVER (PARTITION BY source), 0) AS gap FROM placed WHERE size > 0),
slots AS (
  SELECT num, source, size, key, doc_id, gap, layer::BIGINT - whole::BIGINT AS layer FROM begun, range(1, 4) AS r(layer) WHERE layer > copies),
hist AS (
  SELECT source, size, count(*) AS room, any_value(gap) AS gap, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS step FROM slots GROUP BY source, size),
fill(source, step, size, take, rest) AS (
  SELECT source, 0, 0::BIGINT, 0::BIGINT, floor(max(gap))::BIGINT FROM hist GROUP BY source
  UNION ALL
  SELECT h.source, h.step, h.size, least(h.room, f.rest // h.size), f.rest - least(h.room, f.rest // h.size) * h.size
  FROM fill f JOIN hist h ON h.source IS NOT DISTINCT FROM f.source AND h.step = f.step + 1),
ended AS (
  SELECT f.*, h.room, min(CASE WHEN h.room > f.take THEN f.size END) OVER (PARTITION BY f.source) AS smallest,
         min(f.rest) OVER (PARTITION BY f.source) + h.gap - floor(h.gap) AS missing
  FROM fill f JOIN hist h ON h.source IS NOT DISTINCT FROM f.source AND h.step = f.step),
takes AS (
  SELECT source, size, take + CASE WHEN size = smallest AND smallest - missing < missing THEN 1 ELSE 0 END AS take FROM ended),
more AS (
  SELECT num, count(*) AS extra FROM (
    SELECT s.num, t.take, row_number() OVER (PARTITION BY s.source, s.size ORDER BY layer, key, doc_id, num) AS r
    FROM slots s JOIN takes t ON s.source IS NOT DISTINCT FROM t.source AND s.size = t.size) WHERE r <= take GROUP BY num)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(b.copies + coalesce(m.extra, 0), 0))::BIGINT AS taken
FROM placed p LEFT JOIN begun b USING (num) LEFT JOIN more m USING (num)
"""
