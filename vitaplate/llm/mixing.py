"""Mixing sources to target weights: a time-varying curriculum.

Every source has a weight schedule over the training run, ``w(t) = w (1 + a (2t - 1))``
for t from 0 to 1, whose integral is its weight ``w``.  The share of its demand
that is met by time t is the integral's share ``F(t) = (1 - a) t + a t^2``.  A
source's documents stand in a fixed shuffled order; the one that begins after c
of its words is trained at the time where its demand reaches c, ``t = F^-1(c / target)``.
Sources whose target exceeds their words go round again.  All documents are then
sorted by that position, by range partitioning.

Running sums never gather a source in one task: the shuffled order is cut into
slices by hash, slices are summed first, and a slice starts at the sum of those
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaplate.llm import common as C

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix for each word of the corpus.
TOTAL = 1.5
#: A source gives at most so many times its words.
MOST = 2.0
#: Slopes of the schedules, repeating like the weights: a source fades in (1) or out (-1).
SLOPES = (-0.5, 0.0, 0.5)
#: Hexadecimal digits of the order key that make a slice: 16^3 slices of each source.
SLICE_DIGITS = 3


def source_targets(sources: DataFrame, total: float = TOTAL, most: float = MOST, weights=WEIGHTS, slopes=SLOPES) -> DataFrame:
    """(source, source_size) to targets: shares by weight, none above ``most`` times its size.

    Sources take the weights in code point order, null last.  The excess of
    sources above their cap is reshared by weight until none is above: sources
    are capped in ascending order of cap over weight, as long as the level that
    the rest would share exceeds that ratio.  One row per source, so these
    windows see no more rows than there are sources.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i % len(values) + 1).cast("int"))
    ranked = sources.withColumn("i", F.row_number().over(place) - 1)
    ranked = ranked.withColumns({"weight": pick(weights, F.col("i")), "slope": pick(slopes, F.col("i")), "cap": F.lit(float(most)) * F.col("source_size")})
    everything = Window.partitionBy()
    ranked = ranked.withColumns({"mix": F.lit(float(total)) * F.sum("source_size").over(everything), "ratio": F.col("cap") / F.col("weight")})
    before = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level)
    # the first source whose cap is not reached sets the level for all after it
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(everything)
    target = F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("free.level")))
    return levels.withColumn("free", free).select("source", "source_size", F.coalesce(target, F.col("cap")).alias("target"), "weight", "slope")


def _position(c, target, slope):
    """F^-1(c / target): where the demand of a schedule reaches c words."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(c, target)))
    b = F.lit(1.0) - slope
    root = F.try_divide(F.sqrt(b * b + F.lit(4.0) * slope * u) - b, F.lit(2.0) * slope)
    return F.when(target <= 0, F.lit(None).cast("double")).when(slope == 0, u).otherwise(F.least(F.lit(1.0), root))


def curriculum(docs: DataFrame, text_col: str = "text", sort: bool = True, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_position), sorted by position.

    ``size`` counts words (null text: 0).  ``taken``: a source with target T over
    size S gives each document floor(T / S) times, and once more in part or whole
    to the documents that begin before the rest of its target in the shuffled
    order, so a source's sum is its target to within a word and no document
    passes 2 times its size.  ``first_position``: where training meets the document first, null if
    nothing is taken.  The order is that of md5(doc_id), then doc_id, so reruns
    agree; a null id counts as the empty text, and rows of equal id and size stay
    rows of their own (with equal ids they share one order, by size).  Documents
    without words take nothing.  Other columns are left out.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = docs.select(F.col("doc_id"), F.col("source"), size.alias("size"))
    sized = sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sized = C.materialise(sized.withColumn("slice", F.substring("key", 1, SLICE_DIGITS)), "sizes")

    slices = C.materialise(sized.groupBy("source", "slice").agg(F.sum("size").alias("words")), "slices")
    targets = C.materialise(source_targets(slices.groupBy("source").agg(F.sum("words").alias("source_size")), **options), "targets")
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    t = targets.withColumnRenamed("source", "of")
    offsets = offsets.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of", "words")

    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    o = offsets.withColumnsRenamed({"source": "of", "slice": "at"})
    placed = placed.join(o, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    begin = F.col("offset") + F.col("within")
    whole = F.floor(F.try_divide("target", "source_size"))
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    again = F.greatest(F.lit(0), F.least(F.col("size"), rest - begin))
    taken = F.when(F.col("source_size") > 0, whole * F.col("size") + again).otherwise(F.lit(0)).cast("long")
    done = placed.withColumn("taken", taken)
    first = F.when(F.col("taken") > 0, _position(begin.cast("double"), F.col("target"), F.col("slope")))
    done = done.select("doc_id", "source", "size", "source_size", "target", "taken", first.alias("first_position"))
    if not sort:
        return done
    return C.materialise(done, "mix").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as key
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as i from sources),
weighed as (
  select *, [3.0, 1.0, 2.0][i % 3 + 1]::double as weight, [-0.5, 0.0, 0.5][i % 3 + 1]::double as slope,
         2.0::double * source_size as cap, 1.5::double * (sum(source_size) over ())::double as mix
  from ranked),
ratios as (select *, cap / weight as ratio from weighed),
levels as (
  select *, (mix - coalesce(sum(cap) over (order by ratio, i rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by ratio, i rows between current row and unbounded following) as level
  from ratios),
targets as (
  select source, source_size, slope,
         coalesce(case when level > ratio then cap
              else least(cap, weight * (select l.level from levels l where l.level <= l.ratio order by l.ratio, l.i limit 1)) end, cap) as target
  from levels),
placed as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, t.slope,
         coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as begin_at
  from sized s join targets t on s.source is not distinct from t.source),
given as (
  select *, case when source_size > 0 then (floor(target / source_size) * size
            + greatest(0, least(size, round(target - floor(target / source_size) * source_size)::bigint - begin_at)))::bigint else 0 end as taken
  from placed),
timed as (select *, greatest(0.0::double, least(1.0::double, begin_at::double / target)) as u, 1.0::double - slope as b from given)
select doc_id, size, source_size, target, taken,
       case when taken > 0 then case when slope = 0 then u else least(1.0::double, (sqrt(b * b + 4.0::double * slope * u) - b) / (2.0::double * slope)) end end as first_position
from timed
"""


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns; a part counts as a whole.

    Rows of equal id come as often as the one that is taken most.
    """
    often = curriculum(docs, sort=False).where("taken > 0").select(F.col("doc_id").alias("of"), F.ceil(F.try_divide("taken", "size")).cast("int").alias("often"))
    often = often.groupBy("of").agg(F.max("often").alias("often"))
    met = docs.join(often, F.col("doc_id").eqNullSafe(F.col("of")))
    return met.withColumn("often", F.explode(F.sequence(F.lit(1), F.col("often")))).select(*[docs[c] for c in docs.columns])
