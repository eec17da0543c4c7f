"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Every source gets a target number of words: its weight's share of all words, at most ``limit`` times
its own, the excess dealt again by weight. A source's documents are dealt over shards of about
``shard_words`` by a seeded hash (so a source with a third of all rows is many shards). Blocks of
``block_words`` words are then apportioned to the shards by highest quotients target / (2 k + 1); the
divisor is found by a bracketing search over one-row aggregates, and only the quotients within the
bracket are ranked. A shard's quota is served from its documents in seeded order: as many whole passes
as it holds, then the leading blocks of one more.

Defined results: null texts have size 0; sources are ordered by code point, the null source last;
without any word all targets are 0; a document with a null id hashes as the empty text; rows that agree
in id, source and size are interchangeable; columns that are not named are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import WORD, stage

LIMIT, SHARD_WORDS, BLOCK_WORDS = 3, 1 << 17, 8


def numbered(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Add the row number in a total order without one task that sees all rows: range partitions, their
    counts (one row a partition) as offsets, and row numbers inside each."""
    keys = [F.expr(f"_k{i}") for i in range(len(order))]
    df = df.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    ranged = stage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), label)
    part = Window.partitionBy("_part")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    out = ranged.withColumn("_row", F.row_number().over(part.orderBy(*keys))).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_row")).cast("long")).drop(
        "_part", "_c", "_before", "_row", *[f"_k{i}" for i in range(len(order))])


def sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, size, h, deal)``: words, seeded order and seeded shard number of each document."""
    md5 = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("n"), md5.alias("m")).select(
        "doc_id", "source", F.coalesce("n", F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring("m", 1, 15), 16, 10).cast("long").alias("h"), F.conv(F.substring("m", 16, 8), 16, 10).cast("long").alias("deal"))


def targets(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(source, source_size, rank, weight, target)`` per source: weights 1, 2, 3, repeating."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = numbered(per, [F.col("source").isNull(), F.coalesce("source", F.lit(""))], "rank", "sources")
    per = stage(per.withColumn("weight", (F.col("rank") - 1) % 3 + 1), "weights")
    total = per.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    if not total[2] or not total[0]:
        return per.withColumn("target", F.lit(0.0))
    level, capped = total[0] / total[1], -1
    while True:  # each round only adds sources to those at their limit
        full = F.col("source_size") * limit < F.col("weight") * F.lit(level)
        got = per.agg(F.sum(F.when(full, 1).otherwise(0)), F.coalesce(F.sum(F.when(full, F.col("source_size") * limit)), F.lit(0)),
                      F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if got[0] == capped or not got[2]:
            break
        capped, level = got[0], (total[0] - got[1]) / got[2]
    return per.withColumn("target", F.least((F.col("source_size") * limit).cast("double"), F.col("weight") * F.lit(float(level))))


def apportion(units: DataFrame, seats: int, rank: list[Column], fan: int = 32, rounds: int = 12) -> DataFrame:
    """Add ``quota``: ``seats`` blocks dealt to the rows of ``units`` by highest quotients target / (2 k + 1),
    equal quotients by ``rank``."""
    total, n = units.agg(F.sum("target"), F.count("*")).first()
    if not seats or not total:
        return units.withColumn("quota", F.lit(0).cast("long"))

    def at(divisor: float) -> Column:
        return F.floor(F.col("target") / F.lit(float(divisor)) + 0.5)

    low, high = total / seats / 4, total / seats * 4
    for _ in range(rounds):  # seats(high) <= seats <= seats(low)
        grid = [low * (high / low) ** (i / fan) for i in range(fan + 1)]
        got = units.agg(*[F.sum(at(g)) for g in grid]).first()
        if got[0] < seats:
            low /= 16
        elif got[fan] > seats:
            high *= 16
        else:
            last = max(i for i in range(fan + 1) if got[i] >= seats)
            low, high = grid[last], grid[min(last + 1, fan)] if last < fan else grid[fan]
            if got[last] - got[min(last + 1, fan)] <= n or low == high:
                break
    base = F.greatest(at(high) - 1, F.lit(0)).cast("long")
    units = stage(units.withColumn("_base", base).withColumn("_top", (at(low) + 1).cast("long")), "units")
    left = seats - units.agg(F.sum("_base")).first()[0]
    open_ = units.select("*", F.explode(F.sequence("_base", "_top")).alias("_k"))
    open_ = numbered(open_.withColumn("_q", F.col("target") / (2 * F.col("_k") + 1)), [-F.col("_q"), *rank], "_place", "quotients")
    won = open_.groupBy("rank", "shard").agg(F.sum(F.when(F.col("_place") <= F.lit(left), 1).otherwise(0)).alias("_won"))
    return units.join(won, ["rank", "shard"]).withColumn("quota", F.col("_base") + F.col("_won")).drop("_base", "_top", "_won")


def mix(docs: DataFrame, limit: int = LIMIT, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``."""
    sized = stage(sizes(docs, seed), "sizes")
    per = stage(targets(sized, limit), "targets")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words)))
    known = per.withColumnRenamed("source", "_source").withColumn("_shards", shards)
    rows = stage(sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.col("deal") % F.col("_shards"))
                 .drop("_source", "_shards", "deal", "weight"), "dealt")
    units = rows.groupBy("rank", "shard").agg(F.sum("size").alias("_z"), F.first("source_size").alias("_s"), F.first("target").alias("_t"))
    units = stage(units.withColumn("target", F.when(F.col("_s") > 0, F.col("_t") * F.col("_z") / F.col("_s")).otherwise(0.0)).drop("_s", "_t"), "shards")
    words = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    quotas = apportion(units, words // block_words, [F.col("rank"), F.col("shard")]).select("rank", "shard", "_z", "quota")
    dealt = F.least(F.col("quota") * block_words, F.col("_z") * limit)
    order = Window.partitionBy("rank", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(quotas, ["rank", "shard"]).withColumn("_hi", F.sum("size").over(order)).withColumn("_dealt", dealt)
    passes = F.when(F.col("_z") > 0, F.floor(F.col("_dealt") / F.col("_z"))).otherwise(0)
    rest = F.col("_dealt") - F.col("_passes") * F.col("_z")
    more = F.greatest(F.lit(0), F.least(F.col("_hi"), rest) - (F.col("_hi") - F.col("size")))
    return out.withColumn("_passes", passes).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_passes") * F.col("size") + more).cast("long").alias("taken"))


def materialise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix has them: every row as often as its words are taken, to the nearest whole number (a
    document without words once). Columns as they were."""
    got = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("_taken"))
    got = got.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_taken")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    times = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(1).cast("int")
    return docs.join(got, same).withColumn("_n", F.explode(F.sequence(F.lit(0), times))).where("_n > 0").select(*docs.columns)


#: the same rows for DuckDB, straight from the definition: every quotient is listed and ranked
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS m
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source),
weighted AS (SELECT *, (rank - 1) % 3 + 1 AS weight FROM per),
levels AS (
  SELECT *, 3 * source_size / weight AS ratio,
         ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
           / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighted WINDOW before AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, rank, least((3 * source_size)::DOUBLE, weight * (SELECT min_by(level, (ratio, rank)) FROM levels WHERE level <= ratio)) AS target
  FROM levels),
rows_ AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank, ('0x' || substr(m, 1, 15))::BIGINT AS h,
         ('0x' || substr(m, 16, 8))::BIGINT % greatest(1, ceil(t.source_size / 131072.0)::BIGINT) AS shard
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
units AS (
  SELECT rank, shard, sum(size)::BIGINT AS z, any_value(target) * sum(size)::BIGINT / any_value(source_size) AS unit FROM rows_ GROUP BY rank, shard),
quotients AS (
  SELECT rank, shard, unit / (2 * k + 1) AS q, k FROM (SELECT *, unnest(range(0, (3 * z) // 8 + 2)) AS k FROM units)),
won AS (
  SELECT rank, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (ORDER BY q DESC, rank, shard) AS place FROM quotients) WHERE place <= (SELECT sum(size) // 8 FROM sized) GROUP BY rank, shard),
dealt AS (
  SELECT u.rank, u.shard, u.z, least(coalesce(quota, 0) * 8, 3 * z)::BIGINT AS dealt FROM units u LEFT JOIN won USING (rank, shard)),
run AS (
  SELECT r.*, z, dealt, CASE WHEN z > 0 THEN dealt // z ELSE 0 END AS passes,
         sum(size) OVER (PARTITION BY rank, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS hi
  FROM rows_ r JOIN dealt USING (rank, shard))
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(hi, dealt - passes * z) - (hi - size)))::BIGINT AS taken
FROM run
"""
