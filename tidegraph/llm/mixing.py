"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get word targets by weight, held to ``max_repeats`` times their own size with the
excess reshared. Equal blocks of B words are dealt to sources by highest quotients
target / (2k + 1), then to each source's shards by quotients blocks / (2k + 1), which gives an
integer quota per shard. A shard reads its documents in a seeded order as one stream and takes
its quota of blocks from it: all of them as often as they fit, and a systematic selection with
a seeded start for the rest. A document's share of the taken blocks has a closed form, so
blocks are never listed and no document is moved. DataFrame functions only.

Scale: texts are read once, for their sizes. The one shuffle of documents carries (id, source,
size) by (source, shard). Documents go to shards by a hash of id and text, so a source with a third of all rows, or
as many rows without an id, are spread over every shard. A shard holds about ``docs_per_shard`` documents of all
sources together, more where there would be over ``most_shards``. Windows over sources see one row a source, those
over shards at most ``most_shards`` rows a source.

Defined cases. Null or wordless texts have size 0 and take 0. A null source is a source of its
own and sorts last; the empty one sorts first. Repeated rows each take part, next to one another. Null ids count as empty
ones. Very long texts are one document like any other. An empty table gives no rows. Columns of the table are kept out of the way:
only doc_id, text and source are read. B is the smallest positive target over
``blocks_per_source``, between 1 and ``max_block`` words, so each source can come near its
target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidegraph.llm.common import WORD
from tidegraph.storage import materialize, settled

SEED = 20


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def highest_quotients(parties: DataFrame, keys: list[str], votes: str, share: str, seats: str, limit: str, order: list) -> DataFrame:
    """``parties`` (one row each, ``keys`` the district) with ``won``: Sainte-Lague seats out of ``seats``.

    share: the exact proportional number of seats; limit: most a party can hold. Rounding every
    share is at most half a seat off for each party, so at most that many seats change hands, and
    only the quotients around each rounded share (some five a party in all) are listed and ranked.
    """
    district = W.partitionBy(*keys)
    spread = F.floor(F.count(F.lit(1)).over(district) * F.coalesce(F.col(share) / F.nullif(F.col(seats), F.lit(0)), F.lit(0.0)) / 2).cast("long") + 2
    near = F.least(F.floor(F.col(share) + 0.5).cast("long"), F.col(limit))
    placed = parties.withColumn("base", F.greatest(F.lit(0).cast("long"), near - spread)).withColumn("open", F.greatest(F.lit(0).cast("long"), F.least(F.col(limit), near + spread) - F.col("base")))
    placed = placed.withColumn("left", F.col(seats) - F.sum("base").over(district))
    dealt = placed.withColumn("k", F.explode_outer(F.when(F.col("open") > 0, F.sequence(F.lit(0).cast("long"), F.col("open") - 1))))
    quotient = F.when(F.col("k").isNotNull(), F.col(votes).cast("double") / (2 * (F.col("base") + F.col("k")) + 1))
    ranked = dealt.withColumn("ranked", F.row_number().over(district.orderBy(quotient.desc_nulls_last(), *order, F.col("k"))))
    got = F.coalesce((F.col("k").isNotNull() & (F.col("ranked") <= F.col("left"))).cast("long"), F.lit(0))
    kept = [c for c in parties.columns]
    return ranked.withColumn("got", got).groupBy(*kept).agg((F.first("base") + F.sum("got")).alias("won"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with rank, weight, target and total.

    The level every uncapped source shares is the largest of (words left) / (weight left) over
    prefixes of sources by cap over weight: capping a source raises it just while the source is above its cap.
    """
    every = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    out = sizes.withColumn("rank", rank.cast("long")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    out = out.withColumn("total", F.sum("source_size").over(every))
    before = W.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    words = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weighs = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = out.withColumn("level", words.cast("double") / weighs)
    out = out.withColumn("level", F.max("level").over(every))
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))


@settled
def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = SEED, docs_per_shard: int = 2048, most_shards: int = 1 << 16, blocks_per_source: int = 200, max_block: int = 2048, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, shard) and the narrow columns ``carry`` for every row of ``docs``; see the module."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    read = materialize(docs.select("doc_id", "source", n_words("text").alias("size"), digest.alias("place"), *carry))
    shards = F.lit(max(1, min(most_shards, -(-read.count() // docs_per_shard)))).cast("long")
    rows = read.withColumn("shard", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), shards))

    by_shard = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    sizes = by_shard.groupBy("source").agg(F.sum("words").alias("source_size"))
    every = W.partitionBy()
    src = targets(sizes, weights, max_repeats)
    src = src.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / blocks_per_source))).cast("long"))
    src = src.withColumn("seats", F.floor(F.col("total") / F.col("block") + 0.5).cast("long"))
    src = src.withColumn("share", F.coalesce(F.col("target") * F.col("seats") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))
    src = src.withColumn("most", F.ceil(F.col("source_size") / F.col("block")).cast("long") * max_repeats)
    src = highest_quotients(src, [], "target", "share", "seats", "most", [F.col("rank")])
    src = materialize(src.select(F.col("source").alias("of_source"), "source_size", "target", "block", F.col("won").alias("quota")))

    along = W.partitionBy("source").orderBy("shard")
    s = by_shard.join(src, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    s = s.withColumn("end", F.sum("words").over(along)).withColumn("start", F.col("end") - F.col("words"))
    s = s.withColumn("first", F.ceil(F.col("start") / F.col("block")).cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("end") / F.col("block")).cast("long") - F.col("first"))
    whole = F.sum("blocks").over(W.partitionBy("source"))
    s = s.withColumn("share", F.coalesce(F.col("blocks").cast("double") * F.col("quota") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
    s = materialize(s.withColumn("most", F.col("blocks") * max_repeats))
    s = materialize(highest_quotients(s, ["source"], "blocks", "share", "quota", "most", [F.col("shard")]))
    s = s.withColumn("n", F.greatest(F.col("blocks"), F.lit(1)))
    s = s.withColumn("times", F.floor(F.col("won") / F.col("n")).cast("long")).withColumn("extra", F.pmod("won", "n"))
    s = s.withColumn("turn", F.pmod(F.col("first") * 7919 + F.col("shard") * 104729 + F.lit(seed), F.col("n")))
    last = F.when(F.col("blocks") > 0, F.col("times") + _chosen(F.col("blocks")) - _chosen(F.col("blocks") - 1))
    # The block that runs into a shard from the one before it is taken as often as it was there.
    s = s.withColumn("carried", F.coalesce(F.last(last, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = materialize(s.select(F.col("source").alias("of_source"), F.col("shard").alias("of_shard"), "source_size", "target", "block", "start", "end", "first", "n", "times", "extra", "turn", "carried"))

    in_shard = W.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = rows.withColumn("upto", F.sum("size").over(in_shard))
    d = d.join(s, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard")))
    upto = F.col("start") + F.col("upto")
    taken = _taken_until(upto) - _taken_until(upto - F.col("size"))
    return d.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "shard", *carry)


def _chosen(k):
    """How many of a shard's first k blocks the seeded systematic selection takes once more."""
    return F.floor((k + F.col("turn")) * F.col("extra") / F.col("n")).cast("long") - F.floor(F.col("turn") * F.col("extra") / F.col("n")).cast("long")


def _taken_until(at):
    """Words taken from the shard's start to position ``at`` of its source."""
    head = F.least(F.col("first") * F.col("block"), F.col("end"))
    past = F.greatest(at - F.col("first") * F.col("block"), F.lit(0).cast("long"))
    full = F.floor(past / F.col("block")).cast("long")
    return (
        F.col("carried") * (F.least(at, head) - F.col("start"))
        + F.col("times") * past + _chosen(full) * F.col("block") + (past - full * F.col("block")) * (_chosen(full + 1) - _chosen(full))
    )


def op1_mix_sources(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The mix of a relation ``{docs}`` (doc_id, text, source), as rows (doc_id, size, source_size, target, taken, ...).
MIX_SQL = """
rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS place,
         CAST(least(65536, greatest(1, ceil((SELECT count(*) FROM {docs}) / 2048.0))) AS BIGINT) AS shards
  FROM {docs}
), rows1 AS (
  SELECT *, CAST('0x' || substr(place, 1, 8) AS BIGINT) % shards AS shard FROM rows_
), by_shard AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS words FROM rows1 GROUP BY source, shard
), sizes AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM by_shard GROUP BY source
), t1 AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sizes
), t2 AS (SELECT *, rank % 3 + 1 AS weight FROM t1
), t3 AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM t2 WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t4 AS (
  SELECT source, source_size, rank, total, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target FROM t3
), t5 AS (
  SELECT *, CAST(greatest(1, least(2048, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 200))) AS BIGINT) AS block FROM t4
), t6 AS (
  SELECT *, CAST(floor(CAST(total AS DOUBLE) / block + 0.5) AS BIGINT) AS seats,
         3 * CAST(ceil(CAST(source_size AS DOUBLE) / block) AS BIGINT) AS most, count(*) OVER () AS parties FROM t5
), t7 AS (SELECT *, coalesce(target * seats / nullif(total, 0), 0) AS share FROM t6
), t8 AS (
  SELECT *, least(CAST(floor(share + 0.5) AS BIGINT), most) AS near,
         CAST(floor(parties * coalesce(share / nullif(seats, 0), 0) / 2) AS BIGINT) + 2 AS spread FROM t7
), t9 AS (
  SELECT *, greatest(0, near - spread) AS base FROM t8
), ta AS (
  SELECT *, seats - sum(base) OVER () AS remaining, greatest(0, least(most, near + spread) - base) AS open FROM t9
), tb AS (
  SELECT source, unnest(range(open)) AS k, target, base, rank, remaining FROM ta
), tc AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * (base + k) + 1) DESC, rank, k) AS place, remaining FROM tb
), td AS (
  SELECT source, count(*) AS got FROM tc WHERE place <= remaining GROUP BY source
), src AS (
  SELECT ta.source, source_size, target, block, CAST(base + coalesce(got, 0) AS BIGINT) AS quota
  FROM ta LEFT JOIN td ON ta.source IS NOT DISTINCT FROM td.source
), s1 AS (
  SELECT b.source, b.shard, b.words, source_size, target, block, quota,
         CAST(sum(words) OVER (PARTITION BY b.source ORDER BY shard) AS BIGINT) AS finish
  FROM by_shard b JOIN src ON b.source IS NOT DISTINCT FROM src.source
), s2 AS (
  SELECT *, finish - words AS start, CAST(ceil(CAST(finish - words AS DOUBLE) / block) AS BIGINT) AS first,
         CAST(ceil(CAST(finish AS DOUBLE) / block) AS BIGINT) - CAST(ceil(CAST(finish - words AS DOUBLE) / block) AS BIGINT) AS blocks FROM s1
), s3 AS (
  SELECT *, coalesce(CAST(blocks AS DOUBLE) * quota / nullif(sum(blocks) OVER (PARTITION BY source), 0), 0) AS share,
         count(*) OVER (PARTITION BY source) AS parties, 3 * blocks AS most FROM s2
), s4 AS (
  SELECT *, least(CAST(floor(share + 0.5) AS BIGINT), most) AS near,
         CAST(floor(parties * coalesce(share / nullif(quota, 0), 0) / 2) AS BIGINT) + 2 AS spread FROM s3
), s5 AS (SELECT *, greatest(0, near - spread) AS base FROM s4
), s6 AS (
  SELECT *, quota - sum(base) OVER (PARTITION BY source) AS remaining, greatest(0, least(most, near + spread) - base) AS open FROM s5
), s7 AS (
  SELECT source, shard, unnest(range(open)) AS k, blocks, base, remaining FROM s6
), s8 AS (
  SELECT source, shard, remaining,
         row_number() OVER (PARTITION BY source ORDER BY CAST(blocks AS DOUBLE) / (2 * (base + k) + 1) DESC, shard, k) AS place FROM s7
), s9 AS (
  SELECT source, shard, count(*) AS got FROM s8 WHERE place <= remaining GROUP BY source, shard
), sa AS (
  SELECT s6.*, CAST(base + coalesce(got, 0) AS BIGINT) AS won, greatest(blocks, 1) AS n
  FROM s6 LEFT JOIN s9 ON s6.source IS NOT DISTINCT FROM s9.source AND s6.shard = s9.shard
), sb AS (
  SELECT *, won // n AS times, won % n AS extra, (first * 7919 + shard * 104729 + 20) % n AS turn FROM sa
), sc AS (
  SELECT *, coalesce(last_value(CASE WHEN blocks > 0 THEN times + ((blocks + turn) * extra) // n - ((blocks - 1 + turn) * extra) // n END IGNORE NULLS)
            OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS carried FROM sb
), d1 AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM rows1
), d2 AS (
  SELECT d1.doc_id, d1.source, d1.size, sc.* EXCLUDE (source, shard), sc.start + upto AS b, sc.start + upto - d1.size AS a,
         least(first * block, finish) AS head FROM d1 JOIN sc ON d1.source IS NOT DISTINCT FROM sc.source AND d1.shard = sc.shard
), d3 AS (
  SELECT *, greatest(a - first * block, 0) AS pa, greatest(b - first * block, 0) AS pb FROM d2
), mixed AS (
  SELECT doc_id, size, source_size, target, CAST(
      carried * (least(b, head) - least(a, head)) + times * (pb - pa)
    + (((pb // block + turn) * extra) // n - ((pa // block + turn) * extra) // n) * block
    + (pb % block) * (((pb // block + 1 + turn) * extra) // n - ((pb // block + turn) * extra) // n)
    - (pa % block) * (((pa // block + 1 + turn) * extra) // n - ((pa // block + turn) * extra) // n) AS BIGINT) AS taken, source
  FROM d3
)
"""
ORACLE = "WITH " + MIX_SQL.replace("{docs}", "documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed"
