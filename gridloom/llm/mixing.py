"""Operator 5, mixing sources to target weights by Sainte-Lague apportionment.

A document's size is its number of words. Sources in code point order, null last, get the weights in
turn; together they are to give `share` of all words, in proportion to the weights, but none more
than `repeat` times its size: what it can't give is dealt again by weight (water filling, solved by
one sort of the sources). The targets are then apportioned in blocks of equal words: the highest
quotients target / (2k + 1) get the blocks, first among sources, then, with a source's blocks as
seats and the shards' words as votes, among its shards. Within a shard documents stand in seeded
order as one stream of words; a quota of q blocks over n takes the whole stream q div n times, and
q mod n blocks from a seeded start on, around the end. So whole documents are taken but for those
at the two ends. Arithmetic on the running sum of words gives each document's share: no block is
ever a row.

Shards of a source follow its size (shard_words), at most max_shards; a shard is a hash bucket of
documents, so one source with a third of all rows is spread over many. Only per-source and per-shard
sums meet in one window.

Null text: size 0, nothing taken. Null source: a source of its own, after all others. Null doc_id: documents like any
other, told apart and dealt by a hash of their text. Repeated rows are documents of their own; rows alike in doc_id (or, without one, in text)
share a shard. Ties: equal quotients go to the source, or shard, that comes first in its order; documents with equal keys stand by doc_id, size and text. Very long texts: one document's words may be cut anywhere. An empty table gives an empty result. mix() ignores
columns besides doc_id, text and source; mixed() keeps all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, read, stored

WEIGHTS, SHARE, REPEAT, BLOCK, SHARD_WORDS, MAX_SHARDS, SEED = (5, 2, 1), 1.5, 2, 8, 1 << 18, 1 << 16, "mix"


def _bucket(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 12), 16, 10).cast("bigint")


def sizes(documents: DataFrame, *more: Column) -> DataFrame:
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    return documents.select("doc_id", "source", ident.alias("ident"), *more, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_no, source_size, target, total): one row a source."""
    every, ranked = Window.partitionBy(), Window.orderBy("source_null", "source")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_null", F.col("source").isNull())
    s = s.withColumn("source_no", F.row_number().over(ranked) - 1)
    s = s.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("source_no", F.lit(len(weights)))))
    s = s.withColumn("cap", F.col("source_size") * float(repeat)).withColumn("total", F.sum("source_size").over(every) * share)
    # Sources fill up in order of cap / weight; level is what a unit of weight gets if this one and all after it aren't full.
    before = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "source_no").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("fill", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(every)["level"])
    return s.select("source", "source_no", "source_size", F.least("cap", F.coalesce(F.col("fill") * F.col("weight"), F.col("cap"))).alias("target"), "total")


def apportion(units: DataFrame, group: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """units with column quota: each group's seats by highest quotients votes / (2k + 1), ties to the smaller order.

    Every unit surely has the seats below `sure` and surely none from `most` on (the quotients' common
    divisor lies within half a seat a unit of votes / seats), so only those between compete."""
    all_of = Window.partitionBy(*group)
    u = units.withColumn("_votes", F.sum(votes).over(all_of)).withColumn("_n", F.count("*").over(all_of))
    part = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0)
    u = u.withColumn("_sure", F.greatest(F.lit(0), F.ceil(part * (F.col(seats) - F.col("_n") / 2) - 0.5) - 1).cast("bigint"))
    u = u.withColumn("_most", F.greatest("_sure", F.floor(part * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1).cast("bigint"))
    u = u.withColumn("_open", F.col(seats) - F.sum("_sure").over(all_of))
    q = u.withColumn("_k", F.explode(F.sequence("_sure", "_most"))).withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    q = q.withColumn("_place", F.row_number().over(all_of.orderBy(F.desc("_q"), order, "_k")))
    won = F.sum(F.when((F.col("_place") <= F.col("_open")) & (F.col("_q") > 0), 1).otherwise(0))
    keep = [F.first(F.col(c)).alias(c) for c in units.columns if c not in (*group, order)]
    return q.groupBy(*group, order).agg(*keep, (F.first("_sure") + won).cast("bigint").alias("quota"))


def mix(documents: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS, carry: Column | None = None, repeat: int = REPEAT, **shape) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, whole, ranges): whole copies, and the word ranges [a, b) of one more.

    With carry, each row also has this value of its document, as column _d."""
    sized = stored(sizes(documents), "mix-sizes")
    t = targets(sized, repeat=repeat, **shape).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint"))
    t = t.withColumn("all", F.lit(0)).withColumn("shards", F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_words) + 1).cast("int"))
    t = stored(apportion(t, ["all"], "target", "seats", "source_no").drop("all", "seats").withColumnRenamed("quota", "seats"), "mix-sources")
    # One row a source; a source is a label, so this is small, and Spark broadcasts it by its measured size.
    def dealt(rows: DataFrame) -> DataFrame:
        d = rows.join(t, rows["source"].eqNullSafe(t["source"])).drop(t["source"])
        return d.withColumn("key", F.md5(F.concat_ws(":", F.lit(SEED), F.col("ident")))).withColumn("shard", F.pmod(_bucket(F.col("ident")), F.col("shards")).cast("int"))

    d = dealt(sized if carry is None else sizes(documents, carry.alias("_d"), F.xxhash64("text").alias("tag")))
    units = dealt(sized).groupBy("source_no", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats"))
    units = apportion(units, ["source_no"], "words", "seats", "shard")
    units = units.withColumn("blocks", F.ceil(F.col("words") / block).cast("bigint")).withColumn("quota", F.least("quota", repeat * F.col("blocks")))
    units = units.withColumn("passes", F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0)).withColumn("extra", F.col("quota") - F.col("passes") * F.col("blocks"))
    units = units.withColumn("start", F.when(F.col("blocks") > 0, F.pmod(_bucket(F.col("source_no").cast("string"), F.col("shard").cast("string")), F.col("blocks"))).otherwise(0))
    units = units.select("source_no", "shard", "passes", F.least(F.col("start") * block, "words").alias("a1"), F.least((F.col("start") + F.col("extra")) * block, "words").alias("b1"), F.greatest((F.col("start") + F.col("extra") - F.col("blocks")) * block, F.lit(0)).alias("b2"))
    end = Window.partitionBy("source_no", "shard").orderBy("key", "doc_id", "size", *(["tag"] if carry is not None else []))
    d = d.withColumn("upto", F.sum("size").over(end.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("upto") - F.col("size"))
    d = d.join(stored(units, "mix-shards"), ["source_no", "shard"])
    cut = lambda a, b: F.struct((F.greatest(a, "from") - F.col("from")).alias("a"), (F.least(b, "upto") - F.col("from")).alias("b"))
    ranges = F.filter(F.array(cut(F.lit(0), F.col("b2")), cut(F.col("a1"), F.col("b1"))), lambda r: r["a"] < r["b"])
    d = d.withColumn("ranges", ranges).withColumn("taken", F.col("passes") * F.col("size") + F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["b"] - r["a"]))
    return d.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"), F.col("passes").cast("int").alias("whole"), "ranges", *(["_d"] if carry is not None else []))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each whole copy taken, and one with the words of a part; documents not taken are gone."""
    names = documents.columns
    # Each document goes through the mix with its columns: repeated and null ids couldn't be joined back to their rows.
    j = mix(documents, carry=F.struct(*(F.col(f"`{c}`") for c in names)), **options).where("taken > 0").select("_d", "size", "whole", "ranges")
    full = F.array_repeat(F.lit(None).cast("array<struct<a:bigint,b:bigint>>"), F.col("whole"))
    part = F.when(F.size("ranges") > 0, F.array("ranges")).otherwise(F.expr("array()").cast("array<array<struct<a:bigint,b:bigint>>>"))
    j = j.withColumn("_take", F.explode(F.concat(full, part)))
    words = F.regexp_extract_all("_d.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    chosen = F.array_join(F.flatten(F.transform("_take", lambda r: F.slice(words, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")))), "")
    text = F.when(F.col("_take").isNull() | (F.expr("_take[0].b - _take[0].a") == F.col("size")), F.col("_d.text")).otherwise(chosen)
    out = j.select(*((text if c == "text" else F.col(f"_d.`{c}`")).alias(c) for c in names))
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def _apportioned(name: str, units: str, group: str, votes: str, seats: str, order: str, keep: str) -> str:
    """SQL of apportion()."""
    return f"""
{name}_u AS (SELECT *, sum({votes}) OVER w AS vs, count(*) OVER w AS un FROM {units} WINDOW w AS (PARTITION BY {group})),
{name}_p AS (SELECT *, CASE WHEN vs > 0 THEN CAST({votes} AS DOUBLE) / CAST(vs AS DOUBLE) ELSE 0 END AS part FROM {name}_u),
{name}_s AS (SELECT *, CAST(greatest(0, ceil(part * ({seats} - CAST(un AS DOUBLE) / 2) - 0.5) - 1) AS BIGINT) AS sure FROM {name}_p),
{name}_m AS (SELECT *, CAST(greatest(sure, floor(part * ({seats} + CAST(un AS DOUBLE) / 2) + 0.5) + 1) AS BIGINT) AS most,
             {seats} - sum(sure) OVER (PARTITION BY {group}) AS free FROM {name}_s),
{name}_k AS (SELECT *, unnest(generate_series(sure, most)) AS k FROM {name}_m),
{name}_q AS (SELECT *, CAST({votes} AS DOUBLE) / (2 * k + 1) AS q FROM {name}_k),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY q DESC, {order}, k) AS place FROM {name}_q),
{name} AS (SELECT {keep}, CAST(any_value(sure) + count(*) FILTER (place <= free AND q > 0) AS BIGINT) AS quota FROM {name}_r GROUP BY ALL)"""


_HASH = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"
SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS ident, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s0),
s2 AS (SELECT *, CASE source_no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS ratio FROM s2),
s4 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY ratio, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3),
fill AS (SELECT level AS f FROM s4 WHERE level <= ratio ORDER BY ratio, source_no LIMIT 1),
t0 AS (SELECT source, source_no, source_size, least(cap, coalesce((SELECT f FROM fill) * weight, cap)) AS target FROM s4),
t1 AS (SELECT *, 0 AS one, CAST(round(sum(target) OVER () / {BLOCK}) AS BIGINT) AS blocks_all,
       CAST(least({MAX_SHARDS}, ceil(source_size / {SHARD_WORDS}.0) + 1) AS INTEGER) AS shards FROM t0),
{_apportioned("t", "t1", "one", "target", "blocks_all", "source_no", "source, source_no, source_size, target, shards")},
d0 AS (SELECT sized.*, t.source_no, source_size, target, quota AS seats, md5(concat_ws(':', '{SEED}', ident)) AS key,
       {_HASH.format(f"concat_ws(':', '{SEED}', ident)")} % shards AS shard FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
u0 AS (SELECT source_no, shard, CAST(sum(size) AS BIGINT) AS words, any_value(seats) AS seats FROM d0 GROUP BY ALL),
{_apportioned("u1", "u0", "source_no", "words", "seats", "shard", "source_no, shard, words")},
u2 AS (SELECT *, CAST(ceil(words / {BLOCK}.0) AS BIGINT) AS blocks FROM u1),
u3 AS (SELECT * REPLACE (least(quota, {REPEAT} * blocks) AS quota) FROM u2),
u4 AS (SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS passes FROM u3),
u5 AS (SELECT *, quota - passes * blocks AS extra, CASE WHEN blocks > 0 THEN {_HASH.format(f"concat_ws(':', '{SEED}', CAST(source_no AS VARCHAR), CAST(shard AS VARCHAR))")} % blocks ELSE 0 END AS start FROM u4),
u6 AS (SELECT source_no, shard, passes, least(start * {BLOCK}, words) AS a1, least((start + extra) * {BLOCK}, words) AS b1, greatest((start + extra - blocks) * {BLOCK}, 0) AS b2 FROM u5),
d1 AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source_no, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM d0)
SELECT doc_id, size, source_size, target,
       CAST(passes * size + greatest(0, least(b1, upto) - greatest(a1, upto - size)) + greatest(0, least(b2, upto) - (upto - size)) AS BIGINT) AS taken
FROM d1 JOIN u6 USING (source_no, shard)
"""
