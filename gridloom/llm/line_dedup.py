"""Operator 6, line dedup (DataFrame functions only).

A line's key is the line without SPACES at its ends, A-Z lower-cased; keys of at least min_chars
code points count. Of a key that at least two documents hold, all lines go but those in the
document with the smallest doc_id. Keys travel as two 64-bit hashes. They are dealt out by range of
(key, split) and sorted within it by document and position, and one pass over that order streams
first occurrences: a line goes if the first of its run is another document. Almost every key has
the one split 0, so that pass settles it. A key that a sample of the lines shows to be hot (at most
SAMPLED / LEAST_SEEN of them, whatever the input's size) is split by a row's number, so a line of a third of all
documents lies in as many partitions as there are; only the first document of each of its splits
is still open then, and is held against the first of these. What comes back for a document is a run-length compressed
bitmap of its lines, as (start, n) of each run that isn't kept; never text.

Null or empty text: one empty line, kept. Repeated rows of a doc_id are one document (a key in two
of them is in one document) but each row has its own runs. Null doc_id: the row keeps its lines and
takes none from others. Very long texts and lines are taken whole. An empty table gives an empty result. Other columns pass
through apply_runs() untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, ascii_lower, read, stored

MIN_CHARS = 10
#: Lines looked at for hot keys, about, and how many of these a hot key has at least.
SAMPLED, LEAST_SEEN = 1 << 20, 16


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n")


def line_keys(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, tag, row, pos) of every line that counts; tag tells repeated rows of a doc_id apart, row numbers the documents' rows."""
    trimmed = F.btrim("line", F.lit(SPACES))
    own = documents.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("tag"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16)).cast("int").alias("row"), _lines().alias("lines"))
    lines = own.select("doc_id", "tag", "row", F.posexplode("lines").alias("pos", "line")).select("doc_id", "tag", "row", "pos", trimmed.alias("line"))
    key = ascii_lower(F.col("line"))
    return lines.where(F.char_length("line") >= min_chars).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"), "doc_id", "tag", "row", "pos")


def hot_keys(keys: DataFrame, partitions: int) -> DataFrame:
    """(h1, h2) of the keys that the sample shows to be more than a partition should hold: a bounded number of rows, a stored table."""
    n = keys.count()
    share = min(1.0, SAMPLED / max(n, 1))
    drawn = keys.where(F.xxhash64("h1", "doc_id", "tag", "row", "pos") < F.lit(int(share * (2**64 - 2048)) - 2**63))
    least = max(LEAST_SEEN, int(min(n, SAMPLED) / (4 * partitions)))
    return stored(drawn.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h1", "h2"), "hot-lines")


def streamed(keys: DataFrame, partitions: int) -> DataFrame:
    """(h1, h2, doc_id, tag, pos, open) of the lines that go, and with open those of a hot key's splits that their first document holds."""
    hot = F.broadcast(hot_keys(keys, partitions).withColumn("hot", F.lit(True)))
    split = F.when(F.col("hot"), 1 + F.pmod("row", F.lit(min(partitions, 1 << 16)))).otherwise(0).cast("int")
    dealt = keys.join(hot, ["h1", "h2"], "left").select("h1", "h2", split.alias("split"), "doc_id", "tag", "pos")
    ordered = dealt.repartitionByRange(partitions, "h1", "h2", "split")
    run = Window.partitionBy("h1", "h2", "split").orderBy("doc_id", "tag", "pos")
    first, before = F.first("doc_id").over(run), F.lag(F.struct("doc_id", "tag", "pos")).over(run)
    seen = ordered.select("*", first.alias("first"), before.alias("before"))
    # Repeated rows of a document are neighbours in this order; the first of them tells for all.
    seen = seen.where(~F.col("before").eqNullSafe(F.struct("doc_id", "tag", "pos")))
    still = (F.col("split") > 0) & (F.col("doc_id") == F.col("first"))
    return seen.where((F.col("doc_id") > F.col("first")) | still).select("h1", "h2", "doc_id", "tag", "pos", still.alias("open"))


def dropped_runs(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, tag, n_dropped, runs): runs is the sorted array of (start, n) of dropped lines; documents that lose none are absent."""
    keys = stored(line_keys(documents, min_chars), "line-keys")
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(streamed(keys, partitions), "line-streams")
    # Where a key's run is split, the splits' firsts meet: one row a hot key, of which there is a bounded number.
    firsts = F.broadcast(found.where("open").groupBy("h1", "h2").agg(F.min("doc_id").alias("first")))
    joined = found.where("open").join(firsts, ["h1", "h2"]).where("doc_id > first")
    gone = found.where("not open").select("doc_id", "tag", "pos").union(joined.select("doc_id", "tag", "pos"))
    # A line that two splits hold is there twice, with one rank.
    run = gone.withColumn("run", F.col("pos") - F.dense_rank().over(Window.partitionBy("doc_id", "tag").orderBy("pos")))
    runs = run.groupBy("doc_id", "tag", "run").agg(F.struct(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("n")).alias("run_of"))
    runs = runs.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list("run_of")).alias("runs"))
    return runs.select("doc_id", "tag", F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r["n"]).alias("n_dropped"), "runs")


def apply_runs(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """documents' columns with text less its dropped lines, and _n_lines and _n_dropped."""
    names = documents.columns
    d = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_d"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_tag"))
    r = runs.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "n_dropped", "runs")
    j = d.join(r, ["_id", "_tag"], "left").withColumn("lines", F.split(F.coalesce("_d.text", F.lit("")), "\n"))
    end = lambda k: F.when(k == 0, 0).otherwise(F.get("runs", k - 1)["start"] + F.get("runs", k - 1)["n"])
    start = lambda k: F.coalesce(F.get("runs", k)["start"], F.size("lines"))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda k: F.slice("lines", end(k) + 1, start(k) - end(k))))
    text = F.when(F.col("runs").isNull(), F.col("_d.text")).otherwise(F.array_join(kept, "\n"))
    return j.select(*((text if c == "text" else F.col(f"_d.`{c}`")).alias(c) for c in names), F.size("lines").cast("bigint").alias("_n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("_n_dropped"))


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """documents with the repeated lines gone; the columns stay."""
    return apply_runs(documents, dropped_runs(documents, min_chars)).drop("_n_lines", "_n_dropped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_runs(docs, dropped_runs(docs))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (k.doc_id > f.first_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.first_doc IS NULL OR k.doc_id <= f.first_doc), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
