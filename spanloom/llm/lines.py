"""Line dedup by levelled sorted runs of line hashes. DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

#: A line found in more than a 2000th of a batch's lines is hot; so there are fewer than 2000 of them, and they are broadcast.
HOT_SHARE = 2000
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, string.ascii_uppercase, string.ascii_lowercase))


class LineRuns:
    """The line hashes of all batches so far, in levelled runs.

    A run is a table of distinct hashes, bucketed and sorted by hash, so that a batch's hashes, which are exchanged into the
    same buckets, are merged with it where it lies. A batch adds a run to level 0; as soon as a level has ``fanout`` runs they
    are merged into one of the next level, and their files are deleted. So a hash is rewritten once a level, and a batch
    meets at most fanout - 1 runs of each level.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]

    def _write(self, df: DataFrame) -> tuple[str, str]:
        path = new_path(self.spark, "run")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        df.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(run[1])
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _hashes(self, run: tuple[str, str]) -> DataFrame:
        return self.spark.table(run[0]).where("not seen").select("h", "g")

    def add(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (h, g, doc and any more) that repeat a line of an earlier batch, or of a smaller ``doc`` of this one;
        then the batch's own new hashes become a run. ``lines`` is read three times and should be a written table. A null
        doc comes after all others."""
        own = lines.groupBy("h", "g").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count("doc").alias("named"), F.count(F.lit(1)).alias("n"))
        seen = F.lit(False)
        for i, run in enumerate(run for level in self.levels for run in level):
            own = own.join(self._hashes(run).withColumn(f"in{i}", F.lit(True)), ["h", "g"], "left")
            seen = seen | F.col(f"in{i}").isNotNull()
        several = (F.col("owner") < F.col("last")) | ((F.col("named") > 0) & (F.col("named") < F.col("n")))
        run = self._write(own.select("h", "g", "owner", "n", seen.alias("seen"), F.coalesce(several, F.lit(False)).alias("several")))
        entries = self.spark.table(run[0])
        total = entries.agg(F.sum("n")).collect()[0][0] or 0
        found = entries.where("seen or several").select("h", "g", "owner", "n", "seen")
        is_hot = F.col("n") * F.lit(HOT_SHARE) > F.lit(total)
        hot = F.broadcast(found.where(is_hot).drop("n"))
        out = lines.join(hot, ["h", "g"]).unionByName(lines.join(hot, ["h", "g"], "left_anti").join(found.where(~is_hot).drop("n").hint("merge"), ["h", "g"]))
        out = materialize(out.where(F.col("seen") | ~F.col("doc").eqNullSafe(F.col("owner"))).select(*lines.columns), "repeats")
        self.levels[0].append(run)
        self._compact()
        return out

    def _compact(self) -> None:
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if k + 1 == len(self.levels):
                self.levels.append([])
            merged = self._hashes(self.levels[k][0])
            for run in self.levels[k][1:]:
                merged = merged.unionAll(self._hashes(run))
            # an exchange into the buckets gives one sorted file a bucket
            self.levels[k + 1].append(self._write(merged.withColumn("seen", F.lit(False)).repartition(self.buckets, "h", "g")))
            for run in self.levels[k]:
                self._drop(run)
            self.levels[k] = []
            k += 1

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = [[]]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """id, n_lines, n_dropped (long) and kept (the text that stays) of every row.

    Texts are split at each line feed; a null or empty text is one empty line. Lines are equal when their keys are
    (``line_key``). Lines with keys of at least ``min_chars`` code points that stand in several documents stay only in the one
    with the smallest id, where all of them stay; the others of a text are joined again by line feeds, and a text that loses
    every line is empty. Ids are numbers. Rows with one id are one document, and so are all rows with a null id, which comes
    after all others; repeated rows stay, each with the same result. An empty table gives no rows; other columns are not read.

    Documents are taken in ``batches`` of ascending ids, each held against the runs of those before. Only hashes of lines (96
    bits: two independent ones of 64 and 32) are exchanged for that, hot lines not even then; the texts are exchanged once, to meet
    the places of their dropped lines.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    edges = src.agg(F.percentile_approx("doc", [(i + 1) / batches for i in range(batches - 1)], 1000)).collect()[0][0] if batches > 1 else []
    batch = F.lit(0)
    for edge in sorted(set(edges or [])):
        batch = batch + (F.coalesce(F.col("doc") > F.lit(edge), F.lit(True))).cast("int")
    numbered = src.select("doc", F.xxhash64("t").alias("rid"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    hashed = numbered.where(F.char_length("key") >= min_chars).select("doc", "rid", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"), batch.alias("batch"))
    path = new_path(spark, "lines")
    hashed.write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema(hashed.schema).parquet(path)
    runs, repeats = LineRuns(spark, fanout), None
    for i in range(len(set(edges or [])) + 1):
        found = runs.add(hashed.where(F.col("batch") == i).drop("batch"))
        repeats = found if repeats is None else repeats.unionAll(found)
    runs.close()
    lost = repeats.groupBy("doc", "rid").agg(F.collect_set("pos").alias("lost")).withColumnRenamed("doc", "of").withColumnRenamed("rid", "row")
    met = src.join(lost, F.col("doc").eqNullSafe(F.col("of")) & (F.xxhash64("t") == F.col("row")), "left")
    lines = F.split("t", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("t")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("ls", i)), "\n"))
    out = met.withColumn("ls", lines)
    return out.select(F.col("doc").alias(id_col), F.size("ls").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_sql() -> str:
    """The same over ``documents``, for DuckDB."""
    return rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, row_number() OVER () AS r FROM documents),
x AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM x),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, o.owner IS NOT NULL AND k.doc_id <> o.owner AS gone FROM k LEFT JOIN o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
