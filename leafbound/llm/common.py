"""What the corpus operators share: table access, words, durable cuts of the lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the byte-wise path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str = SPACE) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Set here only where the session names none and all of it runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (own := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafbound-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes stored tables of which nothing that is still to be computed reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What a broadcast table may hold: rows, and characters or bytes of its strings, binaries and arrays.
FEW, SMALL = 100_000, 16 << 20


def is_small(df: DataFrame, rows: int = FEW, size: int = SMALL) -> bool:
    """Whether df, which is stored, is counted to be within the bounds of a broadcast."""
    wide = [F.sum(F.length(F.to_json(F.struct(f"`{f.name}`"))) if f.dataType.typeName() in ("array", "struct", "map") else F.octet_length(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    n, *sizes = df.limit(rows + 1).agg(F.count("*"), *wide).first()
    return n <= rows and sum(x or 0 for x in sizes) <= size


def if_small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, which is stored, marked for broadcast if it is small; else a shuffled join follows."""
    return F.broadcast(df) if is_small(df, rows) else df


def join_skewed(big: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "left", salts: int = 16, rows: int = FEW) -> DataFrame:
    """big with small, which is stored and has each key once. Beyond the bounds of a broadcast the keys are salted by `spread`, so that one common key is `salts` tasks' work and not one's."""
    if is_small(small, rows):
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (a, b).

    Alternating large-star and small-star steps until the edge set stands still; every step is a
    grouped minimum and an equi-join, nothing is collected but two counters per round.
    """
    e = stored(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")

    def mark(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen, last = mark(e), e
    while seen[0]:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(least, "a").where("b > a").selectExpr("b a", "m b").where("a <> b").distinct()
        e = e.selectExpr("greatest(a, b) a", "least(a, b) b")
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a")
        e = small.selectExpr("a", "m b").union(small.where("b <> m").selectExpr("b a", "m b")).distinct()
        before, e = last, stored(e, "edges")
        last = e
        discard(before)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.selectExpr("a node", "b root").union(e.selectExpr("b node", "b root").distinct())
