"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines that hold a word make a window (lines without one are passed over); a text with fewer
makes one window of all it has. Windows are hashed and compared over all texts. The first occurrence, in order of
key and place, stays; the lines that later occurrences cover are removed, covered places merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightloom.llm.common import WORD_SEPARATORS, fresh, written

WINDOW = 3


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Rows (key, print, place, lines, hash, hash2): each window of each text. print tells texts with one key apart,
    place numbers the windows of a text from 0, lines holds the numbers of the window's lines in the text. Two hashes,
    128 bits: 64 would collide among the windows of a very large corpus."""
    said = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.when(F.length(F.btrim(x, F.lit(WORD_SEPARATORS))) > 0, F.xxhash64(x)).alias("h"), F.xxhash64(F.lit(1), x).alias("h2")))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.filter(said, lambda x: x["h"].isNotNull()).alias("lines"))
    rows = rows.where(F.size("lines") > 0)
    places = F.sequence(F.lit(0), F.greatest(F.size("lines") - size, F.lit(0)))
    cut = lambda i: F.slice("lines", i + 1, size)
    hashed = F.transform(places, lambda i: F.struct(i.alias("place"), F.transform(cut(i), lambda x: x["i"]).alias("lines"), F.xxhash64(F.transform(cut(i), lambda x: x["h"])).alias("hash"), F.xxhash64(F.transform(cut(i), lambda x: x["h2"])).alias("hash2")))
    return rows.select("key", "print", F.inline(hashed))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Rows (key, print, gone): the numbers of the lines that later occurrences cover, for texts that lose lines.

    Rows with equal key and text are one text here, so neither loses lines to the other.
    """
    found = written(windows(docs, key, text, size))
    at = F.struct("key", "print", "place")
    # Written, so that the join shuffles both sides by itself and Spark can split a window that many texts share.
    firsts = written(found.groupBy("hash", "hash2").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1").select("hash", "hash2", "first"))
    later = found.join(firsts, ["hash", "hash2"]).where(~at.eqNullSafe(F.col("first"))).select("key", "print", F.explode("lines").alias("line"))
    return later.groupBy("key", "print").agg(F.collect_set("line").alias("gone"))


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """All rows and columns, texts without the lines that later occurrences of repeated windows cover, and a column
    `lines_removed`.

    Rows are never removed: a text whose every line is repeated becomes empty, a null text stays null. Order of
    occurrences: key (null first), then the text's hash, then place. Repeated rows (equal key and text) keep or
    lose the same lines. Lines without a word stay. An input column `lines_removed` is replaced. Long texts are taken whole; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() != "lines_removed"]
    k, p, q, gone = (fresh(docs, x) for x in ("_key", "_print", "_lost_print", "_gone"))
    lost = removals(docs, key, text, size).select(F.col("key").alias(k), F.col("print").alias(q), F.col("gone").alias(gone))
    rows = docs.select(*kept, F.xxhash64(text).alias(p))
    # Merged, not broadcast: how many texts lose lines has no bound, and small tables shall run as large ones do.
    rows = rows.join(written(lost).hint("merge"), F.col(key).eqNullSafe(F.col(k)) & (F.col(p) == F.col(q)), "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)))
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return rows.select(*[cleaned.alias(c) if c.lower() == text.lower() else F.col(c) for c in kept], n.alias("lines_removed"))


def op5_linededup(spark, sf_dir: str) -> DataFrame:
    """Every document without its later repeated lines, by `deduped`: a null text stays null, whole texts are read however
    long, repeated rows lose the same lines, ties go by key, an empty table gives no rows; other columns don't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduped(docs)


#: Two orders of nulls don't matter here: every document of the tables has an id.
OP5_SQL = """
WITH lines AS (
  SELECT doc_id, text, i, line
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS i)
), said AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n,
         lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3
  FROM lines WHERE regexp_matches(line, '[^ \\t\\n\\x0b\\x0c\\r]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), wins AS (
  SELECT *, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, k) AS seen
  FROM said WHERE k <= greatest(n - 2, 1)
), gone AS (
  SELECT DISTINCT doc_id, x AS i FROM (SELECT doc_id, unnest([i, i2, i3]) AS x FROM wins WHERE seen > 1) WHERE x IS NOT NULL
), done AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS lines_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text, CAST(coalesce(x.lines_removed, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN done x ON d.doc_id = x.doc_id
"""
