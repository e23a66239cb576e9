"""Line deduplication by overlapping three-line windows, in DataFrame operations only.

Every run of three consecutive lines of a text is hashed. Of windows that are
equal, the first by doc_id (null first), text hash and line stays; the lines
that the later ones cover are removed, overlapping windows as one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import every, fresh, reshuffled, table

#: Lines in a window.
WINDOW = 3


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(d, t, gone, kept, at)`` for each document with removals: its id, text hash, the number of
    lines to remove, the ranges ``(begin, length)`` that stay and the line from which all stay.

    Windows carry two 64-bit hashes with different seeds, their document and
    line. A window whose lines are all blank is left alone, and so are texts of
    fewer lines than a window. A window that overlaps its own first occurrence
    in the same text covers only lines after that occurrence, so one whole
    occurrence always stays.
    """
    rows = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("t"), F.split(F.col(text), "\n", -1).alias("lines")).where(F.size("lines") >= window)
    hashed = rows.select("d", "t", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(x) == "").alias("blank"))).alias("h"))
    window_of = lambda i: F.struct(
        F.xxhash64(*[F.get("h", i + k)["a"] for k in range(window)]).alias("a"),
        F.xxhash64(F.lit(2), *[F.get("h", i + k)["b"] for k in range(window)]).alias("b"),
        i.alias("i"),
        F.forall(F.slice("h", i + 1, window), lambda x: x["blank"]).alias("blank"),
    )
    windows = hashed.select("d", "t", F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - window), window_of))).where("NOT blank").drop("blank")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("d", "t", "i")).alias("first"), F.max(F.struct("d", "t", "i")).alias("last")).where("first != last")
    first = first.select(reshuffled("a").alias("fa"), reshuffled("b").alias("fb"), "first")  # hot windows are split
    later = windows.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb"))).where(~F.struct("d", "t", "i").eqNullSafe(F.col("first")))
    same = F.struct("d", "t").eqNullSafe(F.struct("first.d", "first.t"))
    begin = F.when(same, F.greatest("i", F.col("first.i") + window)).otherwise(F.col("i"))
    covered = later.select("d", "t", begin.alias("begin"), (F.col("i") + window - 1).alias("end")).where("begin <= end")
    ranges = covered.groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("ranges"))
    # merge the ranges; what lies between them stays
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gone"), F.expr("CAST(array() AS array<struct<begin:int,length:int>>)").alias("kept"))
    merge = lambda s, r: F.struct(
        F.greatest(s["at"], r["end"] + 1).alias("at"),
        (s["gone"] + F.greatest(r["end"] + 1 - F.greatest(s["at"], r["begin"]), F.lit(0))).alias("gone"),
        F.when(r["begin"] > s["at"], F.concat(s["kept"], F.array(F.struct(s["at"].alias("begin"), (r["begin"] - s["at"]).alias("length"))))).otherwise(s["kept"]).alias("kept"),
    )
    return ranges.select("d", "t", F.aggregate("ranges", start, merge).alias("m")).select("d", "t", "m.gone", "m.kept", "m.at")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` with ``text`` less the removed lines; ``removed`` names a column for their number.

    A text that loses all its lines becomes empty, a null text stays null. Rows
    equal in id and text are one document and are treated alike.
    """
    cut, hashed, split, d, t = fresh(docs, "line_cut", "line_hash", "line_split", "line_d", "line_t")
    lines = repeated_lines(docs, doc_id, text).select(F.col("d").alias(d), F.col("t").alias(t), F.struct("gone", "kept", "at").alias(cut))
    marked = docs.withColumn(hashed, F.xxhash64(F.col(text)))
    joined = marked.join(lines, marked[doc_id].eqNullSafe(lines[d]) & marked[hashed].eqNullSafe(lines[t]), "left")
    joined = joined.withColumn(split, F.when(F.col(cut).isNotNull(), F.split(F.col(text), "\n", -1)))
    rest = F.slice(split, F.col(cut)["at"] + 1, F.greatest(F.size(split) - F.col(cut)["at"], F.lit(0)))
    kept = F.concat(F.flatten(F.transform(F.col(cut)["kept"], lambda r: F.slice(split, r["begin"] + 1, r["length"]))), rest)
    out = joined.withColumn(text, F.when(F.col(cut).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text)))
    count = [F.coalesce(F.col(cut)["gone"], F.lit(0)).alias(removed)] if removed else []
    return out.select(*every(docs), *count)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, removed="n_removed")
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), F.length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


SQL_OP1 = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
     w AS (SELECT doc_id, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS body
           FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - {WINDOW - 1})) AS i FROM l WHERE len(lines) >= {WINDOW})
           WHERE trim(lines[i + 1]) || trim(lines[i + 2]) || trim(lines[i + 3]) != ''),
     f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(i) OVER o AS fi FROM w WINDOW o AS (PARTITION BY body ORDER BY doc_id, i)),
     c AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(i, fi + {WINDOW}) ELSE i END, i + {WINDOW})) AS i
           FROM f WHERE doc_id != fd OR i != fi),
     u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM l),
     k AS (SELECT doc_id, count(c.i) AS n_removed, coalesce(string_agg(u.line, chr(10) ORDER BY u.i) FILTER (WHERE c.i IS NULL), '') AS kept
           FROM u LEFT JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
