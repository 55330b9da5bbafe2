"""Line deduplication by winnowing over line hashes, with DataFrame functions alone.

A run of lines counts if it has ``window`` lines or ``chars`` characters; blank lines are no part of runs. Every window,
the shortest such run from a line onward or back from a line, names the line of its smallest hash, and the lines so
named are the text's fingerprints: two equal runs always share some, and only fingerprints are written and shuffled.
Positions are joined on them; from those that recur, the match is extended both ways to the windows that named the line,
which are compared by text. Windows that occur before are deleted; they overlap, so the longest repeated run goes as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

WINDOW, CHARS = 3, 200


def _windows(lines: Column, window: int, chars: int) -> Column:
    """Distinct (s, e), first and last index in ``lines``, of all windows."""
    n = F.size(lines)

    def at(k: Column) -> Column:
        return F.when((k >= 0) & (k < n), F.get(lines, k)["n"])

    def reach(k: Column, step: int) -> Column:
        """The other end of the window from k, or null if the text ends before."""
        end = F.lit(None).cast("int")
        for i in reversed(range(window)):
            j = k + i * step
            enough = F.lit(True) if i == window - 1 else sum((at(k + q * step) for q in range(1, i + 1)), at(k)) >= chars
            end = F.when(enough & at(j).isNotNull(), j).otherwise(end)
        return end

    def both(k: Column) -> Column:
        return F.array(F.struct(k.alias("s"), reach(k, 1).alias("e")), F.struct(reach(k, -1).alias("s"), k.alias("e")))

    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), both))
    return F.when(n > 0, F.array_distinct(F.filter(every, lambda w: w["s"].isNotNull() & w["e"].isNotNull())))


def _lines(text: str) -> Column:
    """(i, x, h, n) of the lines that aren't blank: index, text without spaces at its ends, hash, length."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x).alias("x"))), lambda p: p["x"] != "")
    return F.transform(lines, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x"), F.xxhash64(p["x"]).alias("h"), F.length(p["x"]).alias("n")))


def _run(w: Column) -> Column:
    return F.slice("lines", w["s"] + 1, w["e"] - w["s"] + 1)


def _least(w: Column) -> Column:
    """The window's fingerprint: its smallest hash, and the index of the last line that has it."""
    least = F.array_min(F.transform(_run(w), lambda p: F.struct(p["h"].alias("h"), (-p["i"]).alias("i"))))
    return runtime.let(least, lambda x: F.struct(x["h"].alias("print"), (-x["i"]).alias("place")))


def fingerprints(documents: DataFrame, window: int = WINDOW, chars: int = CHARS) -> DataFrame:
    """doc_id, t (a hash of the text), print, place (index of the line): the distinct minima of all windows of each text."""
    rows = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), _lines("text").alias("lines")).where(F.size("lines") > 0)
    chosen = F.array_distinct(F.transform(_windows(F.col("lines"), window, chars), _least))
    return rows.select("doc_id", "t", F.explode(chosen).alias("p")).select("doc_id", "t", "p.print", "p.place")


def _repeats(documents: DataFrame, window: int, chars: int) -> DataFrame:
    """doc_id, hash of text, and the indices of its lines that later copies of runs cover."""
    prints = runtime.written(fingerprints(documents, window, chars), "prints")
    place = F.struct("doc_id", "t", "place")
    counted = prints.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("m")).where("a <> b").select("print", "m")
    joined = runtime.joined_unevenly(prints, runtime.written(counted, "recurring"), ["print"], "m")
    found = runtime.written(joined.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("place").alias("at")), "found")
    # the texts with recurring prints alone are laid out again, to extend the matches
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))
    texts = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), "text")
    texts = texts.join(runtime.joined_side(found.select("_d", "_t")), same, "left_semi").dropDuplicates(["doc_id", "t"])
    rows = texts.join(found, same).select("doc_id", "t", "at", _lines("text").alias("lines"))
    through = F.filter(_windows(F.col("lines"), window, chars), lambda w: F.array_contains("at", _least(w)["place"]))
    rows = rows.select("doc_id", "t", "lines", F.explode(through).alias("w"))
    run = _run(F.col("w"))
    rows = rows.select("doc_id", "t", F.get("lines", F.col("w.s"))["i"].alias("s"), F.unhex(F.md5(F.array_join(F.transform(run, lambda p: p["x"]), "\n"))).alias("name"), F.transform(run, lambda p: p["i"]).alias("covered"))
    rows = runtime.written(rows, "windows")
    start = F.struct("doc_id", "t", "s")
    first = rows.groupBy("name").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("m")).where("first <> last").select("name", "first", "m")
    later = runtime.joined_unevenly(rows, runtime.written(first, "first"), ["name"], "m").where(F.struct("doc_id", "t", "s") > F.col("first"))
    return later.select("doc_id", "t", F.explode("covered").alias("i")).groupBy("doc_id", "t").agg(F.collect_set("i").alias("gone"))


def drop_repeated_lines(documents: DataFrame, window: int = WINDOW, chars: int = CHARS) -> DataFrame:
    """``documents`` with later copies of runs of lines taken out of ``text``, and n_lines, n_removed (which replace columns of such names).

    Order is that of (doc_id, position); a null doc_id comes first. Lines are compared without spaces at their ends, runs
    by the MD5 of their lines' text, and deleted with their line break. Overlapping copies in one document collapse to what comes before the second. Null and
    empty texts stay, and rows of the same doc_id and text are one document and are treated alike. Rows and other
    columns stay as they are; a text of which all lines go becomes empty.
    """
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    gone = _repeats(documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), window, chars)
    doc, text, removed = runtime.fresh(documents.columns, "_gone_doc", "_gone_text", "_gone")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("t").alias(text), F.col("gone").alias(removed))
    joined = documents.select(*own).join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text)), "left")
    split = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(removed, i)), "\n")
    return joined.select(
        *[F.when(F.col(removed).isNull(), F.col("text").cast("string")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in own],
        F.coalesce(F.size(split), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(removed), F.lit(0)).alias("n_removed"),
    )


def op4_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, trim(parts[i], ' ') AS x FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), full_lines AS (
  SELECT doc_id, i, x, length(x) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE x <> ''
), near AS (
  SELECT *, lead(x) OVER d AS x1, lead(x, 2) OVER d AS x2, lead(n) OVER d AS n1, lead(x) OVER b AS y1, lead(x, 2) OVER b AS y2, lead(n) OVER b AS m1
  FROM full_lines WINDOW d AS (PARTITION BY doc_id ORDER BY k), b AS (PARTITION BY doc_id ORDER BY k DESC)
), windows AS (
  SELECT doc_id, k AS s, CASE WHEN n >= {CHARS} THEN [x] WHEN n + n1 >= {CHARS} THEN [x, x1] WHEN x2 IS NOT NULL THEN [x, x1, x2] END AS run FROM near
  UNION
  SELECT doc_id, k - CASE WHEN n >= {CHARS} THEN 0 WHEN n + m1 >= {CHARS} THEN 1 ELSE 2 END, CASE WHEN n >= {CHARS} THEN [x] WHEN n + m1 >= {CHARS} THEN [y1, x] WHEN y2 IS NOT NULL THEN [y2, y1, x] END FROM near
), ranked AS (
  SELECT doc_id, s, len(run) AS n, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS r FROM windows WHERE run IS NOT NULL
), gone AS (
  SELECT DISTINCT f.doc_id, f.i FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM ranked WHERE r > 1) g JOIN full_lines f USING (doc_id, k)
), lost AS (SELECT doc_id, list(i) AS i FROM gone GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN lost.i IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(list_transform(string_split(d.text, chr(10)), lambda x, k: {{'x': x, 'k': k - 1}}), lambda p: NOT list_contains(lost.i, p.k)), lambda p: p.x), chr(10)), '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(lost.i), 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN lost USING (doc_id)
"""
