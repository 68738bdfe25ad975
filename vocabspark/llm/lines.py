"""Line dedup over windows of three consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a new column that is computed once for each row, however often and wherever it is used later.

    A plain column would be put in place of each use, inside the loops over lines too.
    """
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def dedup_lines(docs: DataFrame, id_col: str, text_col: str, width: int = 3, out: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """`docs` with `text_col` less repeated passages, and the new columns `out` (long): its lines and those removed.

    Lines are compared without blanks at their ends; blank lines are skipped when windows of `width` consecutive lines are
    formed. A window that stands anywhere in the table more than once keeps its first place, by id (null
    first), then the text's digest, then position; the lines of all its later places are removed, overlapping
    places as one. A removed line's first place is always earlier, so no line is lost from the table.
    Texts with fewer lines than `width` stay as they are, as do null texts (0 lines). Rows equal in id and
    text are one document: they keep the same lines. An empty table gives an empty one. The new columns
    replace columns of their names.

    Only digests of windows are shuffled, 128 bits each, and counted before the shuffle, so a window that stands in
    a third of the rows meets as one row of each task; the join back to its places can be split.
    """
    plain, (id_col, text_col), back = aside(docs.drop(*[c for c in out if c not in (id_col, text_col)]), id_col, text_col)
    return back(_dedup(plain, id_col, text_col, width, out))


def _dedup(docs: DataFrame, id_col: str, text_col: str, width: int, out: tuple[str, str]) -> DataFrame:
    named = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), _lines(F.col(text_col)).alias("lines"))
    full = named.select("d", "t", F.filter(F.transform("lines", _trimmed), lambda x: x != "").alias("own")).filter(F.size("own") >= width)
    spot = lambda k: [F.get("own", k + i) for i in range(width)]
    window = lambda k: F.struct(F.xxhash64(*spot(k)).alias("a"), F.xxhash64(F.lit(width), *spot(k)[::-1]).alias("b"), k.alias("k"))
    windows = full.select("d", "t", F.explode(F.transform(F.sequence(F.lit(0), F.size("own") - width), window)).alias("w")).select("d", "t", "w.a", "w.b", "w.k")
    place = F.struct("d", "t", "k")
    repeated = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(repeated, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("d", "t").agg(F.collect_set("k").alias("__k")).withColumnsRenamed({"d": "__d", "t": "__t"})

    names = docs.columns
    whole = docs.withColumns({"__id": F.col(id_col), "__digest": F.xxhash64(text_col)})
    joined = whole.join(starts, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__digest") == F.col("__t")), "left")
    at = F.sequence(F.lit(0), F.size("__lines") - 1)
    parts = _once(joined, "__lines", _lines(F.col(text_col)))
    parts = _once(parts, "__full", F.filter(at, lambda i: _trimmed(F.get("__lines", i)) != ""))
    covered = F.array_distinct(F.flatten(F.transform("__k", lambda k: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("__full", k + i)))))
    cut = _once(parts, "__gone", F.coalesce(covered, F.array().cast("array<int>")))
    kept = F.transform(F.array_except(at, F.col("__gone")), lambda i: F.get("__lines", i))
    text = F.when(F.size("__gone") == 0, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return cut.withColumns(
        {text_col: text, out[0]: F.size("__full").cast("long"), out[1]: F.size("__gone").cast("long")}
    ).select(*[n for n in names if n not in out], *out)


ORACLE = r"""
  WITH cut AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       every_line AS (SELECT doc_id, text, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM cut),
       own AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
               FROM every_line WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
       win AS (SELECT a.doc_id, a.k, a.i, b.i AS i2, c.i AS i3, a.line AS l1, b.line AS l2, c.line AS l3
               FROM own a JOIN own b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN own c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
       late AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, k) > 1),
       gone AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) AS i FROM late),
       kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM every_line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
       lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
       counted AS (SELECT doc_id, count(*) AS n_lines FROM own GROUP BY doc_id)
  SELECT c.doc_id, CASE WHEN l.n_removed IS NULL THEN c.text ELSE coalesce(k.text, '') END AS text,
         coalesce(n.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_removed, 0)::BIGINT AS n_removed
  FROM cut c LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN counted n USING (doc_id)"""
