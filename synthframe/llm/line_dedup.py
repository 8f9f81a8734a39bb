"""Repeated runs of lines, by prefix doubling over line ids; DataFrame functions only.

A document is the sequence of the ids of its lines, blank lines left out.  Ids are 128
bits of hashes, and ranks of pairs double the length that a rank stands for until it
reaches the shortest run; the last step overlaps.  Suffixes of equal rank form an
interval of common prefix at least that long, its members are the copies of a run, and
all but the first in the order of (doc_id, row, line) are later copies.  Neighbouring
later copies of one source make a maximal run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import SPACE, stash

MIN_LINES = 3
#: Words that make a shorter run count, where they are asked for.
MIN_WORDS = 50


def _words(line: Column) -> Column:
    """The number of words of a line."""
    bare = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE)))


def _runs(rows: DataFrame, least: int, words: int | None) -> DataFrame:
    """(row, id, line, length, a, b): every run that is compared, and its rank as a hash pair.

    Runs are of `least` lines; with `words`, also the shorter ones that have so many words.
    """
    length, found = 1, []
    while True:
        if length == least:
            found.append(F.expr(f"transform(a, (x, i) -> struct(i AS line, {length} AS length, x AS a, b[i] AS b))"))
            break
        if words is not None:
            rows = rows.withColumn(f"short{length}", F.expr(f"""filter(transform(a, (x, i) -> struct(i AS line, {length} AS length, x AS a, b[i] AS b)),
                r -> aggregate(slice(n, r.line + 1, {length}), 0, (t, v) -> t + v) >= {words})"""))
            found.append(F.col(f"short{length}"))
        step = min(length, least - length) if words is None else 1
        rows = rows.withColumns({
            name: F.expr(f"""CASE WHEN size({name}) <= {step} THEN array() ELSE
                transform(sequence(0, size({name}) - 1 - {step}), i -> xxhash64({salt}, {name}[i], {name}[i + {step}])) END""")
            for name, salt in (("a", 11 * length), ("b", 11 * length + 5))})
        length += step
    return rows.select("row", "id", F.inline(F.concat(*found)))


def copies(rows: DataFrame, least: int, words: int | None = None) -> DataFrame:
    """(row, starts): for each row with later copies, (line, source row, source line, length) of every copied start."""
    sizes = {} if words is None else {"n": F.transform("lines", lambda x: _words(x["text"]))}
    suffixes = _runs(rows.select(
        "row", "id", F.transform("lines", lambda x: F.xxhash64(x["text"])).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(5), F.length(x["text"]), x["text"])).alias("b"),
        *[c.alias(name) for name, c in sizes.items()]), least, words).select(F.struct("id", "row", "line").alias("place"), "length", "a", "b")
    intervals = suffixes.groupBy("a", "b").agg(F.min("place").alias("source"), F.max("place").alias("latest"))
    later = suffixes.join(intervals.filter("source <> latest").select("a", "b", "source"), ["a", "b"]).filter("place <> source")
    start = F.struct("place.line", F.col("source.row").alias("source_row"), F.col("source.line").alias("source_line"), "length")
    return later.groupBy(F.col("place.row").alias("row")).agg(F.sort_array(F.collect_list(start)).alias("starts"))


def delete_copies(docs: DataFrame, least: int = MIN_LINES, words: int | None = None) -> DataFrame:
    """All columns of `docs` with later copies of line runs deleted from `text`, and `line counts`.

    `line counts` holds n_lines, n_removed and n_runs.  A run is `least` or more
    lines with a word, in sequence, or with `words` also fewer lines that together have
    at least so many words; blank lines neither match nor go.  Null texts stay null, empty ones empty.  Of repeated rows the first written keeps its lines.  Null
    ids come first in the order.  An empty table gives no rows.
    """
    numbered = stash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row")), "line-rows")
    lines = F.split(F.coalesce("d.text", F.lit("")), "\n")
    indexed = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("at"))), lambda x: x["text"].rlike(r"[^\x20\x09-\x0D]"))
    found = copies(numbered.select("row", F.col("d.doc_id").alias("id"), indexed.alias("lines")), least, words)
    joined = numbered.join(found, "row", "left").withColumn("lines", lines).withColumn("indexed", indexed)
    covered = F.expr("""array_distinct(flatten(transform(coalesce(starts, array()),
        s -> transform(sequence(s.line, s.line + s.length - 1), p -> indexed[p].at))))""")
    # starts that no start one line before, of the same source, leads to
    runs = F.expr("""size(array_except(transform(coalesce(starts, array()), s -> xxhash64(s.line, s.source_row, s.source_line)),
        transform(coalesce(starts, array()), s -> xxhash64(s.line + 1, s.source_row, s.source_line + 1))))""")
    marked = joined.select("d", "lines", covered.alias("gone"), runs.alias("runs"), F.size("indexed").alias("n"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    text = F.when(F.size("gone") == 0, F.col("d.text")).otherwise(kept)
    counts = F.struct(F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.col("runs").cast("long").alias("n_runs"))
    return marked.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns], counts.alias("line counts"))


def oracle(least: int = MIN_LINES) -> str:
    """DuckDB SQL of the per-document counts and the kept text's MD5."""
    run = " || chr(10) || ".join(f"lead(line, {i}) OVER w" if i else "line" for i in range(least))
    return f"""WITH x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr FROM documents),
l AS (SELECT doc_id, nr, line, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS p FROM x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
r AS (SELECT doc_id, p, {run} AS run FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT doc_id, p, first_value(doc_id) OVER v AS sd, first_value(p) OVER v AS sp, row_number() OVER v AS nth FROM r WHERE run IS NOT NULL WINDOW v AS (PARTITION BY run ORDER BY doc_id, p)),
c AS (SELECT * FROM s WHERE nth > 1),
starts AS (SELECT doc_id, count(*) AS n_runs FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.p = c.p - 1 AND o.sd = c.sd AND o.sp = c.sp - 1) GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM c, range({least}) t(k)),
k AS (SELECT x.doc_id, x.nr, x.line, gone.p IS NOT NULL AS dropped, l.p IS NOT NULL AS worded FROM x LEFT JOIN l USING (doc_id, nr) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = l.p)
SELECT k.doc_id, CAST(count(*) FILTER (worded) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_removed, CAST(coalesce(max(n_runs), 0) AS BIGINT) AS n_runs,
  md5(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT dropped), '')) AS kept_md5 FROM k LEFT JOIN starts USING (doc_id) GROUP BY k.doc_id"""
