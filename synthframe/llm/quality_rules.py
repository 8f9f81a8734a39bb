"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  Expectation
maximisation over the counts of vote patterns estimates how often each rule is right
when it votes, within the rule's stated bounds, and the share of good documents; a
document's quality probability is the posterior given its votes.  Nothing but the pattern counts, at most 3^rules
rows, reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import SPACE, stash

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"
#: Rule -> (votes bad where, votes good where, least and most accuracy). It abstains where neither holds.
#: Rules that see plain damage are trusted from the start; counts that clean text can
#: also show (copied lines, repetition, word length) stay weak alone.
RULES = {
    "symbols": ("n_symbols > 0.25 * n_words", "false", 0.98, 0.999),
    "shouting": ("n_exclaims > 0.30 * n_words", "false", 0.98, 0.999),
    "copied_lines": ("n_dup_lines > 0.50 * n_lines", "false", 0.50, 0.80),
    "repetition": ("n_repeat_words > 0.30 * n_words", "false", 0.50, 0.80),
    "word_length": ("word_chars > 14 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words", 0.50, 0.65),
}
ROUNDS = 25
START_GOOD, LEAST_GOOD, MOST_GOOD = 0.8, 0.05, 0.95


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; a null text has none.

    Repeated three-word windows are found inside the row, without a shuffle: hashes
    that carry their position in the low 24 bits are sorted as plain numbers, equal
    neighbours are suspects, and only the suspects' words are sorted and compared.
    The words they cover are the union of three positions from each.  Texts of 2^24
    words or more suspect every window.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spaced = F.col("text")
    for blank in BLANKS:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))

    def without(column, chars):
        for char in chars:
            column = F.replace(column, F.lit(char), F.lit(""))
        return F.length(column)

    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = text.withColumn("spaced", spaced).withColumn("lines", lines).withColumn("words", F.filter(F.split("spaced", " "), lambda w: w != ""))
    counted = split.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        without(F.col("spaced"), " ").cast("long").alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - without(F.col("text"), "!")).cast("long").alias("n_exclaims"))
    hashed = counted.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    keyed = hashed.withColumn("k", F.expr("""CASE WHEN n_words < 4 THEN array() WHEN n_words < 16777216 THEN
        sort_array(transform(sequence(1, int(n_words) - 2), i -> (xxhash64(h[i - 1], h[i], h[i + 1]) & -16777216L) | i)) END""")).drop("h")
    maybe = F.expr("""CASE WHEN k IS NULL THEN sequence(1, int(n_words) - 2) ELSE transform(filter(k, (x, i) ->
        shiftright(x, 24) = shiftright(get(k, i - 1), 24) OR shiftright(x, 24) = shiftright(get(k, i + 1), 24)), x -> int(x & 16777215L)) END""")
    suspects = keyed.withColumn("at", maybe).drop("k")
    windows = suspects.withColumn("w", F.expr("""CASE WHEN size(at) = 0 THEN NULL ELSE
        sort_array(transform(at, i -> struct(words[i - 1] AS a, words[i] AS b, words[i + 1] AS c, i AS at))) END""")).drop("words", "at")
    repeated = windows.withColumn("at", F.expr("""sort_array(transform(filter(w, (x, i) ->
        (x.a = get(w, i - 1).a AND x.b = get(w, i - 1).b AND x.c = get(w, i - 1).c)
        OR (x.a = get(w, i + 1).a AND x.b = get(w, i + 1).b AND x.c = get(w, i + 1).c)), x -> x.at))""")).drop("w")
    covered = F.expr("""coalesce(aggregate(at, struct(0L AS covered, -9 AS past),
        (s, x) -> struct(s.covered + least(3, x - s.past) AS covered, x AS past), s -> s.covered), 0L)""")
    return repeated.withColumn("n_repeat_words", covered).drop("at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(bad: str, good: str) -> str:
    """SQL of a vote; without words every rule abstains."""
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[float]]:
    """(share of good documents, each rule's accuracy when it votes) by expectation maximisation over pattern counts."""
    good, right = START_GOOD, [least for _, _, least, _ in RULES.values()]
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        beliefs = [(votes, n, posterior_of(votes, good, right)) for votes, n in patterns]
        good = min(max(sum(n * p for _, n, p in beliefs) / total, LEAST_GOOD), MOST_GOOD)
        for r, (_, _, least, most) in enumerate(RULES.values()):
            voted = sum(n for votes, n, _ in beliefs if votes[r])
            agreed = sum(n * (p if votes[r] > 0 else 1 - p) for votes, n, p in beliefs if votes[r])
            right[r] = min(max(agreed / voted, least), most) if voted else least
    return good, right


def posterior_of(votes: tuple[int, ...], good: float, right: list[float]) -> float:
    odds = math.log(good / (1 - good)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, right, strict=True))
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, quality probability and verdict of every document.

    Empty and null texts have zero words and fail the base rules; rules abstain on
    them.  Repeated rows are judged alike, null ids are carried, an empty table gives
    an empty result, and no column but doc_id and text is read.
    """
    voted = measures(docs).select("*", *[F.expr(vote(*rule[:2])).alias(f"vote_{name}") for name, rule in RULES.items()])
    counted = stash(voted, "quality-votes")
    names = [f"vote_{name}" for name in RULES]
    patterns = sorted((tuple(row[n] for n in names), row["count"]) for row in counted.groupBy(*names).count().collect())
    good, right = estimate(patterns)
    odds = F.lit(math.log(good / (1 - good)))
    for name, accuracy in zip(names, right, strict=True):
        odds = odds + F.col(name) * F.lit(math.log(accuracy / (1 - accuracy)))
    probability = 1 / (1 + F.exp(-odds))
    return counted.withColumn("base_failed", base_failed()).withColumn("probability", probability).withColumn(
        "kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def oracle() -> str:
    """DuckDB SQL of the contract's columns, expectation maximisation unrolled."""
    names = [f"vote_{name}" for name in RULES]
    lines = [f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM s)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
  length(text) - length(replace(text, '!', '')) AS n_exclaims,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM s LEFT JOIN cov USING (doc_id)),
v AS MATERIALIZED (SELECT *, """ + ", ".join(f"{vote(*rule[:2])} AS vote_{name}" for name, rule in RULES.items()) + f""" FROM m),
p AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM v GROUP BY ALL),
e0 AS (SELECT {START_GOOD}::DOUBLE AS good, """ + ", ".join(f"{rule[2]}::DOUBLE AS r{i}" for i, rule in enumerate(RULES.values())) + ")"]
    odds = "ln(good / (1 - good))" + "".join(f" + {n} * ln(r{i} / (1 - r{i}))" for i, n in enumerate(names))
    for k in range(ROUNDS):
        rates = ", ".join(
            f"coalesce(least(greatest(sum(CASE {n} WHEN 1 THEN n * q WHEN -1 THEN n * (1 - q) ELSE 0 END) / nullif(sum(CASE WHEN {n} <> 0 THEN n ELSE 0 END), 0), "
            f"{rule[2]}), {rule[3]}), {rule[2]}) AS r{i}" for i, (n, rule) in enumerate(zip(names, RULES.values(), strict=True)))
        lines.append(f"e{k + 1} AS MATERIALIZED (SELECT least(greatest(sum(n * q) / sum(n), {LEAST_GOOD}), {MOST_GOOD}) AS good, {rates} "
                     f"FROM (SELECT p.*, 1 / (1 + exp(-({odds}))) AS q FROM p, e{k}))")
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return ",\n".join(lines) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
  NOT {failed} AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM v, e{ROUNDS}"""
