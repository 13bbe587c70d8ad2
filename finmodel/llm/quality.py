"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each document gives a few measures: symbols among its letters, repeated lines among its lines (parts per million), and the mean
length of its words (thousandths). Their distributions per language and source are kept in log-linear histograms: the key of a
bucket is the value with all but its KEEP leading bits cleared, so a quantile is exact up to 1/64 of its size, two sketches merge
by adding counts, and the result does not depend on the order of merging. No cutoff is fixed: a fence stands SPREAD times the
spread of the group beyond its quartiles. The spread is the distance of the quartiles, or what the sketch of the documents' sizes
says that chance alone makes of it: EVENTS symbols (or lines) in a document of the group's median size; for word lengths the
error of the sketch. Quartiles and medians are smoothed hierarchically: those of a group towards those of its language, these
towards all, as if the parent had SMOOTH documents. So a small group has fences too, and there is no size at which the rule
changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import cut, row_key, without

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPREAD, EVENTS, SMOOTH, KEEP = 6, 2, 20, 7
#: Measures with an upper fence, and the size that each is a share of; the measure that has fences on both sides.
SHARES, LENGTH = {"symbol_ppm": "word_chars", "dup_line_ppm": "n_lines"}, "word_milli"
MEASURES = (*SHARES, LENGTH)
SKETCHED = (*MEASURES, *SHARES.values())
#: Rows of the table of fences (one per language and source) up to which it is broadcast; beyond, it is joined by shuffling.
BROADCAST_GROUPS = 100_000
BLANKS, SYMBOLS = ("\t", "\n", "\x0b", "\x0c", "\r"), "#*$%&|<>"

_REPEATS = """
aggregate(transform(places, (p, k) -> least(3L, coalesce(get(places, k + 1), p + 3) - p)), 0L, (x, y) -> x + y)
"""
_PLACES = """
sort_array(transform(filter(packed, (v, k) ->
       (shiftright(v, wide) = shiftright(get(packed, k - 1), wide)
        AND words[CAST(v & mask AS INT)] = words[CAST(get(packed, k - 1) & mask AS INT)]
        AND words[CAST(v & mask AS INT) + 1] = words[CAST(get(packed, k - 1) & mask AS INT) + 1]
        AND words[CAST(v & mask AS INT) + 2] = words[CAST(get(packed, k - 1) & mask AS INT) + 2])
    OR (shiftright(v, wide) = shiftright(get(packed, k + 1), wide)
        AND words[CAST(v & mask AS INT)] = words[CAST(get(packed, k + 1) & mask AS INT)]
        AND words[CAST(v & mask AS INT) + 1] = words[CAST(get(packed, k + 1) & mask AS INT) + 1]
        AND words[CAST(v & mask AS INT) + 2] = words[CAST(get(packed, k + 1) & mask AS INT) + 2])), v -> v & mask))
"""


def _without(text: Column, chars) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` plus the base counts of each whole text, its lines and MEASURES.

    A window of three words is found again by sorting (hash, position) numbers and comparing the words of neighbours, so a text
    of n words costs n log n however often it repeats. Null text has no words; nothing else is read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blanked = F.col("t")
    for c in BLANKS:
        blanked = F.replace(blanked, F.lit(c), F.lit(" "))
    one = docs.select(*keep, text.alias("t"))
    two = one.select(*keep, "t", F.array_remove(F.split(blanked, " "), "").alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(_without(x, (" ", *BLANKS))) > 0)
    counted = two.select(
        *keep,
        "words",
        lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.length(F.bin(F.size("words"))).alias("wide"),
    )
    three = counted.select(
        *keep, "words", "wide", "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("shiftleft(1L, wide) - 1L").alias("mask"),
        F.expr("""CASE WHEN n_words >= 3 THEN sort_array(transform(slice(words, 1, CAST(n_words - 2 AS INT)),
            (x, k) -> shiftleft(xxhash64(x, get(words, k + 1), get(words, k + 2)), wide) | CAST(k AS BIGINT))) ELSE CAST(array() AS ARRAY<BIGINT>) END""").alias("packed"),
    )
    four = three.withColumn("places", F.expr(_PLACES))
    share = lambda x, of, unit: F.when(F.col(of) > 0, F.expr(f"({x} * {unit}L) div {of}")).otherwise(F.lit(0)).cast("long")
    return four.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(_REPEATS).cast("long").alias("n_repeat_words"), "n_lines",
        share("n_symbols", "word_chars", 1_000_000).alias("symbol_ppm"), share("n_dup_lines", "n_lines", 1_000_000).alias("dup_line_ppm"), share("word_chars", "n_words", 1000).alias(LENGTH),
    ).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def sketch(measured: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Mergeable quantile sketches of the documents that pass the base rules: (by..., measure, bucket, n)."""
    pairs = F.explode(F.create_map(*[x for m in SKETCHED for x in (F.lit(m), F.col(m))])).alias("measure", "value")
    rows = measured.where("NOT base_failed").select(*by, pairs)
    drop = f"greatest(0, length(bin(value)) - {KEEP})"
    return rows.groupBy(*by, "measure", F.expr(f"shiftleft(shiftright(value, {drop}), {drop})").alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


_QUANTILES = {"low": 25, "mid": 50, "high": 75}


def quantiles(sketches: DataFrame, by: tuple[str, ...], prefix: str) -> DataFrame:
    """(by..., measure, docs, low, mid, high), the last four with a prefix: a group has at most a few hundred buckets per measure."""
    keys = [*by, "measure"]
    cols = ", ".join(keys)
    ranked = sketches.select(*keys, "bucket", "n", F.expr(f"sum(n) OVER (PARTITION BY {cols} ORDER BY bucket)").alias("upto"), F.expr(f"sum(n) OVER (PARTITION BY {cols})").alias("docs"))
    at = [F.min(F.when(F.expr(f"100 * upto >= {p} * docs"), F.col("bucket"))).alias(f"{prefix}_{q}") for q, p in _QUANTILES.items()]
    return ranked.groupBy(*keys).agg(F.max("docs").alias(f"{prefix}_docs"), *at)


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per language and source that has a document which passes the base rules: a fence per measure, and one below."""
    parts = cut(sketch(measured), "sketches")
    own = quantiles(parts, ("lang", "source"), "own").alias("o")
    lang = quantiles(merge(parts, ("lang",)), ("lang",), "lang").alias("l")
    every = quantiles(merge(parts, ()), (), "all").alias("e")
    joined = own.join(lang, F.expr("o.lang <=> l.lang AND o.measure = l.measure")).join(every, F.expr("o.measure = e.measure"))
    smooth = lambda x, over, n: f"(({n}_docs * {n}_{x} + {SMOOTH} * {over}) div ({n}_docs + {SMOOTH}))"
    fused = joined.select("o.lang", "o.source", "o.measure", *[F.expr(smooth(q, smooth(q, f"all_{q}", "lang"), "own")).alias(q) for q in _QUANTILES])
    wide = fused.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(q))).alias(f"{m}_{q}") for m in SKETCHED for q in _QUANTILES])
    far = lambda m, chance: f"{SPREAD} * greatest({m}_high - {m}_low, {chance})"
    fences = [F.expr(f"{m}_high + " + far(m, f"({EVENTS} * 1000000L) div greatest({of}_mid, 1)")).alias(f"{m}_fence") for m, of in SHARES.items()]
    error = f"{LENGTH}_high div {1 << (KEEP - 1)} + 1"
    return wide.select("lang", "source", *fences, F.expr(f"{LENGTH}_high + {far(LENGTH, error)}").alias(f"{LENGTH}_fence"), F.expr(f"{LENGTH}_low - {far(LENGTH, error)}").alias("below_fence"))


def judge(measured: DataFrame, table: DataFrame) -> DataFrame:
    """``measured`` with the fences and ``kept``. A group without a sketch (all its documents failed the base rules) has only failures."""
    t = table.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"{m}_fence" for m in MEASURES], "below_fence")
    t = cut(t, "fences")
    if t.count() <= BROADCAST_GROUPS:
        t = F.broadcast(t)
    out = measured.join(t, F.expr("lang <=> t_lang AND source <=> t_source"), "left").drop("t_lang", "t_source")
    beyond = " OR ".join([*(f"coalesce({m} > {m}_fence, false)" for m in MEASURES), f"coalesce({LENGTH} < below_fence, false)"])
    return out.withColumn("kept", F.expr(f"NOT (base_failed OR {beyond})"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``op3`` keeps, with all their columns, whatever their names.

    Only measures are written; the rows that go are named by doc_id and a hash of text, language and source. Null ids and repeated
    rows are judged like any other, an empty table gives an empty result.
    """
    told = ("text", "lang", "source")
    rows = docs.select(F.col("doc_id").alias("id"), row_key(*map(F.col, told)).alias("key"), *told)
    measured = cut(measure(rows, ("id", "key", "lang", "source")), "measured")
    return without(docs, judge(measured, thresholds(measured)).where("NOT kept").select("id", "key"), told)


def op3(docs: DataFrame) -> DataFrame:
    """The base counts, ``base_failed`` and ``kept`` for every row of ``docs`` (doc_id, text, lang, source), and the measures.

    Null text counts as no words and fails; null languages and sources are groups of their own; repeated rows are judged alike
    and each counts in its sketch; a text is measured whole, however long; other columns are ignored; an empty table gives an
    empty result.
    """
    measured = cut(measure(docs), "measured")
    return judge(measured, thresholds(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)


def _oracle() -> str:
    levels = {"own": "lang, source,", "lang": "lang,", "all": ""}
    tables = ", ".join(
        f"""h_{k} AS (SELECT {by} measure, bucket, count(*) AS n FROM b GROUP BY ALL),
r_{k} AS (SELECT *, sum(n) OVER (PARTITION BY {by} measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by} measure) AS docs FROM h_{k}),
q_{k} AS (SELECT {by} measure, CAST(max(docs) AS BIGINT) AS docs, {", ".join(f"min(bucket) FILTER (WHERE 100 * upto >= {p} * docs) AS {q}" for q, p in _QUANTILES.items())} FROM r_{k} GROUP BY ALL)"""
        for k, by in levels.items()
    )
    smooth = lambda x, over, n: f"(({n}.docs * {n}.{x} + {SMOOTH} * {over}) // ({n}.docs + {SMOOTH}))"
    fused = ", ".join(f"{smooth(q, smooth(q, f'a.{q}', 'l'), 'o')} AS {q}" for q in _QUANTILES)
    wide = ", ".join(f"max({q}) FILTER (WHERE measure = '{m}') AS {m}_{q}" for m in SKETCHED for q in _QUANTILES)
    far = lambda m, chance: f"{SPREAD} * greatest({m}_high - {m}_low, {chance})"
    fences = ", ".join(f"{m}_high + {far(m, f'({EVENTS} * 1000000) // greatest({of}_mid, 1)')} AS {m}_fence" for m, of in SHARES.items())
    error = f"{LENGTH}_high // {1 << (KEEP - 1)} + 1"
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, k, words[k] || ' ' || words[k+1] || ' ' || words[k+2] AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS k FROM w)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT k + d) AS n FROM again, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words FROM w LEFT JOIN cover USING (doc_id)),
f AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000000 // word_chars ELSE 0 END AS symbol_ppm, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END AS dup_line_ppm,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_milli, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{x}' AS measure, {x} AS x FROM f WHERE NOT base_failed" for x in SKETCHED)}),
b AS (SELECT lang, source, measure, (x >> greatest(0, length(bin(x)) - {KEEP})) << greatest(0, length(bin(x)) - {KEEP}) AS bucket FROM v),
{tables},
s AS (SELECT o.lang, o.source, o.measure, {fused} FROM q_own o JOIN q_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN q_all a ON o.measure = a.measure),
x AS (SELECT lang, source, {wide} FROM s GROUP BY ALL),
t AS (SELECT lang, source, {fences}, {LENGTH}_high + {far(LENGTH, error)} AS {LENGTH}_fence, {LENGTH}_low - {far(LENGTH, error)} AS below_fence FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR {" OR ".join(f"coalesce({m} > {m}_fence, false)" for m in MEASURES)} OR coalesce({LENGTH} < below_fence, false)) AS kept, {", ".join(MEASURES)}
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""  # fmt: skip


ORACLE_SQL = _oracle()
