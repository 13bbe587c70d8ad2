"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a document's language are multiplied: the likelihood of its text under character trigrams, the
language that its markup (or metadata) declares, the suffix of its address, and a prior of its host. The host's prior is
smoothed towards that of its parent domain, and that towards all hosts, by counts that one grouped aggregation over the whole
corpus gathers; a document's own share is taken out of its host before it is used, so no text counts twice. A text whose trigrams
are far less likely than the text of any known language is none of them, whatever else speaks for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ._io import cut, row_key, without
from .bytebpe import as_texts

#: Rows per language that the trigram model is fitted on.
TRAIN_ROWS = 500
#: Buckets of hashed trigrams; trigrams of a text that count as independent; how often a declaration or suffix is right.
BUCKETS, EVIDENCE, DECLARED_RIGHT, SUFFIX_RIGHT = 1 << 14, 60, 0.9, 0.7
#: Documents that a parent's prior weighs as, and the posterior below which no language is given.
SMOOTH, LEAST_POSTERIOR = 20.0, 0.5
#: How far below a language's own mean log-probability a text may lie: in standard deviations of a trigram, and of the mean of as many
#: as count as independent (a third of the text's).
FLOOR, FLOOR_SHORT = 1.5, 4.0
#: Hosts up to whose number their priors are broadcast; beyond, they are joined by shuffling.
BROADCAST_HOSTS = 100_000
#: Three-letter codes of languages that also have a two-letter one.
SHORTER = {"deu": "de", "ger": "de", "eng": "en", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "nld": "nl", "dut": "nl", "por": "pt", "pol": "pl"}
#: Country suffixes and the language they speak for.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "nl": "nl", "pt": "pt", "br": "pt", "pl": "pl"}


def trigrams(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the lower-cased text; texts without a letter have none."""
    if not any(map(str.isalpha, text)):
        return np.zeros(BUCKETS, np.int64)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    h = (c[:-2] * np.uint64(961748927) + c[1:-1] * np.uint64(31393) + c[2:] * np.uint64(97)) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount((h >> np.uint64(50)).astype(np.intp), minlength=BUCKETS)


class Model:
    """Trigram log-probabilities (language x bucket)."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.log = np.log(share).astype(np.float32)
        self.mean = (share * self.log).sum(1)
        self.deviation = np.sqrt(np.maximum(0.0, (share * self.log**2).sum(1) - self.mean**2))

    def likelihood(self, text: str) -> list[float] | None:
        """Relative likelihood of the text per language; None if it has no letters or is in none of the languages."""
        g = trigrams(text)
        n = int(g.sum())
        if not n or not self.languages:
            return None
        at = np.flatnonzero(g)
        mean = self.log[:, at] @ g[at] / n
        if not (mean >= self.mean - self.deviation * (FLOOR + FLOOR_SHORT / np.sqrt(n / 3))).any():
            return None
        p = np.exp((mean - mean.max()) * min(n, EVIDENCE))
        return (p / p.sum()).tolist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
            sums[lang] = sums.get(lang, 0) + trigrams(text)
    for lang, g in sums.items():
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(g[at], pa.int64())], ["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> Model:
    """A model from (id, text, lang) rows: about TRAIN_ROWS whole texts of each language.

    The rows are those whose id hashes below a share of its range, so the sample does not depend on partitions. Trigrams are
    counted on the executors; the driver gets sums, at most BUCKETS per language, and no text. Labels are compared as ``plain_code``.
    """
    rows = labelled.select("id", "text", plain_code(F.col("lang")).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(max(1, round((1 << 20) * min(1.0, TRAIN_ROWS / n)))))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("lang", "text")
    counts = np.zeros((len(langs), BUCKETS))
    for r in chosen.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[langs.index(r["lang"]), r["bucket"]] = r["n"]
    return Model(langs, counts)


def _likelihoods(batches: Iterator[pa.RecordBatch], model, carry: list[str]) -> Iterator[pa.RecordBatch]:
    at = len(carry)
    for batch in batches:
        got = [model.value.likelihood(t) for t in as_texts(batch.column(at))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), pa.array(got, pa.list_(pa.float64()))], [*carry, "like"])


def plain_code(label: Column) -> Column:
    """The first part of a language tag, in lower case and two letters where it has such a code; null without one."""
    first = F.regexp_extract(F.lower(label.cast("string")), r"^\s*([a-z]+)", 1)
    short = F.create_map(*[F.lit(x) for kv in SHORTER.items() for x in kv])
    return F.when(first != "", F.coalesce(F.try_element_at(short, first), first))


def suffix_of(address: Column) -> Column:
    """The last label of a host or URL."""
    host = F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)", 1)
    return F.lower(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1))


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)", 1))


def parent_of(host: Column) -> Column:
    """The last two labels of a host; hosts without a dot have the empty parent."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def _evidence(value: Column, languages: list[str], right: float) -> Column:
    """P(evidence | language): neutral where it is missing or names no known language."""
    n = len(languages)
    options = [F.when(value == lang, F.lit(right)).otherwise(F.lit((1 - right) / max(n - 1, 1))) for lang in languages]
    known = F.coalesce(value.isin(languages), F.lit(False))
    return F.when(known, F.array(*options)).otherwise(F.array(*[F.lit(1.0)] * n))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` plus (language, posterior, text_language): ``docs`` has columns text, declared, address besides them.

    If the greatest posterior is below LEAST_POSTERIOR, or the text has no letters or is in none of the languages, the language is
    null. Null declarations and addresses are neutral; null addresses share the empty host.
    """
    spark, languages = docs.sparkSession, model.languages
    n = len(languages)
    if not n:
        return docs.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_language"))
    address = F.coalesce(F.col("address").cast("string"), F.lit(""))
    spoken = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix_of(address))
    pre = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept_"), plain_code(F.col("declared")).alias("declared_"), spoken.alias("spoken_"), host_of(address).alias("host_"), F.col("text").cast("string").alias("text_"))
    carry = ["kept_", "declared_", "spoken_", "host_"]
    schema = StructType([*(pre.schema[c] for c in carry), StructField("like", ArrayType(DoubleType()))])
    scored = cut(pre.mapInArrow(partial(_likelihoods, model=spark.sparkContext.broadcast(model), carry=carry), schema), "likelihoods")

    likes = scored.where("like IS NOT NULL")
    sums = [F.sum(F.col("like")[k]).alias(f"n{k}") for k in range(n)]
    hosts = cut(likes.groupBy("host_").agg(*sums), "hosts").withColumn("parent_", parent_of(F.col("host_")))
    parents = hosts.groupBy("parent_").agg(*[F.sum(f"n{k}").alias(f"p{k}") for k in range(n)])
    total = hosts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0.0)) for k in range(n)]).first()  # one row
    share = [(t + 1.0) / (sum(total) + n) for t in total]
    parent_sum = sum((F.col(f"p{k}") for k in range(1, n)), F.col("p0"))
    smooth = [((F.col(f"p{k}") + SMOOTH * share[k]) / (parent_sum + SMOOTH)) for k in range(n)]
    priors = cut(hosts.join(parents, "parent_"), "priors").select(F.col("host_").alias("h_"), F.array(*[f"n{k}" for k in range(n)]).alias("seen_"), F.array(*smooth).alias("above_"))

    if priors.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)
    joined = scored.join(priors, scored["host_"] == priors["h_"], "left")
    seen = F.coalesce("seen_", F.array(*[F.lit(0.0)] * n))
    above = F.coalesce("above_", F.array(*[F.lit(s) for s in share]))
    own = F.coalesce("like", F.array(*[F.lit(0.0)] * n))
    others = joined.select("kept_", "like", above.alias("above_"), F.zip_with(seen, own, lambda a, b: F.greatest(a - b, F.lit(0.0))).alias("others_"), _evidence(F.col("declared_"), languages, DECLARED_RIGHT).alias("d_"), _evidence(F.col("spoken_"), languages, SUFFIX_RIGHT).alias("s_"))
    mass = F.aggregate("others_", F.lit(0.0), lambda a, x: a + x)
    fused = others.select("kept_", "like", F.array(*[(F.col("others_")[k] + SMOOTH * F.col("above_")[k]) / (mass + SMOOTH) * F.coalesce(F.col("like")[k], F.lit(1.0)) * F.col("d_")[k] * F.col("s_")[k] for k in range(n)]).alias("w_"))
    top = fused.select("kept_", "like", "w_", F.array_max("w_").alias("most_"), F.aggregate("w_", F.lit(0.0), lambda a, x: a + x).alias("all_"))
    names = F.array(*[F.lit(x) for x in languages])
    posterior = F.col("most_") / F.col("all_")
    sure = (posterior >= LEAST_POSTERIOR) & F.col("like").isNotNull()
    return top.select(
        "kept_.*",
        F.when(sure, F.get(names, F.array_position("w_", F.col("most_")).cast("int") - 1)).alias("language"),
        F.round(posterior, 6).alias("posterior"),
        F.get(names, F.array_position("like", F.array_max("like")).cast("int") - 1).alias("text_language"),
    )


def documents_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare their language in ``lang`` and have their ``source`` as host."""
    return docs.withColumns({"declared": F.col("lang"), "address": F.col("source")})


def op5(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, language, posterior, text_language, kept) for every row; ``kept`` is false where no language is found.

    Null and letterless texts, and those in none of the languages, are not kept; nulls in other columns are neutral; repeated rows
    are judged alike; a text is scored whole, however long; other columns are ignored; an empty table gives an empty result.
    Ties between languages go to the first by name.
    """
    model = fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    src = documents_evidence(docs.select("doc_id", "text", "lang", "source"))
    return identify(src, model, ("doc_id", "lang")).withColumn("kept", F.col("language").isNotNull())


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language ``op5`` finds, with all their columns, whatever their names.

    Only likelihoods are written; the rows that go are named by doc_id and a hash of text, language and source. Null ids and repeated
    rows are judged like any other, an empty table gives an empty result.
    """
    model = fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    told = ("text", "lang", "source")
    rows = docs.select(F.col("doc_id").alias("id"), row_key(*map(F.col, told)).alias("key"), F.col("text"), F.col("lang").alias("declared"), F.col("source").alias("address"))
    return without(docs, identify(rows, model, ("id", "key")).where("language IS NULL").select("id", "key"), told)


def pages_language(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, language, posterior, text_language) of web pages: visible text, the html element's lang attribute, the URL.

    Null html has no letters and so no language; null URLs share a host; repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty result.
    """
    model = fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    src = pages.select("page_id", bare.alias("text"), F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1).alias("declared"), F.col("url").alias("address"))
    return identify(src, model, ("page_id",))
