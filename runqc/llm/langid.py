"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runqc.llm.common import give_back
from runqc.session import written

#: Labelled texts per language that the likelihoods are fitted on, least hash of the id first. A documented bound.
SAMPLE_PER_LANGUAGE = 400
TABLE = 1 << 16
SMOOTH = 0.5
#: Each byte is in three overlapping trigrams, so their summed evidence counts a third.
TEMPER = 1 / 3
#: Pseudo-counts with which a level of the hierarchy leans on the one above it.
LEAN = 10.0
#: Count tables of so many keys at most, each a few numbers a language, are broadcast; larger ones are shuffled to.
BROADCAST_ROWS = 100_000
#: Below this posterior a language counts as not found.
CONFIDENT = 0.5
MARKUP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
NOT_LETTERS = re.compile(r"[\W\d_]+")


def markup_text(page: str | None) -> str:
    """Visible text of a page: scripts, styles, comments and tags become blanks, entities are resolved."""
    return "" if page is None else html.unescape(MARKUP.sub(" ", page))


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text with one blank for each run of non-letters."""
    b = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32) if text else np.zeros(0, np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class TextModel:
    """log P(trigram | language), fitted with additive smoothing."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({language for language, _ in samples})
        counts = np.zeros((TABLE, len(self.languages)))
        for language, text in samples:
            counts[:, self.languages.index(language)] += np.bincount(trigrams(text), minlength=TABLE)
        self.logp = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * TABLE)).astype(np.float32)

    def evidence(self, text: str | None) -> list[float] | None:
        """Tempered log likelihood per language, the largest at 0; None for a text without letters."""
        grams = trigrams(text)
        if not len(grams):
            return None
        total = sum(self.logp[grams[i:i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(grams), 65536)) * TEMPER
        return (total - total.max()).tolist()


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> TextModel:
    """Fits the text model on at most ``per_language`` texts of each declared language. Rows with NULLs are not used.

    The ids are chosen on narrow rows in salted steps, then their texts are fetched; only this bounded sample reaches
    the driver.
    """
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null and lang <> ''")
    chosen = rows.select("id", "lang", F.xxhash64("id").alias("h")).withColumn("salt", F.pmod("h", F.lit(16)))
    for keys in (["lang", "salt"], ["lang"]):
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id"))).where(F.col("n") <= per_language)
    chosen = written(chosen.select("id", "lang").distinct(), "langid-sample")
    few = chosen.count() <= BROADCAST_ROWS  # then the texts stay where they are
    sample = rows.join(F.broadcast(chosen) if few else chosen, ["id", "lang"], "left_semi").select("lang", "text")
    return TextModel([(r.lang, r.text) for r in sample.toLocalIterator()])


def _evidence(model, is_markup: bool):
    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        read = markup_text if is_markup else lambda t: t
        found = pa.array([model.value.evidence(read(t.as_py())) for t in texts], pa.list_(pa.float64()))
        give_back()
        return found

    return evidence


def declared_language(value: Column) -> Column:
    """Primary tag of a language attribute: 'en-US' gives 'en'; blank gives NULL."""
    return F.nullif(F.substring_index(F.lower(F.trim(value)), "-", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def identify(rows: DataFrame, model: TextModel, text: str, declared: Column, host: Column, suffix: Column, is_markup: bool = False) -> DataFrame:
    """``doc`` (the row), ``language``, ``confidence``, ``text_language``, ``declared``, ``suffix``, ``host``.

    posterior(l) ~ P(text | l) P(declared | l) P(suffix | l) P(l | host). The last three come from grouped counts of the
    language that the texts alone point to, over all rows: declared and suffix are smoothed towards their overall share,
    hosts towards their domain (last two labels) and domains towards all rows. One row per host, domain, suffix or
    declared tag is joined back, so a hot host is one joined row; few keys are broadcast, so that rows stay where they are.

    A text without letters (NULL, empty, marks only) gives no evidence and counts nowhere; its language is NULL with
    confidence 0. A NULL or unseen tag, suffix or host says nothing. Equal evidence is resolved by language order.
    """
    spark = rows.sparkSession
    languages = model.languages
    if not languages:
        return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"),
                           F.lit(None).cast("string").alias("text_language"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"))
    shared = spark.sparkContext.broadcast(model)
    names = F.array(*map(F.lit, languages))
    scored = written(
        rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("doc"), _evidence(shared, is_markup)(F.col(text)).alias("evidence"),
                    declared.alias("declared"), suffix.alias("suffix"), host.alias("host")),
        "langid",
    ).withColumn("text_language", F.get(names, F.array_position("evidence", F.array_max("evidence")).cast("int") - 1))
    known = scored.where("text_language is not null")

    def counts(*keys: str) -> DataFrame:
        each = [F.count_if(F.col("text_language") == name).cast("double") for name in languages]
        grouped = known.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys) if keys else known.groupBy()
        return grouped.agg(F.array(*each).alias("n"))

    total = counts().first().n  # one row
    share = [(n + 1) / (sum(total) + len(languages)) for n in total]
    parent = F.array(*map(F.lit, share))
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    lean = lambda n, up: F.zip_with(n, up, lambda x, p: (x + LEAN * p) / (sum_of(n) + LEAN))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    hosts = counts("host").withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(len(languages))]).alias("up")).withColumn("up", lean(F.col("up"), parent))
    prior = hosts.join(domains, "domain").select("host", lean(F.col("n"), F.col("up")).alias("prior"))

    def likelihood(key: str) -> DataFrame:
        smoothed = [(F.col("n")[i] + LEAN * sum_of(F.col("n")) / max(1.0, sum(total))) / (total[i] + LEAN) for i in range(len(languages))]
        return counts(key).select(key, F.array(*smoothed).alias(f"{key}_likelihood"))

    joined = scored
    for key, table in (("host", prior), ("declared", likelihood("declared")), ("suffix", likelihood("suffix"))):
        table = written(table, "langid-counts")
        joined = joined.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, key, "left")
    log_of = lambda column, i, default: F.coalesce(F.log(F.col(column)[i]), F.lit(float(default)))
    posterior = F.array(*[
        F.col("evidence")[i] + log_of("prior", i, np.log(share[i])) + log_of("declared_likelihood", i, 0) + log_of("suffix_likelihood", i, 0)
        for i in range(len(languages))])
    joined = joined.withColumn("posterior", posterior).withColumn("most", F.array_max("posterior"))
    found = F.col("text_language").isNotNull()
    return joined.select(
        "doc",
        F.when(found, F.get(names, F.array_position("posterior", F.col("most")).cast("int") - 1)).alias("language"),
        F.when(found, 1 / F.aggregate("posterior", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))).otherwise(0.0).alias("confidence"),
        "text_language", "declared", "suffix", "host",
    )


def page_languages(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``page_id, language, confidence, text_language, declared, suffix, host`` for raw web pages."""
    host = host_of(F.col(url))
    attribute = F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z\-]+)", 1)
    suffix = F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))
    found = identify(pages.select(page_id, url, markup), fit(labelled), markup, declared_language(attribute), host, suffix, is_markup=True)
    return found.select(F.col(f"doc.{page_id}").alias("page_id"), "language", "confidence", "text_language", "declared", "suffix", "host")


def known_language(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", confident: float = CONFIDENT) -> DataFrame:
    """The rows of ``docs`` whose language is found with at least ``confident``: declared by ``lang``, hosted by ``source``.

    Rejected are texts without letters and texts that no language explains better than the others together.
    """
    found = identify(docs, fit(labelled), text, declared_language(F.col(lang)), F.col(source), F.lit(None).cast("string"))
    return found.where(F.col("confidence") >= confident).select("doc.*")
