"""Language ID by Bayesian fusion of evidence.

The posterior of a language is proportional to
    prior(language | host) * P(declared | language) * P(suffix | language) * P(text | language)^power
- text: smoothed 3-gram models of lower-cased bytes, one for each declared language, fitted on a
  bounded sample of labelled rows (at most SAMPLE different texts of a language, drawn by hash, for
  the LANGUAGES most declared); the power is min(1, EVIDENCE / n-grams), as neighbouring n-grams are
  not independent.  An ``und`` class has all n-grams equally likely;
- declared markup language and address suffix: their rates given the text's language, counted over
  all rows by grouped aggregation and smoothed, for every value that occurs;
- host: counted over all rows and smoothed hierarchically, host -> site -> everything.
Rows whose best class is ``und`` are rejected, unless they declare a language that has no model:
those keep the declared one.

Null and empty texts have no n-grams: rows without any n-gram are ``und`` and rejected.  Null
declared languages, suffixes and hosts are no evidence.  Repeated rows count each.  Without any
labelled row there is no language and everything is rejected.  All columns pass through.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, over_texts

#: Texts of a language that its model is fitted on, at most; languages that get a model; hashed n-gram buckets.
SAMPLE, LANGUAGES, BUCKETS = 2_000, 200, 1 << 16
#: Share of a language's n-grams that any bucket is equally likely to get.
UNSEEN = 0.1
#: N-grams' worth of evidence that a text has at most; weights of the parent in host priors and of the uniform rate elsewhere.
EVIDENCE, HOST_WEIGHT, RATE_WEIGHT = 60.0, 8.0, 4.0
UND = "und"
#: Prior weight of ``und`` at the root.
UND_PRIOR = 0.0001
#: Numbers (of 8 bytes) in a table of priors or rates that is broadcast at most; a larger one is joined by a shuffle.
BROADCAST = 2_000_000


def grams(text: str | None) -> np.ndarray:
    """Bucket of each 3-gram of bytes, ends marked by blanks."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.uint32)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(documents: DataFrame, text: str, label: str) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bucket by language."""
    labelled = documents.where(F.col(label).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(label).alias("__label"), F.col(text).alias("__text"))
    sizes = {r[0]: r[1] for r in labelled.groupBy("__label").count().orderBy(F.desc("count"), "__label").limit(LANGUAGES).collect()}
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * SAMPLE / n))))
        drawn = F.xxhash64("__text", F.lit(1))
        rows = labelled.withColumn("__drawn", drawn).where(F.pmod("__drawn", F.lit(1_000_000)) / 1e6 < share[F.col("__label")])
        place = F.row_number().over(Window.partitionBy("__label").orderBy("__drawn"))
        rows = rows.dropDuplicates(["__label", "__drawn"]).withColumn("__place", place).where(F.col("__place") <= SAMPLE).select("__label", "__text")

        def count(texts: pd.DataFrame) -> pd.DataFrame:
            n = sum((np.bincount(grams(t), minlength=BUCKETS) for t in texts["__text"]), np.zeros(BUCKETS, np.int64))
            return pd.DataFrame({"label": [texts["__label"].iloc[0]], "n": [n.tobytes()]})

        for r in rows.groupBy("__label").applyInPandas(count, "label string, n binary").toLocalIterator():
            counts[languages.index(r[0])] = np.frombuffer(r[1], dtype=np.int64)
    share_seen = counts / np.maximum(1, counts.sum(1, keepdims=True))
    return languages, np.log((1 - UNSEEN) * share_seen + UNSEEN / BUCKETS)


def text_scores(df: DataFrame, text: str, model: tuple[list[str], np.ndarray], into: str) -> DataFrame:
    """Adds the array of tempered log likelihoods, by language and then ``und``; null without n-grams."""
    shared = df.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))

    def score(texts: list) -> list:
        table = shared.value
        flat = -np.log(BUCKETS)
        out = []
        for t in texts:
            g = grams(t)
            power = min(1.0, EVIDENCE / len(g)) if len(g) else 0
            out.append([*(float(row[g].sum() * power) for row in table), float(len(g) * flat * power)] if len(g) and t.strip() else None)
        return out

    return df.withColumn(into, over_texts(score, "array<double>", pa.list_(pa.float64()))(F.col(text)))


def site(host: Column) -> Column:
    """The last two labels of a host, or the host itself."""
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column) -> Column:
    """Language-like part of an address: a two-letter first path segment, else a two-letter top domain."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1)
    top = F.regexp_extract(url, r"^[a-z]+://[^/?#:]+\.([a-z]{2})(?:[:/?#]|$)", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(top, F.lit("")))


def declared_of(html: Column) -> Column:
    """The primary tag of the lang attribute of the html element."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def _rates(counted: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """column, __rate: log P(value | language) of every value by language and then ``und``, smoothed towards the uniform rate."""
    per = [F.sum(F.when(F.col("__best") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(len(languages))]
    values = counted.where(F.col(column).isNotNull()).groupBy(column).agg(*per)
    totals = values.agg(F.count(F.lit(1)), *(F.sum(f"c{k}") for k in range(len(languages)))).first()
    flat = 1 / (totals[0] + 1)
    logs = [F.ln((F.col(f"c{k}") + RATE_WEIGHT * flat) / F.lit((totals[k + 1] or 0) + RATE_WEIGHT)) for k in range(len(languages))]
    return _fitting(values.select(column, F.array(*logs, F.lit(float(np.log(flat)))).alias("__rate")), totals[0] * (len(languages) + 1))


def _fitting(table: DataFrame, numbers: int) -> DataFrame:
    """The table, marked for broadcast if its numbers are few enough."""
    return F.broadcast(table) if numbers <= BROADCAST else table


def identify(df: DataFrame, *, text: str = "text", declared: str = "lang", suffix: str | None = None, host: str = "source") -> DataFrame:
    """The rows with __lang, __p (its posterior) and __accepted."""
    model = fit(df, text, declared)
    hint = F.col(suffix) if suffix else F.lit(None).cast("string")
    evidence = df.withColumns({"__text": F.col(text), "__declared": F.col(declared), "__suffix": hint, "__host": F.col(host)})
    scored = text_scores(evidence, "__text", model, "__scores")
    return posterior(scored, model[0]).select(*df.columns, "__lang", "__p", "__accepted")


def posterior(scored: DataFrame, languages: list[str]) -> DataFrame:
    """Adds __lang, __p and __accepted to rows with __scores, __declared, __suffix and __host; the counts are over all of them."""
    names = [*languages, UND]
    width = len(names)
    best = F.array_position(F.slice("__scores", 1, max(1, width - 1)), F.array_max(F.slice("__scores", 1, max(1, width - 1)))).cast("int") - 1
    small = scored.select("__declared", "__suffix", "__host", "__scores").where("__scores IS NOT NULL")
    counted = small.withColumn("__best", best).groupBy("__declared", "__suffix", "__host", "__best").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    # priors: counts by host and by site, smoothed down the hierarchy
    root_counts = {r["__best"]: r["n"] for r in counted.groupBy("__best").agg(F.sum("n").alias("n")).collect()}
    total = sum(root_counts.values())
    root = [(root_counts.get(k, 0) + 1) / (total + len(languages)) * (1 - UND_PRIOR) for k in range(len(languages))]
    per = lambda k: F.sum(F.when(F.col("__best") == k, F.col("n")).otherwise(0))
    by_host = counted.where("__host IS NOT NULL").groupBy("__host").agg(F.array(*(per(k) for k in range(len(languages)))).alias("c")) if languages else None
    log_root = F.array(*(F.lit(float(np.log(x))) for x in [*root, UND_PRIOR]))
    priors = None
    if by_host is not None:
        sites = by_host.groupBy(site(F.col("__host")).alias("__site")).agg(*(F.sum(F.col("c")[k]).alias(f"s{k}") for k in range(len(languages))))
        site_total = reduce(Column.__add__, (F.col(f"s{k}") for k in range(len(languages))))
        site_p = sites.select("__site", F.array(*((F.col(f"s{k}") + HOST_WEIGHT * root[k]) / (site_total + HOST_WEIGHT * (1 - UND_PRIOR)) for k in range(len(languages)))).alias("s"))
        host_total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
        smoothed = F.zip_with("c", "s", lambda c, s: F.ln((c + HOST_WEIGHT * s) / (host_total + HOST_WEIGHT) * (1 - UND_PRIOR)))
        priors = by_host.withColumn("__site", site(F.col("__host"))).join(site_p, "__site").select("__host", F.concat(smoothed, F.array(F.lit(float(np.log(UND_PRIOR))))).alias("__prior"))
        priors = _fitting(priors, by_host.count() * width)
    scored = scored.join(priors, "__host", "left") if priors is not None else scored.withColumn("__prior", F.lit(None).cast("array<double>"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    scored = scored.withColumn("__logs", add(F.coalesce("__prior", log_root), F.col("__scores")))
    for column in ("__declared", "__suffix") if languages else ():
        rates = _rates(counted, column, languages)
        scored = scored.join(rates, column, "left").withColumn("__logs", F.when(F.col("__rate").isNull(), F.col("__logs")).otherwise(add(F.col("__logs"), F.col("__rate")))).drop("__rate")
    top = F.array_max("__logs")
    p = 1 / F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("__logs")))
    lang = F.coalesce(F.get(F.array(*map(F.lit, names)), F.array_position("__logs", top).cast("int") - 1), F.lit(UND))
    # a declared language without a model is kept where the models see nothing in the text
    other = F.col("__scores").isNotNull() & F.col("__declared").isNotNull() & ~F.array_contains(F.array(*map(F.lit, names)), F.col("__declared"))
    lang = F.when((lang == UND) & other, F.col("__declared")).otherwise(lang)
    return scored.withColumns({"__lang": lang, "__p": F.coalesce(p, F.lit(1.0)), "__accepted": lang != UND})


def accepted(documents: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    return identify(documents).where("__accepted").select(*documents.columns)


def page_text(html: Column) -> Column:
    """Running text of a page for its language only: without scripts, styles, comments and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " "), r"<[^>]*>", " ")


def report(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each document and each page: its language, the posterior, and whether it is accepted."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = documents.select("doc_id", none("long").alias("page_id"), "text", "lang", none("string").alias("suffix"), F.col("source").alias("host"))
    host = F.nullif(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1), F.lit(""))
    more = pages.select(none("long").alias("doc_id"), "page_id", page_text(F.col("html")).alias("text"), declared_of(F.col("html")).alias("lang"), suffix_of(F.col("url")).alias("suffix"), host.alias("host"))
    rows = rows.unionByName(more)
    model = fit(rows, "text", "lang")
    evidence = rows.withColumnsRenamed({"lang": "__declared", "suffix": "__suffix", "host": "__host"})
    out = posterior(cut(text_scores(evidence, "text", model, "__scores").drop("text")), model[0])
    return out.select("doc_id", "page_id", F.col("__lang").alias("language"), F.col("__p").alias("posterior"), F.col("__accepted").alias("accepted"))
