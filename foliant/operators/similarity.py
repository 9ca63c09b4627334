"""A bounded relevance score, close to 1 whatever the corpus.

``boost * (idf + tf)`` with ``idf`` 1 unless ``max_idf`` is set, and ``tf`` between 0 and ``max_tf``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Settings:
    max_idf: float = 0.0
    max_tf: float = 0.2
    force_tf: int = -1
    bias_tf: float = 0.6
    discount_overlaps: bool = True


def field_length(stream: Column, settings: Settings = Settings()) -> Column:
    """Length of a full token stream; tokens on the position of another don't count if overlaps are discounted."""
    return F.size(F.filter(stream, lambda t: t["pos_inc"] > 0)) if settings.discount_overlaps else F.size(stream)


def idf(n: Column, df: Column, settings: Settings) -> Column:
    if settings.max_idf == 0:
        return F.lit(1.0)
    most = F.log(1 + (n - 0.5) / 1.5)
    return 1 + settings.max_idf * F.log(1 + (n - df + 0.5) / (df + 0.5)) / most


def tf(freq: Column, length: Column, settings: Settings) -> Column:
    f = F.lit(float(settings.force_tf)) if settings.force_tf > 0 else freq.cast("double")
    f = F.least(f, F.lit(255.0), length.cast("double"))
    return settings.max_tf * F.log(settings.bias_tf + f) / F.log(settings.bias_tf + length)


def score(freq: Column, length: Column, n: Column, df: Column, settings: Settings = Settings(), boost: float = 1.0) -> Column:
    return boost * (idf(n, df, settings) + tf(freq, length, settings))


def scored(docs: DataFrame, terms_column: str, query: list[str], settings: Settings = Settings(), boost: float = 1.0, boosts: dict[str, float] | None = None, explain: bool = False, phrase: bool = False, parent_term: str = "") -> DataFrame:
    """Rows that hold any of the query's terms, with their summed ``score``.

    The column holds strings, or full tokens; of these, tokens on another's position don't count for the length if
    ``discount_overlaps``.  Document frequencies are global and count every row of ``docs``, deleted ones as well.  They
    come from one aggregation, joined as a single row.  With ``phrase``, all terms share the largest document frequency.
    ``explain`` adds an ``explanation``: a struct per term with its numbers, a description and the details behind it.
    """
    full = isinstance(docs.schema[terms_column].dataType.elementType, T.StructType)
    length = field_length(F.col(terms_column), settings) if full else F.size(terms_column)
    words = F.transform(terms_column, lambda t: t["term"]) if full else F.col(terms_column)
    need_counts = settings.max_idf != 0 or explain
    rows = docs
    if need_counts:
        stats = docs.agg(F.count("*").alias("_n"), *[F.count_if(F.array_contains(words, t)).alias(f"_df{i}") for i, t in enumerate(query)])
        rows = docs.crossJoin(F.broadcast(stats))  # one row
    parts, details = [], []
    for i, t in enumerate(query):
        df = F.col(f"_df{i}") if need_counts else F.lit(1)
        if phrase and need_counts:
            df = F.greatest(*[F.col(f"_df{j}") for j in range(len(query))]) if len(query) > 1 else df
        n = F.col("_n") if need_counts else F.lit(1)
        b = boost * (boosts or {}).get(t, 1.0)
        present = F.array_contains(words, t)
        freq = _frequency(words, t)
        parts.append(F.when(present, score(freq, length, n, df, settings, b)).otherwise(0.0))
        if explain:
            why = explained(freq, length, n, df, settings, b, parent_term)
            details.append(F.struct(F.lit(t).alias("term"), F.lit(b).alias("boost"), freq.alias("freq"), df.cast("long").alias("df"), idf(n, df, settings).alias("idf"), F.when(present, tf(freq, length, settings)).alias("tf"), parts[-1].alias("score"), F.when(present, why["description"]).alias("description"), F.when(present, why["details"]).alias("details")))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    out = rows.where(F.arrays_overlap(words, F.array(*[F.lit(t) for t in query]))).withColumn("score", total)
    if explain:
        out = out.withColumn("explanation", F.array(*details))
    return out.drop("_n", *[f"_df{i}" for i in range(len(query))])


def explained(freq: Column, length: Column, n: Column, df: Column, settings: Settings = Settings(), boost: float = 1.0, parent_term: str = "") -> Column:
    """Struct of ``value, description, details`` of one term's score.

    Without inverse document frequency and boost the description is that of the frequency part, and there are no
    details; otherwise they are the frequency part, then what is added, then what it is multiplied by.  A
    ``parent_term`` stands in front of the description, with a slash.
    """
    inverse = idf(n, df, settings)
    part = tf(freq, length, settings)
    said = F.format_string(f"tfBoost (tf=%.1f, fieldlen=%d, maxTf={settings.max_tf:.2f}, forceTf={settings.force_tf:.1f}, bias={settings.bias_tf:.2f})", freq.cast("double"), length.cast("long"))
    one = lambda value, text: F.struct(value.alias("value"), text.alias("description"))
    details = []
    if settings.max_idf != 0:
        details.append(one(inverse, F.format_string(f"+= idf=%.3f (docs=%d out of %d, maxIdf={settings.max_idf:.3f})", inverse, df.cast("long"), n.cast("long"))))
    if boost != 1.0:
        details.append(one(F.lit(float(boost)), F.lit(f"*= boost={boost:.3f}")))
    prefix = f"{parent_term}/" if parent_term else ""
    if not details:
        return F.struct((inverse + part).alias("value"), F.concat(F.lit(prefix), said).alias("description"), F.array().cast("array<struct<value: double, description: string>>").alias("details"))
    first = one(part if settings.max_idf != 0 else inverse + part, said)
    return F.struct(score(freq, length, n, df, settings, boost).alias("value"), F.lit(prefix + "Combined from:").alias("description"), F.array(first, *details).alias("details"))


def _frequency(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def weighted_term(terms_column: str, term: str, freq_score: Column, weight: float) -> Column:
    """Score of a single term times a weight, null where the row doesn't hold it."""
    return F.when(F.array_contains(terms_column, term), freq_score * weight)
