"""Language identification by Bayesian fusion of evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .scratch import T, join_groups, write_table
from .url_filter import url_host

#: Labelled rows that the text model is fitted on, about, at most.
SAMPLE = 8000
#: Hash buckets of byte trigrams.
BUCKETS = 1 << 16
#: Trigrams that a text counts for at most: its mean log-likelihood is weighed by ``n * T / (n + T)`` of its n trigrams.
TEMPER = 60.0
#: Rows that a parent's share counts for in its child's prior.
PSEUDO_ROWS = 5.0
#: Least posterior of the language that is named.
CONFIDENCE = 0.5
#: Bytes of text scored at a time.
SLICE = 1 << 20
UNKNOWN = "und"

#: Hosts whose owner's name is the third label from the end.
_SECOND_LEVEL = r"\.(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}$"

_FOLD = np.full(256, 32, np.uint32)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte, and whether that byte is of a letter."""
    folded = _FOLD[data]
    padded = np.concatenate([[np.uint32(32)], folded, [np.uint32(32)]]).astype(np.uint32)
    code = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
    return (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64), folded != 32


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' bytes with a blank after each, and where each begins, slice by slice."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        part.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(part[-1]) + 1
        if size >= SLICE:
            yield _joined(part)
            part, size = [], 0
    if part:
        yield _joined(part)


def _joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(t) + 1 for t in part[:-1]])
    return np.frombuffer(b" ".join(part) + b" ", np.uint8), starts


@dataclass(frozen=True)
class TextModel:
    """Log-likelihood of each trigram bucket under each language, above the mean over languages."""

    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages, float32

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the sums for each language and its number of trigrams."""
        sums, counts = [np.empty((0, len(self.languages)))], [np.empty(0, np.int64)]
        for data, starts in _slices(texts):
            code, letter = _grams(data)
            weights = self.weights[code]
            weights[~letter] = 0
            sums.append(np.add.reduceat(weights, starts, axis=0, dtype=np.float64))
            counts.append(np.add.reduceat(letter, starts, dtype=np.int64))
        return np.concatenate(sums), np.concatenate(counts)


def fit_text_model(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", key: str = "doc_id", seed: int = 3) -> TextModel:
    """Trigram counts of about ``sample`` rows (all, if fewer), drawn by a hash of ``key``; add-half smoothing.

    The sample is written first, so that all tasks share the read; 16 tasks then count it and send one table a language each. Rows without
    label or text don't count; without any, the model knows no language.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = labelled.where(F.col(lang).isNotNull()).agg(F.count(F.lit(1))).first()[0]
    share = min(1.0, sample / max(1, rows))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for one in sorted(set(langs)):
                mine = totals.setdefault(one, np.zeros(BUCKETS, np.int64))
                for data, _ in _slices(batch.column(0).filter(pa.array(langs == one))):
                    code, letter = _grams(data)
                    mine += np.bincount(code[letter], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["lang", "counts"])

    tables: dict[str, np.ndarray] = {}
    for row in write_table(drawn.select(text, lang), "sample").coalesce(16).mapInArrow(tidy(count), "lang string, counts binary").collect():
        tables[row["lang"]] = tables.get(row["lang"], 0) + np.frombuffer(row["counts"], np.int64)
    languages = tuple(sorted(tables))
    if not languages:
        return TextModel((), np.zeros((BUCKETS, 0), np.float32))
    counts = np.stack([tables[k] for k in languages], axis=1) + 0.5
    logs = np.log(counts / counts.sum(axis=0))
    return TextModel(languages, np.ascontiguousarray(logs - logs.mean(axis=1, keepdims=True), np.float32))


_ATTRIBUTE = r"[^\s=>\"'/]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute; null if it has none."""
    own = F.get(F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 0), lambda a: a.rlike(rf"^(?i:{name})\s*=")), F.lit(0))
    return F.regexp_replace(own, r"^[^=]*=\s*+[\"']?|[\"']$", "")


def markup_language(html: Column) -> Column:
    """The primary subtag, in lower case, that ``<html lang=...>`` (or ``xml:lang``) declares, else ``<meta http-equiv="content-language">``; else null.

    A subtag has two or three letters; names of languages aren't subtags.
    """
    tag = F.regexp_extract(html, r"(?i)<html(?=[\s/>])([^>]*+)", 1)
    meta = F.get(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*+"), 0), lambda m: F.lower(_attribute(m, "http-equiv")) == "content-language"), F.lit(0))
    subtag = lambda value: F.nullif(F.lower(F.regexp_extract(value, r"^\s*+([A-Za-z]{2,3})(?![A-Za-z0-9])", 1)), F.lit(""))
    return F.coalesce(subtag(_attribute(tag, "(?:xml:)?lang")), subtag(_attribute(meta, "content")))


def markup_text(html: Column) -> Column:
    """What a page shows: without comments, scripts, styles and tags."""
    return F.regexp_replace(html, r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*+>", " ")


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """``page_id, text, declared, host, domain, suffix`` of ``page_id, url, html``."""
    host = F.when(url_host(F.col("url")) != "", F.regexp_replace(url_host(F.col("url")), r":\d*$", ""))
    rows = pages.select("page_id", markup_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), host.alias("host"))
    labels = F.when(F.col("host").rlike(_SECOND_LEVEL), 3).otherwise(2)
    domain = F.when(labels == 3, F.substring_index("host", ".", -3)).otherwise(F.substring_index("host", ".", -2))
    return rows.withColumns({"domain": domain, "suffix": F.substring_index("host", ".", -1)})


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text, declared, host, domain, suffix``: a source stands for a host, and has no address."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.lower(F.substring_index("lang", "-", 1)).alias("declared"), F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"))


def fuse(rows: DataFrame, model: TextModel, confidence: float = CONFIDENCE, text: str = "text") -> DataFrame:
    """``rows`` without ``text``, with ``lang, posterior, text_lang, kept``.

    Needs ``declared, host, domain, suffix``. The posterior of a language is, up to a constant, the product of the text's
    tempered likelihood, the chance that pages in that language declare what this one declares and have
    its suffix, and the host's prior. The chances are smoothed shares, and the prior a host's share smoothed by its
    domain's, that by the share of all rows: each from counts, by grouped aggregation, of the language that
    the text alone points to. A row is left out of the counts that it is judged by.

    Null host, domain, declared or suffix: one value like any other. Texts without letters (null, empty): ``und``, not
    kept; so are those whose best posterior is below ``confidence``. Repeated rows give repeated results. A host (or source, or null) may hold any share of the rows: ``join_groups``.
    """
    small_batches(rows.sparkSession)
    languages, size = model.languages, len(model.languages)
    keep = [c for c in rows.columns if c != text]
    shared = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = shared.value.score(batch.column(0))
            arrays = [pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], [*batch.schema.names[1:], "_sums", "_grams"])

    kept_schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    scored = rows.select(text, *keep).mapInArrow(tidy(score), f"{kept_schema}, _sums array<double>, _grams bigint")
    if not size:
        return rows.select(*keep, F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("kept"))
    best = F.when(F.col("_grams") > 0, F.array_position("_sums", F.array_max("_sums")).cast("int") - 1)
    scored = write_table(scored.withColumn("_best", best), "evidence")

    shares = lambda: [F.count(F.when(F.col("_best") == k, 1)).cast("double").alias(f"_c{k}") for k in range(size)]
    whole = scored.agg(*shares()).first()  # one row
    total = [float(whole[k]) for k in range(size)]
    overall = [(c + 1.0) / (sum(total) + size) for c in total]
    out = scored
    for column in ("host", "domain", "declared", "suffix"):
        counts = scored.groupBy(F.col(column).alias(f"_{column}")).agg(F.array(*shares()).alias(f"_n_{column}"), F.count(F.lit(1)).alias("_n"))
        out = join_groups(out, counts, {column: f"_{column}"}, "_n")

    def own(k: int) -> Column:
        return F.when(F.col("_best") == k, 1.0).otherwise(0.0)

    def others(column: str, k: int) -> Column:
        return F.get(F.col(f"_n_{column}"), F.lit(k)) - own(k)

    def every(column: str) -> Column:
        return sum((others(column, k) for k in range(1, size)), others(column, 0))

    logs = []
    for k in range(size):
        domain = (others("domain", k) + PSEUDO_ROWS * overall[k]) / (every("domain") + PSEUDO_ROWS)
        host = (others("host", k) + PSEUDO_ROWS * domain) / (every("host") + PSEUDO_ROWS)
        in_language = F.greatest(F.lit(total[k]) - own(k), F.lit(0.0))
        chance = lambda column: (others(column, k) + PSEUDO_ROWS * every(column) / max(1.0, sum(total)) + 0.01) / (in_language + PSEUDO_ROWS)  # noqa: B023, E731
        tempered = F.get("_sums", F.lit(k)) * TEMPER / (F.col("_grams") + TEMPER)
        logs.append(tempered + F.log(host) + F.log(chance("declared")) + F.log(chance("suffix")))
    out = out.withColumn("_logs", F.array(*logs))
    out = out.withColumn("_top", F.array_max("_logs"))
    posterior = 1.0 / F.aggregate("_logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))
    names = F.array(*map(F.lit, languages))
    some = F.col("_grams") > 0
    out = out.withColumn("posterior", F.when(some, posterior).otherwise(0.0))
    kept = some & (F.col("posterior") >= confidence)
    named = F.when(kept, F.get(names, F.array_position("_logs", F.col("_top")).cast("int") - 1)).otherwise(UNKNOWN)
    return out.select(*keep, named.alias("lang"), "posterior", F.get(names, F.col("_best")).alias("text_lang"), kept.alias("kept"))


def language_report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_id, host, declared, lang, posterior, text_lang, kept`` for every document and page.

    The text model is fitted on labelled documents (``SAMPLE``). One of ``doc_id`` and ``page_id`` is null.
    """
    none = F.lit(None).cast("long")
    of_docs = evidence_of_documents(docs).withColumn("page_id", none)
    of_pages = evidence_of_pages(pages).withColumn("doc_id", none)
    fused = fuse(of_docs.unionByName(of_pages), fit_text_model(docs))
    return fused.select("doc_id", "page_id", "host", "declared", "lang", "posterior", "text_lang", "kept")


def keep_identified(docs: DataFrame, sample: int = SAMPLE, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` without those that have no letters or no language of at least ``confidence``.

    What goes is found by ``doc_id`` and a hash of the text, written, and anti-joined: broadcast if that table's known size
    allows, else shuffled.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = evidence_of_documents(docs).withColumn(f"{T}mark", mark)
    fused = fuse(rows, fit_text_model(docs, sample), confidence)
    gone = write_table(fused.where(~F.col("kept")).select(F.col("doc_id").alias(f"{T}id"), f"{T}mark").distinct(), "rejected")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(f"{T}id")) & (mark == F.col(f"{T}mark")), "left_anti")
    return joined.select(*docs.columns)
