"""Language of documents and pages by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wlanlake.llm.common import unit_hash
from wlanlake.llm.shingles import in_parts
from wlanlake.llm.tokens import texts_of
from wlanlake.session import store

BUCKETS = 1 << 16
#: all ASCII bytes that are not letters become blanks, upper case becomes lower case
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
#: declared codes that name no language
_NO_LANGUAGE = ("und", "mul", "mis", "zxx")
TAGS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"


def _plain(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[32], _PLAIN[np.frombuffer(b"\n".join(texts), np.uint8)], [32]]).astype(np.int32)


def _bucket(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a * 961 + b * 31 * 7 + c) % BUCKETS


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams around every letter, and where each text's begin (one more entry)."""
    raw = _plain(texts)
    middle = np.flatnonzero(raw[1:-1] != 32)
    grams = _bucket(raw[middle], raw[middle + 1], raw[middle + 2])
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return grams, np.searchsorted(middle, np.concatenate([[0], np.cumsum(sizes)]))


def declared_languages(
    labelled: DataFrame, lang_col: str = "lang", most: int = 32, least_rows: int = 3
) -> tuple[str, ...]:
    """The languages that at least ``least_rows`` rows of the whole table declare, at most the ``most`` frequent ones."""
    counts = labelled.groupBy(_primary(F.col(lang_col)).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.filter((F.col("lang") != "") & ~F.col("lang").isin(*_NO_LANGUAGE) & (F.col("n") >= least_rows))
    return tuple(sorted(r["lang"] for r in named.orderBy(F.desc("n"), "lang").limit(most).collect()))


def fit_trigrams(
    labelled: DataFrame,
    languages: Sequence[str],
    id_col: str,
    text_col: str,
    lang_col: str,
    rows_per_language: int = 500,
    outlier: bool = False,
) -> np.ndarray:
    """Log probabilities (buckets x languages) from about ``rows_per_language`` hash-chosen rows of each language.

    ``outlier`` adds a last column, the background that a text of none of them is held against: its bytes as
    frequent as in all chosen rows but independent of each other, mixed with trigrams that are all alike.
    """
    known = list(languages)
    if not known:
        return np.full((BUCKETS, int(outlier)), -np.log(BUCKETS), np.float32)
    tagged = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _primary(F.col(lang_col)).alias("lang"))
    tagged = tagged.filter(F.col("lang").isin(*known))
    sizes = dict(tagged.groupBy("lang").agg(F.count(F.lit(1))).collect())
    share = F.lit(0.0)
    for lang in known:
        share = F.when(F.col("lang") == lang, F.lit(rows_per_language / max(1, sizes.get(lang, 0)))).otherwise(share)
    chosen = tagged.filter(unit_hash("id", seed="language") < share).select("lang", "text").repartition(8)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, letters = np.zeros((len(known), BUCKETS), np.int64), np.zeros(256, np.int64)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, part in in_parts(texts_of(batch)):
                grams, begin = trigrams(part)
                for k in range(len(part)):
                    total[known.index(langs[at + k])] += np.bincount(grams[begin[k] : begin[k + 1]], minlength=BUCKETS)
                raw = _plain(part)
                # A blank counts once after each word.
                letters += np.bincount(raw[1:][(raw[1:] != 32) | (raw[:-1] != 32)], minlength=256)
        sent = [pa.array([x.tobytes()], pa.binary()) for x in (total, letters)]
        yield pa.RecordBatch.from_arrays(sent, ["counts", "letters"])

    total, letters = np.zeros((len(known), BUCKETS)), np.zeros(256)
    for raw, seen in chosen.mapInArrow(count, "counts binary, letters binary").collect():
        total += np.frombuffer(bytes(raw), np.int64).reshape(total.shape)
        letters += np.frombuffer(bytes(seen), np.int64)
    background = _background(letters)
    # Smoothed towards the background, so trigrams that a language lacks are always likelier in the background.
    total += 0.1 * BUCKETS * background
    model = total / total.sum(axis=1, keepdims=True)
    return np.log(np.vstack([model, background]) if outlier else model).T.astype(np.float32)


def _background(letters: np.ndarray) -> np.ndarray:
    """Probabilities of the buckets: half of it bytes as frequent as given and independent, half uniform."""
    symbols = np.flatnonzero((_PLAIN[np.arange(256)] == np.arange(256)) & (np.arange(256) >= 32))
    share = letters[symbols] + 0.5
    a, b, c = np.meshgrid(symbols, symbols[symbols != 32], symbols, indexing="ij", sparse=True)
    pa, pb = share, share[symbols != 32]
    joint = pa[:, None, None] * pb[None, :, None] * pa[None, None, :]
    independent = np.bincount(_bucket(a, b, c).ravel(), weights=joint.ravel(), minlength=BUCKETS)
    return 0.5 * independent / independent.sum() + 0.5 / BUCKETS


def _primary(tag: Column) -> Column:
    """The language of a tag, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))


def primary_language(tag: Column, languages: Sequence[str]) -> Column:
    """One of the languages, ``other`` for any other tag, ``none`` where nothing is declared."""
    first = _primary(tag)
    known = F.when(first.isin(*languages), first)
    return F.when(F.trim(F.coalesce(tag, F.lit(""))) == "", "none").otherwise(F.coalesce(known, F.lit("other")))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> list[Column]:
    """text, declared, host and suffix of a page: its visible text, the tag of its html element, its address."""
    html, url = F.col(html_col), F.col(url_col)
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return [
        F.regexp_replace(html, TAGS, " ").alias("text"),
        F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1).alias("declared"),
        F.when(host != "", host).alias("host"),
        F.regexp_extract(host, r"\.([a-z]{2,})$", 1).alias("suffix"),
    ]


def fuse_languages(
    rows: DataFrame,
    model: np.ndarray,
    languages: Sequence[str],
    strength: float = 100.0,
    most_grams: int = 100,
    least_confidence: float = 0.5,
    outlier_prior: float = 0.001,
) -> DataFrame:
    """Adds lang, confidence, text_lang, n_grams and kept; drops text, declared, host and suffix.

    ``rows`` has the columns text, declared, host and suffix, besides any that identify a row. The
    posterior of a language is the product of

    * the likelihood of the text's letter trigrams, as strong as ``most_grams`` of them at most, since
      trigrams of a text depend on each other;
    * the likelihood of the declared language and of the address suffix, from grouped sums of the
      posteriors that the texts alone give;
    * the prior of the host: its sums, smoothed towards its domain's, smoothed towards all rows', each
      with the weight of ``strength`` rows.

    When ``model`` has one more column than there are languages (see ``fit_trigrams``), it is the hypothesis
    "none of them", named ``other``: its prior is ``outlier_prior``, and what is declared, host and suffix say
    nothing about it. Such rows take no part in the grouped sums.

    A row is rejected when it has no letter, when ``other`` wins, or when no language reaches
    ``least_confidence``; without any language all rows are. Null text counts as empty, an unreadable or missing declaration, host or suffix as none; empty texts get ``und``,
    confidence 0. An empty table gives no rows; repeated rows are rows of their own.
    """
    n, m = len(languages), model.shape[1]
    names = [*languages, "other"][:m]
    scores, shares = [f"_s{k}" for k in range(m)], [f"_t{k}" for k in range(n)]
    keys = [c for c in rows.columns if c not in ("text", "declared", "host", "suffix")]
    types = dict(rows.dtypes)
    told = rows.select(
        *keys,
        "text",
        primary_language(F.col("declared"), languages).alias("_declared"),
        F.coalesce("host", F.lit("")).alias("_host"),
        F.coalesce("suffix", F.lit("")).alias("_suffix"),
    )
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + ["_declared string, _host string, _suffix string, _n long"] + [f"{c} double" for c in scores])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sums, sizes = np.zeros((batch.num_rows, m)), np.zeros(batch.num_rows, np.int64)
            for at, part in in_parts(texts_of(batch)):
                grams, begin = trigrams(part)
                so_far = np.zeros((len(grams) + 1, m))
                np.cumsum(model[grams], axis=0, dtype=float, out=so_far[1:])
                sizes[at : at + len(part)] = np.diff(begin)
                sums[at : at + len(part)] = np.diff(so_far[begin], axis=0)
            sums *= np.minimum(1.0, most_grams / np.maximum(sizes, 1))[:, None]
            sums[:, n:] += np.log(outlier_prior)
            sums -= sums.max(axis=1, keepdims=True)
            columns = [batch.column(c) for c in [*keys, "_declared", "_host", "_suffix"]]
            columns += [pa.array(sizes)] + [pa.array(sums[:, k].copy()) for k in range(m)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "_declared", "_host", "_suffix", "_n", *scores])

    total = sum(F.exp(c) for c in scores)
    seen = store(
        told.mapInArrow(read, schema).withColumns(
            {t: F.when(F.col("_n") > 0, F.exp(s) / total).otherwise(0.0) for t, s in zip(shares, scores)}
        ),
        "evidence",
    )

    some = F.col("_n") > 0
    if not n:
        name = F.when(some, "other").otherwise("und")
        found = [name.alias("lang"), F.lit(0.0).alias("confidence"), name.alias("text_lang"), F.col("_n").alias("n_grams")]
        return seen.select(*keys, *found, F.lit(False).alias("kept"))

    def sums(prefix: str) -> list[Column]:
        return [F.sum(t).alias(f"{prefix}{k}") for k, t in enumerate(shares)]

    hosts = seen.groupBy("_host", "_suffix").agg(*sums("h")).withColumn("_domain", F.substring_index("_host", ".", -2))
    hosts = store(hosts, "hosts")
    again = lambda prefix: [F.sum(f"h{k}").alias(f"{prefix}{k}") for k in range(n)]
    everything = hosts.agg(*again("g")).first()
    overall = [((everything[k] or 0.0) + 1) / (sum(x or 0.0 for x in everything) + n) for k in range(n)]
    domains = hosts.groupBy("_domain").agg(*again("d"))
    suffixes = store(hosts.groupBy("_suffix").agg(*again("x")), "suffixes")
    kinds = suffixes.count()
    in_domain = sum(F.col(f"d{k}") for k in range(n))
    in_host = sum(F.col(f"h{k}") for k in range(n))
    prior = []
    for k in range(n):
        of_domain = (F.col(f"d{k}") + strength * overall[k]) / (in_domain + strength)
        of_host = (F.col(f"h{k}") + strength * of_domain) / (in_host + strength)
        of_suffix = (F.col(f"x{k}") + 1) / ((everything[k] or 0.0) + kinds)
        prior.append((F.log(of_host) + F.log(of_suffix)).alias(f"_p{k}"))
    if m > n:
        of_suffix = [(F.col(f"x{k}") + 1) / ((everything[k] or 0.0) + kinds) for k in range(n)]
        prior.append(F.log(sum(overall[k] * of_suffix[k] for k in range(n))).alias(f"_p{n}"))
    priors = store(hosts.join(domains, "_domain").join(suffixes, "_suffix").select("_host", "_suffix", *prior), "priors")

    values = [*languages, "other", "none"]
    said = {r["_declared"]: r for r in seen.groupBy("_declared").agg(*sums("c")).collect()}
    of_value = np.array(
        [[((said[v][f"c{k}"] if v in said else 0.0) + 1) / ((everything[k] or 0.0) + len(values)) for v in values] for k in range(n)]
    )
    of_value = np.log(np.vstack([of_value, np.array(overall) @ of_value])[:m])
    declared = []
    for k in range(m):
        score = F.lit(0.0)
        for v, said_so in zip(values, of_value[k]):
            score = F.when(F.col("_declared") == v, float(said_so)).otherwise(score)
        declared.append(score)

    fused = seen.join(priors, ["_host", "_suffix"])
    fused = fused.withColumns({f"_f{k}": F.col(scores[k]) + F.col(f"_p{k}") + declared[k] for k in range(m)})
    sums_of = [f"_f{k}" for k in range(m)]

    def top(columns: list[str]) -> Column:
        return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])

    def first_of(columns: list[str]) -> Column:
        pick = F.lit(names[m - 1])
        for k in range(m - 2, -1, -1):
            pick = F.when(F.col(columns[k]) == top(columns), names[k]).otherwise(pick)
        return pick

    confidence = 1 / sum(F.exp(F.col(c) - top(sums_of)) for c in sums_of)
    lang = F.when(some, first_of(sums_of)).otherwise("und")
    return fused.select(
        *keys,
        lang.alias("lang"),
        F.when(some, confidence).otherwise(0.0).alias("confidence"),
        F.when(some, first_of(scores)).otherwise("und").alias("text_lang"),
        F.col("_n").alias("n_grams"),
        (some & (lang != "other") & (confidence >= least_confidence)).alias("kept"),
    )


def identify_documents(docs: DataFrame, languages: Sequence[str] | None = None, **options) -> DataFrame:
    """doc_id, text_hash and the language of documents: ``lang`` is what they declare, ``source`` their host.

    The languages are those that the documents declare, unless they are given.
    """
    languages = declared_languages(docs) if languages is None else languages
    model = fit_trigrams(docs, languages, "doc_id", "text", "lang", outlier=True)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "text",
        F.col("lang").alias("declared"),
        F.col("source").alias("host"),
        F.lit(None).cast("string").alias("suffix"),
    )
    return fuse_languages(rows, model, languages, **options)


def identify(docs: DataFrame, pages: DataFrame, languages: Sequence[str] | None = None, **options) -> DataFrame:
    """One row per document and per page (the other's id is null), fused together; trigrams are fitted on documents.

    The languages are those that the documents declare, unless they are given.
    """
    languages = declared_languages(docs) if languages is None else languages
    model = fit_trigrams(docs, languages, "doc_id", "text", "lang", outlier=True)
    none = F.lit(None)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        none.cast("long").alias("page_id"),
        "text",
        F.col("lang").alias("declared"),
        F.col("source").alias("host"),
        none.cast("string").alias("suffix"),
    ).unionByName(
        pages.select(none.cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), *page_evidence(pages))
    )
    return fuse_languages(rows, model, languages, **options)
