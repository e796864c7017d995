"""Language identification by Bayesian evidence fusion.

The posterior of a language multiplies the tempered likelihood of the text (byte trigrams, one smoothed
multinomial a language), of the language its markup declares, of the suffix of its address, and a prior
of its host. Host priors are grouped counts of declared languages, each level smoothed by the one above:
all rows, suffix, domain, host (or any list of columns from coarse to fine).

The trigram model is fitted on a bounded sample (``per_language`` texts of each declared language); the
priors count all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import support, urlrep
from .kernels import LOWER

_BITS = 16
_UNSEEN = 0.05
#: Lower-cased letters and the bytes of other scripts as they are, all else blank: numbers, addresses and
#: marks are no evidence.
_PLAIN = LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32
#: Country suffixes and their main language (fixed values).
SUFFIX_LANGUAGE = {"at": "de", "br": "pt", "cl": "es", "de": "de", "es": "es", "fr": "fr", "it": "it", "jp": "ja", "mx": "es", "nl": "nl", "pl": "pl", "pt": "pt", "ru": "ru", "uk": "en", "us": "en"}


def _grams(raw: bytes) -> np.ndarray:
    d = _PLAIN[np.frombuffer(raw, np.uint8)]
    d = d[np.concatenate(([True], (d[1:] != 32) | (d[:-1] != 32)))].astype(np.uint32)  # blanks in a row are one
    if len(d) < 3:
        return np.empty(0, np.int64)
    x = (d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(32 - _BITS)).astype(np.int64)


class TextModel:
    """log p(trigram | language) for each language, and for no language at all (all alike)."""

    def __init__(self, languages: list[str], logp: np.ndarray):
        self.languages, self.logp = languages, logp

    def loglik(self, g: np.ndarray) -> np.ndarray:
        return self.logp[g].sum(0, dtype=np.float64)

    def evidence(self, text: str | None, temper: float) -> tuple[np.ndarray, bool]:
        """Tempered log likelihoods, and whether some language explains the text better than chance. A
        text without letters is explained by none."""
        n = len(self.languages)
        if not text or not any(c.isalpha() for c in text):
            return np.zeros(n), False
        g = _grams(f" {text} ".encode())
        total = np.zeros(n)
        for at in range(0, len(g), 1 << 20):
            total += self.loglik(g[at : at + (1 << 20)])
        return temper * total, bool(total.max() > -_BITS * np.log(2) * len(g))


class SparseTextModel(TextModel):
    """The same for many languages: what each language has over an unseen trigram, listed by trigram."""

    def __init__(self, languages: list[str], grams: np.ndarray, cols: np.ndarray, counts: np.ndarray):
        self.languages = languages
        order = np.argsort(grams, kind="stable")
        self.at = np.searchsorted(grams[order], np.arange((1 << _BITS) + 1))
        self.cols = cols[order].astype(np.int32)
        self.unseen = np.log(_UNSEEN / (np.bincount(cols, counts, len(languages)) + _UNSEEN * (1 << _BITS)))
        self.more = np.log((counts[order] + _UNSEEN) / _UNSEEN).astype(np.float32)

    def loglik(self, g: np.ndarray) -> np.ndarray:
        grams, n = np.unique(g, return_counts=True)
        lengths = self.at[grams + 1] - self.at[grams]
        where = np.repeat(self.at[grams] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return self.unseen * len(g) + np.bincount(self.cols[where], self.more[where] * np.repeat(n, lengths), len(self.languages))


def fit(docs: DataFrame, per_language: int = 1500, dense: int = 64) -> TextModel:
    """docs (text, declared). Languages are all declared ones; of each, ``per_language`` texts in expectation
    are counted, drawn by hash. Up to ``dense`` languages make a dense model, more a sparse one."""
    n = docs.filter("declared is not null").groupBy("declared").count().collect()
    n = {r["declared"]: r["count"] for r in n}
    languages = sorted(n)
    if not languages:
        return TextModel([], np.zeros((1 << _BITS, 0)))
    large = {k: per_language / n[k] for k in languages if n[k] > per_language}  # of the others all texts count
    share = F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("declared")] if large else F.lit(1.0)
    draw = (F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)) < F.coalesce(share, F.lit(1.0))

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def counted():
            for lang, c in total.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_pydict({"declared": pa.array([lang] * len(at), pa.string()), "g": pa.array(at), "c": pa.array(c[at])})
            total.clear()

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                c = total.setdefault(lang, np.zeros(1 << _BITS, np.int64))
                c += np.bincount(_grams(f" {t.as_py() or ''} ".encode()), minlength=1 << _BITS)
                if len(total) > 64:
                    yield from counted()
        yield from counted()

    rows = docs.filter(F.col("declared").isNotNull() & draw).select("declared", "text").mapInArrow(count, "declared string, g bigint, c bigint")
    rows = rows.groupBy("declared", "g").agg(F.sum("c").alias("c")).toArrow()  # languages x 2^16 numbers at most
    at = {k: i for i, k in enumerate(languages)}
    cols = np.array([at[x] for x in rows.column(0).to_pylist()], int)
    if len(languages) > dense:
        return SparseTextModel(languages, rows.column(1).to_numpy().astype(int), cols, rows.column(2).to_numpy().astype(float))
    counts = np.full((1 << _BITS, len(languages)), _UNSEEN)
    np.add.at(counts, (rows.column(1).to_numpy().astype(int), cols), rows.column(2).to_numpy())
    return TextModel(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def host_priors(docs: DataFrame, languages: list[str], levels: list[str], strength: float = 20.0) -> tuple[DataFrame, list[float]]:
    """(finest level, p: array over languages) of each of its values, and the overall shares.

    Each level is one grouped count of declared languages; its shares are smoothed by ``strength``
    pseudo-rows of the level above. Rows without declared language count for nothing.
    """
    by = docs.groupBy("declared").count().collect()
    by = {r["declared"]: r["count"] for r in by}
    total = sum(by.get(k, 0) for k in languages) + len(languages)
    overall = [(by.get(k, 0) + 1) / total for k in languages]
    names = F.array(*map(F.lit, languages))
    table: DataFrame | None = None
    for i, level in enumerate(levels):
        keys = levels[: i + 1]
        got = docs.groupBy(*keys, "declared").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(*keys)
        got = got.agg(F.map_from_entries(F.collect_list(F.when(F.col("declared").isNotNull(), F.struct("declared", "c")))).alias("counts"))
        n = F.transform(names, lambda k: F.coalesce(F.col("counts")[k], F.lit(0.0)))
        if table is None:
            got = got.withColumn("up", F.array(*map(F.lit, overall)))
        else:
            up = table.select(*[F.col(k).alias(f"__{k}") for k in keys[:-1]], F.col("p").alias("up"))
            on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys[:-1]]
            got = got.join(up, on).drop(*[f"__{k}" for k in keys[:-1]])
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        table = got.select(*keys, F.zip_with(n, "up", lambda x, p: (x + strength * p) / (size + strength)).alias("p"))
    return table, overall


def posterior(docs: DataFrame, model: TextModel, levels: list[str], suffix: str | None = None, temper: float = 0.05, trust: float = 0.9, suffix_trust: float = 0.7) -> DataFrame:
    """Adds lang_id, lang_posterior, lang_explained to docs (text, declared, the level columns).

    Unknown or null declarations and suffixes say nothing. Ties go to the first language by name. Without
    any language lang_id is null and the posterior 0.
    """
    if not model.languages:
        return docs.select("*", F.lit(None).cast("string").alias("lang_id"), F.lit(0.0).alias("lang_posterior"), F.lit(False).alias("lang_explained"))
    table, _ = host_priors(docs, model.languages, levels)
    keys = table.select(*[F.col(k).alias(f"__{k}") for k in levels], F.col("p").alias("__p"))
    keys, _ = support.written(keys, "host-priors")
    if keys.count() <= 20_000:  # a bounded table goes to all machines; a larger one joins by shuffle
        keys = F.broadcast(keys)
    rows = docs.join(keys, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in levels], "left")
    names = model.languages

    at = {k: i for i, k in enumerate(names)}

    def spread(value: str | None, p: float) -> np.ndarray | None:
        if value not in at:
            return None
        out = np.full(len(names), (1 - p) / max(1, len(names) - 1))
        out[at[value]] = p
        return out

    where = F.lit(None).cast("string")
    if suffix:
        to = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
        where = to[F.substring_index(F.col(suffix), ".", -1)]  # co.uk counts as uk

    @F.pandas_udf("lang string, p double, explained boolean")
    def fuse(text: pd.Series, prior: pd.Series, said: pd.Series, where: pd.Series) -> pd.DataFrame:
        out = []
        for t, prior_, said_, where_ in zip(text, prior, said, where):
            z, explained = model.evidence(t, temper)
            for x in (prior_, spread(said_, trust), spread(where_, suffix_trust)):
                if x is not None:
                    z = z + np.log(np.maximum(np.asarray(x, float), 1e-12))
            p = np.exp(z - z.max())
            p /= p.sum()
            i = int(p.argmax())
            out.append((names[i], float(p[i]), explained))
        return pd.DataFrame(out, columns=["lang", "p", "explained"])

    got = rows.withColumn("__got", fuse("text", "__p", "declared", where))
    return got.select(*[docs[c] for c in docs.columns], F.col("__got.lang").alias("lang_id"), F.col("__got.p").alias("lang_posterior"), F.col("__got.explained").alias("lang_explained"))


def identify(docs: DataFrame, declared: str = "lang", host: str = "source", least: float = 0.5, levels: list[str] | None = None, suffix: str | None = None, **kw) -> DataFrame:
    """All columns of docs and lang_id, lang_posterior, lang_explained, lang_kept.

    ``levels`` are the columns of the prior from coarse to fine, ``host`` alone by default; ``suffix`` is the
    column of the address suffix, without which it is no evidence. A row is rejected if it has no letters,
    if no language explains its text better than chance, or if the best language's posterior is under
    ``least``. Null and empty texts are rejected.
    """
    names, levels = docs.columns, levels or [host]
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c != "text"], "text", F.col(declared).alias("declared"), *[F.col(c).alias(f"level{i}") for i, c in enumerate(levels)], *([F.col(suffix).alias("suffix")] if suffix else []))
    model = fit(inner.select("text", "declared"), **kw)
    out = posterior(inner, model, [f"level{i}" for i in range(len(levels))], "suffix" if suffix else None)
    back = [F.col("text") if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return out.select(*back, "lang_id", "lang_posterior", "lang_explained", (F.col("lang_explained") & (F.col("lang_posterior") >= least)).alias("lang_kept"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, text, declared, suffix, domain, host and the columns of identify.

    The text is the visible one, the declaration the main part of ``<html lang>``; the suffix of the address is
    evidence, and the prior is smoothed from suffix to domain to host."""
    host = urlrep.host_of(F.col("url"))
    said = F.lower(F.regexp_extract(text.attribute(F.col("html"), "html", "lang"), "^\\s*([A-Za-z]+)", 1))
    rows = pages.select("page_id", text.visible_text("html").alias("text"), F.when(said != "", said).alias("declared"), urlrep.suffix_of(host).alias("suffix"), urlrep.domain_of(host).alias("domain"), host.alias("host"))
    rows, _ = support.written(rows, "page-texts")  # pages are parsed once
    return identify(rows, "declared", levels=["suffix", "domain", "host"], suffix="suffix")
