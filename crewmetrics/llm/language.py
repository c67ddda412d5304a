"""Language identification by Bayesian fusion of four kinds of evidence.

For every page: the likelihood of its text under character trigrams of each language, the language its
markup declares, the language code in its address, and a prior of its host. What declared languages and codes
say, and how hosts are composed, is learnt from the pages themselves, as sums of the posteriors from text alone by
grouped aggregation. Host priors are smoothed towards their domain, the domain's towards its suffix, that
towards all pages. A page's own posterior is taken out of every sum that its evidence is drawn from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewmetrics.llm.common import Scratch

BUCKETS = 1 << 12
#: Labelled texts to learn from at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: A labelled text counts as so many trigrams at most, all of them alike, so that no long one speaks for its language alone.
TEXT_WEIGHT = 2_000
#: Trigrams of one text are not independent; they count as so many independent ones at most.
EFFECTIVE = 60
#: Pseudo-pages by which a level of the hosts leans on the one above, and an evidence table on all pages.
KAPPA, ALPHA = 5.0, 1.0
THRESHOLD = 0.5
#: Nats per trigram by which the best language may fall behind a background that deems all trigrams equally likely, before a
#: text is in no known language; texts learnt from are 0.3 to 3 ahead of it. Deviation of one trigram's logarithm.
FIT, FIT_SPREAD = -1.5, 2.0

#: Bytes to letters: A-Z in lower case, those above ASCII as they are, all others a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)


def trigrams(text: str | None) -> np.ndarray:
    """Counts of a text's letter trigrams by bucket; whatever lies between words is one space."""
    letters = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    codes = np.frombuffer(b" " + b" ".join(letters) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(BUCKETS)
    first, second, third = _FACTORS
    hashed = codes[:-2] * first
    hashed += codes[1:-1] * second
    hashed += codes[2:] * third
    return np.bincount(hashed >> np.uint32(20), minlength=BUCKETS).astype(float)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # by bucket and language
    prior: np.ndarray

    def evidence(self, text: str | None) -> tuple[list[float], float]:
        """Logarithms of the text's likelihoods, the highest 0, and how far the best language is ahead of the background, per
        trigram and at the upper end of what chance allows; all 0 without letters."""
        counts = trigrams(text)
        n = counts.sum()
        if not n or not self.languages:
            return [0.0] * len(self.languages), 0.0
        mean = counts @ self.logs / n
        logs = mean * min(n, EFFECTIVE)
        return (logs - logs.max()).tolist(), float(mean.max() + np.log(BUCKETS) + 3 * FIT_SPREAD / np.sqrt(n))

    def likelihoods(self, text: str | None) -> list[float]:
        return self.evidence(text)[0]


def train(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Trigram frequencies of each language from labelled ``docs`` (doc_id, text, lang).

    Each task adds up its own rows; a row of counts per task and language is added up further.
    """
    labelled = docs.where("lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    ids = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counts = trigrams(text)
                sums[lang] = sums.get(lang, 0.0) + counts * min(1.0, TEXT_WEIGHT / max(counts.sum(), 1.0))
                seen[lang] = seen.get(lang, 0) + 1
        if sums:
            yield pd.DataFrame({"lang": list(sums), "n": [seen[x] for x in sums], "counts": [c.tolist() for c in sums.values()]})

    parts = labelled.join(F.broadcast(ids), "doc_id").select("lang", "text").mapInPandas(count, "lang string, n long, counts array<double>")
    total, seen = {}, {}
    for lang, n, counts in parts.toLocalIterator():
        total[lang] = total.get(lang, 0.0) + np.array(counts)
        seen[lang] = seen.get(lang, 0) + n
    languages = sorted(total)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    table = np.stack([total[x] + 0.5 for x in languages], axis=1)
    prior = np.array([seen[x] + 1.0 for x in languages])
    return Model(languages, np.log(table / table.sum(axis=0)), prior / prior.sum())


def _text_column(text: str, model: Model) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def likelihoods(texts: pd.Series) -> pd.Series:
        return pd.Series([model.likelihoods(_HIDDEN.sub(" ", t) if t else t) for t in texts])

    return likelihoods(text)


def _fit_column(text: str, model: Model) -> Column:
    """The likelihoods of a text, and last how far its best language is ahead of the background."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def evidence(texts: pd.Series) -> pd.Series:
        found = map(model.evidence, texts)
        return pd.Series([[*logs, fit] for logs, fit in found])

    return evidence(text)


def declared_language(html: Column) -> Column:
    """The primary language of the html element's lang, in lower case; null if there is none."""
    found = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def address_parts(url: Column) -> list[Column]:
    """host, domain (its last two labels), suffix (its last one) and a language code in the path."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    code = F.nullif(F.lower(F.regexp_extract(url, r"^[^?#]*?//[^/?#]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:[/?#]|$)", 1)), F.lit(""))
    return [
        host.alias("host"),
        F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0).alias("domain"),
        F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"),
        code.alias("code"),
    ]


KEYS = ("host", "domain", "suffix", "code", "declared")


def _normal(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=-1, keepdims=True)


def _alone(logs: np.ndarray, model: Model) -> np.ndarray:
    """Posteriors from texts alone."""
    return _normal(np.exp(logs) * model.prior)


def learn(evidence: DataFrame, model: Model, scratch: Scratch) -> tuple[list[float], dict[str, DataFrame]]:
    """Sums of the posteriors from text over all rows, and by value of each key, from rows of keys and ``logs`` alone.

    Every aggregate is combined before its shuffle, so a host with a third of all rows is as good as any other.
    """
    n = len(model.languages)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def alone(logs: pd.Series) -> pd.Series:
        return pd.Series(list(_alone(np.stack(logs.to_numpy()), model)))

    rows = scratch.save(evidence.select(*KEYS, alone("logs").alias("post")))
    total = [F.sum(F.get("post", F.lit(i))) for i in range(n)]
    sums = {
        k: scratch.save(rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.array(*total).alias(f"{k}_sums"))) for k in KEYS
    }
    return [float(x or 0.0) for x in rows.agg(*total).first()], sums


def posteriors(logs: np.ndarray, sums: dict[str, pd.Series], everything: np.ndarray, model: Model) -> np.ndarray:
    """A row by language for each row of ``logs``. ``sums`` has for each key what rows of its value sum up to, the row itself
    included, or None for a row without the key."""
    own = _alone(logs, model)
    known = {k: s.notna().to_numpy() for k, s in sums.items()}
    rest = {}  # what is left of each sum without the row itself
    for k, s in sums.items():
        rest[k] = np.zeros_like(own)
        if known[k].any():
            rest[k][known[k]] = np.maximum(np.stack(s[known[k]].to_numpy()) - own[known[k]], 0.0)
    others = np.maximum(everything - own, 0.0) + ALPHA
    prior = _normal(others)
    for k in ("suffix", "domain", "host"):
        prior = _normal(rest[k] + KAPPA * prior)
    joint = np.exp(logs) * prior
    for k in ("code", "declared"):
        said = (rest[k] + ALPHA / logs.shape[1]) / (others + ALPHA)
        joint = joint * np.where(known[k][:, None], said, 1.0)
    return _normal(joint)


def fuse(evidence: DataFrame, model: Model, learnt: tuple[list[float], dict[str, DataFrame]], into: str) -> DataFrame:
    """``evidence`` (the keys, ``logs`` and other columns) with a struct ``into`` of text_lang, lang and probability.

    A tie goes to the first language of the alphabet.
    """
    everything, names = np.array(learnt[0]), np.array(model.languages, dtype=object)

    @F.pandas_udf("text_lang string, lang string, probability double")
    def best(logs: pd.Series, host: pd.Series, domain: pd.Series, suffix: pd.Series, code: pd.Series, declared: pd.Series) -> pd.DataFrame:
        stacked = np.stack(logs.to_numpy())
        found = posteriors(stacked, dict(zip(KEYS, (host, domain, suffix, code, declared))), everything, model)
        return pd.DataFrame(
            {"text_lang": names[stacked.argmax(axis=1)], "lang": names[found.argmax(axis=1)], "probability": found.max(axis=1)}
        )

    rows = evidence
    for key, sums in learnt[1].items():
        rows = rows.join(sums, key, "left")
    # Computed once for each row, whatever a later filter asks for.
    return rows.select(*evidence.columns, best.asNondeterministic()("logs", *[f"{k}_sums" for k in KEYS]).alias(into))


def report(pages: DataFrame, docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, declared, text_lang, lang, probability of every row of ``pages`` (page_id, url, html).

    ``docs`` (doc_id, text, lang) is what the languages are learnt from. A null or empty html has no text evidence
    and declares nothing, a null url or one without a host has the prior of all pages. ``text_lang`` is the
    language by text alone. Repeated rows are evidence for each other. No pages give no rows, and without labelled
    documents every language is null; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    model = train(docs, rows)
    if not model.languages:
        host, declared = address_parts(F.coalesce("url", F.lit("")))[0], declared_language(F.coalesce("html", F.lit("")))
        none = F.lit(None).cast("string")
        return pages.select("page_id", host, declared.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("probability"))
    evidence = scratch.save(
        pages.select(
            "page_id",
            *address_parts(F.coalesce("url", F.lit(""))),
            declared_language(F.coalesce("html", F.lit(""))).alias("declared"),
            _text_column("html", model).alias("logs"),
        )
    )
    fused = fuse(evidence, model, learn(evidence, model, scratch), "found")
    return fused.select("page_id", "host", "declared", "found.text_lang", "found.lang", "found.probability")


def keep_identified(
    docs: DataFrame, train_on: DataFrame, languages: list[str] | None = None, threshold: float = THRESHOLD, rows: int = FIT_ROWS, fit: float = FIT
) -> DataFrame:
    """The rows of ``docs`` (text, lang as declared, source as host, and any other columns, all kept) in a known language.

    A row goes if its likeliest language has a probability of under ``threshold``, or is none of ``languages`` (all
    that ``train_on`` has, if not given), or if no language explains its text: the best one falls behind a background of equally
    likely trigrams by more than ``fit`` allows, whatever the row declares. The fewer trigrams, the more is left to chance.
    A null text or one without letters has no text evidence, a null lang declares nothing, a null source has
    the prior of all rows; a row with none of these has the prior alone. Repeated rows meet one fate, a tie goes to the first
    language of the alphabet. Without labelled rows nothing is known, and all rows stay.
    """
    scratch = Scratch(docs.sparkSession)
    model = train(train_on, rows)
    if not model.languages:
        return docs
    into, n = "row", len(model.languages)
    none, evidence = F.lit(None).cast("string"), _fit_column("text", model)
    keys = [
        F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("code"),
        F.nullif(F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), "^[a-zA-Z]{2,3}", 0)), F.lit("")).alias("declared"),
        F.slice(evidence, 1, n).alias("logs"),
    ]
    # The texts are read twice rather than written: what is learnt needs the keys and likelihoods alone.
    learnt = learn(docs.select(*keys), model, scratch)
    judged = docs.select(F.struct(*docs.columns).alias(into), *keys, F.element_at(evidence, -1).alias("fit"))
    kept = fuse(judged, model, learnt, "found").where((F.col("found.probability") >= threshold) & (F.col("fit") >= fit))
    if languages is not None:
        kept = kept.where(F.col("found.lang").isin(languages))
    return kept.select(*[F.col(f"{into}.`{c}`").alias(c) for c in docs.columns])
