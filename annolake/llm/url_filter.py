"""URL filters: written rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and the beginning of a path; it fits its host and all subdomains where the path begins so, and the longest that fits decides. The
trees see lengths, depth, ratios of digits, entropies, numbers of parameters, escapes and hyphens, and statistics of the host's suffixes and words: the log odds of
each among the labelled URLs, for training from other folds than the URL's own. Labelled URLs are a bounded sample (``SAMPLE`` rows, the first by a hash of
the URL), and so are the statistics that go to each task. One row a URL, no shuffle.

Cases: a null URL and one without ``://`` have an empty host and path, fit no rule and are allowed, as nothing speaks against them; an empty path begins with no rule's
path; of rules of one length the longer host, then the first in order, decides; upper case counts as lower in hosts only; very long URLs are read whole, in linear
time; repeated rows are judged each; null or repeated ids are passed through; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import string
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.boosting import Trees, fit
from annolake.llm.columns import parts
from annolake.llm.labelled_urls import URLS, labelled_urls
from annolake.llm.tables import table

#: Fixed by the contract of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled rows that training reads at most; folds of the statistics; weight of the prior in them; log odds from which a URL is blocked; rules that a filter can have.
SAMPLE, FOLDS, PRIOR, THRESHOLD, MOST_RULES = 20_000, 4, 4.0, 0.0, 10_000
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "host_hyphens", "host_digits", "path_digits", "host_entropy", "path_entropy", "parameters", "query_length", "escapes", "path_upper", "path_hyphens",
    "host_vowels", "end_odds", "site_odds", "word_odds", "worst_word",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to the path, query or fragment, in lower case; empty without any."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a filter holds {MOST_RULES}")
    ordered = sorted(enumerate(rules), key=lambda r: (-len(r[1][1] + r[1][2]), -len(r[1][1]), r[0]))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    listed = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for _, (v, h, p) in ordered))
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.try_element_at(fits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def _counts(data: np.ndarray, ends: np.ndarray, which: bytes) -> np.ndarray:
    """How many bytes of each value are among ``which``."""
    hit = np.zeros(256, bool)
    hit[list(which)] = True
    return np.diff(np.concatenate([[0], np.cumsum(hit[data])])[ends]).astype(float)


def _entropy(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits a byte of each value."""
    sizes = np.diff(ends)
    cells = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 256 + data, minlength=256 * len(sizes)).reshape(-1, 256)
    share = cells / np.maximum(sizes, 1)[:, None]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(1)


_NUMBER = re.compile(r"[0-9]+")


def host_words(host: str) -> tuple[str, str, list[str]]:
    """A host's last label, its last two, and its words: what hyphens, digits and dots part."""
    labels = host.split(".")
    end = labels[-1]
    if end.isdigit():
        return "0", "0.0", []
    return end, ".".join(labels[-2:]), [w for label in labels[:-1] for w in _NUMBER.sub("-", label).split("-") if len(w) > 1]


Odds = dict[tuple[str, str], float]


def _odds(hosts: Sequence[str], y: Sequence[int]) -> Odds:
    """Smoothed log odds, above those of all rows, of each last label, pair of last labels and word."""
    share = min(max(sum(y) / max(len(y), 1), 1e-3), 1 - 1e-3)
    seen: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for host, label in zip(hosts, y, strict=True):
        end, site, words = host_words(host)
        for key in {("end", end), ("site", site), *(("word", w) for w in words)}:
            seen[key][label] += 1
    base = math.log(share / (1 - share))
    return {key: math.log((bad + PRIOR * share) / (good + PRIOR * (1 - share))) - base for key, (good, bad) in seen.items()}


def _told(hosts: Sequence[str], odds: Odds) -> np.ndarray:
    rows = []
    for host in hosts:
        end, site, words = host_words(host)
        own = [odds.get(("word", w), 0.0) for w in words]
        rows.append((odds.get(("end", end), 0.0), odds.get(("site", site), 0.0), sum(own), max(own, default=0.0)))
    return np.array(rows, float).reshape(-1, 4)


def lexical(host: pa.Array, path: pa.Array, query: pa.Array) -> np.ndarray:
    """The features that need no statistics."""
    (h, he), (p, pe), (q, qe) = (parts(c.cast(pa.string())) for c in (host, path, query))
    hn, pn, qn = (np.diff(e).astype(float) for e in (he, pe, qe))
    digits = string.digits.encode()
    return np.stack(
        [
            hn + pn + qn, hn, pn, _counts(p, pe, b"/"), _counts(h, he, b".") + (hn > 0), _counts(h, he, b"-"), _counts(h, he, digits) / np.maximum(hn, 1), _counts(p, pe, digits) / np.maximum(pn, 1),
            _entropy(h, he), _entropy(p, pe), _counts(q, qe, b"&") + (qn > 1), qn, _counts(p, pe, b"%") + _counts(q, qe, b"%"), _counts(p, pe, string.ascii_uppercase.encode()) / np.maximum(pn, 1),
            _counts(p, pe, b"-_"), _counts(h, he, b"aeiouy") / np.maximum(hn, 1),
        ],
        1,
    )


@dataclass(frozen=True)
class Filter:
    odds: Odds
    trees: Trees

    def log_odds(self, host: pa.Array, path: pa.Array, query: pa.Array) -> np.ndarray:
        coded = host.dictionary_encode()
        told = _told(coded.dictionary.to_pylist(), self.odds)
        return self.trees.log_odds(np.concatenate([lexical(host, path, query), told[coded.indices.to_numpy()]], 1))


def _fold(host: str) -> int:
    return hashlib.blake2b(host.encode(), digest_size=4).digest()[0] % FOLDS


def train(labelled: DataFrame, sample: int = SAMPLE, url: str = "url", label: str = "label") -> Filter:
    """From rows of (url, label: 1 unwanted, 0 wanted); rows without either, or without a host, teach nothing."""
    rows = labelled.select(F.col(url).cast("string").alias("u"), F.col(label).cast("int").alias("y")).where("u IS NOT NULL AND y IN (0, 1)").select("u", "y", host_of(F.col("u")).alias("h")).where("h <> ''")
    known = rows.orderBy(F.xxhash64("u"), "u", "y").limit(sample).select("h", path_of(F.col("u")).alias("p"), query_of(F.col("u")).alias("q"), "y").toArrow().combine_chunks()
    host, path, query = (pa.concat_arrays(known.column(c).chunks) if known.num_rows else pa.array([], pa.string()) for c in "hpq")
    hosts, y = host.to_pylist(), known.column("y").to_pylist()
    folds = np.array([_fold(h) for h in hosts], int)
    told = np.zeros((len(hosts), 4))
    for k in range(FOLDS):
        odds = _odds([h for h, f in zip(hosts, folds, strict=True) if f != k], [v for v, f in zip(y, folds, strict=True) if f != k])
        told[folds == k] = _told([h for h, f in zip(hosts, folds, strict=True) if f == k], odds)
    return Filter(_odds(hosts, y), fit(np.concatenate([lexical(host, path, query), told], 1), np.array(y, float)))


def judge(urls: DataFrame, model: Filter, rules: Sequence[tuple[str, str, str]] = (), threshold: float = THRESHOLD, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, log_odds) of each row."""

    @F.arrow_udf("double")
    def log_odds(host: pa.Array, path: pa.Array, query: pa.Array) -> pa.Array:
        return pa.array(model.log_odds(host, path, query))

    rows = urls.select(F.col(id_col), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("_url"))
    rows = rows.select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), query_of(F.col("_url")).alias("_query"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("_rule"), log_odds("host", "path", "_query").alias("log_odds"))
    own = F.when((F.col("host") != "") & (F.col("log_odds") >= threshold), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "log_odds")


@functools.lru_cache(4)
def _examples(count: int) -> tuple[tuple[str, int], ...]:
    return tuple(labelled_urls(count))


def examples(spark: SparkSession, count: int = URLS) -> DataFrame:
    return spark.createDataFrame(list(_examples(count)), "url string, label int")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), train(examples(spark)), RULES)
