"""URL filter: rules first, and for all other URLs a ratio of two character language models.

URLs that an allowing rule decides teach the model of accepted URLs, those that a blocking rule decides that of rejected ones. A model is a smoothed
Markov model of variable order over UTF-8 bytes: a string of up to ``ORDER`` symbols is kept if it makes up at least 1 / 2^``SHARE`` of its
class's symbols (and occurs twice), so contexts are as long as the data allow; each context gives what it saw of a symbol and leaves the rest, by
the number of its different followers, to the context shorter by one (Witten and Bell), down to equal shares. A URL's margin is the
difference of the two log10 likelihoods, divided by its symbols. It is allowed from a threshold up, which is calibrated on a fifth of the
decided URLs that the models never saw: the one with the best balanced accuracy, the middle of the widest-scoring range if several are as good.

Scale: strings are counted in tasks and merged by a shuffle, over all decided URLs. As kept strings have a share of at least 1 / 2^16, there
are at most 2^16 of each length, however large the table: that is the bound of the broadcast. Margins for the threshold are counted in bins of
1 / 1024, of which there are at most ``2 * WIDEST * 1024``. Judging is a map over the pages; only page_id and url are read.

Defined cases. A null URL, or one without ``://``, has an empty host and path; no rule fits it, and the models judge its text
as it is (null: empty). The longest fitting rule wins. Copies of a URL fall on the same side of the calibration. Very long URLs are judged whole. Repeated rows are kept, null page ids too. If one of
the classes has no URL to learn from, every other URL is allowed; without one to calibrate on, the threshold is 0. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegraph.llm.common import Shared, crc_bucket

ORDER, SHARE, BINS, WIDEST = 6, 16, 1024, 16
#: Bytes that UTF-8 never uses mark the two ends.
START, END = b"\xfe", b"\xff"
SYMBOLS = 257
ENTRIES = 1 << 18
FOLDS = 5
ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path): fixed values.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` that fits the columns host and path, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.index("/")
        host, path = text[:at], text[at:]
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decides).otherwise(verdict)
    return rule, verdict


def strings(text: bytes) -> Iterator[bytes]:
    """All strings of up to ``ORDER`` symbols of a text between its ends, but the start alone."""
    whole = START + text + END
    for n in range(1, ORDER + 1):
        yield from (whole[i : i + n] for i in range(n == 1, len(whole) - n + 1))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {}

    def flush():
        for kind, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found)), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["kind", "string", "n"])
        held.clear()

    for batch in batches:
        for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist()):
            held.setdefault(kind, Counter()).update(strings(text))
            if sum(map(len, held.values())) > ENTRIES:
                yield from flush()
    yield from flush()


def kept_strings(decided: DataFrame) -> DataFrame:
    """(kind, string, n) of (kind, text): the strings that have their share of their kind's symbols."""
    counted = decided.select("kind", F.col("text").cast("binary").alias("text")).mapInArrow(_counting, "kind string, string binary, n long")
    summed = counted.groupBy("kind", "string").agg(F.sum("n").alias("n"))
    # A symbol a byte, and the end.
    total = decided.groupBy(F.col("kind").alias("of")).agg(F.sum(F.octet_length("text") + 1).alias("total"))
    return summed.join(F.broadcast(total), F.col("kind") == F.col("of")).where((F.col("n") >= 2) & (F.shiftleft("n", SHARE) >= F.col("total"))).select("kind", "string", "n")


class Markov:
    """Log10 probabilities from counts of strings: of a string's last symbol after the rest of it, and what a context leaves to the shorter one."""

    def __init__(self, counts: dict[bytes, int]):
        total, followers = Counter(), Counter()
        for s, n in counts.items():
            total[s[:-1]] += n
            followers[s[:-1]] += 1
        share = {}
        for s in sorted(counts, key=len):
            c = s[:-1]
            shorter = share[s[1:]] if c else 1 / SYMBOLS
            share[s] = (counts[s] + followers[c] * shorter) / (total[c] + followers[c])
        self.log = {s: math.log10(p) for s, p in share.items()}
        self.left = {c: math.log10(followers[c] / (total[c] + followers[c])) for c in total}

    def score(self, text: bytes) -> float:
        """Log10 probability of a text and its end."""
        whole, log, left, out = START + text + END, self.log, self.left, 0.0
        for i in range(1, len(whole)):
            for at in range(max(0, i + 1 - ORDER), i + 1):
                if (p := log.get(whole[at : i + 1])) is not None:
                    out += p
                    break
                out += left.get(whole[at:i], 0.0)
            else:
                out -= math.log10(SYMBOLS)
        return out


class Ratio:
    def __init__(self, counts: dict[str, dict[bytes, int]]):
        self.allow, self.block = Markov(counts[ALLOW]), Markov(counts[BLOCK])

    def margin(self, text: bytes) -> float:
        return (self.allow.score(text) - self.block.score(text)) / (len(text) + 1)


def with_margin(pages: DataFrame, model: Shared, schema: str) -> DataFrame:
    """``pages`` with text (bytes) replaced by margin, the last column of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = pa.array([model.value.margin(t) for t in batch.column("text").to_pylist()], pa.float64())
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), margins], names=[*kept, "margin"])

    return pages.mapInArrow(run, schema)


def threshold(bins: list[tuple[str, int, int]]) -> int:
    """The bin from which to allow, of (kind, bin, n): best balanced accuracy, the middle of the first longest run of best ones."""
    total, at = Counter(), {}
    for kind, b, n in bins:
        total[kind] += n
        at.setdefault(b, Counter())[kind] += n
    if not total[ALLOW] or not total[BLOCK]:
        return 0
    edges = sorted(at)
    rejected, right, found = 0.0, 1.0, []
    # Allowing from bin b up: rejected ones below b and accepted ones from b on are right.
    for low, b in zip([edges[0] - 1, *edges], [*edges, edges[-1] + 1]):
        found.append((rejected + right, low + 1, b))
        here = at.get(b, Counter())
        rejected, right = rejected + here[BLOCK] / total[BLOCK], right - here[ALLOW] / total[ALLOW]
    best = max(f[0] for f in found)
    _, low, high = max((f for f in found if f[0] > best - 1e-12), key=lambda f: f[2] - f[1])
    return (low + high) // 2


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, margin) of pages (page_id, url); see the module."""
    url = F.col("url")
    # The models read what follows the scheme, with the host in lower case.
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    found = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = fitting(rules)
    found = found.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("kind"), F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat("host", rest)).otherwise(url), F.lit("")).alias("text"))
    decided = found.where("kind is not null")
    aside = crc_bucket("url", FOLDS) == 0
    counts = {ALLOW: {}, BLOCK: {}}
    for r in kept_strings(decided.where(~aside)).toLocalIterator():
        counts[r.kind][bytes(r.string)] = r.n
    if not counts[ALLOW] or not counts[BLOCK]:
        return found.select("page_id", "host", "path", "rule", F.coalesce("kind", F.lit(ALLOW)).alias("verdict"), F.lit(0.0).alias("margin"))
    model = Shared(pages.sparkSession, Ratio(counts))
    held = with_margin(decided.where(aside).select("kind", F.col("text").cast("binary").alias("text")), model, "kind string, margin double")
    bin_ = F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("margin"))) * BINS).alias("bin")
    edge = threshold([tuple(r) for r in held.groupBy("kind", bin_).count().collect()]) / BINS
    names = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    carried = ["page_id", "host", "path", "rule", "kind"]
    scored = with_margin(found.select(*carried, F.col("text").cast("binary").alias("text")), model, ", ".join(f"{c} {names[c]}" for c in carried) + ", margin double")
    own = F.when(F.col("margin") >= edge, ALLOW).otherwise(BLOCK)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("kind", own).alias("verdict"), "margin")


def op13_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
