"""URL filters: explicit host and path rules, and association rules mined from labelled urls.

A url is a set of tokens (scheme, host, its parent domains and labels, path segments with digits folded, extension,
query names, fragment). A url that an explicit rule fits is labelled by it, another by the row of ``labels`` with the page's id
(quality 1 is allow, 0 is block). Over a bounded sample of these, Spark's FP-growth finds all frequent combinations of tokens and
labels; of tokens on the same urls one is enough, and one on all urls tells nothing, so those are left out first. A
combination with a label is a rule, kept by support, confidence, chi-square (which asks for more than the label's base rate and which any
share of a class can reach) and if no shorter rule is as confident. All urls are then matched by an inverted index from token
to rules, counting hits until a rule's tokens are complete: one pass, no shuffle.

Defined cases: a null url or one without ``://`` has empty host and path and no tokens (verdict by default); repeated
pages are judged alike; of several rows of ``labels`` for a page the lowest quality counts; tied rules: the shorter, then the smaller
by code point decides; urls of any length are read whole; without labels only explicit rules and the default
speak, which is allow, or block where most labelled urls are bad; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Explicit rules (verdict, host, path); the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Mining: sampled labels of a class and sampled urls of a verdict at most; a rule's least share and number of rows, confidence and chi-square (0.01 by chance).
SAMPLE = 50_000
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_CHI, DEFAULT = 0.002, 5, 0.6, 6.63, "allow"

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END, _QUERY = re.compile(r"[/?#]"), re.compile(r"[?#]")


def parts(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path, and the rest of a url."""
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    m = _END.search(rest)
    host, tail = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    m = _QUERY.search(tail)
    path, more = (tail[: m.start()], tail[m.start() :]) if m else (tail, "")
    return host.translate(_LOWER), path, more


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a url, sorted."""
    host, path, more = parts(url)
    if not host and not path:
        return []
    names = host.split(".")
    out = {"scheme:" + url.split("://", 1)[0].lower(), *("host:" + ".".join(names[i:]) for i in range(len(names))), *("label:" + x for x in names)}
    for seg in path.split("/"):
        if seg:
            out.add("seg:" + re.sub(r"\d+", "#", seg.lower()))
            if "." in seg:
                out.add("ext:" + seg.rsplit(".", 1)[1].lower())
    if path.endswith("/"):
        out.add("end:/")
    query, _, fragment = more.partition("#")
    out.update("arg:" + x.split("=", 1)[0].lower() for x in query[1:].split("&") if x)
    if fragment:
        out.add("fragment:" + fragment.lower())
    return sorted(out)


#: Labels among the items of a combination: no token of a url starts like this.
VERDICT = "="


def _labelled(urls: DataFrame, rules) -> DataFrame:
    """(verdict, h, tokens) of urls(url, h, known) that a rule or a known verdict labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url, h, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                host, path, _ = parts(url)
                if verdict := explicit(host, path, rules)[1] or known:
                    out.append((verdict, h, tokens(url)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.string())))], names=["verdict", "h", "tokens"])

    return urls.mapInArrow(run, "verdict string, h long, tokens array<string>")


def sample_urls(pages: DataFrame, labels: DataFrame, rules=(), sample: int = SAMPLE) -> DataFrame:
    """(verdict, tokens) of at most ``sample`` urls of each verdict, by the hash of id and url."""
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = lambda v: wanted.where(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).unionByName(pick(1)).select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 1, "allow").otherwise("block").alias("known"))
    urls = pages.select("page_id", "url").join(F.broadcast(chosen), "page_id", "left")  # at most 2 x sample rows
    found = _labelled(urls.select("url", F.xxhash64("page_id", "url").alias("h"), "known"), rules)
    best = lambda v: found.where(F.col("verdict") == v).orderBy("h", "tokens").limit(sample).select("verdict", "tokens")
    return best("allow").unionByName(best("block"))


def chi_square(n, k, total: int, hits: int):
    """Chi-square of combinations of ``n`` of ``total`` rows, ``k`` of whose rows are in a class of ``hits``; negative where it speaks against the class."""
    n, k, total, hits = n.cast("double"), k.cast("double"), float(total), float(hits)  # the products pass the range of long
    gain = k * total - n * hits
    return total * gain * F.abs(gain) / (n * F.greatest(F.lit(total) - n, F.lit(1.0)) * hits * (total - hits))


def mine(pages: DataFrame, labels: DataFrame, rules=(), sample: int = SAMPLE, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, min_chi: float = MIN_CHI) -> list[tuple[tuple[str, ...], str, float]]:
    """All rules (tokens, verdict, confidence) that pass, the most confident first."""
    return learn(pages, labels, rules, sample, min_support, min_rows, min_confidence, min_chi)[0]


def learn(pages: DataFrame, labels: DataFrame, rules=(), sample: int = SAMPLE, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE, min_chi: float = MIN_CHI) -> tuple[list[tuple[tuple[str, ...], str, float]], str]:
    """The rules, and the default: block where most labelled urls are bad."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    wanted = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    bad = {r.quality: r["count"] for r in wanted.join(pages.select(F.col("page_id").alias("doc_id")), "doc_id").groupBy("quality").count().collect()}
    default = "block" if bad.get(0, 0) > bad.get(1, 0) else DEFAULT
    known = scratch.write(sample_urls(pages, labels, rules, sample).withColumn("row", F.xxhash64(F.monotonically_increasing_id())))
    total = {r.verdict: r["count"] for r in known.groupBy("verdict").count().collect()}
    n = sum(total.values())
    if len(total) < 2:
        scratch.drop()
        return [], default
    least = max(min_rows, min_support * n)
    each = known.select("row", F.explode("tokens").alias("token")).groupBy("token")
    count = each.agg(F.count(F.lit(1)).alias("n"), F.bit_xor("row").alias("x"), F.sum(F.col("row") % 1_000_003).alias("y")).where((F.col("n") >= least) & (F.col("n") < n))
    one = count.groupBy("n", "x", "y").agg(F.min("token").alias("token"))  # of tokens on the same rows
    told = [r.token for r in one.select("token").collect()]  # at most tokens of the sample / least
    items = F.concat(F.filter("tokens", lambda t: t.isin(told)), F.array(F.concat(F.lit(VERDICT), "verdict")))
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=least / n, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(known.select(items.alias("items")))
    is_verdict = lambda t: t.startswith(VERDICT)
    sets = scratch.write(model.freqItemsets.select(F.array_sort(F.filter("items", lambda t: ~is_verdict(t))).alias("have"), F.get(F.filter("items", is_verdict), F.lit(0)).alias("v"), "freq").where(F.size("have") > 0))
    both = sets.where("v is not null").join(sets.where("v is null").select("have", F.col("freq").alias("n")), "have").select("have", F.substring("v", len(VERDICT) + 1, 9).alias("verdict"), F.col("freq").alias("k"), "n")
    both = both.withColumn("confidence", F.col("k") / F.col("n"))
    chi = F.when(F.col("verdict") == "block", chi_square(F.col("n"), F.col("k"), n, total["block"])).otherwise(chi_square(F.col("n"), F.col("k"), n, total["allow"]))
    good = scratch.write(both.where((F.col("confidence") >= min_confidence) & (chi >= min_chi)).select("have", "verdict", "confidence"))
    less = good.where(F.size("have") > 1).select("verdict", "have", "confidence", F.explode("have").alias("t")).withColumn("part", F.filter("have", lambda x: x != F.col("t")))
    beaten = less.join(good.select(F.col("have").alias("part"), "verdict", F.col("confidence").alias("c")), ["part", "verdict"]).where("c >= confidence").select("have", "verdict").distinct()
    found = good.join(beaten, ["have", "verdict"], "left_anti").collect()  # what one token less makes worse
    scratch.drop()
    kept: list[tuple[frozenset, str, float]] = []
    by_token: dict[str, list[int]] = defaultdict(list)
    for r in sorted(found, key=lambda r: (len(r.have), r.have)):
        have = frozenset(r.have)
        shorter = {i for t in have for i in by_token[t]}
        if not any(kept[i][1] == r.verdict and kept[i][2] >= r.confidence and kept[i][0] < have for i in shorter):
            for t in have:
                by_token[t].append(len(kept))
            kept.append((have, r.verdict, r.confidence))
    return sorted(((tuple(sorted(k)), v, c) for k, v, c in kept), key=lambda x: (-x[2], len(x[0]), x[0])), default


class Index:
    """Inverted index from token to mined rules; the first complete rule in rule order gives the verdict."""

    def __init__(self, mined: list[tuple[tuple[str, ...], str, float]]):
        self.mined, self.by_token = mined, defaultdict(list)
        for i, (have, _, _) in enumerate(mined):
            for t in have:
                self.by_token[t].append(i)

    def verdict(self, found: list[str]) -> str | None:
        hits: dict[int, int] = defaultdict(int)
        for t in found:
            for i in self.by_token.get(t, ()):
                hits[i] += 1
        return min(((i, self.mined[i][1]) for i, k in hits.items() if k == len(self.mined[i][0])), default=(0, None))[1]


def explicit(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def judge(pages: DataFrame, mined: list[tuple[tuple[str, ...], str, float]], rules=RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict, by): ``by`` tells whether a rule, a mined rule or the default spoke."""
    schema = T.StructType([pages.schema["page_id"], *T.StructType.fromDDL("host string, path string, rule string, verdict string, by string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(mined)
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path, _ = parts(url)
                rule, verdict = explicit(host, path, rules)
                mined_verdict = None if rule or not mined else index.verdict(tokens(url))
                out.append((host, path, rule, verdict or mined_verdict or default, "rule" if rule else "mined" if mined_verdict else "default"))
            cols = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), pa.string()) for c in cols]], names=schema.names)

    return pages.select("page_id", "url").mapInArrow(run, schema)


def classify(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """All pages judged by the rules, the rules mined from what these and the labels say, and the default."""
    mined, default = learn(pages, labels, rules)
    return judge(pages, mined, rules, default)
