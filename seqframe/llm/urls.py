"""Operator 5: URL filtering by host and path rules, and by mined association rules for the rest.

DataFrame functions and Spark's FP-growth only. Given rules decide where one
fits: on its host and all subdomains, if the path starts with the rule's; the
longest wins. Their verdicts label the distinct URLs that they fit, and only those;
FP-growth mines token combinations (host and its labels, path segments, file type,
query keys and pairs, scheme) of whole URLs that imply `block` or `allow` with
enough support and confidence. Of those combinations only the least are kept, and an inverted
index from token to combination finds the ones that a URL has in full. A URL that
no given rule fits gets the verdict of the combination with the largest
confidence; without any it is allowed.

Mining takes about `SAMPLE` labelled URLs, by a hash, of each the `TOKENS` most
telling frequent tokens, so that no URL has an unbounded number of combinations,
and combinations of up to `ITEMS` tokens. Matching takes all tokens of all URLs.

Defined results: a null url, or one without `://`, has an empty host and path, no
rule and the verdict allow; equal urls have equal results, however many rows they
have; without given rules, or if all labels are the same, nothing is mined; urls of
any length are read whole; rows with null or equal keys are judged each; other
columns are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.llm.common import spread_join, written

#: Least share of the labelled URLs that have a combination and the label, and of those with the combination that have the label.
SUPPORT, CONFIDENCE = 0.005, 0.95
#: Labelled URLs that are mined, about, and tokens of each; tokens of a combination; standard deviations that its confidence is trusted by.
SAMPLE, TOKENS, ITEMS, DEVIATIONS = 200_000, 10, 3, 1.96

Rules = Sequence[tuple[str, str]]


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Rules) -> Column:
    """The longest of `rules` ((verdict, host/path) pairs) that fits, as a struct (rule, verdict), else null."""
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    listed = F.array(*[F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0].lower()).alias("host"), F.lit("/" + r.partition("/")[2] if "/" in r else "").alias("path")) for v, r in rules])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"], r["rule"], r["verdict"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a whole URL: its scheme, its host and the host's last two and three labels, each label, each path segment, file type, query key and query pair, and the fragment."""

    def marked(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))

    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    ends = F.array(*[F.when(F.size(labels) > k, F.array_join(F.slice(labels, -k, k), ".")).otherwise("") for k in (2, 3)], host)
    whole = F.coalesce(url, F.lit(""))
    query = F.split(F.regexp_extract(whole, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    parts = [
        marked("scheme", F.array(F.when(host != "", F.substring_index(whole, "://", 1)).otherwise(""))),
        marked("host", ends),
        marked("label", labels),
        marked("path", F.split(path, "/")),
        marked("type", F.array(F.regexp_extract(path, r"\.([^./]+)$", 1))),
        marked("key", F.transform(query, lambda x: F.substring_index(x, "=", 1))),
        marked("query", query),
        marked("fragment", F.array(F.regexp_extract(whole, r"(?s)#(.*)$", 1))),
    ]
    return F.array_distinct(F.concat(*parts))


def baskets(labelled: DataFrame, least: float, tokens: int = TOKENS) -> DataFrame:
    """`items` of each row of `labelled` (row, tokens, verdict): its verdict, and those of its tokens that are mined.

    These are tokens of `least` rows at least, and of a row the `tokens` most telling, so that a row has a bounded number of
    combinations. A token is the more telling the further its share of blocks is from that of all rows, in standard errors.
    """
    terms = labelled.select("row", (F.col("verdict") == "block").cast("int").alias("y"), F.explode("tokens").alias("token"))
    share, total = terms.agg(F.avg("y"), F.count("*")).first()
    each = terms.groupBy("token").agg(F.count("*").alias("_n"), F.avg("y").alias("p")).filter(F.col("_n") >= least)
    worth = F.abs(F.col("p") - F.lit(share)) * F.sqrt("_n")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("worth"), "token"))
    kept = spread_join(terms.select("row", "token"), each.select("token", "_n", worth.alias("worth")), "token", total).withColumn("nth", nth).filter(F.col("nth") <= tokens).groupBy("row").agg(F.collect_list("token").alias("kept"))
    none = F.array().cast("array<string>")
    return labelled.select("row", "verdict").join(kept, "row", "left").select(F.concat(F.coalesce("kept", none), F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))


def least_share(share: Column, n: Column) -> Column:
    """The lower end of Wilson's interval, `DEVIATIONS` wide on each side, of a share seen in `n` cases."""
    z2 = DEVIATIONS**2
    return (share + z2 / (2 * n) - DEVIATIONS * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, tokens: int = TOKENS) -> DataFrame:
    """The least token combinations of `labelled` (tokens, verdict: block or allow) that imply a verdict: `items` (sorted), `verdict`, `confidence`, `support` and `combination`, a number.

    A combination must leave at most half as much doubt as there is without it, by the lower end of its confidence's interval, so
    that few URLs that agree by chance make no rule.
    """
    labelled = written(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "url-labels")
    total = labelled.count()
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets(labelled, support * total, tokens))
    implied = F.get("consequent", F.lit(0))
    rules = model.associationRules.filter(implied.startswith("verdict:") & (F.size("antecedent") <= ITEMS)).select(F.array_sort("antecedent").alias("items"), F.substring_index(implied, "verdict:", -1).alias("verdict"), "confidence", "support")
    base = F.broadcast(labelled.groupBy("verdict").agg((F.count("*") / F.lit(max(1, total))).alias("base")))  # two rows
    seen = F.col("support") * total / F.col("confidence")  # labelled URLs that have the combination
    rules = written(rules.join(base, "verdict").filter((F.col("base") < 1) & (1 - least_share(F.col("confidence"), seen) <= (1 - F.col("base")) / 2)).drop("base"), "url-rules")
    # a combination goes if a part of it (of `ITEMS` tokens: each one, each pair) is one for the same verdict
    without_one = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.filter("items", lambda _, j: j != i))
    parts = rules.filter(F.size("items") > 1).select("items", "verdict", F.explode(F.array_union(without_one, F.transform("items", lambda x: F.array(x)))).alias("part"))
    wider = parts.join(rules.select(F.col("items").alias("part"), "verdict"), ["part", "verdict"], "left_semi").select("items", "verdict").distinct()
    return written(rules.join(wider, ["items", "verdict"], "left_anti").select("items", "verdict", "confidence", "support", F.xxhash64("items", "verdict").alias("combination")), "least-url-rules")


def decide(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """`url` and `verdict` of each of `urls` (url, tokens) that has a mined combination in full: the verdict of the one with the largest confidence, then support, then allow before block."""
    terms = urls.select("url", F.explode("tokens").alias("token"))
    index = mined.select(F.explode("items").alias("token"), F.struct(F.size("items").alias("n"), "confidence", "support", "verdict", "combination").alias("rule"))
    index = index.groupBy("token").agg(F.collect_list("rule").alias("rules"))
    index = written(terms.groupBy("token").agg(F.count("*").alias("_n")).join(index, "token"), "url-index")
    found = spread_join(terms, index, "token", urls.count()).select("url", F.explode("rules").alias("r"))
    whole = found.groupBy("url", "r").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("r.n"))
    best = F.max(F.struct("r.confidence", "r.support", (F.col("r.verdict") == "allow").alias("allow")))
    return whole.groupBy("url").agg(best.alias("best")).select("url", F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))


def judge(pages: DataFrame, rules: Rules, key: str = "page_id", url: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, sample: int = SAMPLE) -> DataFrame:
    """`key`, host, path, rule, verdict and `by` (given, mined or default: what gave the verdict) of every row."""
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))  # a null url and an empty one have the same results
    parts = rows.groupBy("url").agg(F.count("*").alias("_n")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parts = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    parts = written(parts.select("url", "_n", "tokens", F.col("fit.verdict").alias("verdict")), "urls")
    total, labels = parts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("verdict")).first()
    # about `sample` labelled URLs, by a hash
    some = F.pmod(F.xxhash64(F.lit("url"), "url"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(1, labels)) * (1 << 30)))
    mined = mine(parts.filter(F.col("verdict").isNotNull() & some), support, confidence) if labels else None
    out = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    given, rest = out.filter("fit is not null"), out.filter("fit is null")
    none = F.lit(None).cast("string").alias("mined")
    if mined is not None and not mined.isEmpty():
        unruled = parts.filter("verdict is null")
        decided = decide(unruled, mined).withColumnRenamed("verdict", "mined")
        rest = spread_join(rest, written(unruled.select("url", "_n").join(decided, "url", "left"), "decided-urls"), "url", total)
    else:
        rest = rest.select("*", none)
    out = given.select("*", none).unionByName(rest)
    by = F.when(F.col("fit").isNotNull(), "given").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return out.select(F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "mined", F.lit("allow")).alias("verdict"), by.alias("by"))
