import itertools
import math

import pytest
from pyspark.sql import functions as F

from seqframe.llm import urls
from seqframe.llm.queries import URL_RULES


def plain(url):
    """Host, path, rule and verdict by the rules alone."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r), r, v) for v, r in URL_RULES if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_hosts_paths_and_rules(spark):
    cases = [None, "", "no scheme.com/en/", "http://", "http://x.COM/en/1?a=/en/", "http://xcom/en/1", "a://b://c/d", "http://example.com/en/7", "http://a.example.com/en/71#x", "http://example.com/en", "HTTPS://É.Example.NET/de/8", "http://net/de/8", "http://a.net/de/", "http://org/es/?q", "http://o.org?es/", "http://a.org#/es/", "http://a.com/en/\nx", "http://a.com/en/" + "x" * 100_000]
    rows = urls.judge(spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)] * 2, "page_id long, url string, host int"), URL_RULES).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        host, path, rule, verdict = plain(cases[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def subsets(rows, support, confidence):
    """The least combinations by all subsets of up to three tokens: {(items, verdict): (confidence, support)}."""
    base = {v: sum(x == v for _, x in rows) / len(rows) for v in ("block", "allow")}
    have = {}
    for tokens, v in rows:
        for n in range(1, 4):
            for combo in itertools.combinations(sorted(tokens), n):
                have.setdefault(combo, []).append(v)
    good = {}
    for combo, vs in have.items():
        for v in base:
            share = vs.count(v) / len(vs)
            n, z2 = len(vs), urls.DEVIATIONS**2
            low = (share + z2 / (2 * n) - math.sqrt(z2 * (share * (1 - share) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
            if vs.count(v) >= support * len(rows) and share >= confidence and base[v] < 1 and 1 - low <= (1 - base[v]) / 2:
                good[combo, v] = (share, vs.count(v) / len(rows))
    return {(c, v): x for (c, v), x in good.items() if not any(v == w and set(d) < set(c) for d, w in good)}


def test_mined_combinations_against_all_subsets(spark):
    rows = [(["a", "b", "c"], True)] * 5 + [(["a", "b"], True)] * 4 + [(["a", "c"], False)] * 6 + [(["b"], False)] * 3 + [(["d", "a"], True)] * 2 + [(["d"], True)] * 3 + [([], False)] + [(["e", "c"], False)] * 4 + [(["e"], True)]
    rows = [(t, "block" if b else "allow") for t, b in rows] * 6
    found = {(tuple(r["items"]), r.verdict): (r.confidence, r.support) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.8).collect()}
    want = subsets(rows, 0.1, 0.8)
    assert found.keys() == want.keys() and len(want) > 2 and {v for _, v in want} == {"block", "allow"}
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_labels_reach_what_no_rule_fits(spark):
    pages = [(i, f"http://ads{i % 3}.bad.net/track{i % 2}/{i}?aff={i}") for i in range(40)] + [(100 + i, f"http://ok.net/page/{i}") for i in range(40)] + [(200, "http://new.site.org/track1/x"), (201, "http://new.site.org/x"), (202, None), (203, "http://new.site.org/page/"), (200, "http://new.site.org/track1/x")]
    rows = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), [("block", "bad.net/"), ("allow", "ok.net/page")], support=0.05, confidence=0.9).collect()
    verdicts = {r.page_id: (r.rule, r.verdict, r.by) for r in rows}
    assert len(rows) == len(pages) and all(verdicts[i] == ("bad.net/", "block", "given") for i in range(40))
    assert verdicts[200] == (None, "block", "mined") and verdicts[203] == (None, "allow", "mined") and verdicts[201] == verdicts[202] == (None, "allow", "default")


def test_one_kind_of_label_mines_nothing(spark):
    pages = [(i, f"http://bad.net/{i}") for i in range(40)] + [(50, "http://other.net/1")]
    rows = {r.page_id: (r.verdict, r.by) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), [("block", "bad.net/")]).collect()}
    assert rows[50] == ("allow", "default") and rows[3] == ("block", "given")


def test_effect_on_the_real_table(spark):
    """Every verdict of a URL without a rule against all subsets of its tokens, and how many the mined rules give."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = {r.page_id: r for r in urls.judge(pages, URL_RULES).collect()}
    tokens = {r.page_id: r.tokens for r in pages.select("page_id", urls.tokens_of(F.col("url"), urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("tokens")).collect()}
    labelled = [(tokens[k], r.verdict) for k, r in rows.items() if r.rule]
    common = {t for t in set().union(*(t for t, _ in labelled)) if sum(t in x for x, _ in labelled) >= urls.SUPPORT * len(labelled)}
    want = subsets([([t for t in x if t in common], v) for x, v in labelled], urls.SUPPORT, urls.CONFIDENCE)
    single = {c[0]: (x, v) for (c, v), x in want.items() if len(c) == 1}
    mined = [k for k, r in rows.items() if r.by == "mined"]
    unruled = [k for k, r in rows.items() if not r.rule]
    print(len(rows), len(labelled), len(unruled), len(mined), sum(rows[k].verdict == "block" for k in mined), len(want), len(single))
    assert len(mined) > 0.3 * len(unruled) and {rows[k].verdict for k in mined} == {"block", "allow"}
    agree = 0
    for k in unruled:
        fits = [(x, v == "allow") for (c, v), x in want.items() if set(c) <= set(tokens[k])]
        agree += rows[k].verdict == ("block" if fits and not max(fits)[1] else "allow")
    assert agree >= 0.97 * len(unruled)  # a row's basket holds its most telling tokens, not all


def test_no_rows_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert urls.judge(one, []).collect()[0].verdict == "allow"
