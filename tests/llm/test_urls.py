import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import urls

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
CASES = [
    None, "", "no scheme/x", "http://", "http://Example.COM/en/1?x#y", "https://www.example.com/en/", "https://a.www.example.com/en/7",
    "http://xexample.com/en/", "http://com/", "http://a.net/es/1", "http://a.net/ES/1", "ftp://net?q=/es/", "http://net#/fr/",
    "http://b.net/fr/x://y/en/", "http://h.org/en/\n/x", "http://É.COM/é", "http://casino-win.example.org/en/5", "http://tionsh.example.org/en/5",
    "x" * 9000 + "://" + "y" * 9000, "http://example.com", "http://example.com?/en/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_rules_and_parts(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(CASES)] + [(0, None, "h", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string")
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, best = brute(CASES[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), CASES[r.page_id]
        assert r.verdict == (best[0] if best else "block" if r.score >= 0.5 else "allow")
        assert 0 <= r.score <= 1
    by = {r.page_id: r.verdict for r in got}
    assert by[CASES.index("http://casino-win.example.org/en/5")] == "block"


def test_learns_from_the_given_table(spark):
    rows = [(f"http://{'aaa' if k % 2 else 'zzz'}{k}.org/{k}", k % 2) for k in range(60)] + [(None, 0), ("http://x.org/", None)]
    train = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(i, f"http://{'aaa' if i % 2 else 'zzz'}{900 + i}.org/{i * 3}") for i in range(20)], "page_id long, url string")
    got = urls.judge(pages, [], train).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") for r in got)
    empty = spark.createDataFrame([], "url string, label int")
    assert {r.score for r in urls.judge(pages, [], empty).collect()} == {0.5}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


def brute_slots(host, path):
    """Slots of n-grams by a hash that is written out here (XXH64 of both strings, chained, as Spark defines it)."""
    out = []
    for name, text in (("host", f"^{host}$"), ("path", f"^{path}$")):
        for n in urls.GRAMS:
            for i in range(len(text) - n + 1):
                h = xxhash.xxh64_intdigest(text[i : i + n].encode(), xxhash.xxh64_intdigest(name.encode(), 42))
                h -= (h >> 63) << 64
                out.append(h % urls.SLOTS)
    return list(dict.fromkeys(out))


def brute_train(rows, steps):
    """The same regression in NumPy, on dense 0/1 features."""
    x = np.zeros((len(rows), urls.SLOTS))
    for i, (url, _) in enumerate(rows):
        slots = brute_slots(*brute(url)[:2])
        x[i, slots] = 1 / np.sqrt(max(len(slots), 1))
    y = np.array([float(label) for _, label in rows])
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, bias, v, vb = np.zeros(urls.SLOTS), 0.0, np.zeros(urls.SLOTS), 0.0
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(x @ w + bias))) - y) * share
        v = 0.9 * v - urls.RATE * (x.T @ e + urls.DECAY * w)
        w = w + v
        vb = 0.9 * vb - urls.RATE / 4 * e.sum()
        bias += vb
    return w, bias, x


def test_model_and_scores_match_brute_force(spark):
    table = urls.labelled_urls(spark)
    rows = [(r.url, r.label) for r in table.collect()]
    w, bias, _ = brute_train(rows, urls.STEPS)
    weights, b = urls.train(table)
    assert np.allclose(weights, w, atol=1e-6) and abs(b - bias) < 1e-6
    got = urls.judge(spark.createDataFrame(list(enumerate(CASES)), "page_id long, url string"), RULES).collect()
    for r in got:
        slots = brute_slots(r.host, r.path)
        want = 1 / (1 + np.exp(-(bias + w[slots].sum() / np.sqrt(max(len(slots), 1)))))
        assert r.score == pytest.approx(want, abs=1e-5)


def test_names_left_out_are_told_apart(spark):
    known, others = urls.labelled_urls(spark, False), urls.labelled_urls(spark, True)
    assert known.join(others, "url").isEmpty() and known.count() + others.count() == urls.labelled_urls(spark).count()
    pages = others.withColumn("page_id", F.monotonically_increasing_id())
    right = urls.judge(pages, [], known).join(pages, "page_id").where("(verdict = 'block') = (label = 1)").count()
    assert right / pages.count() >= 0.85
