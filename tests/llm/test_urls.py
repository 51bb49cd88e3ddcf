import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_DIR
from tenderlens.llm import urls
from tenderlens.llm.storage import table


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    return (m[1].translate(lower), m[2]) if m else ("", "")


def rule(host, path):
    fits = [r for r in urls.RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return min(fits, key=lambda r: (-len(r), r), default=None)


def test_rules_on_all_pages(spark):
    pages = table(spark, SF_DIR, "pages")
    got = urls.judge(pages).collect()
    by = {r.page_id: r.url for r in pages.collect()}
    assert len(got) == len(by)
    for r in got:
        host, path = parts(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path))
        assert r.verdict == (urls.RULES[r.rule] if r.rule else r.verdict)
        assert r.verdict in ("allow", "block")


def test_edges(spark):
    given = [None, "", "no scheme", "HTTP://A.Example.COM", "http://x.com/en/?a://b", "x://www.example.com/en/1", "y://Ä.NET/fr/é",
             "http://evilcom/", "http://a.b.net/es/" + "q" * 50_000, "http://h?x/y", "http://net/es/\nline", "http://example.com/en/"]
    df = spark.createDataFrame(list(enumerate(given + given[:3])), "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("score", F.lit(1))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(got) == len(given) + 3
    for i, u in enumerate(given):
        host, path = parts(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule(host, path)), u
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df, rules={"com/": "allow"}).collect()} == {"allow"}
    assert {r.rule for r in urls.judge(df, rules={}).collect()} == {None}


def test_trees_learn_the_labels(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        bad = bool(rng.integers(2))
        rows.append((i, f"http://{'spam' if bad else 'news'}{rng.integers(9)}.{'xyz' if bad else 'org'}/{rng.integers(10**6) if bad else 'about'}"))
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = {f"spam{k}.xyz/": "block" for k in range(6)} | {f"news{k}.org/": "allow" for k in range(6)}
    got = urls.judge(df, rules=rules).collect()
    rest = [r for r in got if r.rule is None]
    assert rest and all((r.verdict == "block") == r.host.endswith("xyz") for r in rest)


def test_copies_of_one_url_do_not_fill_the_sample(spark):
    rows = [(i, "http://spam0.xyz/same") for i in range(400)]
    rows += [(1000 + i, f"http://{'spam' if i % 2 else 'news'}{i % 9}.{'xyz' if i % 2 else 'org'}/{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = {f"spam{k}.xyz/": "block" for k in range(6)} | {f"news{k}.org/": "allow" for k in range(6)}
    got = urls.judge(df, rules=rules, sample=160).collect()
    rest = [r for r in got if r.rule is None]
    right = [(r.verdict == "block") == r.host.endswith("xyz") for r in rest]
    assert len(got) == 700 and len(rest) > 80 and sum(right) > 0.95 * len(rest), (sum(right), len(rest))


def test_examples_have_both_classes_and_their_copies(spark):
    rows = [(p, p, float(p % 10 == 0)) for p in range(100) for _ in range(1 + 3 * (p == 10))]
    labelled = spark.createDataFrame(rows, "place bigint, place2 bigint, blocked double")
    got = urls._examples(labelled, 10).collect()
    assert sum(r.blocked == 1.0 for r in got) == 5 == sum(r.blocked == 0.0 for r in got)
    assert {r.copies for r in got if r.place == 10} == {4}
    assert abs(sum(r.weight for r in got if r.blocked == 1.0) - 13) < 1e-9
    assert abs(sum(r.weight for r in got if r.blocked == 0.0) - 90) < 1e-9


def test_a_row_is_left_out_of_its_own_rates(spark):
    rows = [(1, "a", "x", "p", 1.0, 2), (2, "a", "y", "q", 0.0, 1)]
    df = spark.createDataFrame(rows, "id int, last string, domain string, segment string, blocked double, copies int")
    rates = urls._rates(df)
    got = {r.id: r for r in urls._with_rates(df, rates, 0.5, F.col("copies"), F.col("blocked")).collect()}
    # "a" is held by two rows, one of them blocked; the example's copies go.
    s = urls.SMOOTHING
    assert math.isclose(got[2].rate_last, (1 + s * 0.5) / (1 + s)) and math.isclose(got[2].rate_domain, (0 + s * 0.5) / s)
    none = {r.id: r for r in urls._with_rates(df, rates, 0.5, F.lit(0.0), F.lit(0.0)).collect()}
    assert math.isclose(none[1].rate_last, (1 + s * 0.5) / (2 + s))


def test_no_python_in_the_plan(spark):
    plan = urls.judge(table(spark, SF_DIR, "pages"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_entropy_of_the_whole_text(spark):
    paths = ["", "/", "/a/b", "/" + "ab" * 1500, "/" + "ab" * 1500 + "xyzq" * 1500, "/é😀" + "😀é✓" * 900, "/" + "".join(map(chr, range(0x4E00, 0x9E00)))]
    df = spark.createDataFrame([(i, f"http://h{'x' * 3000 + 'yz' * i}.org{p}", f"h{'x' * 3000 + 'yz' * i}.org", p) for i, p in enumerate(paths)],
                               "page_id bigint, url string, host string, path string")
    got = {r.page_id: r for r in urls.lexical(df).select("page_id", "host", "host_entropy", "path_entropy").collect()}
    for i, p in enumerate(paths):
        for text, value in ((p, got[i].path_entropy), (got[i].host, got[i].host_entropy)):
            want = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())
            assert math.isclose(value, want, abs_tol=1e-9), (i, value, want)
