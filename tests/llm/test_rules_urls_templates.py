"""Native operators: quality rules, URL filters, templates; against SQL and by hand."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from clientela.llm import decontamination as D
from clientela.llm import quality_rules as R
from clientela.llm.oracle import ORACLE
from clientela.llm.queries import QUERIES
from clientela.llm.url_filter import judge_urls

SMALL = "/root/testdata/sf0.001"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert difference(spark, connection, SMALL, name, QUERIES[name], ORACLE[name]) is None


def test_counts_of_a_text(docs):
    text = "a b c a b c\n \na b c a b c\nA* <b> é!\tx\n"
    row = R.with_features(docs([text, None, "", "one two"])).orderBy("doc_id").collect()
    assert (row[0].n_words, row[0].n_dup_lines, row[0].n_symbols, row[0].n_repeat_words) == (16, 1, 3, 12)
    assert row[0].word_chars == len("".join(text.split())) and row[0].n_capitals == 1 and row[0].n_marks == 1
    assert [(r.n_words, r.word_chars, r.n_lines, r.n_repeat_words) for r in row[1:]] == [(0, 0, 0, 0), (0, 0, 0, 0), (2, 6, 1, 0)]


def test_binomial_tail(spark):
    cases = [(0, 100, 0.02), (1, 400, 0.02), (3, 1000, 0.01), (20, 1000, 0.02), (21, 1000, 0.02), (0, 0, 0.02)]
    for k, n, p in cases:
        df = spark.createDataFrame([(k, n)], "k long, n long")
        found = df.select(R.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert found == (pytest.approx(exact, rel=1e-9) if k <= n * p else 1.0)


def test_cutoffs_need_evidence(spark, docs):
    """Many good and bad labels certify a cutoff on symbols; few certify nothing."""
    clean, junk = " ".join(f"word{i}" for i in range(60)), " ".join(f"w{i}##" for i in range(60))
    texts = [clean + f" t{i}" for i in range(1200)] + [junk + f" t{i}" for i in range(200)]
    labels = spark.createDataFrame([(i + 1, int(i < 1200)) for i in range(1400)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in R.judge(docs(texts), labels).collect()}
    assert all(kept[i] for i in range(1, 1201)) and not any(kept[i] for i in range(1201, 1401))
    kept = {r.doc_id: r.kept for r in R.judge(docs(texts), labels.filter("doc_id % 40 = 0")).collect()}
    assert all(kept.values())
    empty = R.judge(docs([]), labels)
    assert empty.count() == 0 and R.judge(docs([None, "x"]), labels.limit(0)).filter("kept").count() == 0


def test_redirect_classes(spark):
    canonical = '<html><link href="{}" rel="canonical"></html>'
    pages = [
        (1, "http://a.net/x", canonical.format("http://b.org/1")),
        (2, "https://B.org/1#top", None),
        (3, "http://c.org/2?q=1", "<meta http-equiv=refresh content='3; url=/3'>"),
        (4, "http://c.org/3", canonical.format("//b.org/1")),
        (5, "http://d.org/fr/9", canonical.format("http://a.net/x")),
        (6, None, canonical.format("http://a.net/x")),
        (7, "no url", ""),
        (8, "http://www.example.net/en/1", None),
        (9, "http://net", None),
        (10, "http://e.org/1", canonical.format("http://d.org/fr/8")),
        (11, "http://e.org/1", canonical.format("http://z.net/1")),
        (11, "http://e.org/1", canonical.format("http://z.net/1")),
    ]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rows = sorted(judge_urls(df, rules).collect())
    verdicts = [(r.page_id, r.rule, r.verdict, r.reason) for r in rows]
    # 5 is allowed by a rule and in one class with 1, which allows what no rule decides
    assert verdicts == [
        (1, "net/", "block", "rule"), (2, None, "allow", "alias"), (3, None, "allow", "alias"), (4, None, "allow", "alias"),
        (5, "org/fr/", "allow", "rule"), (6, None, "allow", "none"), (7, None, "allow", "none"), (8, "example.net/en/", "allow", "rule"),
        (9, None, "allow", "none"), (10, None, "allow", "alias"), (11, None, "allow", "alias"), (11, None, "allow", "alias"),
    ]
    rows = {r.page_id: r.verdict for r in judge_urls(df.filter("page_id IN (1, 2, 3, 4)"), rules).collect()}
    assert rows == {1: "block", 2: "block", 3: "block", 4: "block"}
    assert judge_urls(df.limit(0), rules).count() == 0


def test_reparameterised_questions(spark, docs):
    item = "A train leaves Paris at 9 and travels 300 km in 4 hours while John reads the long report, and then John counts how many km remain before the 300 km are done"
    changed = item.replace("Paris", "Berlin").replace("9", "7").replace("300", "450").replace("John", "Mary").replace("4 hours", "6 days")
    mixed = item.replace("John", "Mary", 1).replace("300", "450", 1).replace("Paris", "Rome")
    filler = " ".join(f"word{chr(97 + i % 26)} plain" for i in range(60))
    texts = [item, f"{filler} {changed} {filler}", f"{filler} {mixed} {filler}", filler, None, "", changed]
    benchmark = spark.createDataFrame([(5, item), (6, "short item"), (7, None), (8, ""), (5, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in D.contaminated(docs(texts), benchmark).collect())
    assert found == [(1, 5), (2, 5), (7, 5)]
    assert D.contaminated(docs(["so here is a short item", "short items"]), benchmark).select("doc_id").collect() == [(1,)]
    assert D.contaminated(docs([]), benchmark).count() == 0 and D.contaminated(docs(texts), benchmark.limit(0)).count() == 0


def test_copies_whatever_their_case_and_slots(spark, docs):
    sums = "12 + 7 * 3 - 8 / 2 + 19 = 41 - 5"
    capitals = "WHAT IS THE CAPITAL OF THE LARGEST ISLAND IN THE WESTERN SEA"
    story = "The miller of Old Town sold 12 sacks of flour to Anna Maria Bell and kept the other 7 sacks for the winter"
    filler = " ".join(f"word{chr(97 + i % 26)} plain" for i in range(40))
    texts = [f"{filler} {sums} {filler}", f"{filler} {capitals}", f"{filler} {capitals.lower()} {filler}", story.lower(), story.upper(), "12 + 7 * 3", filler]
    benchmark = spark.createDataFrame([(1, sums), (2, capitals), (3, story), (4, "Old Town")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in D.contaminated(docs(texts), benchmark).collect())
    assert found == [(1, 1), (2, 2), (3, 2), (4, 3), (4, 4), (5, 3), (5, 4)]


def test_passages_of_long_items(spark, docs):
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("nd", "lk", "rst", "mp", "x", "ss", "tt", "rv", "gn", "ck")]
    item, filler = " ".join(words[:59]), "some other words before and after the passage"
    quoted = [f"{filler} {' '.join(words[a:b])} {filler}" for a, b in ((0, 35), (20, 40), (46, 59), (10, 22))]
    broken = " ".join(words[:12] + ["Other"] + words[13:25] + ["Other"] + words[26:38])
    shuffled = " ".join(words[30:42] + words[0:12])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in D.contaminated(docs([*quoted, broken, shuffled, filler]), benchmark).collect())
    assert found == [(1, 1), (2, 1), (3, 1)]


LINKS = [
    # page, its url, its html, and what its reference is as a whole URL (None: no edge)
    (1, "http://a.org/x/y?z=1", "<link rel='canonical' href='/login?next=http://bad.net/z'>", "http://a.org/login?next=http://bad.net/z"),
    (2, "http://a.org/x/y", "<link rel=canonical href=../z>", "http://a.org/z"),
    (3, "http://a.org/x/y/", "<link rel=canonical href=./../../q/.>", "http://a.org/q/"),
    (4, "http://a.org/n", '<link rel="nofollow canonical" href="http://b.net/1">', "http://b.net/1"),
    (5, "http://a.org/c", "<!-- <link rel=canonical href=http://b.net/2> -->", None),
    (6, "http://a.org/d", "<script>x = '<link rel=canonical href=http://b.net/3>'</script>", None),
    (7, "http://a.org/e", "<link rel=canonical href='/p&#63;q=1&amp;r=&#x32;'>", "http://a.org/p?q=1&r=2"),
    (8, "http://a.org/f", "<link rel=canonical href='mailto:a@b.net?x=http://c.net/'>", None),
    (9, "http://a.org/g", "<META HTTP-EQUIV='Refresh' content='0; URL=http://b.net/4'>", "http://b.net/4"),
    (10, "http://a.org/h", "<meta http-equiv=refresh content=\"5;url='k'\">", "http://a.org/k"),
    (11, "http://a.org", "<link rel=canonical href='?a=b'>", "http://a.org/?a=b"),
    (12, "http://a.org/i", "<link rel=canonical href='#top'>", "http://a.org/i"),
    (13, "http://a.org/j", "<link href=http://b.net/5 rel=CANONICAL>", "http://b.net/5"),
    (14, "https://b.net/1", None, None),
    (15, "http://d.org/1", "<link rel=canonical href='http://A.org/../../k/../k'>", "http://A.org/k"),
    (16, "http://d.org/2", "<link rel=canonical title='a > b' href='//b.net/6'>", "http://b.net/6"),
    (17, "http://d.org/3", "<link rel=canonical href=\"javascript:go('x://y')\">", None),
    (18, "http://d.org/4", "<link rel=canonical href='&lt;&#xD800;&unknown;&'>", "http://d.org/<\ufffd&unknown;&"),
    (19, "http://d.org/5", "<!-- open <link rel=canonical href=http://b.net/7>", None),
    (20, "http://d.org/6", "<link rel=canonicals href=http://b.net/8><link rel=canonical href=''>", None),
]


def test_references_of_pages(spark):
    import duckdb

    from clientela.llm.oracle import OP2
    from clientela.llm.queries import URL_RULES
    from clientela.llm.url_filter import resolved, targets_of

    df = spark.createDataFrame([p[:3] for p in LINKS], "page_id long, url string, html string")
    links = df.filter("html IS NOT NULL").select("page_id", "url", F.explode(targets_of(F.col("html"))).alias("t"))
    found = {r.page_id: r.w for r in links.select("page_id", resolved(F.col("t"), F.col("url")).alias("w")).collect()}
    assert {p: found.get(p) for p, *_ in LINKS} == {p: w for p, _, _, w in LINKS}
    columns = ["page_id", "host", "path", "rule", "verdict", "reason"]
    ours = judge_urls(df, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?, ?)", [p[:3] for p in LINKS])
    theirs = connection.execute(f"SELECT {', '.join(columns)} FROM ({OP2})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in ours.collect()))) == sorted(map(str, theirs))
    assert {r.page_id for r in ours.filter("reason = 'alias' AND verdict = 'block'").collect()} == {4, 9, 13, 16}


def test_rules_of_one_length(spark):
    rules = spark.createDataFrame([("net", "/abcdefgh/", "block"), ("a.net", "/abcdef", "block"), ("b.a.net", "/abcd", "allow")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://b.a.net/abcdefgh/x", None)], "page_id long, url string, html string")
    assert [(r.rule, r.verdict) for r in judge_urls(df, rules).collect()] == [("net/abcdefgh/", "block")]
    even = rules.union(spark.createDataFrame([("b.a.net", "/abcdef", "allow")], rules.schema))
    assert [(r.rule, r.verdict) for r in judge_urls(df, even).collect()] == [("b.a.net/abcdef", "allow")]


def test_long_chains_and_wide_hubs(spark):
    """A chain of a thousand redirects, a hub with a hundred thousand, and an allowed address inside a blocked class."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    chain = spark.range(1000).selectExpr("concat('http://c', id, '.com/') AS source", "if(id = 999, 'http://end.net/', concat('http://c', id + 1, '.com/')) AS target")
    hub = spark.range(100_000).selectExpr("concat('http://h', id, '.com/') AS source", "if(id = 7, 'http://end2.net/', 'http://hub.com/') AS target")
    hub = hub.union(spark.sql("SELECT 'http://h7.com/', 'http://hub.com/'"))
    inside = spark.createDataFrame([("http://i1.com/", "http://i2.net/"), ("http://i2.net/", "http://i3.org/fr/1")], "source string, target string")
    pages = ["http://c0.com/", "http://c500.com/", "http://h0.com/", "http://h99999.com", "http://hub.com/", "http://i1.com/", "http://i2.net/", "http://other.com/"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    found = {r.page_id: (r.verdict, r.reason) for r in judge_urls(df, rules, chain.union(hub).union(inside)).collect()}
    assert [found[i] for i in range(8)] == [("block", "alias")] * 5 + [("allow", "alias"), ("block", "rule"), ("allow", "none")]
