from urllib.parse import urljoin

import duckdb
from pyspark.sql import functions as F

from locusmill.llm import preferences, urls

TARGETS = ["../../q", "p2.html", "?x=1", "/a/../b", "./", "..", "../..", "a/./b/../c?d=../e", "//other.net/z", "https://q.org/x#f", "x/y/..", "../../../../top", "/", "go?u=http://x.y/", ".hidden", "/..", "/a/b/."]


def test_targets_resolve_like_the_standard(spark):
    bases = ["http://h.com/a/b/c.html?k=v#z", "http://h.com", "http://h.com/", "http://h.com/a/b/"]
    rows = spark.createDataFrame([(b, t) for b in bases for t in TARGETS], "b string, t string")
    got = {(r["b"], r["t"]): r["u"] for r in rows.select("b", "t", urls.node_of(urls.resolve(F.col("b"), F.col("t"))).alias("u")).collect()}
    for (b, t), u in got.items():
        want = urljoin(b, t).split("#")[0].split("://", 1)[1]
        # a bare host means its root
        host, slash, rest = want.partition("/")
        host, mark, query = host.partition("?")
        want = f"{host}/{mark}{query}{rest}" if mark or not slash else want
        assert u == want, (b, t)
    # empty segments stay, which urljoin drops
    double = spark.createDataFrame([("http://h.com/x/y", "a//b/../c")], "b string, t string")
    assert double.select(urls.resolve(F.col("b"), F.col("t"))).first()[0] == "http://h.com/x/a//c"
    none = spark.createDataFrame([("http://h.com/a", t) for t in ("mailto:a@b", "#top", "", "javascript:x()", None)], "b string, t string")
    assert {r[0] for r in none.select(urls.resolve(F.col("b"), F.col("t"))).collect()} == {None}


def test_edges_and_the_sql_agree(spark, tmp_path):
    link = '<html><link {}><p>canonical</p>'
    pages = [
        (1, "http://x.example.com/en/a/b.html", link.format('rel="alternate canonical" href="../../other/p.html"')),
        (2, "http://x.example.com/other/p.html", None),
        (3, "http://y.net/es/1", '<!-- <link rel=canonical href="http://free.org/"> canonical -->'),
        (4, "http://free.org/", "<meta http-equiv='refresh' content='0; url=deep/./er/../p.html'>"),
        (5, "http://free.org/deep/p.html", link.format("href='?q=2' rel='canonical'")),
        (6, "http://free.org/deep/p.html?q=2", "<link rel=noncanonical href=http://y.net/es/1>"),
        (7, "http://z.net/fr/k", "<link data-rel=canonical href=/m><link rel=CANONICAL href=/n/../../o><!-- canonical"),
        (8, "http://z.net/o", ""),
        (9, "http://z.net/m", ""),
        (10, None, link.format("rel=canonical href=/x")),
        (11, "nothing", None),
        (12, None, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    edges = {(r["a"], r["b"]) for r in urls.alias_edges(df).collect()}
    assert edges == {
        ("x.example.com/en/a/b.html", "x.example.com/other/p.html"), ("free.org/", "free.org/deep/p.html"),
        ("free.org/deep/p.html", "free.org/deep/p.html?q=2"), ("z.net/fr/k", "z.net/o"),
    }
    got = sorted(tuple(r) for r in urls.op3_redirect_equivalence(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(urls.OP3_SQL).fetchall())
    verdicts = {r[0]: r[4] for r in got}
    assert len(got) == 12 and verdicts[8] == "block" and verdicts[9] == "allow" and verdicts[4] == "allow"


def test_own_columns_of_preferences_stay(spark):
    turn = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")], "x", "y", "mine", "upper", 7)]
    df = spark.createDataFrame(rows, f"own int, chosen {turn}, rejected {turn}, _a string, _b string, prompt string, PROMPT_in string, n_common int")
    out = preferences.format_preferences(df)
    (r,) = out.collect()
    assert (r["own"], r["_a"], r["_b"], r["prompt_in_in"], r["PROMPT_in"], r["n_common_in"]) == (1, "x", "y", "mine", "upper", 7)
    assert r["prompt"] == "<|user|>\nq<|end|>\n" and r["n_common"] == 1 and len(out.columns) == len({c.lower() for c in out.columns}) == 14
