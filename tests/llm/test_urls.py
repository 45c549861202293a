from plotline.llm import urls as U

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def judged(spark, rows, **more):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA)
    return {r["page_id"]: r for r in U.judge_urls(df, **more).collect()}


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#f", None), (2, "http://example.net/de/", ""), (3, "https://net/", None), (4, "http://net", None), (5, "http://badexample.com/de/x", None),
        (6, "http://w.example.com/de/x", None), (7, "http://x.org/fr/", None), (8, None, None), (9, "no url", None), (10, "x://h?y=/z", None), (11, "a://b://c.net/d", None), (None, "http://q.net/", None),
    ]
    got = judged(spark, rows)
    show = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    assert show[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert show[2] == ("example.net", "/de/", "net/", "block")
    assert show[3] == ("net", "/", "net/", "block") and show[4][:3] == ("net", "", None)
    assert show[5][2] is None and show[6][2:] == ("example.com/de/", "block") and show[7][2:] == ("org/fr/", "allow")
    assert show[8] == show[9] == ("", "", None, "allow")
    assert show[10] == ("h", "", None, "allow") and show[11] == ("b:", "//c.net/d", None, "allow") and show[None][3] == "block"


def test_propagation_against_brute_force(spark):
    link = lambda *to: " ".join(f'<a href="http://{t}/p">x</a>' for t in to)
    pages = {
        "bad.net": link("farm.com"), "farm.com": link("bad.net", "bad.net", "lone.com"), "friend.com": link("farm.com"), "good.example.net": link("kind.com", "ok.com"), "kind.com": link("ok.com", "bad.net"),
        "ok.com": "", "lone.com": None,
    }
    rows = [(i, f"http://{h}/{'en/' if h.startswith('good') else ''}", t) for i, (h, t) in enumerate(pages.items())]
    got = {r["host"]: r for r in judged(spark, rows, rounds=8).values()}
    hosts = list(pages)
    out = {h: {} for h in hosts}
    for h, t in pages.items():
        for to in (t or "").split('href="http://')[1:]:
            out[h][to.split("/")[0]] = out[h].get(to.split("/")[0], 0) + 1
    back = {h: {a: n for a in hosts for b, n in out[a].items() if b == h} for h in hosts}
    for column, seed, ways in (("trust", "good.example.net", out), ("distrust", "bad.net", back)):
        p = {h: float(h == seed) for h in hosts}
        for _ in range(8):
            flow = {h: 0.0 for h in hosts}
            for a in hosts:
                for b, n in ways[a].items():
                    flow[b] += p[a] * n / sum(ways[a].values())
            p = {h: 0.85 * flow[h] + (h == seed) * (1 - 0.85 * sum(flow.values())) for h in hosts}
        assert all(abs(got[h][column] - p[h]) < 1e-9 for h in hosts)
    assert got["farm.com"]["verdict"] == "block" and got["ok.com"]["verdict"] == "allow" and got["lone.com"]["verdict"] == "allow"


def test_empty(spark):
    assert U.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0


def settled(hosts, edges, seed):
    """Score of each host after very many rounds along ``edges`` (from, to)."""
    p = {h: float(h == seed) for h in hosts}
    for _ in range(400):
        flow = {h: 0.0 for h in hosts}
        for a, b in edges:
            flow[b] += p[a] / sum(x == a for x, _ in edges)
        moved = sum(flow.values())
        p = {h: 0.85 * flow[h] + (h == seed) * (1 - 0.85 * moved) for h in hosts}
    return p


def test_a_long_chain_settles(spark):
    hosts = ["bad.net"] + [f"h{i}.com" for i in range(1, 21)]
    rows = [(i, f"http://{h}/", f'<a href="http://{hosts[i - 1]}/p">' if i else None) for i, h in enumerate(hosts)]
    got = judged(spark, rows)
    want = settled(hosts, [(hosts[i - 1], hosts[i]) for i in range(1, 21)], "bad.net")
    assert all(abs(got[i]["distrust"] - want[h]) < 1e-5 for i, h in enumerate(hosts))
    assert [got[i]["verdict"] for i in range(21)] == ["block" if i == 0 or 21 * want[h] > 0.2 else "allow" for i, h in enumerate(hosts)]
    assert got[9]["verdict"] == "block"


def test_links_to_hosts_without_pages_and_without_a_scheme(spark):
    rows = [(1, "http://a.com/", '<a href="http://x.net/">'), (2, "http://b.com/", "<a href='//between.com/'>"), (3, "https://c.com/", "<a href=//a.com/ > <a href='/local//d.com/'>"), (4, "http://d.com/", '<a href="https://ok.org/fr/x">')]
    got = judged(spark, rows + [(5, "http://between.org/", None)])
    hosts = ["a.com", "b.com", "c.com", "d.com", "between.org", "x.net", "between.com", "ok.org"]
    edges = [("a.com", "x.net"), ("b.com", "between.com"), ("c.com", "a.com"), ("d.com", "ok.org")]
    want = settled(hosts, [(b, a) for a, b in edges], "x.net")
    assert all(abs(got[i]["distrust"] - want[h]) < 1e-5 for i, h in enumerate(hosts[:4], 1))
    assert [got[i]["verdict"] for i in range(1, 6)] == ["block", "allow", "block", "allow", "allow"]
    assert set(got) == {1, 2, 3, 4, 5}


def test_the_registered_query_and_its_sql_on_linked_pages(spark, tmp_path):
    """Absolute and protocol-relative links, hosts without pages, a hub: the query beside its SQL in DuckDB."""
    import random

    import duckdb

    from plotline.llm import queries
    from plotline.llm.sql import URLS_SQL

    rng = random.Random(8)
    hosts = [f"h{i}.com" for i in range(30)] + ["bad.net", "m.example.net", "de.example.com", "x.org", "hub.com"]
    far = ["evil.net", "uncrawled.com", "ok.org"]
    rows = []
    for i in range(120):
        h = rng.choice(hosts)
        to = [rng.choice(hosts + far) for _ in range(rng.choice([0, 1, 3]))] if h != "hub.com" else hosts + far
        html = " ".join(rng.choice(['<a href="http://{}/fr/x">', "<A HREF = '//{}/de/'>", "<a href=https://{}:80/en/?q>", "<a href='/{}'>"]).format(t) for t in to)
        rows.append((i, f"{rng.choice(['http', 'HTTPS'])}://{h}{rng.choice(['', '/', '/en/p', '/de/p', '/fr/p'])}", html if i % 7 else None))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    mine = sorted(tuple(r) for r in queries.op6_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = sorted(con.execute(URLS_SQL).fetchall())
    assert mine == theirs
    unruled = [r for r in mine if r[3] is None]
    assert {r[4] for r in unruled} == {"allow", "block"}


def test_repeated_rows_long_html_and_ties(spark):
    page = "<p>" + "x " * 100_000 + '<a href="http://bad.net/">'
    rows = [(1, "http://a.com/", page), (1, "http://a.com/", page), (None, "http://a.com/", None), (2, "http://example.net/en/", ""), (3, "http://bad.net/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["rule"], r["verdict"]) for r in U.judge_urls(df).collect())
    assert got == [("1", None, "block")] * 2 + [("2", "example.net/en/", "allow"), ("3", "net/", "block"), ("None", None, "block")]
    # rules of equal length: the later by name decides
    tied = U.judge_urls(df, rules=(("a.com", "/", "block"), ("com", "/", "allow"))).where("host = 'a.com'").collect()
    assert {r["rule"] for r in tied} == {"a.com/"}
