from cohortlens.llm import url_filters as u


def page(link):
    return f'<p><a class="x" href="{link}">x</a></p>'


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.NET/en/x?q#f", "www.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://a.example.net/de", "a.example.net", "/de", "net/", "block"),
        (3, "x://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        (4, "http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        (5, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (6, "http://x.net", "x.net", "", None, "allow"), (7, "no host", "", "", None, "allow"), (8, None, "", "", None, "allow"),
        (9, "http://h.com?x://y/z", "h.com", "", None, "allow"), (9, "http://h.com?x://y/z", "h.com", "", None, "allow"),
        (None, "a\nb://net/x", "net", "/x", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, url, None, "z", 1) for i, url, *_ in rows], "page_id long, url string, html string, host string, n int")
    got = u.url_verdicts(pages).collect()
    by = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:5] for r in got), key=by) == sorted(((r[0], *r[2:]) for r in rows), key=by)
    assert u.url_verdicts(pages.limit(0)).collect() == []


def test_distrust_goes_back_and_trust_forward(spark):
    bad, good = "http://bad.net/x", "http://good.org/fr/"
    rows = [
        (1, bad, page("http://victim.com/")), (2, good, page("//friend.com/a")),
        (3, "http://farm.com/1", page(bad) + page("HTTP://BAD.net/y")), (4, "http://farm2.com/1", page("http://farm.com/")),
        (5, "http://victim.com/a", ""), (6, "http://friend.com/", page(bad)), (7, "http://alone.com/", page("/local")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in u.url_verdicts(pages).collect()}
    assert {i: r.verdict for i, r in got.items()} == {
        1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow",
    }
    assert got[3].distrust > got[4].distrust > 0 and got[5].distrust == 0
    assert got[6].trust > 0 and got[1].distrust >= got[3].distrust


def test_scores_agree_with_plain_iteration(spark):
    links = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 3.0), ("d", "a", 1.0)]
    seed = {"a": (1.0, 0.0), "d": (0.0, 0.5), "e": (0.25, 0.25)}
    got = u.propagate(
        spark.createDataFrame([(h, *s) for h, s in seed.items()], "host string, trust double, distrust double"),
        spark.createDataFrame(links, "src string, dst string, n double"),
    ).collect()
    hosts, limits = "abcde", {}
    for kind, at in (("trust", 0), ("distrust", 1)):
        steps = links if kind == "trust" else [(d, s, n) for s, d, n in links]
        start = {h: seed.get(h, (0.0, 0.0))[at] for h in hosts}
        score = dict(start)
        for _ in range(300):
            new = dict(start)
            for h in hosts:
                out = [(d, n) for s, d, n in steps if s == h]
                for d, n in out:
                    new[d] += u.PASS_ON * score[h] * n / sum(n for _, n in out)
            score = new
        settled = {r.host: r[kind] for r in got}
        assert set(settled) == set(hosts) and all(score[h] + 1e-9 >= settled[h] >= 0.5 * score[h] for h in hosts)
        limits[kind] = score
    blocked = lambda t, d: d > t and d >= u.BLOCK_FROM
    assert {r.host: blocked(r.trust, r.distrust) for r in got} == {h: blocked(limits["trust"][h], limits["distrust"][h]) for h in hosts}


def test_rounds_go_on_until_verdicts_are_settled(spark):
    """Two hosts that link each other: 0.405 after 8 rounds, 0.504 in the limit."""
    got = u.propagate(
        spark.createDataFrame([("a", 0.0, 0.14)], "host string, trust double, distrust double"),
        spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, n double"),
    ).collect()
    assert {r.host for r in got if r.distrust >= u.BLOCK_FROM} == {"a"}
