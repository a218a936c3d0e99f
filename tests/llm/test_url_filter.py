import random
import re

import pytest

from skytrail.llm import url_filter


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://A.Example.COM/en/7?x", "https://example.com/en/8", "http://xexample.com/en/7", "ftp://net/de/", "http://example.net/de/81/x#y", "http://example.net/de/9", "http://org/es/", "http://org", "no scheme/en/", "", None, "http://", "http://h?q://x/en/", "http://com/en/\nx", "x://com/en/" + "a/" * 5000, "http://com//en/"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "k", "t") for i, u in enumerate(URLS)], "page_id long, url string, host string, template string")
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "page_id long, bad int")
    for r in url_filter.judge(pages, labels).collect():
        host, path, rule, verdict = plain_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_templates(spark):
    """Ids are wildcards; a branch that is mostly bad is told apart and rejected; its siblings merge."""
    rows, labels = [], []
    for i in range(600):
        kind = ("news", "spam", "blog")[i % 3]
        rows.append((i, f"http://site.test/{kind}/{i}"))
        labels.append((i, int(kind == "spam" and i % 10 > 0 or kind != "spam" and i % 20 == 0)))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=[]).collect()
    by = {}
    for r in got:
        by.setdefault(rows[r.page_id][1].split("/")[3], set()).add((r.template, r.verdict))
    assert by == {"news": {("/{blog|news}/*", "allow")}, "spam": {("/spam/*", "block")}, "blog": {("/{blog|news}/*", "allow")}}


def test_wide_nodes_and_alike_branches(spark):
    rows = [(i, f"http://w.test/t{i}/x") for i in range(100)] + [(100 + i, f"http://a.test/{'abc'[i % 3]}/p") for i in range(300)]
    labels = [(i, int(i % 2)) for i in range(100, 400)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=[]).collect()
    assert {r.template for r in got if r.page_id >= 100} == {"/{a|b|c}/p"}
    assert len({r.template for r in got if r.page_id < 100}) == 1


def test_bad_branch_below_the_fourth_segment(spark):
    """The same branch is found at any depth; ids in deep paths are wildcards."""
    rows, labels = [], []
    for i in range(900):
        kind = ("spam", "news", "blog")[i % 3]
        rows.append((i, f"http://deep.test/blog/2023/05/a/b/c/{kind}/{i}"))
        labels.append((i, int(kind == "spam")))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=[]).collect()
    by = {}
    for r in got:
        by.setdefault(rows[r.page_id][1].split("/")[9], set()).add((r.template, r.verdict))
    clean = {("/blog/2023/05/a/b/c/{blog|news}/*", "allow")}
    assert by == {"spam": {("/blog/2023/05/a/b/c/spam/*", "block")}, "news": clean, "blog": clean}


def plain_templates(patterns):
    """(segments, n, labelled, bad) of a host -> templates, a segment at a time."""
    out, level = {}, [((), p) for p in patterns]
    depth = 0
    while level:
        nodes, nxt = {}, []
        for at, p in level:
            if len(p[0]) == depth:
                out[p[0]] = "".join("/" + s for s in at)
            else:
                nodes.setdefault(at, []).append(p)
        for at, ps in nodes.items():
            child = {}
            for q, *c in ps:
                child[q[depth]] = [a + b for a, b in zip(child.get(q[depth], [0, 0, 0]), c)]
            pages = sum(c[0] for c in child.values())
            way = {q: "*" if len(child) > url_filter.WIDE and url_filter.WIDE * c[0] < pages else q for q, c in child.items()}
            branch = {}
            for q, c in child.items():
                branch[way[q]] = [a + b for a, b in zip(branch.get(way[q], [0, 0]), c[1:])]
            known = sorted(((x + 0.5) / (lab + 1), b) for b, (lab, x) in branch.items() if lab)
            groups = [[b for b, (lab, _) in branch.items() if not lab]]
            for i, (share, b) in enumerate(known):
                if i:
                    (l0, x0), (l1, x1) = branch[known[i - 1][1]], branch[b]
                    pooled = (x0 + x1 + 1) / (l0 + l1 + 2)
                if not i or share - known[i - 1][0] > url_filter.Z * (pooled * (1 - pooled) * (1 / (l1 + 1) + 1 / (l0 + 1))) ** 0.5:
                    groups.append([])
                groups[-1].append(b)
            name = {b: g[0] if len(g) == 1 else "{" + "|".join(sorted(g)) + "}" for g in groups for b in g}
            nxt += [((*at, name[way[p[0][depth]]]), p) for p in ps]
        level, depth = nxt, depth + 1
    return out


def test_templates_against_a_plain_walk(spark):
    rng = random.Random(5)
    patterns = {}
    for _ in range(600):
        path = ["x", "y"] if rng.random() < 0.5 else []
        path += [rng.choice("abc") for _ in range(rng.randrange(7))] + ([f"t{rng.randrange(60)}", "end"] if rng.random() < 0.3 else [])
        n = rng.randrange(1, 30)
        lab = rng.randrange(n + 1)
        bad = lab if path[-3:-2] == ["b"] else rng.randrange(lab // 4 + 1)
        patterns[tuple(path)] = (n, lab, bad)
    rows = [("h", list(k), *v) for k, v in patterns.items()]
    got = url_filter.templates(spark.createDataFrame(rows, "host string, segs array<string>, n long, labelled long, bad long")).collect()
    assert len(got) == len(rows)
    assert {tuple(r.segs): r.template for r in got} == plain_templates([(k, *v) for k, v in patterns.items()])


def test_purity_is_smoothed(spark):
    rows = [(i, f"http://one.test/{'a' if i < 10 else 'b'}/x") for i in range(100)]
    labels = [(i, int(i < 10)) for i in range(100)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=[]).collect()}
    assert got[0].purity == pytest.approx((10 + 4 * 0.1) / 14) and got[50].purity == pytest.approx(0.4 / 94)


def test_held_out_pages(spark):
    """Hosts with a bad section each, of another name and depth, among clean hosts: templates are learned
    from a third of the pages' labels, and judge the others."""
    rng = random.Random(11)
    rows, truth = [], {}
    for i in range(6000):
        host = rng.randrange(12)
        bad_section = f"s{host % 4}"
        section = f"s{rng.randrange(6)}"
        path = [section, "x", str(rng.randrange(10**6))] if host % 2 else ["t", section, f"p{rng.randrange(10**6)}.html"]
        truth[i] = int(rng.random() < (0.9 if host < 8 and section == bad_section else 0.03))
        rows.append((i, f"https://h{host}.test/" + "/".join(path), int(host < 8 and section == bad_section)))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in truth.items() if i % 3 == 0], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, rules=[]).collect()}
    held = [(planted, got[i] == "block") for i, _, planted in rows if i % 3]
    assert sum(b for p, b in held if p) >= 0.95 * sum(p for p, _ in held)
    assert sum(b for p, b in held if not p) <= 0.02 * sum(not p for p, _ in held)


def test_random_labels_reject_next_to_nothing(spark):
    """Labels that have nothing to do with the urls."""
    rng = random.Random(12)
    rows = [(i, f"https://h{rng.randrange(30)}.test/{rng.choice(('en', 'de', 'fr'))}/{rng.randrange(10**5)}") for i in range(5000)]
    labels = [(i, int(rng.random() < 0.14)) for i in range(0, 5000, 2)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=[])
    assert got.filter("verdict = 'block'").count() <= 50


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).collect() == []
