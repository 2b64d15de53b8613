"""Filter audit, ball codes and URL blocks against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pytest

from postlens.llm import ball_codes, filter_audit, sql_more, url_blocks
from tests.llm.conftest import CLASHES, SCHEMA, long_text

# filter audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_fails(rows):
    """[(part, doc_id, failing letters)]."""
    found = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": smaller}
        found.append((part or "", i, {k for k, v in tests.items() if v}))
    return found


def plain_audit(fails, good, toxic):
    report = {}
    for part in {p for p, *_ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                report[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x,
                ]
        for (p, *_), r in report.items():
            if p == part:
                r[-1] = shapley[r[-1]]
    return {k: tuple(r) for k, r in report.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in filter_audit.filter_audit(docs, labels).collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_audit_edges(spark, edge_docs, edge_rows):
    mixed = " ".join(f"Ab{k}" for k in range(120))
    more = [(30, mixed, "en", "a", 1), (31, mixed + " #", "en", "a", 1), (32, mixed, None, "a", 1), (33, mixed.lower(), "zz", "a", 1), (34, "", "zz", "a", 1)]
    rows = edge_rows + more
    labels = [(1, 1, 0), (2, 0, 1), (31, 1, 1), (32, 1, None), (32, None, 1), (20, 1, 0), (None, 1, 1), (99, 1, 1), (14, None, None)]
    docs = edge_docs.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    marked = spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' as part", "1 as key", "2 as digest", "true as good")
    got = audited(docs.repartition(5), marked)
    of = lambda k: {i for i, *v in labels if i is not None and v[k] == 1}
    want = plain_audit(plain_fails([(r[0], r[1], r[2]) for r in rows]), of(0), of(1))
    assert got == want
    # whichever filter removes a document, each document is removed once in every order
    for part, order in {k[:2] for k in got}:
        steps = [got[part, order, s] for s in range(1, 6)]
        assert sum(s[6] for s in steps) == 120 * sum(s[1] for s in steps)


def test_audit_without_failures_or_labels(spark):
    clean = " ".join(f"w{k}" for k in range(150))
    docs = spark.createDataFrame([(1, clean, "en"), (2, clean + " x", "en"), (3, "#", "xx")], "doc_id long, text string, lang string")
    got = audited(docs, spark.createDataFrame([], LABELS))
    assert len(got) == 1200
    assert all(v == (2, 0, 0, 0, 0, 0, 0) for (p, *_), v in got.items() if p == "en")
    assert got["xx", "ADBCE", 1] == (0, 1, 0, 0, 0, 0, 60) and got["xx", "ADBCE", 2] == (0, 0, 1, 0, 0, 0, 60)


def test_audit_empty(spark, no_docs):
    assert audited(no_docs, spark.createDataFrame([], LABELS)) == {}


def test_audit_hot_text(spark):
    """A third of all rows holds one text: it is broadcast, not shuffled."""
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i // 2}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = filter_audit.judged(docs, spark.createDataFrame([], LABELS))
    assert {r.doc_id for r in filter_audit.repeats(judged).collect()} == {i for p, i, f in plain_fails_by_text(rows) if f}


def plain_fails_by_text(rows):
    least = {}
    for i, t, _ in rows:
        least[t] = min(i, least.get(t, i))
    return [(p, i, i > least[t]) for i, t, p in rows]


def test_audit_walks_relations(spark, edge_docs):
    """Removals come from anti joins, redundancies from semi joins, of ids."""
    rows = filter_audit.judged(edge_docs, spark.createDataFrame([], LABELS))
    ids = filter_audit.failing_ids(rows, {c: rows.where(c) for c in "ABCD"})
    plan = filter_audit.prefix_tallies(ids)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 3 and "text" not in plan
    assert not re.search("Join Cross|CartesianProduct", plan)


# ball codes


def plain_codes(vectors, parts, entries, rounds):
    """(codes, errors, codebooks) by comparing all with all, in plain integers."""
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    size = len(x[0]) // parts
    x = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in x]
    books = [[v[p] for v in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    find = lambda v: [min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        own = [find(v) for v in x]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, o in zip(x, own) if o[p][1] == k]
                if mine:
                    books[p][k] = tuple(sum(c) // len(mine) for c in zip(*mine))
    own = [find(v) for v in x]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return ["".join("%02x" % k for _, k in o) for o in own], [sum(d for d, _ in o) for o in own], digest


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_equal_all_with_all(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 1, (6, 32))
    v = np.concatenate([centres[i % 6] + draw.normal(0, 0.02 if i % 2 else 0.5, 32) for i in range(240)]).reshape(-1, 32).astype("f4")
    v[50:90] = v[10]  # ties
    v[100:110] = np.round(v[100:110])
    rows = [(i, v[i].tolist(), None if i % 5 == 0 else i % 3) for i in range(240)]
    shuffled = spark.createDataFrame(rows, VECTORS).repartition(7)
    for parts, entries, rounds in ((16, 64, 2), (4, 16, 3), (1, 8, 1), (2, 300, 0)):
        if entries > 256:
            with pytest.raises(ValueError):
                ball_codes.ball_codes(shuffled, parts=parts, entries=entries)
            continue
        got = sorted(ball_codes.ball_codes(shuffled, parts=parts, entries=entries, rounds=rounds).collect())
        codes, errors, digest = plain_codes([r[1] for r in rows], parts, entries, rounds)
        assert [r.code for r in got] == codes
        assert [r.error for r in got] == errors
        assert {r.codebooks_sha256 for r in got} == {digest}
        sums = {}
        for (_, _, label), e in zip(rows, errors):
            sums[label] = sums.get(label, 0) + e
        assert [r.label_error for r in got] == [sums[label] for *_, label in rows]


def test_codes_edges(spark):
    inf, nan = float("inf"), float("nan")
    one = [0.5] * 16
    rows = [(5, one, 1), (5, one, 1), (None, [0.25] * 16, None), (1, None, 1), (2, [nan] + one[1:], 1), (3, one[1:] + [inf], 1), (4, [None] + one[1:], 1),
            (6, [], 1), (7, [-0.001] * 16, None), (8, [-inf] + one[1:], None)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", *[f"1 as {c}" for c in CLASHES if c not in VECTORS], "'q' as v", "'q' as code", "'q' as label_key")
    got = sorted(ball_codes.ball_codes(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [r.vec_id for r in got] == [5, 5, 7, None]
    codes, errors, digest = plain_codes([one, one, [-0.001] * 16, [0.25] * 16], 16, 64, 2)
    assert [r.code for r in got] == codes and [r.error for r in got] == errors and got[0].codebooks_sha256 == digest
    assert ball_codes.ball_codes(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(Exception, match="components among vectors"):
        ball_codes.ball_codes(spark.createDataFrame([(1, one, 1), (2, one + one, 1)], VECTORS))
    with pytest.raises(Exception, match="components among vectors"):
        ball_codes.ball_codes(spark.createDataFrame([(1, one, 1), (2, one + one, 1)], VECTORS), entries=1).collect()


def test_rings_skip_and_restrict():
    """Stable parts meet no entry, the others only those of their ring."""
    book = np.array([[0], [10], [40], [1000]])
    order, gap = ball_codes.gaps(book, [4, 6, 6, 6])
    assert (gap[0] == ball_codes.FAR).all()  # a ball of radius 4 reaches no entry at 10 or more
    assert (gap[1][:1] == [100]).all() and (gap[1][1:] == ball_codes.FAR).all()
    x = np.array([[4], [5], [6], [25], [999]])
    met = []
    order, gap = ball_codes.gaps(book, None)

    class Watched:
        def __getitem__(self, key):
            met.append(len(key[0]))
            return order[key]

    entry, d = ball_codes.nearest(x, np.array([0, 0, 0, 1, 3]), book, Watched(), gap)
    assert entry.tolist() == [0, 0, 1, 1, 3] and d.tolist() == [16, 25, 16, 225, 1]  # ties go to the lower entry
    assert met == [3, 1]  # parts 1, 2 and 3 meet their first ring, part 3 alone the second; 0 and 4 are stable


# URL blocks

PAGES = "page_id long, url string, html string"


def tag(*tags):
    return "<!DOCTYPE html><html><head>" + "".join(tags) + "</head><body><a href='/x'>x</a></body></html>"


def canonical(to):
    return f'<link rel="canonical" href="{to}">'


def refresh(to):
    return f'<meta http-equiv="refresh" content="0; url={to}">'


CASES = [
    (1, "http://a.org/x", tag(canonical("http://bad.net/y")), "block"),  # named by a blocked URL
    (2, "https://b.org/x?q=1#f", tag(refresh("http://a.org/x")), "block"),  # over two edges
    (3, "http://c.org/x", None, "allow"),
    (4, None, tag(canonical("http://bad.net/y")), "allow"),
    (5, "nourl", tag(canonical("http://bad.net/y")), "allow"),
    (6, "HTTP://B.org/x?q=1", "", "block"),  # the same URL as 2, in other letters
    (7, "http://d.org", tag(canonical("/z")), "block"),
    (8, "http://d.org/z", tag(canonical("http://sub.example.com/de/q")), "block"),
    (9, "http://e.org/x", tag(canonical("http://f.net/")), "allow"),  # 10 is allowed by a rule and an alias
    (10, "http://e.org/fr/x", tag(canonical("http://f.net/")), "allow"),
    (11, "http://f.net/", "", "block"),  # its own rule
    (12, "http://g.org/x", tag("<title>plain</title>"), "allow"),
    (13, "http://x.example.net/en/1", tag(canonical("http://bad.net/y")), "allow"),  # explicit allow, and so an alias of 1
    (14, "http://q.org/fr", "", "allow"),
    (15, "", "", "allow"),
    (16, "http://Net/a", "", "block"),
    (17, "http://notnet/a", "", "allow"),
    (18, "http://example.com/de/", "", "block"),
    (19, "http://y.org/1", tag(canonical("http://y.org/1")), "allow"),
    (20, "http://b.org/x", "", "allow"),  # another query than 2
]


def verdicts(spark, cases):
    df = spark.createDataFrame([c[:3] for c in cases], PAGES).selectExpr("*", "'q' as host", "'q' as path", "1 as node", "'q' as rule", "'q' as verdict", "1 as component")
    return {r.page_id: r for r in url_blocks.url_verdicts(df.repartition(3), url_blocks.rule_table(spark)).collect()}


def test_url_cases(spark):
    without = [c for c in CASES if c[0] != 13]
    got = verdicts(spark, without)
    assert {k: r.verdict for k, r in got.items()} == {c[0]: c[3] for c in without}
    assert got[1].n_aliases == 3 and got[1].by_alias and got[4].host == "" and got[11].rule == "net/" and not got[11].by_alias
    # an explicit allow among the aliases goes before the block
    got = verdicts(spark, CASES)
    assert [got[k].verdict for k in (1, 2, 6, 13)] == ["allow"] * 4 and got[13].rule == "example.net/en/"


def test_url_sql_agrees(spark, tmp_path):
    spark.createDataFrame([c[:3] for c in CASES], PAGES).coalesce(1).write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict, n_aliases, by_alias FROM ({sql_more.URL_BLOCKS}) ORDER BY page_id").fetchall()
    got = verdicts(spark, CASES)
    assert [tuple(got[k]) for k in sorted(got)] == want


def test_url_parsing():
    at = "http://h.org/a/b"
    assert url_blocks.targets(at, "<!-- <link rel=canonical href='http://no.org/'> --><script>'<link rel=canonical href=x>'</script>") == []
    assert url_blocks.targets(at, tag("<LINK HREF='../c?x=1&amp;y=2' REL='Alternate Canonical'/>")) == ["http://h.org/c?x=1&y=2"]
    assert url_blocks.targets(at, tag("<base href='//other.org/d/'>", canonical("e"))) == ["http://other.org/d/e"]
    assert url_blocks.targets(at, tag(refresh("'/r s'"), '<meta http-equiv=refresh content="5">', canonical(""), canonical("http://[no"))) == ["http://h.org/r s"]
    assert url_blocks.targets(at, "x" * 100_000 + canonical("/z" + long_text(2000)[:500])) != []


def test_url_hot_target_and_chain(spark):
    """A third of all pages names one URL, others form a long chain."""
    rows = [(i, f"http://s{i}.org/p", tag(canonical("http://hub.org/"))) for i in range(300)]
    rows += [(1000 + i, f"http://t{i}.org/p", tag(refresh(f"http://t{i + 1}.org/p"))) for i in range(40)]
    rows += [(2000, "http://hub.org/", tag(canonical("http://bad.net/z")))]
    got = verdicts(spark, [(*r, None) for r in rows])
    assert all(got[i].verdict == "block" and got[i].n_aliases == 302 for i in [*range(300), 2000])
    assert all(got[1000 + i].verdict == "allow" and got[1000 + i].n_aliases == 41 for i in range(40))


def test_rules_longest_and_ties(spark):
    rules = [("block", "org", "/"), ("allow", "a.org", "/"), ("block", "a.org", "/b"), ("allow", "b.a.org", ""), ("block", "b.a.org", ""), ("block", None, "/x"), ("block", "", "/"), ("allow", "C.org", None)]
    pages = [(1, "http://z.org/q", ""), (2, "http://a.org/q", ""), (3, "http://a.org/bq", ""), (4, "http://b.a.org/", ""), (5, "http://b.a.org/bb", ""), (6, "http://c.org/", ""), (7, "http://z.com/x", "")]
    found = url_blocks.url_verdicts(spark.createDataFrame(pages, PAGES), url_blocks.rule_table(spark, rules))
    got = {r.page_id: (r.rule, r.verdict) for r in found.collect()}
    # 4: b.a.org and a.org/b do not both fit; b.a.org (7) beats a.org/ (6); 5: a.org/b (7) ties with b.a.org (7), the longer host wins
    assert got == {1: ("org/", "block"), 2: ("a.org/", "allow"), 3: ("a.org/b", "block"), 4: ("b.a.org", "allow"), 5: ("b.a.org", "allow"), 6: ("c.org", "allow"), 7: (None, "allow")}


def test_url_empty(spark):
    assert verdicts_empty(spark) == []


def verdicts_empty(spark):
    return url_blocks.url_verdicts(spark.createDataFrame([], PAGES), url_blocks.rule_table(spark)).collect()
