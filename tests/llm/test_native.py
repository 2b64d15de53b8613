"""Quality rules, exact dedup, mixing and fuzzy lines."""

from __future__ import annotations

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from postlens.llm import exact_dedup, fuzzy_lines, mixing, quality, queries
from tests.llm import plain


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


# exact dedup

NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("salts", [1, 32])
def test_exact_dedup_edges(edge_docs, edge_pairs, salts):
    got = rows_of(exact_dedup.exact_dedup(edge_docs.repartition(5), salts=salts), *NAMES)
    assert got == sorted(plain.exact(edge_pairs), key=repr)


def test_exact_dedup_null_id_loses(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, "ab"), (3, "ab")], "doc_id long, text string")
    assert rows_of(exact_dedup.exact_dedup(docs), "doc_id", "keep_id") == [(3, None), (7, None), (None, None)]
    docs = spark.createDataFrame([(None, "ab"), (7, "ab")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs).collect()} == {7}


def test_exact_dedup_empty(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == []


def test_stages_compare_content(spark):
    plan = exact_dedup.duplicate_groups(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*content", plan)) == 2


# quality


def test_quality_statistics(edge_docs, edge_rows):
    got = {r.doc_id: r for r in quality.quality(edge_docs).collect()}
    for i, t, *_ in edge_rows:
        w, r = plain.words(t), got[i]
        lines = [x for x in (t or "").split("\n") if plain.words(x)]
        assert r.n_words == len(w)
        assert r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == plain.repeated_words(w)
        assert r.base_failed == (len(w) < 10 or 100 * plain.repeated_words(w) > 20 * len(w))
        assert r.kept <= (not r.base_failed)


def test_quality_repeats(spark):
    texts = ["a b c d e f a b c d e", "a a a a a a", "a b c d e", "", "a b c d e " * 3, " ".join("abcdefghij" * 4), "x y z " * 400]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_repeat_words for r in quality.quality(docs).collect()}
    assert got == {i: plain.repeated_words(plain.words(t)) for i, t in enumerate(texts)}


def test_quality_boilerplate(spark):
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(12))
    banner = "Subscribe  to our letter\tnow"
    rows = [(i, f"{own(i)}\n{banner}", "big") for i in range(40)]
    rows += [(100 + i, own(100 + i), "big") for i in range(40)]
    rows += [(200, "one two three four five\n" + "\n".join([banner] * 1), "big")]  # little of its own
    rows += [(300, f"{own(300)}\n{banner}", "small"), (301, f"{own(301)}\n{banner}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert all(got[i].n_removed == 5 and got[i].clean_text == own(i) and got[i].kept for i in range(40))
    assert all(got[100 + i].n_removed == 0 and got[100 + i].kept for i in range(40))
    assert got[200].n_removed == 5 and not got[200].kept
    assert got[300].n_removed == 0 and got[300].kept and got[301].kept


def test_quality_empty(no_docs):
    assert quality.quality(no_docs, keep_columns=no_docs.columns).collect() == []


# mixing


def weights(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    power = {s: (n / total) ** exponent for s, n in tokens.items()}
    return {s: p / sum(power.values()) for s, p in power.items()}


def test_mixing_limits(spark, sample):
    docs, _ = sample
    for limit in (1.0, 1.5, 4.0):
        rows = mixing.mix(docs, max_repeats=limit).collect()
        tokens = collections.Counter()
        drawn = collections.Counter()
        for r in rows:
            tokens[r.source_key] += r.n_tokens
            drawn[r.source_key] += r.n_tokens * r.copies
            assert 1 <= r.copies <= math.ceil(limit)
        budgets = {r.source_key: r.budget for r in rows}
        ratio = {s: budgets[s] / tokens[s] for s in tokens}
        assert max(ratio.values()) <= limit + 1e-6 and abs(min(ratio.values()) - 1) < 1e-6
        longest = max(r.n_tokens for r in rows)
        assert all(0 <= drawn[s] - budgets[s] <= longest for s in tokens)
        assert abs(sum({r.source_key: r.weight for r in rows}.values()) - 1) < 1e-9


def test_mixing_entropy(spark, sample):
    docs, _ = sample
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "most").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    rows = mixing.mix(docs, max_repeats=None, entropy=1.77).collect()
    w = {r.source_key: r.weight for r in rows}
    assert abs(-sum(x * math.log(x) for x in w.values()) - 1.77) < 1e-4


def test_mixing_budget_takes_the_front(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "one") for i in range(100)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, budget=1250).collect()
    extra = {r.doc_id for r in rows if r.copies == 2}
    by_key = [r.doc_id for r in sorted(rows, key=lambda r: r.order_key)]
    assert extra == set(by_key[:25]) and sum(r.copies for r in rows) == 125
    rows = mixing.mix(docs, budget=300).collect()
    assert sum(r.copies for r in rows) == 30


def test_mixing_edges(edge_docs, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count() and min(r.copies for r in rows) >= 1
    again = mixing.drawn(edge_docs)
    assert again.columns == edge_docs.columns and again.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).collect() == [] and mixing.drawn(no_docs).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(no_docs, max_repeats=None)


# fuzzy lines


def simhash(line: str, hashes: dict) -> int:
    w = line.split(" ")
    return sum(1 << b for b in range(60) if 2 * sum(hashes[x] >> b & 1 for x in w) > len(w))


def edits(a: str, b: str) -> float:
    a, b = a.split(" "), b.split(" ")
    longer = max(len(a), len(b))
    return (longer - plain.levenshtein(a, b)) / longer


def fuzzy(spark, pairs, similarity: float) -> dict:
    """(doc_id, pos) -> kept, by comparing all lines with all."""
    lines = {}
    for i, t in pairs:
        for k, line in enumerate(x for x in (t or "").split("\n") if plain.words(x)):
            normal = " ".join(re.findall(r"[^\W_]+", line.lower()))
            if normal:
                lines[i, k] = normal
    every = sorted({w for x in lines.values() for w in x.split(" ")})
    hashed = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    hashes = {r.w: r.h & (2**64 - 1) for r in hashed}
    distinct = sorted(set(lines.values()))
    sims = {x: simhash(x, hashes) for x in distinct}
    links = [
        (a, b)
        for a in distinct
        for b in distinct
        if a < b and bin(sims[a] ^ sims[b]).count("1") <= 3 and edits(a, b) >= similarity
    ]
    found = plain.groups(distinct, links)
    first = {}
    for place in sorted(lines):
        first.setdefault(found[lines[place]], place)
    return {place: first[found[x]] == place for place, x in lines.items()}, len(links)


def variants() -> list[tuple]:
    base = [f"{chr(97 + k % 26)}word{k}" for k in range(70)]
    rows = []
    for i in range(60):
        w = list(base)
        w[i], w[(i * 5) % 70] = f"new{i}", f"put{i % 4}"
        rows.append((i, " ".join(w) + f"\nline number {i} of its own kind"))
    return rows + [(100 + i, "A line, that   many documents HOLD!") for i in range(30)]


def test_simhash_of_any_length(spark):
    lines = [" ".join(f"w{(k * k) % 97}" for k in range(n)) for n in (1, 2, 3, 100, 510, 511, 512, 513, 3000)]
    every = sorted({w for x in lines for w in x.split(" ")})
    hashes = {r.w: r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", fuzzy_lines.simhash(F.col("line")).alias("s")).collect()
    assert {r.line: r.s for r in got} == {x: simhash(x, hashes) for x in lines}


def test_fuzzy_lines(spark):
    pairs = variants()
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.pos): r.kept for r in fuzzy_lines.fuzzy_lines(docs).collect()}
    expected, links = fuzzy(spark, pairs, 0.8)
    assert links > 20
    assert got == expected


def test_all_similar_lines(spark):
    """Against all pairs, without the SimHash; lines of 1 to 60 words with up to a quarter of the words edited."""
    draw = random.Random(4)
    word = lambda: f"w{draw.randrange(60)}"
    lines = []
    for n in [*range(1, 31), 40, 60]:
        base = [word() for _ in range(n)]
        for edits in (0, 1, n // 5, n // 5, n // 4):
            w = list(base)
            for _ in range(edits):
                k = draw.randrange(len(w) + 1)
                w[k : k + draw.randrange(2)] = [word()] * draw.randrange(2)
            lines.append(" ".join(w) or "none")
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(5)
    distinct = sorted(set(lines))
    links = [(a, b) for a in distinct for b in distinct if a < b and edits_at_least(a, b, 0.8)]
    found = plain.groups(distinct, links)
    first = {}
    for i, line in enumerate(lines):
        first.setdefault(found[line], i)
    got = {r.doc_id: r.kept for r in fuzzy_lines.fuzzy_lines(docs, max_bits=None).collect()}
    assert len(links) > 60
    assert got == {i: first[found[line]] == i for i, line in enumerate(lines)}
    lost = {r.doc_id: r.kept for r in fuzzy_lines.fuzzy_lines(docs).collect()}
    assert sum(got.values()) < sum(lost.values())


def test_runs_of_words_without_waste(spark):
    """A line's windows end where no segment of a similar line can start; every similar line finds one near its place."""
    draw = random.Random(6)
    rows = []
    for n in [*range(4, 26), 58, 120]:
        base = [f"w{k}" for k in range(n)]
        for _ in range(12):
            w = list(base)
            for e in range(n // 5):
                k = draw.randrange(len(w))
                w[k : k + 1] = [[], [f"x{e}"], [f"x{e}"]][draw.randrange(3)]
            rows.append((n, len(w), base, w))
    df = spark.createDataFrame(rows, "n int, m int, base array<string>, w array<string>")
    s = fuzzy_lines._segments(F.col("base"), F.col("n"), 0.8)
    found = df.select("n", "m", s.alias("s"), fuzzy_lines._windows(F.col("w"), F.col("m"), 0.8).alias("t")).collect()
    for r in found:
        d = r.n // 5
        starts = collections.defaultdict(list)
        for t in r.t:
            starts[t.bucket].append(t.at)
        near = lambda i, x: any(abs(x.at - at) <= i and abs(x.at - at - r.n + r.m) <= d - i for at in starts[x.bucket])
        assert d == 0 or any(near(i, x) for i, x in enumerate(r.s))
        assert d == 0 or len(r.s) == d + 1
        assert max((t.at for t in r.t), default=0) <= 0.8 * r.m + 1e-6


def test_least_pairs_of_words_meet(spark):
    """Of two similar lines' least pairs of words some are the same and near."""
    draw = random.Random(7)
    rows = []
    for k, n in enumerate([*range(4, 26), 58, 120]):
        base = [f"w{draw.randrange(2 * n)}" for _ in range(n)]
        for v in range(8):
            w = list(base)
            for e in range(int(n * 0.2)):
                at = draw.randrange(len(w))
                w[at : at + 1] = [[], [f"x{e}"], [w[at], f"y{e}"]][draw.randrange(3)]
            if edits_at_least(" ".join(base), " ".join(w), 0.8):
                rows += [(k * 1000 + v * 2, " ".join(base)), (k * 1000 + v * 2 + 1, " ".join(w))]
    lines = spark.createDataFrame(rows, "id long, line string")
    found = fuzzy_lines._word_pairs(lines)
    found = found.withColumn("last", F.coalesce(fuzzy_lines._last(F.col("buckets"), F.col("n"), 0.8), F.lit(0).cast("long")))
    least = fuzzy_lines._least_pairs(found).withColumn("id", F.shiftright("row", fuzzy_lines.PLACE_BITS))
    two = least.select("bucket", F.col("row").alias("row2"), F.col("id").alias("id2"))
    near = least.join(two, "bucket").where("id2 = id + 1 AND id % 2 = 0").where(fuzzy_lines._near_rows(F.col("row"), F.col("row2"), 0.8))
    met = {r.id for r in near.select("id").distinct().collect()}
    changed = {a[0] for a, b in zip(rows[::2], rows[1::2]) if a[1] != b[1]}
    assert len(changed) > 100 and changed <= met


def test_hot_pairs_of_words_and_repeated_runs(spark, monkeypatch):
    """Pairs of words at many places are put last; lines that have no others meet on segments. A repeated run is one row."""
    monkeypatch.setattr(fuzzy_lines, "MOST", 3)
    draw = random.Random(8)
    passage = " ".join(f"quoted{k}" for k in range(9))
    lines = []
    for k in range(6):
        base = [f"b{k}w{i}" for i in range(12)] + passage.split()
        for _ in range(3):
            w = list(base)
            w[draw.randrange(len(w))] = f"z{draw.randrange(99)}"
            lines.append(" ".join(w))
    lines += [" ".join(["ble"] * n) for n in (40, 41, 47, 55, 80)] + [passage] * 2 + [passage + " end"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    distinct = sorted(set(lines))
    found = plain.groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and edits_at_least(a, b, 0.8)])
    first = {}
    for i, line in enumerate(lines):
        first.setdefault(found[line], i)
    made = {}
    keep = fuzzy_lines.written

    def written(df, name, **options):
        made[name] = keep(df, name, **options)
        return made[name]

    monkeypatch.setattr(fuzzy_lines, "written", written)
    got = {r.doc_id: r.kept for r in fuzzy_lines.fuzzy_lines(docs, max_bits=None).collect()}
    assert got == {i: first[found[line]] == i for i, line in enumerate(lines)}
    assert not any(line.startswith("b0") for line in (r.line for r in made["common_texts"].collect()))
    windows = made["shared_windows"]
    assert windows.groupBy("bucket", "id2").count().where("count > 1").isEmpty()


def test_a_line_is_normalised_once(spark):
    docs = spark.createDataFrame([(1, "One Line\nTwo")], "doc_id long, text string")
    plan = fuzzy_lines._lines(docs, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\p{L}\\p{M}\\p{N}]+") == 1


def edits_at_least(a: str, b: str, similarity: float) -> bool:
    n, m = a.count(" ") + 1, b.count(" ") + 1
    return min(n, m) >= similarity * max(n, m) and edits(a, b) >= similarity


def test_query_links_a_changed_word(spark, tmp_path):
    base = " ".join(f"word{k}" for k in range(10))
    rows = [(1, base), (2, base.replace("word4", "other")), (3, "nothing like the others")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_dropped for r in queries.op10_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_fuzzy_lines_edges(spark, edge_docs, edge_rows, no_docs):
    pairs = [(r[0], r[1]) for r in edge_rows if r[0] not in (18, None)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {(r.doc_id, r.pos): r.kept for r in fuzzy_lines.fuzzy_lines(docs).collect()}
    assert got == fuzzy(spark, pairs, 0.8)[0]
    report = {r.doc_id: r for r in fuzzy_lines.fuzzy_line_report(edge_docs).collect()}
    assert set(report) == {r[0] for r in edge_rows}
    assert (report[6].n_lines, report[6].dropped) == (0, "") and report[15].dropped == "1,2"
    clean = {r.doc_id: r.text for r in fuzzy_lines.without_dropped_lines(edge_docs).collect()}
    assert clean[15] == "same line here\n\nother £ ünïcode 漢字 🙂 line" and clean[6] is None and clean[8] == " \t\n\x0b\f\r "
    assert fuzzy_lines.fuzzy_line_report(no_docs).collect() == []


def test_no_python_in_native_plans(sample):
    docs, _ = sample
    for df in (quality.quality(docs), exact_dedup.exact_dedup(docs), mixing.mix(docs), fuzzy_lines.fuzzy_line_report(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
