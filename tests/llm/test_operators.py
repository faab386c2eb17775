"""Each operator against a plain version, and its defined results for odd inputs."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate, exact_dedup, line_dedup, near_dedup, packing, pii, suffix_dedup, token_files, toxicity, warc
from tests.llm import brute

SCHEMA = "text string, doc_id long, source string, n_words long, rep long, kept string"
WORDS = [f"w{i}" for i in range(400)] + ["Über", "naïve", "Ñandú", "日本", "éclair"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents():
    """Null and empty texts, ties, repeated rows, a very long text, near copies, shared passages."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split(" ")
    near[60] = "changed"
    passage = prose(rng, 90)
    rows = [
        (1, None),
        (2, ""),
        (3, base),
        (4, base.upper()),
        (5, " ".join(near)),
        (6, "one two"),
        (7, "One  two\n"),
        (8, "   \n\t"),
        (9, prose(rng, 30000)),
        (10, passage + " " + prose(rng, 40)),
        (11, prose(rng, 40) + "\n" + passage),
        (12, "ab " * 400),
        (14, "x"),
        (15, "same line of words that is long enough to count\nother a b c d e f g h i"),
        (16, "same line of words that is long enough to count\nother a b c d e f g h i j"),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(t, i, "s", 0, 0, "x") for i, t in rows], SCHEMA)


def with_odd_rows(spark, rows):
    """The rows, one of them twice, and a row without id."""
    return frame(spark, [*rows, rows[2], (None, "no id")])


EMPTY: list = []


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 13, 12, 4, 20])] + [(7, None), (8, "  "), (9, "w1")]
    items.append((10, items[0][1]))
    rows = odd_documents()
    for i in range(20):
        t = prose(rng, rng.randint(0, 60)).split(" ")
        words = items[i % 5][1].split(" ")
        a = rng.randint(0, len(words) - 1)
        t[5:5] = words[a : a + rng.randint(5, 30)]
        rows.append((100 + i, " ".join(t).replace(" ", rng.choice([" ", ", ", "\n"]))))
    bench = spark.createDataFrame(items, "item_id int, text string")

    def got(df, **kw):
        out = decontaminate.find_contamination(df, bench, **kw)
        return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in out.withColumn("sha", decontaminate.items_digest(F.col("items"))).collect()}

    want = brute.contamination(rows, items)
    assert got(frame(spark, rows)) == want
    assert any(x[1] for x in want.values()) and not all(x[1] for x in want.values())
    old, decontaminate.SHARD_BYTES = decontaminate.SHARD_BYTES, 200
    try:
        assert got(frame(spark, rows)) == want
    finally:
        decontaminate.SHARD_BYTES = old
    assert decontaminate.find_contamination(with_odd_rows(spark, rows), bench).count() == len(rows) + 2
    assert got(frame(spark, EMPTY)) == {}
    none = decontaminate.find_contamination(frame(spark, rows), bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0
    kept = {r.doc_id for r in decontaminate.drop_contaminated(with_odd_rows(spark, rows), bench).collect()}
    assert kept == {d for d, x in want.items() if not x[4]} | {None}
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(frame(spark, rows), bench, max_cover=1.0).collect()}
    assert set(cut) == {d for d, _ in rows}
    assert all(cut[d] == t for d, t in rows if not want[d][1])
    again = brute.contamination([(d, t) for d, t in cut.items() if want[d][1]], items)
    assert sum(x[1] for x in again.values()) < sum(x[1] for x in want.values())


def test_decontamination_in_shards_keeps_rows_apart(spark, monkeypatch):
    """Rows that share an id or have none, over several shards: each as if it stood alone."""
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([30, 13, 20, 4, 25])]
    texts = [prose(rng, 20) + " " + t + "\n" + prose(rng, 7) for _, t in items] + [items[0][1] + " " + items[4][1], prose(rng, 50), None, ""]
    rows = [(i, t) for t in texts for i in (None, 7)] + [(7, texts[0])]
    alone = brute.contamination(list(enumerate(texts)), items)
    want = sorted(repr((i, *alone[texts.index(t)])) for i, t in rows)
    bench = spark.createDataFrame(items, "item_id int, text string")

    def got():
        out = decontaminate.find_contamination(frame(spark, rows), bench).withColumn("sha", decontaminate.items_digest(F.col("items"))).collect()
        spans = sorted(repr((r.doc_id, r.n_words, sorted(r.spans))) for r in out)
        return sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated)) for r in out), spans

    whole = got()
    assert whole[0] == want
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 200)
    assert len(list(decontaminate._shards(bench, "item_id", "text", 13))) > 2
    assert got() == whole
    assert decontaminate.find_contamination(with_odd_rows(spark, rows), bench).count() == len(rows) + 2


def test_suffix_automaton_against_windows():
    rng = random.Random(1)
    for _ in range(200):
        items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))) for i in range(4)]
        text = " ".join(rng.choice("ab") for _ in range(30))
        m = decontaminate.Matcher(items, 4)
        data = np.frombuffer(text.encode(), np.uint8)
        _, found, _ = m.block(data, np.array([0, len(data)]))
        spans, owners = found.get(0, ([], set()))
        want = brute.contamination([(0, text)], items, 4)[0]
        assert (sum(b - a + 1 for a, b in decontaminate.merge(spans)), len(owners)) == want[1:3]


def test_near_duplicates(spark):
    rng = random.Random(7)
    rows = odd_documents()
    for i in range(150):
        t = prose(rng, rng.choice([3, 6, 9, 20, 60, 150])).split(" ")
        rows.append((1000 + 10 * i, " ".join(t)))
        for k in range(rng.randint(0, 3)):
            u = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 15))):
                u[rng.randrange(len(u))] = rng.choice(WORDS)
            rows.append((1001 + 10 * i + k, " ".join(u)))
    want = brute.near(rows)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    odd = near_dedup.near_duplicates(with_odd_rows(spark, rows)).collect()
    assert len(odd) == len(rows) + 2
    assert {r.doc_id: r.component_id for r in odd if r.doc_id is not None} == {d: c for d, (_, c) in want.items()}
    assert [(r.component_id, r.kept) for r in odd if r.doc_id is None] == [(None, True)]
    assert near_dedup.near_duplicates(frame(spark, EMPTY)).count() == 0
    kept = {r.doc_id for r in near_dedup.drop_near_duplicates(with_odd_rows(spark, rows)).collect()}
    assert kept == {d for d, (_, c) in want.items() if d == c} | {None}


def test_register_estimates():
    rng = np.random.default_rng(0)
    for n in (4, 12, 60, 800, 20000):
        seen = []
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            common = int(round(n * 0.75))
            extra = max(1, (n - common) // 2)
            a, b = np.sort(pool[:common]), None
            a = np.sort(np.concatenate([pool[:common], pool[common : common + extra]]))
            b = np.sort(np.concatenate([pool[:common], pool[common + extra : common + 2 * extra]]))
            sig = near_dedup.registers([near_dedup.K.mix(a), near_dedup.K.mix(b)])
            sig = near_dedup.registers([np.sort(near_dedup.K.mix(a)), np.sort(near_dedup.K.mix(b))])
            est = near_dedup.estimate(sig[:1], sig[1:], np.array([len(a)]), np.array([len(b)]))[0]
            seen.append(est - common / (common + 2 * extra))
        assert abs(np.mean(seen)) < 0.05 and np.std(seen) < 0.12


def test_revisits(spark):
    h = lambda **k: [(a.replace("_", "-"), v) for a, v in k.items()]
    rows = [
        (1, "http://www.A.org/x/?utm_source=q&b=1&a=2#f", "2024-01-01", "response", h(ETag='"1"', Content_Type="text/html", Date="d1"), "D1"),
        (2, "https://a.org/x?a=2&b=1", "2024-01-02", "revisit", h(ETag='W/"1"', Date="d2", Set_Cookie="c"), None),
        (3, "http://a.org/x?a=2&b=1", "2024-01-03", "response", h(ETag='"2"', Date="d3"), "D3"),
        (4, "http://a.org/x?a=2&b=1", "2024-01-04", "revisit", h(ETag='"1"'), None),
        (5, "http://a.org/x?a=2&b=1", "2024-01-04", "revisit", h(), "D3"),
        (6, "http://a.org/x?a=2&b=1", "2024-01-04", "revisit", None, None),
        (7, "http://b.org/", "2024-01-04", "revisit", h(ETag='"1"'), None),
        (8, None, "2024-01-04", "revisit", None, None),
        (9, "http://a.org/x?a=2&b=1", None, "revisit", None, None),
        (10, "http://a.org/x?a=2&b=1", "2024-01-01", "revisit", h(ETag='"1"'), None),
        (11, "http://a.org/x?a=2&b=1", "2024-01-05", None, None, None),
    ]
    schema = "record_id long, uri string, captured string, kind string, headers array<struct<name:string,value:string>>, digest string"
    df = spark.createDataFrame(rows, schema).withColumn("captured", F.to_timestamp("captured")).withColumn("url", F.lit("clash"))
    for slices in (1, 4):
        got = {r.record_id: r for r in warc.resolve_revisits(df, slices).collect()}
        assert {k: (r.status, r.source_id) for k, r in got.items()} == {2: ("resolved", 1), 4: ("changed", 3), 5: ("resolved", 3), 6: ("unverified", 3), 7: ("orphan", None), 8: ("orphan", None), 9: ("orphan", None), 10: ("orphan", None)}
        assert got[2].url == "a.org/x?a=2&b=1"
        assert [(x.name, x.value) for x in got[2].headers] == [("Content-Type", "text/html"), ("Date", "d2"), ("ETag", 'W/"1"')]
        assert got[2].digest == "D1" and got[4].headers is None
    assert warc.resolve_revisits(df.union(df.filter("record_id = 2"))).count() == 9
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_exact_duplicates(spark):
    rows = odd_documents()
    groups: dict[str, list[int]] = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(brute.LOWER), []).append(d)
    want = {d: (max(ds), len(ds), d == max(ds), brute.sha(t)) for t, ds in groups.items() for d in ds}
    got = exact_dedup.mark_exact_duplicates(frame(spark, rows), digest=True).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    odd = exact_dedup.mark_exact_duplicates(with_odd_rows(spark, rows)).collect()
    assert len(odd) == len(rows) + 2
    assert [r.group_size for r in odd if r.doc_id == 3] == [3, 3]
    assert [(r.keep_id, r.kept) for r in odd if r.doc_id is None] == [(None, True)]
    assert exact_dedup.mark_exact_duplicates(frame(spark, EMPTY)).count() == 0
    kept = [r.doc_id for r in exact_dedup.drop_exact_duplicates(with_odd_rows(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*(d for d, x in want.items() if x[2]), None]))


CLASHES = ["_gone", "_bad", "_hit", "_over", "spans", "n_hit", "_id", "_key", "_many", "row_key", "_own"]


def clashing(df):
    return df.selectExpr("*", *[f"'{c}' as {c}" for c in CLASHES])


def told(df):
    assert df.columns[-len(CLASHES) :] == CLASHES
    out = df.collect()
    assert all(list(r[-len(CLASHES) :]) == CLASHES for r in out)
    return sorted(repr((r.doc_id, r.text)) for r in out)


def told_rows(rows):
    return sorted(repr(r) for r in rows)


def test_rows_that_share_an_id(spark, monkeypatch):
    """Decisions are carried out row by row, with repeated rows, null ids and clashing columns."""
    rng = random.Random(21)
    long = prose(rng, 60)
    rows = [(5, "a"), (9, "A"), (5, "unique text"), (7, "rep"), (7, "rep"), (None, "a"), (None, "b"), (None, "b"), (None, None), (3, None), (3, None), (11, long), (12, long + " end"), (11, "other " + prose(rng, 30)), (11, long)]
    df = clashing(frame(spark, rows))
    got = told(exact_dedup.drop_exact_duplicates(df))
    assert got == told_rows([(9, "A"), (5, "unique text"), (7, "rep"), (None, "b"), (3, None), *rows[11:14]])
    got = told(near_dedup.drop_near_duplicates(df))
    # one document of {5, 9}: the smallest id, under which another text stands too
    assert got == told_rows([(5, "a"), (5, "unique text"), (7, "rep"), (None, "a"), (None, "b"), (None, "b"), (None, None), (3, None), (11, long), rows[13]])
    items = [(1, long[:200]), (2, prose(rng, 20))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows += [(5, long[:200] + " x y"), (20, prose(rng, 3000) + " " + long[:200])]
    df = clashing(frame(spark, rows))
    judged = [brute.contamination([(0, t)], items)[0] for _, t in rows]
    for size in (1 << 20, 100):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        assert told(decontaminate.drop_contaminated(df, bench)) == told_rows([r for r, x in zip(rows, judged, strict=True) if not x[4]])
        cut = decontaminate.cut_spans(df, bench, max_cover=0.5)
        assert len(told(cut)) == sum(x[1] <= 0.5 * x[0] for x in judged)
        assert told(cut.filter("doc_id is null or doc_id < 10")) == told_rows([r for r in rows if (r[0] or 0) < 10 and r[1] != rows[-2][1]])
        (t,) = [r.text for r in cut.filter("doc_id = 20").collect()]
        assert len(t) < len(rows[-1][1]) and t.startswith(rows[-1][1][:1000])


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = prose(rng, rng.randint(5, 80)).split(" ")
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["vilebad", "VILEworse", "grimword"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    labels += [(0, 1), (None, 1), (99999, 1), (5, None)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = with_odd_rows(spark, rows + [(1000, None), (1001, ""), (1002, "x " * 50000)])
    machine = toxicity.train(docs, lab)
    scored = toxicity.score_toxicity(docs, machine).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(scored) == len(rows) + 5
    by_id = {r.doc_id: r for r in scored}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in range(600) if by_id[i].held} == set(held)
    right = sum(by_id[i].predicted == int(i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored)
    assert by_id[1000].score == by_id[1001].score
    kept = [r.doc_id for r in toxicity.drop_toxic(docs, lab).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(r.doc_id for r in scored if r.predicted == 0 and r.doc_id is not None)
    assert toxicity.score_toxicity(frame(spark, EMPTY), machine).count() == 0
    flat = toxicity.train(docs, lab.limit(0))
    assert toxicity.score_toxicity(docs, flat).filter("predicted = 1").count() == 0


def plain_score(m, terms):
    """The machine's formula, pair by pair."""
    s = sorted({int(m.slots[t]) for t in terms if m.slots[t] >= 0})
    z = m.bias + sum(m.linear[i] for i in s) + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(s) for j in s[k + 1 :])
    return 1 / (1 + np.exp(-z))


def test_pairs_count_where_single_terms_do_not():
    """Both terms together, one alone, none: with an "and", and with a label that neither term tells anything about."""
    rng = np.random.default_rng(1)
    for rule in (lambda a, b: a & b, lambda a, b: 1 - (a ^ b)):
        rows, y = [], []
        for _ in range(4000):
            a, b = rng.integers(0, 2, 2)
            rows.append(np.array([10] * a + [20] * b + [int(x) for x in np.unique(rng.integers(30, 130, 12))], np.int64))
            y.append(int(rule(a, b)))
        half = len(rows) // 2
        m = toxicity.fit(rows[:half], np.array(y[:half]))
        assert (m.slots[[10, 20]] >= 0).all()
        score = [m.score(np.zeros(len(r), np.int64), r, 1)[0] for r in rows[half:]]
        assert np.allclose(score, [plain_score(m, r) for r in rows[half:]], atol=1e-6)
        right = np.mean([(s >= toxicity.REJECT) == bool(l) for s, l in zip(score, y[half:], strict=True)])
        assert right > 0.98


def test_repeated_lines(spark):
    rng = random.Random(9)
    rows = odd_documents()
    lines = [prose(rng, rng.choice([1, 5, 10, 25, 60])) for _ in range(60)]
    for i in range(40):
        own = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(lines).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            own.append(" ".join(w))
        rows.append((200 + i, "\n".join(own)))
    want = brute.lines(rows)
    out = line_dedup.repeated_lines(frame(spark, rows))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, ",".join(map(str, r.removed))) for r in out.collect()} == want
    assert any(x[2] for x in want.values())
    odd = {r.doc_id: r for r in line_dedup.repeated_lines(with_odd_rows(spark, rows)).collect()}
    assert len(odd) == len(rows) + 1 and odd[3].n_lines == 2 * want[3][0] and odd[None].n_removed == 0
    assert line_dedup.repeated_lines(frame(spark, EMPTY)).count() == 0
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    for d, t in rows:
        gone = {int(x) for x in want[d][3].split(",") if x}
        assert cut[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))


def test_repeated_lines_at_85(spark):
    """One word in 13 replaced, and one added to six: both are missed at 0.9."""
    rng = random.Random(85)
    rows = odd_documents()
    for i in range(30):
        line = rng.sample(WORDS, rng.choice([6, 7, 8, 12, 13, 15, 18, 20, 40]))
        swapped = ["swapped", *line[1:]]
        rows.append((300 + i, "\n".join(" ".join(x) for x in (line, swapped, [*line, "added"], ["other", "words", *line[2:]]))))
    want = brute.lines(rows, percent=85)
    assert sum(x[2] for x in want.values()) > sum(x[2] for x in brute.lines(rows, percent=90).values())
    out = line_dedup.repeated_lines(frame(spark, rows))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, ",".join(map(str, r.removed))) for r in out.collect()} == want
    pair = [(1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l z"), (3, "p q r s t u"), (4, "p q r s t u v")]
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame(spark, pair), percent=85).collect()}
    assert cut == {1: pair[0][1], 2: "", 3: pair[2][1], 4: ""}
    want = brute.lines(rows, percent=90)
    out = line_dedup.repeated_lines(frame(spark, rows), percent=90)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, ",".join(map(str, r.removed))) for r in out.collect()} == want


def test_the_index_of_lines_goes_in_shares(spark, monkeypatch):
    """No write shuffles the whole index, and the shares give all pairs."""
    monkeypatch.setattr(line_dedup, "SHARES", 3)
    written, write = [], line_dedup.scratch.write
    monkeypatch.setattr(line_dedup.scratch, "write", lambda df, name, **options: (written.append(name), write(df, name, **options))[1])
    rng = random.Random(85)
    base = [rng.sample(WORDS, 30) for _ in range(4)]
    rows = [(i, " ".join([*base[i % 4][: 30 - i % 5], *(f"v{i}x{k}" for k in range(i % 5))])) for i in range(40)]
    want = brute.lines(rows)
    out = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, ",".join(map(str, r.removed))) for r in out} == want
    assert written.count("line-met") == 3 and max(x[2] for x in want.values()) > 3


def test_similar_lines_meet_once(spark, monkeypatch):
    """Classes that share all their rarest words are kept at the first of them, not at each."""
    met, write = [], line_dedup.scratch.write
    monkeypatch.setattr(line_dedup.scratch, "write", lambda df, name, **options: (out := write(df, name, **options), name == "line-met" and met.append(out.count()))[0])
    common = [f"c{i}" for i in range(40)]
    rows = [(100 + i, "\n".join(" ".join(common[k:] + common[:k]) + f" x{i}y{k}" for k in range(2))) for i in range(5)]
    for i in range(6):
        rare = [f"r{i}x{k}" for k in range(30)]
        rows += [(2 * i, " ".join([*rare, *common[:10]])), (2 * i + 1, " ".join([*rare, *common[1:11]]))]
    want = brute.lines(rows)
    assert all(want[i][2] == 1 for i in range(12))
    out = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, ",".join(map(str, r.removed))) for r in out} == want
    assert sum(met) <= 52  # one row for each of the 12 and what the filler leaves, not a whole prefix of 7 each


@pytest.mark.parametrize("block", [256, 3])
def test_large_families_of_lines(spark, monkeypatch, block):
    """Every pair of a family is a link; families larger than a block, and links that do not reach all members."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(86)
    rows = []
    for f in range(3):
        base = rng.sample(WORDS, 30)
        for i in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(30)] = f"v{f}x{i}"
            rows.append((1000 * f + i, " ".join(w)))
    want = brute.lines(rows)
    assert max(x[2] for x in want.values()) > 10
    out = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, ",".join(map(str, r.removed))) for r in out} == want


def test_plans_of_lines_stay_short(spark, monkeypatch):
    """The driver keeps plans as text, with every list of numbers that they hold."""
    sizes, write = [], line_dedup.scratch.write

    def measured(df, name, **options):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, name, **options)

    monkeypatch.setattr(line_dedup.scratch, "write", measured)
    assert line_dedup.repeated_lines(frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g h")])).collect()
    assert max(sizes) < 1_000_000


def test_lines_of_rows_that_share_an_id(spark):
    """Other texts under one id are cut for themselves; extra columns may have any name."""
    a, b = "one two three four five six seven", "p q r s t u v w x"
    rows = [(1, a), (1, b + "\n" + a), (None, b), (None, b), (None, None), (2, "other words here"), (2, a + "\nlast")]
    df = frame(spark, rows).selectExpr("*", "1 as _cut", "2 as _key", "3 as _gone", "4 as removed", "5 as _h", "6 as c")
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = sorted(repr((r.doc_id, r.text, r._gone, r.removed)) for r in out.collect())
    order = {(a if t == a else t): i for i, t in enumerate(sorted({a, b + "\n" + a}, key=lambda t: spark.sql("select xxhash64(?) h", [t]).first().h))}
    first = order[a] == 0
    want = [(1, a if first else ""), (1, "" if first else a), (None, b), (None, b), (None, None), (2, "other words here"), (2, "last")]
    assert got == sorted(repr((i, t, 3, 4)) for i, t in want)


def test_repeated_lines_with_other_blanks(spark):
    """Tabs, CRLF, form feeds and vertical tabs separate words as spaces do; the texts themselves stay."""
    plain = "a b c d e f\ng h i\nj k l m n o p\n"
    rows = [(1, plain), (2, plain.replace("\n", "\r\n")), (3, plain.replace(" ", "\t")), (4, plain.replace(" ", "\f")), (5, plain.replace(" ", "\v")), (6, "q\tr \t\r\n\r\n\t")]
    want = brute.lines([(d, t.translate(dict.fromkeys(map(ord, "\t\r\f\v"), " "))) for d, t in rows])
    assert [want[d][1] for d, _ in rows] == [0, 3, 3, 3, 3, 0]
    out = line_dedup.repeated_lines(frame(spark, rows))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_links, ",".join(map(str, r.removed))) for r in out.collect()} == want
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    assert (cut[1], cut[2], cut[6]) == (plain, "", rows[5][1])


def least_cost(lengths, sizes, **kw):
    """Least cost of any packing, by trying every grouping."""
    best = [float("inf")]

    def price(bins):
        return sum(packing.cost(min(s for s in sizes if s >= b), **kw) for b in bins)

    def place(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], price(bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(sizes):
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_packing_bins():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(0, 4096) for _ in range(rng.randint(0, 200))]
        bins, offsets, sizes = packing.pack(lengths)
        used = [0] * len(sizes)
        for n, b, o in sorted(zip(lengths, bins, offsets, strict=True), key=lambda x: (x[1], x[2], x[0])):
            assert o == used[b]
            used[b] += n
        for u, s in zip(used, sizes, strict=True):
            assert s == min(c for c in packing.CAPACITIES if c >= u)
    assert packing.pack([100] * 5)[2] == [512]
    assert packing.pack([4096, 1])[2] == [4096, 512]


def test_packing_against_the_least_cost():
    rng = random.Random(14)
    sizes, kw = (8, 16, 32, 64), {"overhead": 2, "square": 256}
    got = best = 0.0
    for _ in range(60):
        lengths = [rng.choice([rng.randint(1, 8), rng.randint(1, 64)]) for _ in range(rng.randint(1, 7))]
        mine, least = sum(packing.cost(s, **kw) for s in packing.pack(lengths, sizes, **kw)[2]), least_cost(lengths, sizes, **kw)
        assert mine >= least - 1e-9 and mine <= 1.6 * least
        got, best = got + mine, best + least
    assert got <= 1.1 * best


def test_sizes_are_chosen_jointly():
    """Several sizes are used, and their cost is below that of best fit into any single one."""
    rng = random.Random(15)
    lengths = [min(4096, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(4096)]
    sizes = packing.pack(lengths)[2]
    assert len(set(sizes)) == 4 and max(sizes.count(s) for s in set(sizes)) < 0.9 * len(sizes)
    alone = sum(packing.cost(s) for s in packing.pack(lengths, (4096,))[2])
    assert sum(map(packing.cost, sizes)) < 0.95 * alone
    assert sum(lengths) > 0.97 * sum(sizes)


def test_packed_sequences(spark):
    rows = [(1, list(range(1, 20))), (2, None), (3, []), (4, [7] * 5), (4, [7] * 5), (None, [1, 2, 3]), (5, list(range(100, 140)))]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<int>").withColumn("bin_id", F.lit("clash"))
    out = packing.pack_sequences(docs, capacities=(8, 16), overhead=1, shard_rows=3).collect()
    back = []
    for r in out:
        assert len(r.tokens) == r.capacity and sum(d.n_tokens for d in r.documents) == r.n_tokens and not any(r.tokens[r.n_tokens :])
        back += [(d.id, d.piece, r.tokens[d.offset : d.offset + d.n_tokens]) for d in r.documents]
    want = [(i, k, (t or [])[16 * k : 16 * k + 16]) for i, t in rows for k in range(max(1, -(-len(t or []) // 16)))]
    assert sorted(map(repr, back)) == sorted(map(repr, want))
    assert packing.pack_sequences(docs.limit(0)).count() == 0
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(5).alias("n"))
    shards = packing.pack_documents(same, F.col("n"), shard_rows=100).groupBy(F.expr("bin_id >> 32")).count().collect()
    assert len(shards) == 30 and max(r["count"] for r in shards) < 200


def test_packing_table(spark):
    rows = odd_documents()
    out = packing.pack_documents(frame(spark, rows), packing.word_tokens()).collect()
    want = {d: len((t or "").split()) + 1 for d, t in rows}
    total: dict[int, int] = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert r.offset + r.n_tokens <= r.bin_used <= r.capacity
    assert total == want
    assert sorted(r.piece for r in out if r.doc_id == 9) == list(range(-(-want[9] // 4096)))
    per_bin: dict[int, int] = {}
    for r in out:
        per_bin[r.bin_id] = per_bin.get(r.bin_id, 0) + r.n_tokens
    assert all(per_bin[r.bin_id] == r.bin_used for r in out)
    small = packing.pack_documents(frame(spark, rows).repartition(5), packing.word_tokens(), shard_rows=4).collect()
    assert sum(r.n_tokens for r in small) == sum(want.values())
    assert packing.pack_documents(with_odd_rows(spark, rows), packing.word_tokens()).count() == len(out) + 2
    assert packing.pack_documents(frame(spark, EMPTY), packing.word_tokens()).count() == 0
    assert packing.pack_documents(frame(spark, rows), F.lit(None)).agg(F.sum("n_tokens")).first()[0] == 0


PII = [
    "a@b.co, x.y+z@sub-d.example.org; foo@bar baz@ @q.w a@b.com_x@y.org",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.00.0.001 1.2.3 999.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5555555555554444-1",
    "+1 (555) 010-9999 +12 3 +44.20.7946.0958) ++49 30 123456789 +1234567890123456",
    "é日 " * 30 + "mail: ab@x.de 10.0.0.1 ñ+34 600 123 456",
    "GB82WEST12345698765432 GB82WEST12345698765431 DE89370400440532013000",
    "9" * 3000 + "." + "1.2.3." * 500 + "@" + "a." * 2000,
    "x" * 40000 + "@" + "y" * 10,
    "",
    None,
    "0" * 16,
    "1 2-3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
]


def test_personal_data(spark):
    rows = list(enumerate(PII)) + [(100, " ".join(p or "" for p in PII))]
    out = pii.find_pii(frame(spark, rows))
    base = F.filter("spans", lambda s: s["kind"] < pii.BASE)
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)) for k in range(pii.BASE)]  # noqa: B023
    got = {r[0]: tuple(r[1:]) for r in out.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256)).collect()}
    assert got == {d: brute.personal(t) for d, t in rows}
    ibans = {r.doc_id: r.n for r in out.select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == 4)).alias("n")).collect()}
    assert ibans[5] == 2
    scores = {r.doc_id: r.s for r in out.select("doc_id", F.col("spans.score").alias("s")).collect()}
    assert scores[4][0] > scores[0][0]  # "mail" stands near
    masked = {r.doc_id: r.text for r in pii.mask_pii(frame(spark, rows)).collect()}
    assert masked[0].startswith("<EMAIL>, <EMAIL>; foo@bar") and masked[9] is None
    assert pii.find_pii(with_odd_rows(spark, rows)).count() == len(rows) + 2
    assert pii.find_pii(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("group", [256, 1])
def test_repeated_spans(spark, group):
    rng = random.Random(6)
    rows = odd_documents()
    shared = prose(rng, 200)
    rows += [(300, prose(rng, 30) + shared[:600] + prose(rng, 50)), (301, shared[100:900]), (302, shared[:399]), (303, "é" * 500), (304, "\0" * 450 + "a"), (305, shared[:600].replace("w", "W", 1))]
    want = brute.repeats(rows)
    out = suffix_dedup.repeated_spans(frame(spark, rows), group=group)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == want
    odd = suffix_dedup.repeated_spans(with_odd_rows(spark, rows), group=group).collect()
    assert len(odd) == len(rows) + 2 and {r.n_removed for r in odd if r.doc_id == 3} == {want[3][0]}
    assert suffix_dedup.repeated_spans(frame(spark, EMPTY)).count() == 0


def test_cut_spans_keep_whole_characters(spark):
    rng = random.Random(12)
    shared = "é" * 300
    rows = [(1, "x" + shared + prose(rng, 5)), (2, prose(rng, 5) + shared + "y"), (3, prose(rng, 50)), (4, None)]
    cut = {r.doc_id: r.text for r in suffix_dedup.cut_repeated_spans(frame(spark, rows)).collect()}
    assert cut[3] == rows[2][1] and cut[4] is None
    removed = brute.repeats(rows)
    for d, t in rows[:2]:
        assert cut[d].replace("é", "") == t.replace("é", "")
        assert abs(len(t.encode()) - len(cut[d].encode()) - removed[d][1]) <= 2


def test_suffix_sorting():
    rng = random.Random(8)
    for _ in range(100):
        w = rng.choice([8, 16])
        base = bytes(rng.choice(b"ab\xff") for _ in range(60))
        slices = [bytes(base[i : i + rng.randint(w, 40)]) for i in (rng.randint(0, 20) for _ in range(rng.randint(1, 6)))]
        slices = [s for s in slices if len(s) >= w]
        if not slices:
            continue
        starts = [len(s) - w + 1 for s in slices]
        seen: dict[bytes, int] = {}
        for s in slices:
            for i in range(len(s) - w + 1):
                seen[s[i : i + w]] = seen.get(s[i : i + w], 0) + 1
        want = [[i for i in range(n) if seen[s[i : i + w]] > 1] for s, n in zip(slices, starts, strict=True)]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(slices, starts, w)] == want


TOKENIZER = Path("/opt/tokenizers/byte_bpe_50k.json")


@pytest.mark.skipif(not TOKENIZER.exists(), reason="no tokenizer file")
def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = odd_documents() + [(400, "a<|endoftext|>b"), (401, "It's 12'll x  \x1c\x85 ½ 😀 don't  \n\n end "), (402, "Ünï's   'S 're")]
    t = Tokenizer.from_file(str(TOKENIZER))
    want, at = {}, 0
    for d, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    out = token_files.round_trip(frame(spark, rows), str(TOKENIZER), sequence=64)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in out.collect()} == want
    assert token_files.round_trip(with_odd_rows(spark, rows), str(TOKENIZER)).count() == len(rows) + 2
    assert token_files.round_trip(frame(spark, EMPTY), str(TOKENIZER)).count() == 0
    folder = f"file://{tmp_path}/ids"
    (shard,) = token_files.write_token_files(frame(spark, rows[3:6]), folder, str(TOKENIZER), sequence=64).collect()
    reader = token_files.open_sequences(folder, shard.stem)
    ids, mask = token_files.read_sequence(reader, 0)
    assert ids.tolist() == t.encode(rows[3][1], add_special_tokens=False).ids[:64] and mask.all()
    n = sum(b.num_rows for b in (reader.get_batch(i) for i in range(reader.num_record_batches)))
    _, mask = token_files.read_sequence(reader, n - 1)
    assert mask.sum() == shard.n_tokens - 64 * (n - 1)


def test_wordpiece_ids_need_32_bits():
    assert token_files.id_dtype(1 << 16) == "<u2" and token_files.id_dtype((1 << 16) + 1) == "<u4"
