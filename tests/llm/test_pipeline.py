"""The corpus pipeline on a small table, stage by stage, against plain versions of its stages."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import brute  # noqa: E402
from tests.llm.test_operators import WORDS, prose  # noqa: E402


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    import pandas as pd

    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("tables")
    items = [(i, prose(rng, 25)) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        t = prose(rng, rng.randint(10, 90)).split(" ")
        if bad := i % 5 == 0:
            t[rng.randrange(len(t))] = rng.choice(["vilebad", "grimword"])
        docs.append((i, " ".join(t)))
        labels.append((i, 0, int(bad)))
    docs += [(1000 + i, docs[i][1].upper()) for i in range(1, 30)]
    for i in range(31, 60):
        w = docs[i][1].split(" ")
        w[len(w) // 2] = rng.choice(WORDS)
        docs.append((2000 + i, " ".join(w)))
    docs += [(3000 + i, prose(rng, 10) + " " + items[i][1]) for i in range(5)]
    docs += [(4000, None), (4001, ""), (4002, prose(rng, 9000))]
    pd.DataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(folder / "documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(folder / "labels.parquet")
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(folder / "benchmark.parquet")
    return str(folder), docs, items


def test_stages(spark, tables):
    folder, docs, items = tables
    table = spark.read.parquet(f"{folder}/documents.parquet")
    want = {d: t for d, t in docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, folder)
        if name == "toxicity":
            kept = {r.doc_id for r in out.collect()}
            bad = {d for d, t in want.items() if "vilebad" in (t or "").lower() or "grimword" in (t or "").lower()}
            assert not kept & bad and set(want) - bad == kept
            want = {d: want[d] for d in kept}
        elif name == "exact dedup":
            best: dict[str, int] = {}
            for d, t in want.items():
                key = (t or "").translate(brute.LOWER)
                best[key] = max(best.get(key, -1), d)
            want = {d: want[d] for d in best.values()}
        elif name == "near dedup":
            want = {d: want[d] for d, (_, c) in brute.near(want.items()).items() if c == d}
        elif name == "decontamination":
            hit = brute.contamination(want.items(), items)
            assert any(x[4] for x in hit.values())
            want = {d: t for d, t in want.items() if not hit[d][4]}
        else:
            total = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
            assert total == {d: len((t or "").split()) + 1 for d, t in want.items()}
            break
        assert out.columns == table.columns
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        table = spark.read.parquet(path)
        assert {r.doc_id: r.text for r in table.collect()} == want
    assert corpus_pipeline.run(spark, folder).count() == out.count()
