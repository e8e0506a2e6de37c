import inspect

import corpus_pipeline
from tests.llm import helpers
from versograph.llm import op07_decontaminate, op08_secrets, op09_rules, op10_simhash
from versograph.llm.common import DOCUMENT_COLUMNS

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n=80):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def test_stages_take_effect_one_after_another(spark, tmp_path):
    item = text(900, 30)
    rows = [(i, text(i), "en", "a", 1) for i in range(60)]
    rows += [(100, text(3), "en", "a", 1), (101, text(7) + " tail", "en", "b", 1), (102, text(50, 40) + " " + item, "en", "a", 1), (103, text(51) + " password=abcdef123456", "en", "a", 1)]
    rows += [(104, "same " * 100, "en", "a", 1), (105, "short", "en", "a", 1), (106, None, None, None, None)]
    helpers.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == list(DOCUMENT_COLUMNS)
    first, second, third, fourth, last = map(set, seen)
    assert {104, 105, 106}.isdisjoint(first) and len(first) >= 60
    assert first - second == {x for x in (100, 101) if x in first} or 100 not in second
    assert third == second - {102} and fourth == third == last
    if 103 in fourth:
        assert seen[3][103].text == rows[63][1].split(" password")[0] + " " + op08_secrets.MASK
        assert seen[3][103].n_chars == len(seen[3][103].text)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == last
    assert all(m.__name__ for m in (op07_decontaminate, op09_rules, op10_simhash))
