"""The pipeline against a brute-force version of its stages."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_components, brute_mix, words


def test_pipeline(spark, tmp_path):
    item = words(900, 25)
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words(i, 50 + i)), "xx" if i % 2 else "yy", f"s{i % 3}", 0))
    rows += [(100, " ".join(words(3, 53)), "xx", "s0", 0), (101, "123 456", "xx", "s1", 0), (102, None, None, None, None)]
    rows += [(103, " ".join([*words(700, 30), *item, *words(701, 30)]), "xx", "s1", 0), (104, " ".join(words(4, 54)[:-1]) + " call +1 (743) 555-3824", "xx", "s2", 0)]
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    kept = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    comp = brute_components([r[1] for r in kept])
    kept = [r for k, r in enumerate(kept) if comp[k][1] == k and r[0] != 103]
    assert set(got) == {r[0] for r in kept} and 100 not in got and 104 not in got
    size, own, target = brute_mix([(r[0], r[1], r[3]) for r in kept])
    for r in kept:
        x = got[r[0]]
        assert (x.size, x.source_size) == (size[r[0]], own[r[3]]) and abs(x.target - target[r[3]]) < 1e-6

    stage = dict(corpus_pipeline.STAGES)["pseudonyms"]
    one = stage(spark, docs.where("doc_id = 104"), sf).first()
    assert "555-3824" not in one.text and one.n_chars == len(one.text)
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs.where(F.lit(False)), sf).columns == docs.columns, name
