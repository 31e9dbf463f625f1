"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

from collections import Counter

import corpus_pipeline
from tests.llm.helpers import components, odd_documents, shingle_set, table
from tests.llm.test_models import _toxic_corpus


def _corpus(spark, path):
    rows, labels = _toxic_corpus(spark)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(i, t + (" " + item if i % 50 == 3 else ""), "s%d" % (i % 4)) for i, t, _ in rows]
    rows += [(2000 + i, rows[i][1] + (" tail" if i % 2 else ""), "s1") for i in range(1, 60, 2)]
    rows += [(None if i is None else 5000 + i, t, s) for i, t, s in odd_documents()]
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, item


def _read(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_and_run(spark, tmp_path):
    rows, item = _corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert got.columns == columns
        got.write.parquet(f"{tmp_path}/{name}")
        kept[name] = (_read(docs), docs := spark.read.parquet(f"{tmp_path}/{name}"))
    before, after = kept["toxicity"][0], _read(kept["toxicity"][1])
    toxic = lambda t: any(w in (t or "").lower() for w in ("vil", "hateful"))
    assert len(before) == len(rows) and Counter(after) <= Counter(before)
    assert not any(toxic(t) for i, t, _ in after) and sum(not toxic(t) for _, t, _ in before) == len(after)

    before, after = kept["near_copies"][0], _read(kept["near_copies"][1])
    sets = {i: shingle_set(t) for i, t, _ in before if i is not None and shingle_set(t)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    assert links and Counter(i for i, _, _ in after if i is not None) == Counter({i for i, _, _ in before if i is not None and comp.get(i, i) == i})

    before, after = kept["decontamination"][0], _read(kept["decontamination"][1])
    assert any(item in (t or "") for _, t, _ in before)
    assert Counter(after) == Counter(r for r in before if item not in (r[1] or ""))

    before, after = kept["mixing"][0], _read(kept["mixing"][1])
    copies = Counter(after)
    assert set(after) <= set(before) and all(n <= 3 * before.count(r) for r, n in copies.items())

    shards = kept["sharding"][1].collect()
    sizes = Counter(r.shard for r in shards)
    assert len(shards) == len(after) and max(sizes.values()) - min(sizes.values()) <= 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, shards), key=repr)


def test_empty_tables_pass_through(spark, tmp_path):
    from pyspark.sql import functions as F

    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").where(F.lit(False)).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
