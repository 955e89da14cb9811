"""The pipeline against its stages taken one by one on plain Python values."""

import random

import corpus_pipeline
from spanforge.llm import decontamination, pieces
from tests.llm.test_operators import prose, shingle_set


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    bad = ["vile", "scumbag", "wretch"]
    items = [(i, prose(rng, 30) + ".") for i in range(5)]
    rows = []
    for i in range(400):
        w = prose(rng, 60).split(" ")
        if i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "src", 0))
    text = rows[1][1]
    rows += [(500, text, "en", "s", 1), (501, text + " more", "en", "s", 1), (502, prose(rng, 20) + " " + items[2][1], "en", "s", 1), (503, "write to me@x.org now", "en", "s", 1), (504, None, None, None, None), (505, "", "en", "s", 0)]
    labels = [(i, 1, 1 if i % 5 == 0 else 0) for i in range(400)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
    kept = {r["doc_id"]: r for r in docs.collect()}
    clean = [i for i in range(400) if i % 5]
    assert set(kept) == set(clean) | {503, 504, 505}  # toxic ones, copies and the leak are gone
    assert kept[503]["text"] == "write to [EMAIL] now" and kept[503]["n_chars"] == len("write to [EMAIL] now") and kept[504]["n_chars"] is None
    assert all(len(shingle_set(kept[a]["text"], 5) & shingle_set(kept[b]["text"], 5)) == 0 for a, b in zip(clean, clean[1:], strict=False))
    model = pieces.model(pieces.MODEL)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(kept) and all(r["lossless"] for r in out.values())
    assert all(pieces.decode(model, out[i]["token_ids"]) == kept[i]["text"] for i in kept if kept[i]["text"])
    index = decontamination.Index(items)
    assert all(not index.leaks(decontamination.words_of(decontamination.raw_of(r["text"]))) for r in kept.values() if r["text"])
