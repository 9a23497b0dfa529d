"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline

SLUR = "moron"


def test_stages(spark, tmp_path):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    clean = lambda n=80: " ".join(draw.choice(words) for _ in range(n))
    item = clean(20)
    shared = clean(60)
    rows, toxic = [], set()
    for i in range(400):
        text = clean()
        if i % 8 == 1:
            text, _ = f"{text} {SLUR} {clean(5)}", toxic.add(i)
        rows.append([i, text, "en", "s", len(text)])
    near = rows[6][1].split()
    near[3] = "changed"
    rows.append([1000, " ".join(near), "en", "s", 0])
    rows.append([1001, clean() + " " + item + " " + clean(), "en", "s", 0])
    rows += [[1002 + k, clean() + "\n" + shared, "en", "s", 0] for k in range(5)]
    rows += [[2000, None, None, None, None], [2001, "", "en", "s", 0], [None, clean(), None, "s", 0]]
    a, b, c, d = (clean(30) for _ in range(4))
    changed = " ".join(["other", *c.split()[1:]])
    rows += [[1100, f"{a}\n{b}\n{c}", "en", "s", 0], [1101, f"{a}\n{b}\n{changed}", "en", "s", 0], [1102, f"{a}\n{b}\n{c}", "en", "s", 0]]
    rows += [[1103, d, "en", "s", 0], [1104, f"{a}\n{d}\n{d}", "en", "s", 0], [1105, f"{d}\n{clean(40)}", "en", "s", 0]]
    for r in rows:
        r += ["x", 7]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __lost string, __Doc int"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["toxicity"]).isdisjoint(toxic) and len(seen["toxicity"]) >= len(rows) - len(toxic) - 3
    texts = [seen["line_dedup"][1002 + k]["text"] for k in range(5)]
    assert sum(shared in t for t in texts) == 1 and set(seen["line_dedup"]) == set(seen["toxicity"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].values() if r["text"] is not None)
    # A near copy that line dedup left one line of, a copy it emptied, and a text that is put together of others' lines go too.
    assert seen["line_dedup"][1101]["text"] == changed and seen["line_dedup"][1102]["text"] == seen["line_dedup"][1104]["text"] == ""
    assert set(seen["line_dedup"]) - set(seen["near_dedup"]) == {1000, 1101, 1102, 1104} and {6, 1100, 1103, 1105, 2000, 2001, None} <= set(seen["near_dedup"])
    assert all(r["text"] for i, r in seen["decontamination"].items() if i not in (2000, 2001))
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {1001}
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_sweep(spark):
    from chainloom.llm.common import cut, sweep

    assert cut(spark.range(3)).count() == 3
    assert sweep(spark)
    assert cut(spark.range(3)).count() == 3


def test_workers_drop_what_an_operator_before_them_made(spark):
    """The next tasks of a function find what it made; another function's don't, and so a worker never holds the caches of all stages."""
    from chainloom.llm import tokens
    from chainloom.llm.common import in_arrow
    from chainloom.llm.queries import tokenizer

    path = tokenizer("byte_bpe_50k.json")

    def state(batches):
        import os

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "held": [tokens.load_encoder.cache_info().currsize]})

    def encode(batches):
        found = list(state(batches))
        tokens.load_encoder(path)
        yield from found

    def other(batches):
        yield from state(batches)

    ask = lambda run: [tuple(r) for r in in_arrow(spark.range(0, 8, 1, 4), run, "pid long, held long").collect()]
    loaded = {pid for _ in range(4) for pid, _ in ask(encode)}
    assert any(held for _ in range(4) for _, held in ask(encode))
    after = [x for _ in range(4) for x in ask(other)]
    assert loaded & {pid for pid, _ in after} and not any(held for _, held in after)
