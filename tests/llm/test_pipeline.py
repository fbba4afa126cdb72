"""The pipeline's stages, each on the last one's output, against plain Python."""

import random
import re

import corpus_pipeline
from tests.llm.test_map_operators import hit_words
from tests.llm.test_ngram_join import brute

BAD = ["grumpf", "zorkish", "blathen"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, seed=9):
    rng = random.Random(seed)
    bench = [(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(500):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 90))]
        toxic = i % 4 == 1
        if toxic:
            words[3] = rng.choice(BAD)
        if i % 10 == 2:
            words[5:5] = bench[i % 5][1].split()
        if i % 10 == 4:
            words[4] = f"me{i}@mail.example.com"
        text = " ".join(words)
        if i % 10 == 6 and i > 10:
            text = docs[i - 6][1] + " tail"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(bool(set(text.split()) & set(BAD)))))
    docs += [(900, None, "en", None, None), (901, "", "en", "s0", 0), docs[0]]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, bench


def test_stages(spark, tmp_path):
    rows, bench = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "source mix"]
    outs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        path = f"{tmp_path}/out{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        outs.append([tuple(r) for r in docs.collect()])
    clean = {r[0] for r in rows if not set((r[1] or "").split()) & set(BAD)}
    assert len({r[0] for r in outs[0]} ^ clean) <= 10
    want = {key[0] for key in brute(outs[0], 5, 80) if key[0] == key[2]}
    assert sorted(r[0] for r in outs[1]) == sorted(want)
    ids = {r[0] for r in outs[1] if not hit_words(r[1], bench)[-1]}
    assert {r[0] for r in outs[2]} == ids and len(ids) < len(outs[1]) - 10 and {900, 901} <= ids
    before = {r[0]: r for r in outs[2]}
    for r in outs[3]:
        text = before[r[0]][1]
        assert r[1] == (re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", text) if text else text)
        assert r[4] == (len(r[1]) if r[1] is not None else None)
    assert len(outs[3]) == len(outs[2]) and any("[EMAIL]" in (r[1] or "") for r in outs[3])
    sizes = {r[0]: len((r[1] or "").split()) for r in outs[3]}
    assert {r[0]: r[2] for r in outs[4]} == sizes
    assert sum(r[5] for r in outs[4]) / sum(sizes.values()) > 1.45


def test_run(spark, tmp_path):
    tables(spark, str(tmp_path), 3)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "source", "size", "source_size", "target", "taken"} and out.count() > 100


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path), 3)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def text_of(rng, n=60):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def test_null_and_shared_ids(spark, tmp_path):
    rng = random.Random(1)
    a, b, c, d, e, f = (text_of(rng) for _ in range(6))
    row = lambda i, text: (i, text, "en", "s", 0)
    rows = [row(None, a), row(None, a), row(None, a + " tail"), row(1, b), row(2, b + " tail"), row(2, c), row(None, d), row(7, d), row(8, None), row(8, None), row(None, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    seen = sorted((str(r.doc_id), (r.text or "").removesuffix(" tail")) for r in got)
    assert seen == sorted([("None", a), ("1", b), ("2", c), ("7", d), ("8", ""), ("None", "")])
    spark.createDataFrame([(1, e)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [row(None, e), row(None, f), row(3, e + " tail"), row(3, a), row(4, b), row(None, None)]
    got = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("None", f), ("3", a), ("4", b), ("None", "")])


def test_owners_in_threads_clear_only_their_own(spark):
    """Two runs at once: each clears what it opened, and nothing that the other still reads."""
    import threading

    from siltstone.llm.scratch import Scratch

    opened, ready, results = {}, threading.Barrier(2), {}

    def work(name: str) -> None:
        with Scratch.owned():
            opened[name] = Scratch(spark)
            kept = opened[name].keep(spark.range(10), "t")
            ready.wait(60)
            if name == "b":
                done.wait(60)  # until the other has cleared
            results[name] = kept.count()
        done.set()

    done = threading.Event()
    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert results == {"a": 10, "b": 10} and not opened["a"].names and not opened["b"].names
    outside = Scratch(spark)
    outside.keep(spark.range(1), "t")
    assert outside.names == ["t"]

