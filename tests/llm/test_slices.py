"""Long texts are worked on in slices of a batch, and a small benchmark is cut into few files."""
from __future__ import annotations

import pyarrow as pa
import public_tokenizers
import pytest

from eventlens.llm import bpe, decontam, near_dup, words

#: 24 texts of about 300 kB, a null and an empty one.
TEXTS = [f"word{k} of a long text here " * 12_000 for k in range(24)] + [None, ""]
BATCH = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS), pa.array([str(k) for k in range(len(TEXTS))])], names=["id", "text", "key"])


def bounded(parts: list[pa.RecordBatch]) -> bool:
    return all(sum(len(t or "") for t in p.column("text").to_pylist()[:-1]) < words.SLICE_BYTES for p in parts)


def test_slices_hold_every_row_once_and_few_bytes():
    parts = list(words.slices(BATCH, 1))
    assert len(parts) > 4 and bounded(parts)
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([BATCH]))
    assert [p.num_rows for p in words.slices(BATCH.slice(0, 0), 1)] == [0]
    nulls = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([None, None], pa.string())], names=["id", "text"])
    assert [p.num_rows for p in words.slices(nulls, 1)] == [2]


@pytest.mark.parametrize("work, first", [(near_dup._profiles, 0), (near_dup._sets, 1)], ids=["profiles", "sets"])
def test_near_dup_gives_out_slices(work, first):
    batch = BATCH.select(BATCH.schema.names[first:])
    out = list(work(iter([batch])))
    assert len(out) > 4  # was one batch, whatever its size
    alone = [b for k in range(len(TEXTS)) for b in work(iter([batch.slice(k, 1)]))]
    assert pa.Table.from_batches(out).to_pylist() == pa.Table.from_batches(alone).to_pylist()


def test_bpe_gives_out_slices(spark):
    seen = []

    def work(codec, batch):
        seen.append(batch)
        return batch

    out = list(bpe._batches(spark, public_tokenizers.path("byte_bpe_50k.json"), work)(iter([BATCH])))
    assert len(seen) > 4 and bounded(seen)  # was one batch, whatever its size
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([BATCH]))


def test_a_small_benchmark_is_cut_into_few_files(spark, monkeypatch):
    files, real = {}, decontam.common.materialize

    def noted(df, name):
        out = real(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(decontam.common, "materialize", noted)
    item = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        docs = spark.createDataFrame([(k, f"before it {item(k)} after it") for k in range(6)] + [(6, None), (7, "nothing here")], "doc_id long, text string")
        items = spark.createDataFrame([(k, item(k)) for k in range(48)] * 2, "item_id long, text string")
        got = sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(k, k) for k in range(6)]
    assert files["leak-passages"] <= decontam.CUT_TASKS  # was one for each shuffle partition with an item
