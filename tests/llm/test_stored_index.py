"""How the positional index lies in the store."""

import pyarrow.parquet as pq

from clumpwise.llm.phrase_index import build_index, find_in, stored_index


def test_row_groups_of_the_index_hold_few_blocks(spark):
    texts = [(k, " ".join(f"w{(k * 7919 + i * 31) % 50021}" for i in range(60_000)) + " a b c d e f g h i j") for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    index = stored_index(build_index(docs))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 40
    assert max(g.num_rows for g in groups) <= 16 and max(g.total_byte_size for g in groups) < 16 << 20
    bench = spark.createDataFrame([("x", "a b c d e f g h i j")], "item_id string, text string")
    assert {(r.doc_id, r.n_hit) for r in find_in(index, bench).collect()} == {(k, 10) for k in range(40)}
