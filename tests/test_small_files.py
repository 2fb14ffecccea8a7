"""Many small files: they share batches, and what follows a shuffle of few bytes is still dealt to all tasks."""

import pyarrow as pa

from codetables.operators import resolve, scan, structure
from codetables.queries import adapters


def test_small_files_share_a_batch_and_large_ones_are_cut():
    def rows_of(sources):
        files = pa.record_batch([pa.array(["r"] * len(sources)), pa.array([f"{k}.py" for k in range(len(sources))]), pa.array(["python"] * len(sources)), pa.array(sources)], ["repo_id", "path", "grammar", "content"])
        return list(scan.scanned(iter([files.slice(0, 1), files.slice(1)])))

    small = rows_of(["import a\nx = (\n"] + ["import b\n\n\ndef f():\n    pass\n"] * 3000)
    assert [b.num_rows for b in small] == [9003]
    got = [tuple(r.values()) for r in small[0].to_pylist()]
    assert got[:3] == [("r", "0.py", "python", 1, 1, 1, 0, "import a", "import a", None), ("r", "0.py", "python", 2, 2, 2, 0, "x = (", "x = (", None), ("r", "0.py", "python", None, None, None, None, None, None, "line 2: ( without an end")]
    assert [r[3] for r in got[-3:]] == [1, 4, 5] and {r[1] for r in got} == {f"{k}.py" for k in range(3001)}
    large = rows_of(["y = 1\n" * 25_000, "import b\n"])
    assert [b.num_rows for b in large] == [10_000, 10_000, 5_000, 1]
    assert rows_of(["", "\n"]) == []


def test_work_after_small_shuffles_has_all_tasks(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "concat('s', id % 20) AS source")
    docs.coalesce(4).write.parquet(f"{tmp_path}/documents.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = adapters.project(spark, str(tmp_path))
    assert len(p.inputFiles()) == n  # its sources are scanned in as many pieces
    imports = structure.imports(p)
    assert imports.rdd.getNumPartitions() == n and resolve.asked_paths(imports).rdd.getNumPartitions() == n
    assert imports.count() == imports.dropDuplicates(resolve.IMPORT).count() > 15_000
