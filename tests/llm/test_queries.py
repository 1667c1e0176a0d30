from tarnlight.llm import queries


def test_masked_covers_both_tables(spark, tmp_path):
    rows = {
        "memory_recall": ("content", [(1, "Write to anna.berg@example.org before Friday"), (1, "Write to anna.berg@example.org before Friday"), (2, "plain words"), (3, None)]),
        "atomic_memories": ("fact", [(1, "Home address: 12 Maple Street, Northbrook"), (4, "see build 2025-11-2345")]),
    }
    for table, (column, values) in rows.items():
        spark.createDataFrame(values, f"id long, {column} string").write.parquet(f"{tmp_path}/{table}.parquet")
    got = sorted((r.table_name, r.row_id, r.masked) for r in queries.p5_masked(spark, str(tmp_path)).collect())
    assert got == [
        ("atomic_memories", 1, "Home address: [ADDRESS]"), ("atomic_memories", 4, "see build 2025-11-2345"),
        ("memory_recall", 1, "Write to [EMAIL] before Friday"), ("memory_recall", 2, "plain words"), ("memory_recall", 3, None),
    ]
