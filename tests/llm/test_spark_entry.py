import __spark_entry__ as entry


def test_registered():
    found = entry.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in found
    assert "op4_exact_dedup" in entry.oracle_sql()
