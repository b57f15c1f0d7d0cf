"""Ensembles: vectors from positions, and tasks by the number of structures."""

from pyspark.sql import functions as F

from strandlake.operators import clustering
from strandlake.plans import ensembles


def test_vectors_are_filled_in_batches(spark, monkeypatch):
    monkeypatch.setattr(clustering, "VECTOR_CELLS", 10)
    rows = [(0, [0, 3]), (1, None), (2, []), (3, [4, 9]), (4, [2])]
    made = clustering.vectors_of_sets(spark.createDataFrame(rows, "read_id long, p array<int>"), 5)
    assert {r.read_id: r.features.toArray().tolist() for r in made.collect()} == {i: [float(k in (p or [])) for k in range(5)] for i, p in rows}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and made.columns == ["read_id", "p", "features"]


def test_many_structures_are_many_tasks(spark, monkeypatch):
    dbs = ["((...))....", "((....))...", "((...))....", "....((...))", "...((....))", "....((...))", "....((...))"]
    structs = spark.createDataFrame(list(enumerate(dbs)), "struct_id long, db string").coalesce(1)
    seen, clustered = [], ensembles.clustered
    monkeypatch.setattr(ensembles, "TASK_STRUCTURES", 3)
    monkeypatch.setattr(ensembles, "clustered", lambda sets, *a: seen.append(sets) or clustered(sets, *a))
    got = ensembles.analyse(structs, 11, ensembles.Settings())
    assert {(r["n"], r["db"]) for r in got["centres"].collect()} == {(3, "((...))...."), (4, "....((...))")}
    assert seen[0].select(F.spark_partition_id().alias("t")).distinct().count() > 1
    # what is found is written, so tables made from it don't cluster again
    assert "UDF" not in got["assignments"]._jdf.queryExecution().optimizedPlan().toString()
