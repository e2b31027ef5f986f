"""The maintained audit table against the latest record of the whole log."""

import random

from riskfuse.operators.audit import audit_latest
from riskfuse.operators.audit_store import AuditStore
from riskfuse.session import work_dir

SCHEMA = "request_id string, transaction_id string, timestamp string, decision string, tags array<string>"


def batches():
    rng = random.Random(2)
    make = lambda n, ids: [(f"r{rng.randrange(ids)}", f"t{rng.randrange(50)}", f"2024-01-{rng.randint(1, 28):02d}T00:00:00", rng.choice("abc"), [rng.choice("xy")])
                           for _ in range(n)]
    return [make(400, 300), [("hot", f"t{k}", "2024-02-01T00:00:00", "a", None) for k in range(300)] + [(None, "t", "2024-01-01T00:00:00", "a", None)],
            make(5, 3), [], make(200, 400)]


def test_merged_batches_equal_the_whole_log(spark):
    store, seen = AuditStore(spark, work_dir(spark, "store"), buckets=16), []
    assert store.latest() is None and store.get("r1") is None
    for k, rows in enumerate(batches()):
        batch = spark.createDataFrame(rows, SCHEMA)
        before = store.generations()
        touched = store.merge(batch, k)
        after = store.generations()
        assert {b for b in after if after[b] != before.get(b)} == set(touched)
        if k == 2:
            assert 0 < len(touched) <= 3
        if k == 3:
            assert touched == [] and before == after
        seen += rows
        want = sorted(map(str, audit_latest(spark.createDataFrame(seen, SCHEMA).where("request_id is not null")).collect()))
        columns = [f.split()[0] for f in SCHEMA.split(", ")]
        assert sorted(map(str, store.latest().select(*columns).collect())) == want
        store.merge(batch, k)  # run again
        assert sorted(map(str, store.latest().select(*columns).collect())) == want
    assert store.get("hot").first().transaction_id == "t99" and store.get("none").count() == 0


def test_a_lookup_reads_one_bucket_and_old_generations_go(spark):
    store = AuditStore(spark, work_dir(spark, "store"), buckets=8)
    for k, rows in enumerate(batches()):
        store.merge(spark.createDataFrame(rows, SCHEMA), k)
    assert len({f.rsplit("/", 1)[0] for f in store.get("r7").inputFiles()}) == 1
    rows = sorted(map(str, store.latest().collect()))
    assert store.vacuum() > 0 and sorted(map(str, store.latest().collect())) == rows
    assert store.vacuum() == 0
