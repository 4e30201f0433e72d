"""Jobs that can be run again: what is missing is done once, lost runs leave nothing behind."""

import pytest
from skybias.plans import resumable
from skybias.sources import storage

KEYS = ["location_id", "variable"]


@pytest.fixture
def job(spark, tmp_path):
    path, calls = f"{tmp_path}/job", []
    data = spark.createDataFrame([("a", "o3", 1.0), ("a", "o3", 2.0), ("b", "o3", 3.0)], "location_id string, variable string, value double")

    def write(rows, target):
        storage._write(rows, target, ["variable"])

    def run(places, fail=False, rows=data, **options):
        todo = spark.createDataFrame([(p, "o3") for p in places], "location_id string, variable string")

        def produce(wanted):
            calls.append(sorted(r.location_id for r in wanted.collect()))
            return rows.join(wanted, KEYS, "left_semi").select("location_id", "variable", "value")

        def lost(rows, target):
            write(rows, target)
            raise RuntimeError("lost")

        out = resumable.run_missing("test", path, todo, KEYS, produce, lost if fail else write, **options)
        return sorted((r.location_id, r.value) for r in out.collect())

    return path, calls, run


def test_a_second_run_does_what_is_missing(spark, job):
    path, calls, run = job
    assert run([]) == []
    assert run(["a", "c"]) == [("a", 1.0), ("a", 2.0)]
    assert run(["a", "b", "c"]) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    assert run(["a", "b", "c"]) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    assert calls == [[], ["a", "c"], ["b"], []]
    status = {r.location_id: (r.rows, r.succeeded, r.reason, r.batch) for r in resumable.manifest(spark, path, KEYS).collect()}
    assert status == {"a": (2, True, "", 1), "b": (1, True, "", 2), "c": (0, False, "no data", 1)}


def test_data_of_a_lost_run_do_not_count(spark, job):
    path, calls, run = job
    assert run(["a"]) == [("a", 1.0), ("a", 2.0)]
    with pytest.raises(RuntimeError):
        run(["a", "b"], fail=True)
    assert resumable.manifest(spark, path, KEYS).count() == 1
    assert run(["a"]) == [("a", 1.0), ("a", 2.0)]
    assert run(["a", "b"]) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    assert calls == [["a"], ["b"], [], ["b"]]


def test_places_without_data_are_tried_again_on_demand(spark, job):
    path, calls, run = job
    later = spark.createDataFrame([("c", "o3", 9.0)], "location_id string, variable string, value double")
    assert run(["a", "c"]) == [("a", 1.0), ("a", 2.0)]
    assert run(["a", "c"], rows=later) == [("a", 1.0), ("a", 2.0)]
    assert run(["a", "c"], rows=later, retry=True) == [("a", 1.0), ("a", 2.0), ("c", 9.0)]
    assert {r.location_id: r.rows for r in resumable.latest_status(spark, path, KEYS).collect()} == {"a": 2, "c": 1}


def test_unknown_variables_are_refused(spark, tmp_path):
    empty = spark.createDataFrame([], "location_id string")
    with pytest.raises(NotImplementedError):
        resumable.run_observations(f"{tmp_path}/o", empty, empty, empty, "2024-01-01", "2024-01-02", ["co"])
