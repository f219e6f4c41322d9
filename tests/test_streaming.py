from sieveworks.streaming.drop_folder import watch
from tests.fixtures import BROKEN, CONFORMING


def test_each_file_is_checked_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(CONFORMING["document"])
    (tmp_path / "in/b.zip").write_bytes(BROKEN["F2"])
    seen = []
    sink = lambda checked, n: seen.extend((r.target, r.warning) for r in checked.summary.collect())
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), sink).awaitTermination(300)
    assert sorted(seen) == [("a.zip", 0), ("b.zip", 1)]
