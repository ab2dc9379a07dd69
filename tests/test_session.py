import pytest

from rangeloom.operators import batch
from rangeloom.plans.model import QueryError
from rangeloom.session import Session, command
from rangeloom.sources import sinks
from rangeloom.sources.tables import synthetic_housing


@pytest.fixture(scope="module")
def session(spark):
    return Session(synthetic_housing(spark, 3000).persist())


LINES = ["SELECT COUNT(*) FROM data WHERE place = 'Bay Area' AND MedInc >= 3", "SELECT AVG(MedHouseVal) FROM data WHERE MedInc BETWEEN 2 AND 5", "SELECT SUM(Population) FROM data WHERE HouseAge > 40 AND MedInc > 4"] * 4


def test_prompt(session, tmp_path):
    (tmp_path / "w.sql").write_text("# sample\n" + "\n".join(LINES) + "\nbroken\n")
    plain = session.sql(LINES[0]).first()
    _, said = command(session, f"workload {tmp_path}/w.sql")
    assert said.startswith("12 queries, 1 errors")
    assert tuple(session.sql(LINES[0]).first()) == tuple(plain)
    assert session.metrics(LINES[0]).count() == 1
    for line, part in (("help", "SELECT"), ("columns", "MedInc"), ("tables", "data"), ("zones", "Riparian"), ("SELECT MedInc FROM data ORDER BY MedInc LIMIT 2", "MedInc"), ("SELECT nope FROM data", "error"), ("load nowhere.txt", "error")):
        assert part in command(session, line)[1]
    assert command(session, "quit")[1] is None
    with pytest.raises(QueryError):
        session.metrics("SELECT * FROM data")


def test_batch_and_sinks(session, spark, tmp_path):
    queries, _ = session.workload(LINES)
    layout = session.layout or session.build(queries)
    results = batch.run_group(layout, session.table, queries[:3], reps=1)
    assert results.filter("NOT match").isEmpty() and results.count() == 6
    assert batch.latency_percentiles(results).count() == 2
    by = {r["region"]: r["queries"] for r in batch.speedup_by_region(batch.speedups(results)).collect()}
    assert by == {"Bay Area": 1, "": 2}
    sinks.write_results(results, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 6
    assert batch.query_log(spark, queries, session.table.columns).count() == 24
    assert sinks.formatted(None) == "NULL" and sinks.formatted(12345) == "12,345"


def test_benchmark(spark, tmp_path):
    from rangeloom import benchmark

    lines = ["SELECT COUNT(*) FROM data WHERE zone = 'Lowland' AND Slope < 10", "SELECT AVG(Slope) FROM data WHERE Elevation >= 3200"]
    (tmp_path / "w.txt").write_text("\n".join(lines))
    text = benchmark.main(["-w", str(tmp_path / "w.txt"), "--group-a", str(tmp_path / "w.txt"), "-n", "2000", "--dataset", "forest", "--reps", "1", "--csv-out", str(tmp_path / "out")], spark)
    assert "zorder" in text and "Lowland" in text
    assert spark.read.csv(str(tmp_path / "out"), header=True).filter("match = 'true'").count() == 6
