"""All phases from raw files to models, on the test rides."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from dockflow.contract import ContractError, load_contract
from dockflow.operators import models
from dockflow.plans import pipeline
from dockflow.testbed import fixtures as fx
from dockflow.testbed import queries as q

CONTRACT = fx.test_contract()
TREES = models.TreeParams(learning_rate=0.3, max_depth=3, min_rows_per_leaf=5, max_iterations=6)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Raw zone: zips, a station CSV, gzipped weather."""
    root = tmp_path_factory.mktemp("lake")
    raw = root / "raw"
    raw.mkdir()
    (raw / "trips").symlink_to(fx.write_trip_zips(fx.trips_raw(spark, SMALL)).removeprefix("file:"))
    (raw / "stations").mkdir()
    fx.stations_raw(spark, SMALL).toPandas().to_csv(raw / "stations" / "s.csv", index=False)
    (raw / "weather").mkdir()
    for i, row in enumerate(fx.weather_payload(spark, SMALL).collect()):
        (raw / "weather" / f"{i}.json.gz").write_bytes(gzip.compress(row["payload"].encode()))
    return root


def rows(spark, path):
    return spark.read.parquet(str(path))


def test_phases_in_order(spark, root):
    zones = pipeline.Zones(str(root))
    for phase in pipeline.PHASES.values():
        phase(spark, zones, CONTRACT)
    pipeline.train_phase(spark, zones, CONTRACT, TREES, "l2", share=0.2)
    pipeline.train_phase(spark, zones, CONTRACT, TREES, "l2", drop_groups=("lag",), share=0.2)

    clean = rows(spark, root / "clean" / "trips")
    expected = q.trips_clean(spark, SMALL)
    keys = ["trip_id", "duration_s", "start_station_id", "end_station_id", "bike_id"]
    assert clean.count() == expected.count()
    assert clean.select(*keys).exceptAll(expected.select(*keys)).count() == 0
    times = [F.col(c).cast("string") for c in ("start_time", "end_time")]
    assert clean.select(*times).exceptAll(expected.select(*times)).count() == 0

    labels = rows(spark, root / "clean" / "station_hour_labels")
    table = rows(spark, root / "clean" / "station_hour_features")
    assert labels.count() == table.count() > 0
    assert set(CONTRACT.features) <= set(table.columns)
    assert table.filter("temperature_2m IS NOT NULL AND is_daylight IS NOT NULL").count() > 0

    wide = rows(spark, root / "training" / "station_hour_features")
    assert wide.count() == table.count()
    manifest = {r["split"]: r["n_rows"] for r in spark.read.json(str(root / "training" / "split_manifest")).collect()}
    assert sum(manifest.values()) == table.count()
    assert spark.read.json(str(root / "training" / "baseline")).count() > 0
    ledger = {r["check"]: r["status"] for r in spark.read.json(str(root / "checks" / "ledger")).collect()}
    assert ledger["mass_balance"] == "OK" and ledger["zero_rate"] in ("OK", "REVIEW")

    metrics = spark.read.json(str(root / "models" / "current" / "metrics")).first()
    assert metrics["n_train"] == manifest["train"] and metrics["net_flow_mae"] > 0
    shares = spark.read.json(str(root / "models" / "current" / "attribution_by_group")).collect()
    assert {r["feature_group"] for r in shares} == set(CONTRACT.feature_groups)
    assert sum(r["share"] for r in shares) == pytest.approx(1.0)
    assert {r["check"] for r in spark.read.json(str(root / "models" / "current" / "gates")).collect()} == {
        "beats_baseline", "fit_not_degenerate"}

    variant = load_contract(spark, str(root / "models" / "without-lag" / "contract"))
    assert variant.features == CONTRACT.without_groups(["lag"]).features
    assert spark.read.json(str(root / "models" / "without-lag" / "metrics")).first()["effect_measured"] == "total"


def test_unreadable_times_stop_the_conform_phase(spark, tmp_path):
    zones = pipeline.Zones(str(tmp_path))
    cells = fx.trip_cells(fx.trips_raw(spark, SMALL).withColumn(
        "start_time", F.when(F.col("trip_id").cast("int") % 50 == 0, "soon").otherwise(F.col("start_time"))))
    cells.write.parquet(f"{zones.parsed}/trips")
    fx.stations(spark, SMALL).write.parquet(f"{zones.parsed}/stations")
    with pytest.raises(ContractError, match="1%"):
        pipeline.conform_phase(spark, zones, CONTRACT)


def test_missing_weather_point_stops_the_feature_phase(spark, tmp_path):
    zones = pipeline.Zones(str(tmp_path))
    q.weather_table(spark, SMALL).filter("point_name <> 'click'").write.parquet(f"{zones.parsed}/weather")
    with pytest.raises(ContractError, match="click"):
        pipeline.features_phase(spark, zones, CONTRACT)


def test_uncovered_header_stops_the_land_phase(spark, tmp_path):
    import zipfile

    (tmp_path / "raw" / "trips").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "raw" / "trips" / "x.zip", "w") as z:
        z.writestr("t.csv", "ride,when\n1,2\n")
    with pytest.raises(ContractError, match="trip_id"):
        pipeline.land(spark, pipeline.Zones(str(tmp_path)), CONTRACT)


def test_packaged_contract_is_valid_json():
    from pathlib import Path

    json.loads((Path(pipeline.__file__).parents[1] / "contract_default.json").read_text())
