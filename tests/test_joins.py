import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill import shared
from tidemill.operators import joins, lanes, ranges
from tidemill.sources import captured, formats


def test_position_and_pairs_raise(spark):
    df = spark.createDataFrame([([1, 2], ["a"])], "l array<int>, r array<string>")
    with pytest.raises(Exception, match="different lengths"):
        df.select(joins.by_position(F.col("l"), F.col("r")).alias("p")).collect()
    assert [tuple(x) for x in df.select(joins.zipped(n=F.col("l"), s=F.col("r")).alias("z")).first()["z"]] == [(1, "a"), (2, None)]
    one = lambda rows, name: spark.createDataFrame(rows, f"k int, {name} string")
    assert joins.paired(one([(1, "l")], "label"), one([(1, "a")], "action"), one([(1, "b")], "button"), "k").count() == 1
    for actions in ([], [(1, "a"), (1, "c")]):
        with pytest.raises(ValueError, match="not one action"):
            joins.paired(one([(1, "l")], "label"), one(actions, "action"), one([(1, "b")], "button"), "k")


def test_ranges_have_to_hold(spark):
    nets = spark.createDataFrame([("house", 0, 100), ("senate", 200, 300)], "label string, low long, high long")
    good = spark.createDataFrame([("0.0.0.7", 7, "house")], "ip string, stated long, label string")
    assert ranges.checked_ranges(good, nets, "ip", "stated", "label", "low", "high").first()["number"] == 7
    for bad in (("0.0.0.7", 7, "senate"), ("0.0.0.7", 8, "house"), ("x", 7, "house")):
        with pytest.raises(ValueError, match="range"):
            ranges.checked_ranges(spark.createDataFrame([bad], good.schema), nets, "ip", "stated", "label", "low", "high")


def test_first_range_with_few_and_many(spark):
    bands = spark.createDataFrame([(0, 0.0, 10.0), (1, 5.0, 15.0), (2, 40.0, 50.0)], "band int, low double, high double")
    points = spark.createDataFrame([(k, float(k)) for k in range(0, 60, 4)], "__id long, x double")
    want = {k: 0 if k <= 10 else 1 if k <= 15 else 2 if 40 <= k <= 50 else None for k in range(0, 60, 4)}
    for small in (10, 1):
        assert {r["__id"]: r["band"] for r in ranges.first_range(points, bands, "x", "low", "high", "band", 10.0, small).collect()} == want


def test_queries_of_subjects():
    s = lanes.Subject(company=" Acme  Corp ", ticker="acm")
    assert [lanes.subject_query(s, x) for x in ("quoted", "plain", "fields")] == ['"Acme Corp" ACM', "Acme Corp", 'all:"Acme" AND all:"Corp"']
    with pytest.raises(ValueError, match="style"):
        lanes.subject_query(s, "x")


@pytest.mark.parametrize("as_of, sequence", [("2024-02-30", None), ("2024-2-3", None), (None, 1.5), (None, True), (None, 1 << 53)])
def test_checkpoints(as_of, sequence):
    lanes.checked_checkpoint("2024-02-29", 5)
    with pytest.raises(ValueError, match="must be"):
        lanes.checked_checkpoint(as_of, sequence)


def test_captured_filters_pick_files(spark, tmp_path):
    for p, d in (("a", "2024-01-01"), ("a", "2024-01-09"), ("b", "2024-01-09")):
        folder = tmp_path / f"provider={p}" / f"as_of={d}"
        folder.mkdir(parents=True)
        (folder / "x.json").write_text(f"{p}{d}")
    captured.register(spark)
    rows = spark.read.format("captured").option("path", str(tmp_path)).load()
    assert sorted(r["text"] for r in rows.collect()) == ["a2024-01-01", "a2024-01-09", "b2024-01-09"]
    assert [r["text"] for r in rows.where("provider = 'a' and as_of > '2024-01-05'").collect()] == ["a2024-01-09"]
    assert rows.where("provider = 'none'").count() == 0


def test_archives_that_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "x")
    data = out.getvalue()
    assert list(formats.zip_entries(data)) == [("a", b"x")]
    end = data.rfind(b"PK\x05\x06")
    several = data[: end + 4] + b"\1\0" + data[end + 6 :]
    for bad in (several, b"none", data[:end] + b"PK\x06\x07" + b"\0" * 16 + data[end:]):
        with pytest.raises(ValueError):
            list(formats.zip_entries(bad))


def test_shared_folder(spark):
    with shared.paths_made() as made:
        kept = shared.cut(spark.range(3))
    assert kept.count() == 3 and len(made) == 1
    shared.remove(spark, made)
    with pytest.raises(Exception, match="(?i)not.*exist|no such|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(made[0]).count()
