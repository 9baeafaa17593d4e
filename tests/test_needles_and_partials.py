"""Long lists of needles against brute force; stored sums against one load."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from floodlens.functions.geometry import Box
from floodlens.operators.grids import region_daily_mean
from floodlens.operators.needles import first_mentions
from floodlens.operators.partials import RegionPartials

NEEDLES = "needle string, label string, rank int"


@pytest.mark.parametrize("gram", [2, 5])
def test_first_mentions_equal_brute_force(spark, gram):
    rng = random.Random(gram)
    word = lambda n: "".join(rng.choice("abcdé ñ") for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 3, 20, 80]))) for i in range(120)] + [(200, None), (201, "日本語テキスト"), (202, "x" * 30_000 + "needle"), (203, "needl")]
    needles = [(word(rng.randint(1, 8)), f"l{rng.randrange(5)}", rng.randrange(40)) for _ in range(150)]
    needles += [("本語", "jp", 3), ("needle", "long", 2), ("needle", "again", 2), (None, "none", 0), ("zzzzzz", "nowhere", 0), ("a", "short", 35), ("b", None, None)]
    have = first_mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(needles, NEEDLES), "other", gram)
    want = {}
    for i, t in texts:
        hits = [(r, s) for n, s, r in needles if n is not None and r is not None and t is not None and n in t]
        want[i] = min(hits) if hits else (None, "other")
    assert {r.id: (r.rank, r.label) for r in have.collect()} == want
    assert want[202] == (2, "again") and want[203] != want[202] and want[201] == (3, "jp")


def test_empty_needle_and_empty_tables(spark):
    texts, needles = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id long, text string"), spark.createDataFrame([("", "every", 7), ("bc", "some", 9)], NEEDLES)
    assert sorted((r.id, r.label) for r in first_mentions(texts, "id", "text", needles).collect()) == [(1, "every"), (2, None), (3, "every")]
    assert [r.label for r in first_mentions(texts, "id", "text", needles.limit(0), "d").collect()] == ["d"] * 3
    assert first_mentions(texts.limit(0), "id", "text", needles).count() == 0


def test_no_pair_is_formed_without_an_equality(spark):
    texts = spark.createDataFrame([(1, "some text")], "id long, text string")
    plan = first_mentions(texts, "id", "text", spark.createDataFrame([("some", "a", 1), ("text here", "b", 2)], NEEDLES))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


BOXES = (Box("east", 0.0, -10.0, 90.0, 10.0), Box("west", -90.0, -10.0, 0.0, 10.0))
CELLS = "date date, lat double, lon double, v double, part date"


def cells(rng, n, months=4):
    out = []
    for _ in range(n):
        day = dt.date(2024, rng.randrange(1, months + 1), rng.randrange(1, 28))
        out.append((day, float(rng.randrange(-15, 16)), float(rng.randrange(-100, 101)), None if rng.random() < 0.1 else float(rng.randrange(50)), day.replace(day=1)))
    return out


def test_two_loads_give_what_one_load_gives(spark, tmp_path):
    rng = random.Random(4)
    first, late = cells(rng, 400), [c for c in cells(rng, 120) if c[4].month in (2, 3)]
    source = f"{tmp_path}/cells"

    def land(rows):
        spark.createDataFrame(rows, CELLS).coalesce(1).write.mode("append").partitionBy("part").parquet(source)

    def same(rows):
        df = spark.createDataFrame(rows, CELLS)
        want = region_daily_mean(df, {"v": 10.0}, BOXES)
        have = sums.means("day")
        assert sorted(map(str, have.select("region", "date", "mean_v", "n_cells").collect())) == sorted(map(str, want.select("region", "date", "mean_v", "n_cells").collect()))
        month = region_daily_mean(df.withColumn("date", F.trunc("date", "month")), {"v": 10.0}, BOXES)
        assert sorted(map(str, sums.means("month").select("region", "date", "mean_v", "n_cells").collect())) == sorted(map(str, month.select("region", "date", "mean_v", "n_cells").collect()))

    sums = RegionPartials(spark, source, f"{tmp_path}/sums", {"v": 10.0}, BOXES, part="part")
    land(first)
    assert sums.refresh() == 4 and sums.refresh() == 0
    same(first)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "sums" / "partials").rglob("*.parquet")}
    land(late)
    assert sums.refresh() == 2
    same(first + late)
    untouched = {p for p in before if "2024-01" in str(p) or "2024-04" in str(p)}
    assert untouched and all(p.exists() and p.stat().st_mtime_ns == before[p] for p in untouched)
    # A partition written anew, and one whose cells are now all elsewhere, in another session.
    again = RegionPartials(spark, source, f"{tmp_path}/sums", {"v": 10.0}, BOXES, part="part")
    away = [(dt.date(2024, 4, 3), 80.0, 0.0, 5.0, dt.date(2024, 4, 1))]
    spark.createDataFrame(away, CELLS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(source)
    assert again.refresh() == 1
    same([c for c in first + late if c[4].month != 4])
    whole = {r.region: r.n_cells for r in again.means("all").collect()}
    assert sum(whole.values()) == sum(r.n_cells for r in again.means("year").collect())


def test_nothing_stored(spark, tmp_path):
    spark.createDataFrame([], CELLS).write.partitionBy("part").parquet(f"{tmp_path}/cells")
    spark.createDataFrame(cells(random.Random(1), 5), CELLS).write.mode("append").partitionBy("part").parquet(f"{tmp_path}/cells")
    sums = RegionPartials(spark, f"{tmp_path}/cells", f"{tmp_path}/sums", {"v": 1.0}, BOXES, part="part")
    assert sums.means().count() == 0 and sums.refresh() > 0
