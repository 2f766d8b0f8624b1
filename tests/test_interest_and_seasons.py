import datetime as dt

import pytest
from pyspark.sql import functions as F

from termloom.fixed_values import MONTH_LABELS
from termloom.functions.calendar import season_of_month
from termloom.operators.interest import monthly_average, unpivot_interest
from termloom.operators.numbering import assign_batches, numbered
from termloom.operators.seasons import monthly_matrix, season_average, season_summary
from termloom.plans.seasonality import export_scores, interest_requests, store_monthly_scores
from termloom.session import settings
from termloom.sinks import months
from termloom.sinks.tables import append_scores
from termloom.sources.interest import read_interest, read_interest_lines
from termloom.sources.tables import read_scores


def test_season_of_month(column):
    found = column([1, 3, 4, 12, 0, 13, -1], season_of_month(F.col("v")), "int")
    assert found == ["saison_cyclonique"] * 2 + ["haute_saison"] * 5


@pytest.fixture
def scores(spark):
    year = [11, 13, 14, 51, 52, 63, 64, 71, 66, 53, 41, 22]
    rows = [("ile", m, float(v), m) for m, v in enumerate(year, start=1)]
    rows += [("mer", 5, 2.67, 1), ("mer", 5, 2.68, 2), ("mer", 5, 1.0, 0)]
    return spark.createDataFrame(rows, "keyword string, month int, interest_score double, ord long")


def test_season_average_has_no_row_for_an_absent_season(scores):
    found = {(r.keyword, r.season): r.score for r in season_average(scores).collect()}
    assert found == {
        ("ile", "saison_cyclonique"): round(38 / 3, 2), ("ile", "haute_saison"): round(483 / 9, 2),
        ("mer", "haute_saison"): round(6.35 / 3, 2),
    }


def test_season_mean_is_over_rows_and_rounds_the_binary_value(scores):
    [row] = season_summary(scores.where("keyword = 'mer' and ord > 0")).collect()
    assert (row.haute_saison, row.saison_cyclonique) == (round((2.67 + 2.68) / 2, 2), 0.0) == (2.67, 0.0)


def test_month_matrix_takes_the_last_score_and_fills_zero(scores):
    rows = {r.keyword: r for r in monthly_matrix(scores).collect()}
    assert rows["mer"].Mai == 2.68 and rows["mer"].Jan == 0.0
    assert [rows["ile"][m] for m in MONTH_LABELS] == [11, 13, 14, 51, 52, 63, 64, 71, 66, 53, 41, 22]


def series(spark, tmp_path, name="wide"):
    days = [dt.datetime(y, m, 1) for y in (2023, 2024) for m in (1, 2, 3)]
    rows = [(d, n * 10, float(n) if n != 4 else None, n == 5) for n, d in enumerate(days)]
    wide = spark.createDataFrame(rows, "date timestamp_ntz, `nosy be` int, `a.b` double, isPartial boolean")
    path = str(tmp_path / name)
    wide.write.parquet(path)
    return read_interest(spark, path)


def test_unpivot_drops_the_flag_but_not_partial_rows(spark, tmp_path):
    long = series(spark, tmp_path)
    assert long.columns == ["date", "batch", "keyword", "value"] and long.count() == 12
    assert {r.keyword for r in long.collect()} == {"nosy be", "a.b"}


def test_unpivot_without_flag_or_rows(spark):
    wide = spark.createDataFrame([], "date timestamp, x double")
    assert unpivot_interest(wide).count() == 0


def test_monthly_average_over_years_skips_missing(spark, tmp_path):
    means = monthly_average(series(spark, tmp_path), ["keyword"])
    found = {(r.keyword, r.month): r.interest_score for r in means.collect()}
    assert found == {
        ("nosy be", 1): 15.0, ("nosy be", 2): 25.0, ("nosy be", 3): 35.0,
        ("a.b", 1): 1.5, ("a.b", 2): 1.0, ("a.b", 3): 3.5,
    }


def test_later_batch_replaces_the_whole_keyword(spark):
    rows = [("k", 1, "2024-01-01", 1.0), ("k", 1, "2024-02-01", 2.0), ("k", 2, "2024-01-01", 9.0)]
    rows += [("j", 1, "2024-03-01", 3.0)]
    long = spark.createDataFrame(rows, "keyword string, batch int, date string, value double").withColumn(
        "date", F.to_date("date")
    )
    found = monthly_average(long, ["keyword"], batch="batch").collect()
    assert sorted(tuple(r) for r in found) == [("j", 3, 3.0), ("k", 1, 9.0)]


def test_scores_add_up_and_worldwide_is_a_market(spark, tmp_path):
    table, folder = str(tmp_path / "scores"), str(tmp_path / "out")
    schema = "keyword string, month int, interest_score double"
    for geo in ("", "FR", ""):
        append_scores(spark.createDataFrame([("k", 1, 10.0 + len(geo)), ("k", 4, 55.0)], schema), table, geo)
    assert read_scores(spark, table).count() == 4 and read_scores(spark, table, "FR").count() == 2
    assert {r.geo for r in read_scores(spark, table, "").collect()} == {""}
    assert read_scores(spark, table, "DE").count() == 0
    export_scores(spark, table, folder)
    [row] = spark.read.csv(f"{folder}/seasonality_summary_monde", header=True).collect()
    assert tuple(row) == ("k", "55.0", "10.0")
    [row] = spark.read.csv(f"{folder}/seasonality_monthly_monde", header=True).collect()
    assert (row["Jan"], row["Avr"], row["Déc"]) == ("10.0", "55.0", "0.0")


def test_series_to_stored_scores(spark, tmp_path):
    table = str(tmp_path / "scores")
    store_monthly_scores(series(spark, tmp_path), table, "FR")
    assert read_scores(spark, table, "FR").count() == 6


def test_last_appended_score_wins(spark, tmp_path):
    table = str(tmp_path / "scores")
    for score in (1.0, 7.0, 3.0):
        rows = spark.createDataFrame([("k", 1, score)], "keyword string, month int, interest_score double")
        append_scores(rows, table)
    assert monthly_matrix(read_scores(spark, table)).first()["Jan"] == 3.0


@pytest.mark.parametrize("stride", [1, 11, 1 << 20])
def test_numbers_are_consecutive_per_group_for_any_gaps(spark, stride):
    rows = [((None, "hot", "cold")[n % 3], n * 11 % 997 * stride) for n in range(300)]
    df = spark.createDataFrame(rows, "g string, id long")
    found = {(r.g, r.id): r.row_no for r in numbered(df, ["g"], "id").collect()}
    assert len(found) == 300
    for group in ("hot", "cold", None):
        ids = sorted(i for g, i in rows if g == group)
        assert [found[group, i] for i in ids] == list(range(len(ids)))


def test_batches_of_different_columns(spark, tmp_path):
    landed = str(tmp_path / "landed")
    spark.sql("select date'2024-01-01' as date, 1.0 as a, 2.0 as b, false as isPartial").write.parquet(f"{landed}/batch=0")
    spark.sql("select date'2024-01-01' as date, 5.0 as b, 3.0 as c, false as isPartial").write.parquet(f"{landed}/batch=1")
    rows = read_interest(spark, landed)
    assert {(r.batch, r.keyword, r.value) for r in rows.collect()} == {(0, "a", 1.0), (0, "b", 2.0), (1, "b", 5.0), (1, "c", 3.0)}
    means = monthly_average(rows, ["keyword"], batch="batch").collect()
    assert {(r.keyword, r.interest_score) for r in means} == {("a", 1.0), ("b", 5.0), ("c", 3.0)}


def test_scores_of_several_markets_at_once(spark, tmp_path):
    table = str(tmp_path / "scores")
    rows = [("", "k", 1, 2.0), ("FR", "k", 1, 3.0)]
    append_scores(spark.createDataFrame(rows, "geo string, keyword string, month int, interest_score double"), table, None)
    assert [r.interest_score for r in read_scores(spark, table, "FR").collect()] == [3.0]
    assert [r.interest_score for r in read_scores(spark, table).collect()] == [2.0]


def test_interest_requests_take_the_first_keywords(spark):
    rows = spark.createDataFrame([(n * 7, f"k{n}") for n in range(9)], "id long, keyword string")
    asked = {r.keyword: r.batch for r in interest_requests(rows, 7).collect()}
    assert asked == {f"k{n}": n // 5 for n in range(7)}


def test_batches_of_five(spark):
    df = spark.createDataFrame([("en", n) for n in range(7)] + [("fr", 3)], "lang string, id long")
    found = {(r.lang, r.id): r.batch for r in assign_batches(df, ["lang"]).collect()}
    assert [found["en", n] for n in range(7)] == [0, 0, 0, 0, 0, 1, 1] and found["fr", 3] == 0


def test_landed_lines_unfold_in_one_scan(spark, tmp_path):
    for batch, lines in {
        0: ['{"date": "2024-01-01", "a": 1, "b": 2.5, "isPartial": false}', "[1]", "broken", '{"date": "2024-02-01", "a": 7, "o\\"dd.name": 3}'],
        2: ['{"date": "2024-01-08 00:00:00", "a": null, "c": "text", "isPartial": true}'],
        10: ['{"date": "2024-01-15", "b": 4}', '{"date": "2024-01-22", "b": 5}'],
    }.items():
        folder = tmp_path / f"batch={batch}"
        folder.mkdir()
        (folder / "lines.json").write_text("\n".join(lines) + "\n")
    long = read_interest_lines(spark, str(tmp_path))
    rows = {(r.date.month, r.batch, r.keyword, r.value) for r in long.where("date is not null").collect()}
    assert rows == {
        (1, 0, "a", 1.0), (1, 0, "b", 2.5), (2, 0, "a", 7.0), (2, 0, 'o"dd.name', 3.0), (1, 2, "a", None), (1, 2, "c", None),
        (1, 10, "b", 4.0), (1, 10, "b", 5.0),
    }
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and "Exchange" not in plan
    means = {(r.keyword, r.month): r.interest_score for r in monthly_average(long, ["keyword"], batch="batch").collect()}
    # the later batch of a holds a missing value only, and replaces the earlier one whole
    assert means == {("a", 1): None, ("b", 1): 4.5, ("c", 1): None, ('o"dd.name', 2): 3.0}


def test_months_add_up_over_appends_and_snapshots(spark, tmp_path):
    table, rows = str(tmp_path / "months"), []
    schema = "keyword string, geo string, month int, interest_score double, ord long"
    assert months.read_months(spark, table).count() == 0
    for number in range(9):
        own = [(f"k{i % 3}", ["", "FR", None][i % 2 * (1 + number % 2)], i % 4 + 1, [i * 1.25 + number, None, float("nan")][i % 7 // 5], i) for i in range(40)]
        rows += [(number, *x) for x in own]
        frame = spark.createDataFrame(own, schema)
        months.merge_scores(frame, table, geo=None, compact_after=4)
        folders = months._folders(spark, table)
        assert len(months._current(folders)) <= 5 and len(folders["append"]) <= 8
    assert len(folders["snapshot"]) == 2 and min(folders["append"]) > 3  # what the first snapshot was made of is gone
    # a write that broke off counts for nothing, and its number is taken again
    broken = tmp_path / "months" / "append-9" / "market=FR"
    broken.mkdir(parents=True)
    frame.limit(1).write.mode("overwrite").parquet(str(broken / "part"))
    wanted = {}
    for number, keyword, geo, month, score, ord_ in sorted(rows, key=lambda x: (x[0], x[5])):
        entry = wanted.setdefault((keyword, geo or "", month), [0, 0.0, None])
        if score is not None and score == score:
            entry[0], entry[1], entry[2] = entry[0] + 1, entry[1] + score, score

    def found(geo=None):
        return {(x.keyword, x.geo, x.month): [x.n, x.interest_score, x.last_score] for x in months.read_months(spark, table, geo).collect()}

    means = {k: [n, round(total / n, 2) if n else None, last] for k, (n, total, last) in wanted.items()}
    assert found() == means
    assert found("") == {k: v for k, v in means.items() if k[1] == ""}
    months.merge_scores(frame.limit(0), table, geo=None)
    months.compact_months(spark, table)
    months.compact_months(spark, table)
    assert found("FR") == {k: v for k, v in means.items() if k[1] == "FR"} and len(months._current(months._folders(spark, table))) == 1


def test_series_are_not_dealt_out_by_keyword(spark, tmp_path):
    """A batch has few keywords, so the rows of one would be a task's."""
    landed = str(tmp_path / "landed")
    rows = spark.range(20).select(F.current_date().alias("date"), F.col("id").cast("double").alias("w"), F.lit(False).alias("isPartial"))
    rows.write.parquet(f"{landed}/batch=0")
    rows.select("date", F.lit(None).cast("double").alias("w"), F.col("w").alias("v"), "isPartial").write.parquet(f"{landed}/batch=1")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        series = read_interest(spark, landed)
        plan = series._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        found = {(r.batch, r.keyword): r["count"] for r in series.groupBy("batch", "keyword").count().collect()}
    assert found == {(0, "w"): 20, (1, "v"): 20}
