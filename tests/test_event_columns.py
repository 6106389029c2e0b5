"""Events keep their other columns on the way to their bins, and a repeated row counts once for itself."""

from kinetrace.operators import align


def test_columns_go_along_and_rows_do_not_multiply(spark):
    axis = spark.createDataFrame([(0, 5.0), (1, 15.0)], "t_ds long, sample double")
    events = spark.createDataFrame([(1, "a", 4.0), (1, "a", 4.0), (2, "b", 14.0)], "event_id long, event_type string, at double")
    bins = align.nearest_bins(events, axis, least=0)
    assert sorted(map(tuple, bins.select("event_id", "event_type", "t_ds").collect())) == [(1, "a", 0), (1, "a", 0), (2, "b", 1)]
    factor = spark.createDataFrame([(i, 0, float(i)) for i in range(3)], "idx long, r int, value double")
    rows = sorted(map(tuple, align.around_events(factor, bins, 1, 2, (), ("event_type",)).collect()))
    a = [(1, "a", 0, rel, float(rel)) for rel in (0, 0, 1, 1)]
    assert rows == a + [(2, "b", 0, rel, float(1 + rel)) for rel in (-1, 0, 1)]
