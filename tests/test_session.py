from twinweave.session import draw, drawn


def test_draw_at_any_size(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    some = draw(df, 200, "k")
    assert len(some) == 200 and draw(df, 200, "k") == some
    # as if the table were far larger: the bound is raised until rows come
    assert draw(df, 200, "k", rows=10**11) == some and draw(df, 200, "k", rows=10**20) == some
    assert draw(df.repartition(7), 200, "k") == some
    assert len(draw(df, 5000, "k")) == 3000 and draw(df.where("k < 0"), 10, "k") == []


def test_draw_repeated_and_null(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (1,)], "k bigint")
    assert len(draw(df, 10, "k")) == 4 and len(draw(df, 2, "k")) == 2


def test_drawn_at_any_size(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    assert drawn(df, 5000, "k").count() == 3000 and drawn(df.where("k < 0"), 10, "k").count() == 0
    assert 120 < drawn(df, 200, "k").count() < 300
    assert drawn(df, 200, "k", rows=10**11).count() >= 100
