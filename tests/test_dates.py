import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.functions import dates

CASES = [
    ("DATE", "2020-02-03", "2020-02-03 00:00:00"), ("DATE", "2020-02-03 and more", "2020-02-03 00:00:00"), ("DATE", "2020-13-31", "2021-01-31 00:00:00"), ("DATE", "2021-04-31", "2021-05-01 00:00:00"), ("DATE", "20-1-1", "0020-01-01 00:00:00"),
    ("DATE", "x", None), ("DATE", None, None), ("SHORTDATE", "20200203", "2020-02-03 00:00:00"), ("DATETIME", "20200203-040506", "2020-02-03 04:05:06"), ("DATETIMEMS", "20200203-040506.007", "2020-02-03 04:05:06.007"),
    ("UNREADABLEDATETIME", "20200203040506", "2020-02-03 04:05:06"), ("DATETIME_AS_FOLDERNAME", "20200203_040506", "2020-02-03 04:05:06"), ("READABLEDATETIME", "2020-02-03 04:05:06", "2020-02-03 04:05:06"),
    ("DAYFIRSTDATE", "03-02-2020", "2020-02-03 00:00:00"), ("DMY_HM", "03-02-2020 04:05", "2020-02-03 04:05:00"), ("SHORT_TIME", "04:05", "1970-01-01 04:05:00"), ("TIME", "25:00:01", "1970-01-02 01:00:01"),
    ("XMLDATETIME", "2020-02-03T04:05:06Z", "2020-02-03 04:05:06"), ("FULLXMLDATETIME", "2020-02-03T04:05:06.007+01:00", "2020-02-03 03:05:06.007"), ("FULLXMLDATETIME", "2020-02-03T04:05:06", None), ("JAVAFULLXMLDATETIME", "2020-02-03T04:05:06.007+0100", "2020-02-03 03:05:06.007"),
]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Brussels"])
def test_named_patterns(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for name, text, want in CASES:
            if zone != "UTC" and ("+01" in (text or "") or want and want < "1900"):
                continue
            got = spark.range(1).select(dates.parse(F.lit(text).cast("string"), name).cast("string").alias("t")).first()["t"]
            assert got == want, (name, text, got)
        one = spark.range(1).select(F.lit("2020-07-03 04:05:06.007").cast("timestamp").alias("t"))
        shown = one.select(*[dates.format(F.col("t"), n).alias(n) for n in dates.FORMATS], dates.format_ms(F.col("t"), ".").alias("ms"), dates.format_xsd(F.col("t")).alias("xsd"), dates.format(F.lit(None).cast("timestamp"), "DATE").alias("none")).first()
        offset = "Z" if zone == "UTC" else "+02:00"
        assert (shown["DATETIMEMS"], shown["DMY_HM"], shown["ms"], shown["none"], shown["xsd"]) == ("20200703-040506.007", "03-07-2020 04:05", "20200703-040506.007", "", "2020-07-03T04:05:06.007" + offset)
        back = one.select("t", *[dates.parse(dates.format(F.col("t"), n), n).alias(n) for n in ("DATETIMEMS", "FULLXMLDATETIME", "JAVAFULLXMLDATETIME")], dates.parse_xsd(dates.format_xsd(F.col("t"))).alias("x")).first()
        assert len(set(back)) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_xsd_mandatory_and_durations(spark):
    one = spark.range(1)
    for text, want in (("2020-02-03T04:05:06Z", 6), ("2020-02-03T04:05:06.1Z", 6), ("2020-02-03T05:05:06.123+01:00", 6), ("2020-02-03T04:05Z", 0), ("2020-02-03T04:05:06", 6)):
        got = one.select(dates.parse_xsd(F.lit(text)).cast("string").alias("t")).first()["t"]
        assert dt.datetime.fromisoformat(got).replace(microsecond=0) == dt.datetime(2020, 2, 3, 4, 5, want), text
    assert one.select(dates.parse_trimmed_date(F.lit("2020-02-03T99")).cast("string").alias("t")).first()["t"] == "2020-02-03 00:00:00"
    assert one.select(dates.parse_trimmed_date(F.lit("2020-2")).alias("t")).first()["t"] is None
    for bad in (dates.parse_xsd(F.lit("soon")), dates.parse_mandatory(F.lit("soon"), "DATE"), dates.parse_mandatory(F.lit(None).cast("string"), "DATE")):
        with pytest.raises(Exception, match="no date|can't be read"):
            one.select(bad).collect()
    assert [r[0] for r in spark.createDataFrame([(0,), (3_723_004,), (360_000_000,)], "ms long").select(dates.duration(F.col("ms"))).collect()] == ["00:00:00:0", "01:02:03:4", "100:00:00:0"]
