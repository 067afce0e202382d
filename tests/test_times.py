from pyspark.sql import functions as F

from colweave.functions import timeparse

VALUES = ["2031-03-12", "2031-3-1", " 2031-03-12 10:11:12 ", "2031-03-12T10:11:12Z", "+2031-03-12", "T10:11-01:00", "2031/03/12 10:11:12",
          "2031/03/12", "03/12/2031 10:11:12", "03/12/2031 10:11", "03/12/2031", "31/12/2031", "12-Mar-2031", "12 Mar 2031", "20310312",
          "+20310312", "203103121", "1500000000", "hello", "a-b", "1-b", "12/x", "", "-", "٣-03", "2031", "12 march 2031", "99/99/9999",
          "x" * 100, "2031-03-12" + " " * 20, "\t2031-03-12", "12-mar-2031", "0012-01-01"]


def test_shapes_leave_out_no_time(spark):
    """A layout that is skipped for a value's shape would not have read it."""
    df = spark.createDataFrame([(v,) for v in VALUES], "value string")
    text = F.col("value")
    plain = [F.when(text.contains("-"), F.try_to_timestamp(text))] + [F.try_to_timestamp(text, F.lit(x)) for x in timeparse.LAYOUTS]
    for r in df.select("value", F.array(*plain).alias("want"), F.array(*timeparse.parse_attempts(text)).alias("got"),
                       timeparse.may_be_time(text).alias("shaped")).collect():
        assert r["got"] == r["want"], r["value"]
        assert r["shaped"] or not any(r["want"]), r["value"]
