import datetime

from pyspark.sql import functions as F

from gridloom.functions import dates as D
from gridloom.functions import geo as G
from gridloom.functions import text as T


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_codes(spark):
    assert one(spark, ["7", "7.0", "a12b", "1234", None, "x"], lambda c: T.pad_code(c, 3)) == ["007", "007", "012", "1234", None, None]
    assert one(spark, ["7", "1a2b3c4", None], lambda c: T.last_digits(c, 3)) == ["007", "234", None]
    assert one(spark, ["/a/b/dia123x9.txt"], T.station_id) == ["00123"]
    assert one(spark, [" 12.0 ", "a b", ""], T.identifier) == ["12", "ab", None]


def test_numbers(spark):
    assert one(spark, ["1,5", "3.2 ha", "x", None, "-"], T.clean_number) == [1.5, 3.2, None, None, None]
    assert one(spark, ["1,5", "Nulo", "-9999", "99.99", "7"], T.number_or_null) == [1.5, None, None, None, 7.0]
    assert one(spark, ["0.5", "1.5", "2.5", "x"], T.rounded_int) == [0, 2, 2, None]
    assert one(spark, ["1,234", "1 234.5"], T.thousands) == [1234.0, 1234.5]
    assert one(spark, ["Nulo", "-9999", "3,5", "a"], T.token_class) == ["text_sentinel", "numeric_sentinel", "numeric", "other"]


def test_text(spark):
    assert one(spark, ["Árbol Ñandú", None], T.strip_accents) == ["Arbol Nandu", None]
    assert one(spark, ["  D.F. ", "--"], lambda c: T.text_key(c, {"d f": "ciudad de mexico"})) == ["ciudad de mexico", None]
    assert one(spark, ["MÃ©xico", "MÃƒÂ©xico", "México", "Ã"], T.repair_mojibake) == ["México", "México", "México", "Ã"]
    assert one(spark, ["NIÃ‘O", "â€œsÃ­â€\x9d", None, "ÃƒÆ’Ã‚Â±"], T.repair_mojibake) == ["NIÑO", "“sí”", None, "ñ"]
    assert T.unique_names(["Año", "año ", "Á-B", ""]) == ["ano", "ano_2", "a_b", "column"]
    assert T.find_column(["Fecha inicio", "x"], ["fecha"], partial=True) == "Fecha inicio"
    assert one(spark, ["a\tb\x00 c", " "], T.printable) == ["a b c", None]


def test_dates(spark):
    d = datetime.date
    got = one(spark, ["3/4/2015", "2015-4-3 10:00:00", "42097", "42097.75", "03-04-2015", "20150403", "-1", "31/02/2015", "99999999", "", None], D.registry_date)
    assert got == [d(2015, 4, 3)] * 6 + [d(1899, 12, 29)] + [None] * 4
    assert one(spark, ["20150403", "2015/4/3", "3-4-2015", "x"], D.file_date) == [d(2015, 4, 3)] * 3 + [None]
    assert one(spark, ["930", "2460", "9:05", "7", "25:00", None], D.clock) == ["09:30", None, "09:05", "00:07", None, None]
    assert one(spark, ["2 days, 03:04:05", "5:07", "1:2:3", "x", "1 day, 0:00:00", "5;07", "01:02:03.500", "2 days, 3:4:5.25", "2 days, 3:04", "1:60"], D.duration) == ["51:04:05", "05:07:00", "01:02:03", None, "24:00:00", "05:07:00", "01:02:03", "51:04:05", None, None]
    assert one(spark, ["inv_2015-2020.csv", "a2009b", "none"], D.cycle_of) == ["2015_2020", "2009", None]


def test_geo(spark):
    rings = "array<array<struct<x:double,y:double>>>"
    square = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.5, 0.5)]]
    df = spark.createDataFrame([(square, 1.5, 1.5), (square, 0.7, 0.7), (square, 2.0, 1.0), (square, 3.0, 1.0)], f"r {rings}, x double, y double")
    assert [r[0] for r in df.select(G.inside(F.col("r"), F.col("x"), F.col("y"))).collect()] == [True, False, False, False]
    assert df.select(G.polygon_area(F.col("r"))).first()[0] == 3.75
    assert spark.range(1).select(G.dms(F.lit(-20.0), F.lit(30.0), F.lit(0.0)), G.dms(F.lit(100.0), F.lit(30.0), F.lit(36.0), west=True)).first()[:] == (-20.5, -100.51)
