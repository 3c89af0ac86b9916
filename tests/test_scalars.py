"""Edge tables for the scalar functions (FIXTURES §3)."""

from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.functions import normalize_timestamp, safe_int, validate_hardware_id, is_py_infinity, safe_str
from vigil.functions.hardware import with_hardware_check


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_safe_int(spark):
    vals = [" 503 ", "4200.9", "-4200.9", "1e3", None, "N/A", "nan", "1d", "1_000", "inf"]
    assert _one(spark, vals, lambda c: safe_int(c, -1)) == [503, 4200, -4200, 1000, -1, -1, -1, -1, 1000, -1]
    assert _one(spark, ["inf", "-Infinity", "5"], is_py_infinity) == [True, True, False]


def test_safe_str(spark):
    assert _one(spark, ["  Operational  ", None, "   "], lambda c: safe_str(c, "D")) == ["Operational", "D", "D"]


def test_timestamp_sanity(spark):
    vals = ["2024-03-01T12:05:00Z", "2024-03-0", None, "xx 2024-03-01"]
    assert _one(spark, vals, normalize_timestamp) == ["2024-03-01T12:05:00Z", "UNKNOWN", "UNKNOWN", "xx 2024-03-01"]


HW = [
    ("U04tOTI4MA==", True, "SN-9280", None),
    ("U04tOTI4MA", True, "SN-9280", None),
    ("TUFMV0FSRV9DTUQ=", False, "MALWARE_CMD", "Malicious pattern detected: 'MALWARE' found in decoded hardware ID"),
    ("!!!INVALID_BASE64###", False, None, "Invalid Base64 format — contains illegal characters: !!!INVALID_BASE64###"),
    ("A===", False, None, "Base64 decode error: invalid padding or length"),
    ("QUJD====", False, None, "Base64 decode error: invalid padding or length"),
    ("/w==", False, None, "Decoded bytes are not valid UTF-8 — possible binary payload"),
    (None, False, None, "hardware_id_b64 is missing or null"),
    ("   ", False, None, "hardware_id_b64 is missing or null"),
]


def test_base64_column_and_frame_forms_agree(spark):
    df = spark.createDataFrame([(v,) for v, *_ in HW], "v string")
    col_form = [tuple(r) for r in df.select(validate_hardware_id("v").alias("h")).select("h.*").collect()]
    frame_form = [tuple(r) for r in with_hardware_check(df, "v", "h").select("h.*").collect()]
    expected = [(valid, dec, reason) for _, valid, dec, reason in HW]
    assert col_form == expected
    assert frame_form == expected


def test_strip_takes_all_white_space_of_unicode_and_nothing_else(spark):
    points = spark.range(0x110000).where("id < 55296 or id > 57343").selectExpr(
        "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    text = F.concat(F.col("c"), F.lit("a"), F.col("c"), F.lit("b "), F.col("c"), F.col("c"))
    both = points.select("c", scalars.py_strip(text).alias("got"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("want"))
    assert both.where("not got <=> want").count() == 0
    assert both.where("length(got) = 3 and c <> 'a'").count() == len(scalars.WHITE_SPACE) == 25


def test_infinite_numbers(spark):
    texts = ["inf", " -INF\t", "+Infinity", "iNfInItY", "infinit", "- inf", "++inf", "nan", "1e999", "ınf", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k for r in df.where(scalars.is_py_infinity("t")).collect()}
    assert got == {0, 1, 2, 3}


def test_no_span_relies_on_a_method_the_jvm_never_compiles(spark):
    from vigil.session import configure
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
