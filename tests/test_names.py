import math
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from packwright import functions as P
from packwright.sources.readers import human_size


def evaluate(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_sanitize_name(spark):
    cases = {
        "My Resource!": "my_resource", "Test@123#ABC": "test123abc", "20_mw+": "20_mw",
        ".test.name.": "test.name", None: "resource", "": "resource", "@#$%": "resource",
        "test (with) parentheses": "test_with_parentheses", "valid-name": "valid-name",
    }
    got = evaluate(spark, P.sanitize_name, list(cases))
    assert got == list(cases.values())
    assert evaluate(spark, P.sanitize_name, got) == got


def test_check_resource_name(spark):
    got = evaluate(spark, P.check_resource_name, ["   ", "ok-name", "Bad Name!", None, "end\n"])
    assert [tuple(r) for r in got] == [
        (False, "   ", "___"), (True, "ok-name", None), (False, "Bad Name!", "bad_name"),
        (False, "", "resource"), (True, "end\n", None)]
    fixed = evaluate(spark, lambda c: P.check_resource_name(c, auto_fix=True), ["Bad Name!", ""])
    assert [tuple(r) for r in fixed] == [(False, "bad_name", None), (False, "resource", None)]


def test_package_name_version_url(spark):
    got = evaluate(spark, P.package_name_check, [".hidden", "my-data_1.0", "Upper", "", None, "x."])
    assert [r.ok for r in got] == [False, True, False, False, False, False]
    assert "dot" in got[0].message and "lowercase" in got[2].message and "required" in got[3].message
    got = evaluate(spark, P.version_check, ["1.0.0", "1.2.3-beta", "1.0", "v1.0.0", "", None])
    assert [r.ok for r in got] == [True, True, False, False, True, True]
    got = evaluate(spark, P.url_check, ["http://a.b", "https://a.b", "ftp://example.com", "", None])
    assert [r.ok for r in got] == [True, True, False, True, True]


def test_queries(spark):
    cases = {
        "location/city": "location city", "amount\\per\\unit": "amount per unit",
        "data@2024": "data 2024", "valid-name_123": "valid-name_123",
        "  multiple   spaces  ": "multiple spaces", "special!@#$%chars": "special chars",
        "Größe (m²)": "Größe m²", "a b\tc": "a b c", "été/½": "été ½",
    }
    assert evaluate(spark, P.clean_query, list(cases)) == list(cases.values())
    words = {"two words": "two", "one": "one", "   leading spaces": "", "": "", None: ""}
    assert evaluate(spark, P.first_word, list(words)) == list(words.values())
    got = evaluate(spark, lambda c: P.query_check(c, F.lit(" EN")), ["carbon"])
    assert not got[0].ok  # three characters before trimming
    got = evaluate(spark, lambda c: P.query_check(c, F.lit("EN")),
                   ["carbon ", "", "   ", "x" * 500, "x" * 501])
    assert [r.ok for r in got] == [True, False, False, True, False]
    assert (got[0].query, got[0].language) == ("carbon", "en")


def test_identifiers(spark):
    iris = ["https://v.org/Geo names/A*~+b", "https://v.org/x/y/z", "urn:a", "https://v.org", ""]
    got = evaluate(spark, lambda c: P.concept_web_url(c, "https://w.org/"), iris)
    assert got == ["https://w.org/web/concept/" + quote(i, safe="") for i in iris]

    def scheme(iri):
        parts = iri.split("/")
        if len(parts) >= 5 and parts[2] == "v.org":
            return "/".join(parts[:4]) + "/"
        return "/".join(parts[:3]) + "/" if len(parts) >= 3 else iri

    assert evaluate(spark, lambda c: P.concept_scheme(c, "v.org"), iris) == [scheme(i) for i in iris]
    assert evaluate(spark, P.iri_tail, iris) == [i.split("/")[-1] for i in iris]


def test_file_names(spark):
    files = ["in/data.v1.xlsx", "data", ".hidden", "a/b/name.csv"]
    got = evaluate(spark, lambda c: P.dataset_name(c, F.lit("Sheet 1")), files)
    assert got == ["data.v1_Sheet_1", "data_Sheet_1", ".hidden_Sheet_1", "name_Sheet_1"]
    got = evaluate(spark, lambda c: P.config_filename(F.lit("mapping"), F.lit(None).cast("string"),
                                                      c, F.lit("Sheet 1")), ["data.xlsx", None])
    assert got == ["data_Sheet_1_mapping_config.json", "config_mapping_config.json"]
    got = evaluate(spark, lambda c: P.config_filename(F.lit("metadata"), F.lit("my-dataset"), c,
                                                      F.lit("S")), ["data.xlsx"])
    assert got == ["my-dataset_metadata_config.json"]


@pytest.mark.parametrize("text,name", [
    ("12", "int"), ("-3", "int"), ("1.5", "float"), ("1e3", "float"), (".5", "float"),
    ("true", "bool"), ("FALSE", "bool"), ("2024-01-02", "date"), ("2024-01-02T03:04:05Z", "datetime"),
    ("2024-01-02 03:04", "datetime"), ("abc", "str"), ("", "str"), ("1-2", "str"), (None, None),
])
def test_value_type(spark, text, name):
    assert evaluate(spark, P.value_type, [text]) == [name]


def test_variant_value_type(spark):
    texts = ["1", "1.5", '"s"', "true", "[1]", '{"a":1}', "null", None]
    got = evaluate(spark, lambda c: P.variant_value_type(F.parse_json(c)), texts)
    assert got == ["int", "float", "str", "bool", "list", "dict", None, None]


def test_human_size(spark):
    sizes = [10.0, 2048.0, 3.0 * 1024**2, 5.5 * 1024**3]
    assert evaluate(spark, human_size, sizes, "double") == ["10.0 B", "2.0 KB", "3.0 MB", "5.5 GB"]
    assert not math.isnan(sizes[0])
