import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import urls
from leadloom.functions.json_text import indented
from leadloom.operators import verdicts

KIND = "s string, n long, b boolean, x double, l array<string>, d struct<a:array<struct<k:string,v:int>>,m:map<string,array<long>>,e:array<int>>, none struct<y:int>"
ROWS = [
    ('q " back \\ line\nreturn\rtab\tbell\x07 high\x1f del\x7f é 😀 / <a>', -5, True, 0.5, ["a", "", None, "ü"], {"a": [{"k": "x", "v": 1}, {"k": None, "v": None}, None], "m": {"b\n": [1, 2]}, "e": []}, {"y": 1}),
    ("", 0, False, 12345678.0, [], {"a": [], "m": {}, "e": [1]}, None),
    (None, None, None, None, None, None, None),
    ("\x00", 2**63 - 1, None, 1e16, ["\\"], {"a": None, "m": None, "e": None}, {"y": None}),
]


@pytest.mark.parametrize("indent", [1, 2, 4])
def test_nested_json(spark, indent):
    schema = T._parse_datatype_string(KIND)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ROWS)], T.StructType([T.StructField("i", T.LongType()), T.StructField("r", schema)])).orderBy("i")
    got = [r[0] for r in df.select(indented(F.col("r"), schema, indent=indent)).collect()]
    assert got == [json.dumps(dict(zip(schema.names, r)), ensure_ascii=False, indent=indent) for r in ROWS]


def test_doubles_as_json(spark):
    values = [0.0, -0.0, 1.0, -2.5, 0.1, 0.001, 0.00025, 0.0001, 0.00001, 1.5e-7, 1e7, 1.25e9, 123456789012345.0, 9999999999999998.0, 1e16, 1.5e17, -3e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").orderBy("i")
    assert [r[0] for r in df.select(indented(F.col("v"), T.DoubleType())).collect()] == [json.dumps(v) for v in values]


def test_types_without_json(spark):
    with pytest.raises(TypeError):
        indented(F.lit(b""), T.BinaryType())


SIGNALS = "page_id long, generator_meta_tag string, generator_fingerprint string, build_tool_phrases array<string>, trend_fonts array<string>, visual_patterns array<string>, style_phrases array<string>, style_density string, disclosures array<string>, repo_url string"
CHECK = "struct<repo_url:string,checked:boolean,evidence:struct<total_commits_seen:long,first_commit_message:string,single_commit_repo:boolean>,error:string>"


def test_signals_as_json(spark):
    facts = [("u", True, (3, 'fix "it"', False), None), ("u", True, (0, None, None), None), ("u", False, (None, None, None), "status 403"), None]
    rows = [(i, None, "v0", ["built"], [], ["a", "b"], [], "none", [], "u", c) for i, c in enumerate(facts)]
    df = spark.createDataFrame(rows, f"{SIGNALS}, repo_check {CHECK}")
    out = verdicts.signals_json(df)
    assert out.columns == [*df.columns, "signals_json"]
    names = ("total_commits_seen", "first_commit_message", "single_commit_repo")
    for r in out.collect():
        c = facts[r.page_id]
        check = c and {"repo_url": c[0], "checked": c[1], "evidence": {k: v for k, v in zip(names, c[2]) if v is not None}, "error": c[3]}
        own = {"generator_fingerprint": "v0", "vibe_language_matches": ["built"], "trend_fonts_found": [], "visual_patterns_triggered": ["a", "b"], "generator_meta_tag": None}
        own |= {"github_repo_url": "u", "ai_style_phrases_found": [], "ai_style_phrase_density": "none", "ai_authorship_disclosures_found": [], "github_check": check}
        assert r.signals_json == json.dumps(own, ensure_ascii=False, indent=2)


def test_stored_signals_as_json(spark):
    df = spark.createDataFrame([(7, None, None, [], ["Geist"], [], [], "none", [], None)], SIGNALS).withColumns({"id": F.lit(9), "lead_id": F.col("page_id"), "session_id": F.lit(2), "computed_at": F.lit("2024-01-02")})
    got = json.loads(verdicts.signals_json(df, stored=True).first().signals_json)
    assert list(got)[:3] == ["id", "session_id", "lead_id"] and list(got)[-1] == "computed_at" and got["github_check"] is None
    assert (got["id"], got["session_id"], got["lead_id"], got["trend_fonts_found"], got["computed_at"]) == (9, 2, 7, ["Geist"], "2024-01-02")
    assert verdicts.signals_json(df.where("false")).count() == 0


def test_links_are_resolved(spark):
    pages = ["https://h.io", "https://h.io/", "https://h.io/a", "https://h.io/a/b", "https://h.io/a/b/", "http://h.io/a/b?x=/c/d#f"]
    links = ["x", "/x", "//c.d/x", "../y", "../../y", "../../../y", "./z", ".", "..", "a/../b/./c?u=/../v#../w", "?q=1", "#top", "mailto:a@b.c", "https://o.p/../k", "/a/../../b", "x/..", "..x/y.", "/a/b/."]
    rows = [(p, x) for p in pages for x in links]
    got = spark.createDataFrame(rows, "p string, x string").select("p", "x", urls.absolute(F.col("x"), F.col("p")).alias("u")).collect()
    assert len(got) == len(rows)
    bad = [(r.p, r.x, r.u, urljoin(r.p, r.x)) for r in got if r.u != urljoin(r.p, r.x) and not (r.x.startswith("https://"))]
    assert not bad
    assert all(r.u == r.x for r in got if r.x.startswith("https://"))
