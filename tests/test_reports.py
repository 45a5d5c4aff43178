"""Reports written by tasks as one document: each format read by a parser of its own, odd findings, failed and repeated tasks."""

import io
import json
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from girder.plans.ordered import placed
from girder.plans.scratch import Scratch
from girder.sources import report
from tests.test_engine import FINDINGS, finding

ODD = ["plain.py", "=1+1", "a<b>&\"'", "é漢😀.py", "back\\slash (x)", "tab\there", "", "bell\x07", None]


@pytest.fixture(scope="module")
def findings(spark):
    rows = [finding(i, rule=f"R{i % 3}", severity=("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")[i % 5], line=i % 11, path=ODD[i % len(ODD)], snippet=f"s{i}\n\"q\"") for i in range(400)]
    return spark.createDataFrame(rows, FINDINGS).repartition(5).cache()


def order(f):
    return [r.asDict() for r in f.orderBy("file_path", "line", F.coalesce("col", F.lit(0)), "rule_id", "input_pos").collect()]


def made(f, kind, tmp_path, **options):
    at = tmp_path / f"report.{kind}"
    report.write(f, kind, str(at), **options)
    assert [x.name for x in tmp_path.iterdir()] == [at.name]
    return at.read_bytes()


def test_sarif_gitlab_and_cyclonedx_are_json(findings, tmp_path):
    want = order(findings)
    results = json.loads(made(findings, "sarif", tmp_path / "1" if (tmp_path / "1").mkdir() is None else tmp_path))["runs"][0]["results"]
    assert [(x["ruleId"], x["message"]["text"]) for x in results] == [(x["rule_id"], x["snippet"]) for x in want]
    (tmp_path / "2").mkdir()
    assert [x["fingerprint"] for x in json.loads(made(findings, "gitlab", tmp_path / "2"))] == [x["id"] for x in want]
    (tmp_path / "3").mkdir()
    assert [x["id"] for x in json.loads(made(findings, "cyclonedx", tmp_path / "3"))["vulnerabilities"]] == [x["id"] for x in want]


def test_html_and_junit(findings, tmp_path):
    page = made(findings, "html", tmp_path / "1" if (tmp_path / "1").mkdir() is None else tmp_path).decode()
    assert page.count("<tr>") == 400 and "a&lt;b&gt;&amp;" in page
    (tmp_path / "2").mkdir()
    suite = ET.fromstring(made(findings, "junit", tmp_path / "2"))
    cases, want = suite.findall("testcase"), order(findings)
    failed = [x["severity"] in ("CRITICAL", "HIGH") for x in want]
    assert (int(suite.get("tests")), int(suite.get("failures"))) == (400, sum(failed)) and [c.find("failure") is not None for c in cases] == failed
    assert [c.get("name") for c in cases] == [f"{x['rule_id']} {(x['file_path'] or '').replace(chr(7), '')}:{x['line']}" for x in want]


@pytest.mark.parametrize("rows", [None, 41])
def test_excel(findings, tmp_path, rows):
    book = zipfile.ZipFile(io.BytesIO(made(findings, "excel", tmp_path, sheet_rows=rows)))
    assert book.testzip() is None
    ns = {"m": f"{report._NS}/spreadsheetml/2006/main"}
    names = [s.get("name") for s in ET.fromstring(book.read("xl/workbook.xml")).find("m:sheets", ns)]
    sheets = {n: ET.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")) for k, n in enumerate(names, 1)}
    assert [n for n in names if not re.search(r" \d+$", n)] == ["Summary", "Findings", "By rule", "By file", "Remediation"]
    if rows:
        assert "Findings 10" in sheets and max(len(s.findall("m:sheetData/m:row", ns)) for s in sheets.values()) <= rows
    got = sorted(["".join(c.itertext()) for c in r] for n in names if n.startswith("Findings") for r in sheets[n].findall("m:sheetData/m:row", ns)[1:])
    safe = lambda p: "'" + p if p[:1] in ("=", "+", "-", "@", "\t") and p else p.replace("\x07", "")
    assert got == sorted([x["severity"], x["rule_id"], safe(x["file_path"] or ""), str(x["line"])] for x in order(findings))


def test_pdf(findings, tmp_path):
    data = made(findings, "pdf", tmp_path)
    at = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", data)[1])
    table = re.match(rb"xref\n0 (\d+)\n((?:\d{10} \d{5} [nf] \n)+)trailer", data[at:])
    offsets = [int(x[:10]) for x in re.findall(rb"\d{10} \d{5} [nf] \n", table[2])]
    assert len(offsets) == int(table[1]) == 4 + 2 * 9
    assert all(data[o:].startswith(b"%d 0 obj\n" % k) for k, o in enumerate(offsets) if k)
    assert re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[([^]]*)\]", data)[1]) == [b"%d" % (4 + 2 * i) for i in range(9)]
    for m in re.finditer(rb"/Length (\d+) >>\nstream\n", data):
        assert data[m.end() + int(m[1]) :].startswith(b"\nendstream")
    assert data.count(b") Tj T*") == 400 and b"back\\\\slash \\(x\\)" in data


def test_every_finding_of_many(spark, tmp_path):
    n = 10_050
    f = spark.createDataFrame([finding(i, severity="LOW" if i < 20 else "HIGH", path=f"p{i:05}") for i in range(n)], FINDINGS)
    (tmp_path / "1").mkdir()
    said = made(f, "junit", tmp_path / "1").decode()
    assert f'tests="{n}" failures="{n - 20}"' in said and said.count("<failure") == n - 20 and said.count("<testcase ") == n
    (tmp_path / "2").mkdir()
    assert [int(x) for x in re.findall(r"<td>p(\d+):", made(f, "html", tmp_path / "2").decode())] == list(range(n))


@pytest.mark.parametrize("kind", sorted(report.FORMATS))
def test_no_findings(findings, tmp_path, kind):
    data = made(findings.where("false"), kind, tmp_path)
    if kind in ("sarif", "gitlab", "cyclonedx"):
        json.loads(data)
    elif kind == "junit":
        assert ET.fromstring(data).find("testcase").get("name") == "clean"
    elif kind == "excel":
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    elif kind == "pdf":
        assert b"no findings" in data


def test_a_failed_task_leaves_nothing_and_no_name(findings, spark, tmp_path):
    spark.dataSource.register(report.Report)
    at = str(tmp_path / "r.txt")
    pieces = spark.range(100).select(F.lit(0).alias("entry"), (F.col("id") * 3).alias("at"), F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"abc")).alias("data"))
    with pytest.raises(Exception, match="lost"):
        report.put(pieces, at, 300)
    whole = spark.range(100).select(F.lit(0).alias("entry"), (F.col("id") * 3).alias("at"), F.lit(b"abc").alias("data"))
    with pytest.raises(Exception, match="300 bytes were written where 303 belong"):
        report.put(whole, at, 303)
    assert list(tmp_path.iterdir()) == []
    report.put(whole, at, 300)
    assert (tmp_path / "r.txt").read_bytes() == b"abc" * 100


def test_a_repeated_attempt_writes_the_same(tmp_path):
    import pyarrow as pa

    w = report.ReportWriter(str(tmp_path / "x"), "j", 10, [])
    batch = pa.record_batch([pa.array([0, 0], pa.int32()), pa.array([0, 6]), pa.array([b"abcdef", b"ghij"])], ["entry", "at", "data"])
    first, again = w.write(iter([batch])), w.write(iter([batch]))
    assert first == again
    w.commit([first])
    assert (tmp_path / "x").read_bytes() == b"abcdefghij"


@pytest.mark.parametrize("n", [0, 1, 7, 70_000])
def test_checksums_are_combined(n):
    a, b = b"some bytes before", bytes(range(256)) * (n // 256) + b"z" * (n % 256)
    assert report.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_places_and_running_sums(spark):
    """Against a sequential scan, with groups of one key, null keys and rows that the order doesn't tell apart."""
    rows = [(None if i % 7 == 0 else f"g{i % 3}", i * i % 13, i) for i in range(500)] + [("g0", 5, 1)] * 300
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(7)
    for by in ([], ["g"]):
        got = [tuple(r) for r in placed(df, Scratch(spark, "t"), "t", ["o", F.col("v").desc()], by, ["v"]).collect()]
        groups = {}
        for r in got:
            groups.setdefault(r[0] if by else 0, []).append(r)
        for k, mine in groups.items():
            mine.sort(key=lambda r: r[3])
            want = sorted((r for r in rows if not by or r[0] == k), key=lambda r: (r[1], -r[2]))
            total, sums = 0, []
            for r in want:
                total += r[2]
                sums.append(total)
            assert [r[3] for r in mine] == list(range(len(want))) and [r[1:3] for r in mine] == [r[1:3] for r in want] and [r[4] for r in mine] == sums
