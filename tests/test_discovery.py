"""Discovery of the files that an audit reads, on a folder."""

import pytest

from girder.sources import extract

FILES = {
    "src/a.py": b"x = 1\ny = 2\n",
    "src/latin.py": "# sch\xf6n\n".encode("latin-1"),
    "src/empty.ts": b"",
    "src/.hidden.jsx": b"a",
    "src/__init__.py": b"a = 1",
    "src/.py": b"no extension, a name",
    "src/b.bin": b"\0",
    "src/c.py": b"a\0b",
    "src/late.py": b"a" * 1024 + b"\0",
    "src/min.js": b"x" * 8000,
    "src/nearly.js": b"x" * 7999 + b"\n" + b"y" * 9000,
    "src/wide.mjs": "ä".encode() * 7999,
    "src/UP.GO": b"package a",
    "a b/é.tsx": b"1\r\n2",
    "manage.py": b"import os\n",
    "web/Pipfile": b"[x]",
    "web/package.json": b"{}",
    "web/other.json": b"{}",
    "node_modules/d.js": b"y",
    "x/build/package.json": b"{}",
    "builder/e.js": b"y",
    "large.py": b"x\n" * 3_000_000,
}
# Spark's reader passes over empty files and names that begin with a dot or an underscore
WANT = {
    "src/a.py": ("PYTHON", 3, False), "src/latin.py": ("PYTHON", 2, False), "src/late.py": ("PYTHON", 1, False), "src/nearly.js": ("JAVASCRIPT", 2, False),
    "src/wide.mjs": ("JAVASCRIPT", 1, False), "src/UP.GO": ("GO", 1, False), "a b/é.tsx": ("TYPESCRIPT", 2, False), "manage.py": ("PYTHON", 2, True), "web/Pipfile": (None, None, True), "web/package.json": (None, None, True), "builder/e.js": ("JAVASCRIPT", 1, False),
}


def test_folder(spark, tmp_path):
    root = tmp_path / "build"  # what lies above the root excludes nothing
    for name, data in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    found = extract.discover(spark, str(root))
    rows = {r["relative_path"]: r for r in found.drop("content").collect()}
    assert {k: (r["language"], r["line_count"], r["is_manifest"]) for k, r in rows.items()} == WANT
    assert all(r["is_source"] == (r["language"] is not None) and r["size_bytes"] == len(FILES[k]) for k, r in rows.items())
    assert found.where("relative_path = 'src/latin.py'").first()["content"] == "# sch�n\n"
    assert extract.discover(spark, str(root), most_files=len(FILES)).count() == len(WANT)
    with pytest.raises(ValueError, match="more than 10"):
        extract.discover(spark, str(root), most_files=10)


def test_listing_with_nulls_and_more_columns(spark):
    df = spark.createDataFrame([("a.py", 0, None, "x"), (".b.jsx", 1, b"a", "v"), (".py", 1, b"a", "v"), ("p/__init__.py", 1, b"a", "u"), (None, 3, b"abc", "y"), ("b.js", None, b"c", "z"), ("package.json", None, None, "w")], "relative_path string, size_bytes long, content binary, text string")
    got = sorted((r["relative_path"], r["is_source"], r["content"], r["text"]) for r in extract.catalogued(df).collect())
    assert got == [(".b.jsx", True, "a", "v"), ("a.py", True, "", "x"), ("p/__init__.py", True, "a", "u"), ("package.json", False, None, "w")]
    assert extract.catalogued(df.limit(0)).count() == 0
