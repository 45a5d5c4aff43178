"""WARC archives, the prefix trie and the fill-in-middle transformation against brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
import zstandard

from girder.llm import op11_warc as op11
from girder.llm import op12_prefix_trie as op12
from girder.llm import op13_fim as op13
from girder.llm.common import Scratch

PAGES = "page_id long, url string, html string, id int, payload string, record_type string, __all string, __first int"
TURNS = "conv_id long, turn long, role string, text string, depth int, digest string, n string, pos string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# op11


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "y", "z", 2) for i, u, h in rows], PAGES)


def brute_pages(rows):
    top = defaultdict(list)
    for i, _, h in rows:
        top[h or ""].append(i)
    out = []
    for h, ids in top.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        first = ids[-1]
        for k, i in enumerate(ids):
            revisit = len(h.encode()) >= 1000 and k < len(ids) - 1
            out.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def archived(spark, rows, **options):
    scratch = Scratch(spark, "test-op11")
    op11.write(pages(spark, rows).repartition(3), f"{scratch.path}/a", **options)
    return scratch.path + "/a"


def resolved(spark, folder):
    return sorted((tuple(r) for r in op11.resolved(op11.read(spark, folder)).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_op11_round_trip(spark):
    r = random.Random(5)
    body = ["".join(r.choice("abcdé <>\r\n") for _ in range(n)) for n in (0, 1, 400, 999, 1000, 1001, 5000, 40_000)]
    rows = [(i, f"https://h{i % 3}.org/a b\r\nX: {i}", r.choice(body)) for i in range(120)]
    rows += [(7, "u", body[6]), (500, None, body[6]), (500, None, body[6]), (500, "v", body[6]), (None, "n", body[7]), (None, None, None), (901, "z", None), (902, "", "x" * 999), (903, "", "é" * 500), (904, "", "é" * 500)]
    folder = archived(spark, rows)
    assert resolved(spark, folder) == brute_pages(rows)
    whole = op11.read(spark, folder, payloads=True).where("record_type = 'response'").select("id", "payload").collect()
    kept = {(i, (h or "").encode()) for i, _, h in rows}
    assert {(x["id"], bytes(x["payload"])) for x in whole} <= kept and {bytes(x["payload"]) for x in whole} == {p for _, p in kept}


def test_op11_only_ids_that_are_null_tie(spark):
    rows = [(None, None, "q" * 2000)] * 4
    assert resolved(spark, archived(spark, rows)) == brute_pages(rows)


def test_op11_no_rows(spark):
    assert resolved(spark, archived(spark, [])) == []


def test_op11_a_dictionary_leads_and_records_stand_alone(spark):
    """Any record is read from its offset with the dictionary of the first frame, and the dictionary pays."""
    boiler = "<html><head><meta charset='utf-8'><title>Page</title><link rel='stylesheet' href='/static/main.css'></head><body><div class='content'>"
    rows = [(i, f"https://x.org/{i}", boiler + sha(str(i)) * 12 + "</div></body></html>") for i in range(400)]
    folder = archived(spark, rows)
    fs, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
    index = op11.read(spark, folder).collect()
    assert len(index) == 400
    for name in {x["archive"] for x in index}:
        data = fs.open_input_stream(f"{root}/{name}").read()
        assert int.from_bytes(data[:4], "little") == op11.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        by = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        mine = [x for x in index if x["archive"] == name]
        for x in mine:
            fields, block = op11.parsed(by.decompress(data[x["offset"] : x["offset"] + x["length"]]))
            assert fields["x-row-id"] == str(x["id"]) and block.endswith(rows[x["id"]][2].encode())
        plain = zstandard.ZstdCompressor(level=op11.LEVEL)
        alone = sum(len(plain.compress(by.decompress(data[x["offset"] : x["offset"] + x["length"]]))) for x in mine)
        assert sum(x["length"] for x in mine) < 0.9 * alone


def test_op11_archives_are_closed_at_their_size_and_appended(spark):
    rows = [(i, None, sha(str(i)) * 40) for i in range(300)]
    folder = archived(spark, rows, file_bytes=20_000, sample_bytes=10_000)
    names = {x["archive"] for x in op11.read(spark, folder).collect()}
    assert len(names) > 3
    op11.write(pages(spark, [(1000, None, "more")]), folder)
    assert op11.read(spark, folder).count() == 301


def test_op11_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "a")
    op11.write(pages(spark, [(1, None, "x")]), folder)
    before = sorted(x.name for x in tmp_path.joinpath("a").iterdir())
    bad = op11.with_types(pages(spark, [(i, None, sha(str(i)) * 99) for i in range(50)]), Scratch(spark, "test-op11"))
    with pytest.raises(Exception):
        bad.withColumn("payload_digest", F.when(F.col("id") == 49, F.lit("no hex")).otherwise(F.col("payload_digest"))).write.format("warczst").option("sampleBytes", 1000).mode("append").save(folder)
    assert sorted(x.name for x in tmp_path.joinpath("a").iterdir()) == before and op11.read(spark, folder).count() == 1


def test_op11_reader_refuses_what_was_changed(tmp_path):
    archive = op11.Archive(pa.fs.LocalFileSystem(), str(tmp_path), [op11.record("response", "urn:x", {"Content-Type": "application/http", "WARC-Payload-Digest": "sha1:" + "A" * 32}, op11.HTTP + b"y")])
    done = archive.close()
    with pytest.raises(ValueError, match="payload digest"):
        list(op11.indexed(pa.fs.LocalFileSystem(), f"{tmp_path}/{done['name']}", done["name"], False))
    data = tmp_path.joinpath(done["name"]).read_bytes()
    tmp_path.joinpath("cut").write_bytes(data[:-5])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(op11.indexed(pa.fs.LocalFileSystem(), f"{tmp_path}/cut", "cut", False))


# op12


def brute_trie(convs):
    """convs: id -> [(role, text)]; nodes as in the query's contract."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids[p]), sum(not kids[q] for q in below), saved, sha(ends)))
    return sorted(out)


def ordered(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [(x[2], x[3]) for x in sorted(v)] for c, v in by.items()}


def brute_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def turns(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "a", "b", "c") for c, t, r, x in rows], TURNS)


def nodes(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations(seed, n, most, words):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 700), n):
        for t in range(r.randint(0, most)):
            rows.append((c, t, r.choice(["user", "bot"]) if words > 2 else "user", r.choice(["", "é", "abc", "word " * 3][:words])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "most", "words"), [(1, 60, 6, 2), (2, 80, 9, 4), (3, 40, 25, 1)])
def test_op12_against_brute_force(spark, monkeypatch, seed, n, most, words):
    monkeypatch.setattr(op12, "BLOCK", 4)
    monkeypatch.setattr(op12, "PIECE_BYTES", 9)
    rows = conversations(seed, n, most, words)
    assert nodes(op12.conversation_trie(turns(spark, rows))) == brute_trie(ordered(rows))


def test_op12_rebuilt_against_brute_force(spark, monkeypatch):
    rows = conversations(7, 150, 8, 2) + [(0, 0, "user", "é"), (100, 0, "user", "abc"), (100, 1, "user", "é")]
    scratch = Scratch(spark, "test-op12")
    t = scratch.save(op12.ranked(turns(spark, rows), scratch), "turns")
    assert nodes(op12.trie(op12.rebuilt(t), t.select("conv_id"), scratch)) == brute_trie(brute_rebuilt(ordered(rows)))


def test_op12_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (9, None, "", ""), (11, 3, "user", "x" * 50_000), (12, 2, "user", "x" * 50_000), (13, 0, "us", "era"), (14, 0, "user", "a")]
    assert nodes(op12.conversation_trie(turns(spark, rows))) == brute_trie(ordered(rows))
    assert nodes(op12.conversation_trie(turns(spark, rows[:0]))) == []


def test_op12_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK", 16)
    monkeypatch.setattr(op12, "PIECE_BYTES", 64)
    rows = [(1, t, "user", f"t{t % 7}") for t in range(200)] + [(c, t, "user", f"t{t}") for c in range(2, 150) for t in range(3)] + [(200, t, "user", f"t{t % 7}") for t in range(120)] + [(201, 0, "user", "t0"), (201, 1, "bot", "t1")]
    assert nodes(op12.conversation_trie(turns(spark, rows))) == brute_trie(ordered(rows))


# op13


def brute_fim(doc_id, text, unit=lambda t: list(t)):
    t = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = unit(t)
    n = len(u)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def in_words(t):
    out = [""] if t else []
    for i, c in enumerate(t):
        if i and t[i - 1] in " \t\n\v\f\r" and c not in " \t\n\v\f\r":
            out.append("")
        out[-1] += c
    return out


def odd_texts():
    r = random.Random(9)
    texts = ["", None, "a", "é", "😀", "<P>", "a<M", "<S> in it", "é‍", "  two  words ", "\x00\n", "x" * 3_000_000] + ["".join(r.choice("aé漢😀 \n<>PSM") for _ in range(r.randint(1, 60))) for _ in range(400)]
    ids = [None, *range(1, len(texts))]
    return list(zip(ids, texts, strict=True)) + [(3, "twice"), (3, "twice")]


@pytest.mark.parametrize(("unit", "cut"), [("chars", list), ("words", in_words)])
def test_op13_against_brute_force(spark, unit, cut):
    from pyspark.sql import functions as F

    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "f", 3, "o") for i, t in rows], "doc_id long, text string, fim string, n int, output string")
    got = op13.fill_in_middle(df, unit=unit).select("doc_id", "fim.*", F.coalesce("text", F.lit("")).alias("t"), op13.restored(F.col("fim.output"), F.col("fim.form")).alias("back"), F.col("output").alias("kept")).collect()
    assert all(x["t"] == x["back"] and x["kept"] == "o" for x in got)
    assert sorted((tuple(x)[:6] for x in got), key=str) == sorted((brute_fim(i, t, cut) for i, t in rows), key=str)
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}


def test_op13_pieces_and_slices(monkeypatch):
    """The kernel over a sliced array, in pieces that end within code points and texts."""
    texts = [t or "" for _, t in odd_texts() if len(t or "") < 100]
    h = np.arange(len(texts)) * 7919
    whole = np.zeros(len(texts), bool)
    want = op13.cut(pa.array(texts), h, h * 31, whole)
    for size in (1, 3, 64):
        monkeypatch.setattr(op13, "PIECE", size)
        for kind in (pa.string(), pa.large_string()):
            padded = pa.array(["pad é", *texts, "end"], kind).slice(1, len(texts))
            got = op13.cut(padded, h, h * 31, whole)
            assert all(np.array_equal(a, b) for a, b in zip(got[:3], want[:3], strict=True))
            out = op13.dealt(padded, pa.array(["psm"] * len(texts)), got[3], got[4], ("<P>", "<S>", "<M>")).to_pylist()
            assert out == [f"<P>{t[:a]}<S>{t[a + m:]}<M>{t[a : a + m]}" for t, a, m in zip(texts, got[1].tolist(), got[2].tolist(), strict=True)]


def test_op13_no_rows(spark):
    assert op13.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        op13.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="lines")
