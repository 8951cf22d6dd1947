from tessera.operators import indexing as D
from tessera.operators import listing as L
from tests.fixtures import KEYS, keys


def brute_folders(ks):
    out = set()
    for k in ks:
        if k.endswith("/"):
            out.add(k)
        elif "/" in k:
            out.add(k.rsplit("/", 1)[0] + "/")
    return sorted(out)


def test_folders_files_lines(spark):
    k = keys(spark)
    assert [r.folder for r in L.folders(k).collect()] == brute_folders(KEYS) == ["a/", "a/b/"]
    assert [r.file for r in L.files(k).collect()] == sorted(x for x in KEYS if not x.endswith("/"))
    lines = [r.line for r in L.listing_lines(k).orderBy("part", "sort_key").collect()]
    assert lines[:3] == ["Folders:", "  - a/", "  - a/b/"]
    assert lines[3] == "\nFiles:" and lines.count("  - a/b/c.txt") == 2


def test_supported_extensions(spark):
    st = {r.key: r.status for r in L.supported_files(keys(spark)).collect()}
    assert st["a/b/d.PDF"] == "Supported" and st["a/x.bin"] == "Skipped" and st["root.txt"] == "Supported"


def test_decode_and_blank(spark):
    rows = [("ok", "héllo wörld".encode()), ("bad", bytes([0x61, 0xFF, 0x62])),
            ("blank", b" \n\t "), ("empty", b"")]
    df = spark.createDataFrame(rows, "key string, content binary")
    dec = {r.key: r.text for r in D.decode_text(df).collect()}
    assert dec == {"ok": "héllo wörld", "bad": "ab", "blank": " \n\t ", "empty": ""}
    kept = [r.key for r in D.non_empty(D.decode_text(df)).collect()]
    assert kept == ["ok", "bad"]


def test_decode_equals_python_on_random_bytes(spark):
    import random
    rnd = random.Random(3)
    parts = [b"a", b"1", b"0", "\ufffd".encode(), "\ufffe".encode(), b"\xff", b"\xe2\x82", b"\xc3", "é😀".encode(), b"\xed\xa0\x80",
             b"\xf4\x90\x80\x80", b"\xc0\xaf", b" "]
    rows = [(i, b"".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))) for i in range(400)]
    df = spark.createDataFrame([*rows, (-1, None)], "id int, content binary")
    got = {r.id: r.text for r in D.decode_text(df).collect()}
    assert got == {i: b.decode("utf-8", "ignore") for i, b in rows} | {-1: None}


def test_url_keys(spark):
    pages = spark.createDataFrame([("https://a.example.com/en/1.html?x=1#t",), ("http://b.org/de/2/",)], "url string")
    assert [r.key for r in L.keys_from_urls(pages).collect()] == ["a.example.com/en/1.html", "b.org/de/2/"]
