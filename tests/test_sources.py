import pytest
import datetime as dt
import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import convert
from quire.sources import readers, sinks
from quire.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_files_and_notes(spark, tmp_path):
    write(f"{tmp_path}/n/a.md", "---\ntitle: \"T\"\n---\n# Olá\ncorpo")
    write(f"{tmp_path}/n/sub/inf_12.md", "ação".encode("cp1252"))
    write(f"{tmp_path}/n/sub/u16.md", "ação".encode("utf-16"))
    got = {r.name: r for r in readers.text_corpus(spark, f"{tmp_path}/n", [("bulletin", "^inf_")]).collect()}
    assert got["inf_12.md"].text == "ação" and got["inf_12.md"].family == "bulletin" and got["u16.md"].text == "ação" and got["a.md"].family is None
    assert {r.name: r.meta for r in readers.notes(spark, f"{tmp_path}/n").collect()}["a.md"] == {"title": "T"}
    assert readers.binary_files(spark, f"{tmp_path}/n", "*.md").count() == 3
    ins = spark.createDataFrame([("a", 5), ("b", 5), ("c.tmp", 5), ("~$d", 5)], "name string, modified int")
    outs = spark.createDataFrame([("a", 6), ("b", 4)], "name string, modified int")
    assert rows(readers.triage(ins, outs), "name") == [("b",)]
    assert readers.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/n"]) == f"{tmp_path}/n"


def test_json_sources(spark, tmp_path):
    write(f"{tmp_path}/a.json", json.dumps([{"numero": 1, "t": "old"}, {"numero": 2, "t": "x"}]))
    write(f"{tmp_path}/b.json", json.dumps({"fonte": "f", "total": 1, "itens": [{"numeroTema": 1, "texto": "new"}]}))
    got = readers.keyed_last_wins(spark, [f"{tmp_path}/a.json", f"{tmp_path}/b.json"], ["numero", "numeroTema"], ["t", "texto"])
    assert rows(got, "key", "body") == [("1", "new"), ("2", "x")]
    write(f"{tmp_path}/log.jsonl", '{"ts": "2024", "cost": 1.5}\nbroken{\n{"ts": "2025", "cost": null}\n')
    assert rows(readers.json_lines(spark, f"{tmp_path}/log.jsonl", "ts string, cost double"), "ts", "cost") == [("2024", 1.5), ("2025", None)]
    write(f"{tmp_path}/cases.json", json.dumps([{"id": "a"}, {"id": "b", "ativo": False}, {"id": "c", "ativo": True}]))
    assert rows(readers.cases(spark, f"{tmp_path}/cases.json"), "id") == [("a",), ("c",)]
    assert rows(readers.cases(spark, f"{tmp_path}/cases.json", ["c"]), "id") == [("c",)]
    assert readers.tsv(spark, f"{tmp_path}/none.tsv", "a int, b string").count() == 0
    write(f"{tmp_path}/ids.txt", "# all\n12 # gone\n\n13\n")
    assert rows(readers.id_list(spark, f"{tmp_path}/ids.txt"), "id") == [("12",), ("13",)]
    write(f"{tmp_path}/urls.txt", "http://x/y/rtj_101_2.pdf\nhttp://x/y/rtj_7.pdf\n")
    assert rows(readers.volume_urls(spark, f"{tmp_path}/urls.txt"), "volume", "part") == [(101, 2), (7, None)]


def test_landed_markup(spark):
    xml = spark.createDataFrame([("<?xml version='1'?><r><termo><nome>A & B</nome><NE>n\x01ota</NE><TG>C</TG><TR>D</TR></termo><termo><nome>E</nome></termo></r>",)], "x string")
    assert rows(readers.thesaurus(xml, "x"), "term", "note", "kind", "target") == [("A & B", "nota", "TG", "C"), ("A & B", "nota", "TR", "D"), ("E", "", None, None)]
    html = spark.createDataFrame([('<a href="/p/1">One <b>x</b></a><a href="http://o/2">Two</a><a href="/p/1">One again</a><a href="/e"></a>',)], "h string")
    assert sorted(r.url for r in readers.listing(html, "h", "http://b").collect()) == ["http://b/p/1", "http://o/2"]


def test_paged_source(spark, tmp_path):
    for p in (1, 3):
        write(f"{tmp_path}/page-{p}.json", json.dumps([{"p": p, "i": i} for i in range(2)]))
    spark.dataSource.register(readers.PagedListing)
    df = spark.read.format("paged_listing").option("path", str(tmp_path)).option("pages", 3).option("per_partition", 2).load()
    assert df.count() == 4 and df.rdd.getNumPartitions() == 2
    assert rows(df.select(F.get_json_object("record", "$.p").alias("p")).distinct(), "p") == [("1",), ("3",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|c", "x"), (1, None, "y")], "id int, t string, c string")
    sinks.tsv(df.coalesce(1), f"{tmp_path}/t", ["id", "t"], ["id"])
    text = "".join(open(f"{tmp_path}/t/{f}").read() for f in sorted(os.listdir(f"{tmp_path}/t")) if f.startswith("part"))
    assert text.splitlines()[0] == "id\tt" and text.index("1\t") < text.index("2\t")
    assert sinks.csv_with_mark(df, f"{tmp_path}/c") and not sinks.csv_with_mark(df.limit(0), f"{tmp_path}/none") and not os.path.exists(f"{tmp_path}/none")
    lines = [r.line for r in sinks.markdown_table(df, ["id", "t"], ["id"]).orderBy("n").collect()]
    assert lines == ["| id | t |", "|---|---|", "| 1 | - |", "| 2 | b\\|c |"]
    turns = spark.createDataFrame([(0.0, 1.5, "A")], "s double, e double, w string")
    assert sinks.speaker_lines(turns, "f", "s", "e", "w").first().value == "SPEAKER f 1 0.000 1.500 <NA> <NA> A <NA> <NA>"
    head = spark.range(1).select(sinks.front_matter({"a": F.lit('x "y"'), "b": F.lit(None).cast("string")}).alias("h")).first().h
    assert head == "---\na: \"x 'y'\"\nb: null\n---\n"
    sinks.by_collection(df, f"{tmp_path}/ix", "c")
    sinks.by_collection(df.where("c = 'x'").withColumn("id", F.lit(9)), f"{tmp_path}/ix", "c")
    assert rows(spark.read.parquet(f"{tmp_path}/ix"), "id", "c") == [(1, "y"), (9, "x")]
    sinks.markdown_files(df, f"{tmp_path}/md", "c", F.concat(F.lit("# "), F.col("id").cast("string")))
    assert sorted(x for x in os.listdir(f"{tmp_path}/md") if x.startswith("c=")) == ["c=x", "c=y"]
    known, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int"), spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, v string, n int")
    assert rows(sinks.upsert(known, new, "k"), "k", "v", "n") == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    sinks.json_lines(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_html_and_unfolding(spark):
    html = "<html><head><script>var t='</p>';</script><title>T</title></head><body><h2>Título</h2><p>um&nbsp;dois &amp; três<br>quatro<ul><li>item</ul><table><tr><td>a<td>b</table></body>late"
    md = convert.markdown(html)
    assert "## Título" in md and "um dois & três" in md and "- item" in md and "a | b" in md and "var t" not in md and md.endswith("late")
    assert convert.unfold_lines("uma linha\nque segue.\nOutra-\nmente\n\n1. item\nfim") == "uma linha que segue.\nOutramente\n\n1. item fim"


def test_rtf_office_and_bytes():
    rtf = rb"{\rtf1\ansi\uc1{\fonttbl{\f0 Arial;}}{\*\generator x}Ol\'e1 \u231?\par dois\tab x{\pict\bin4 {}{}ff}\u-10179?\u8212?fim}"
    assert convert.rtf_text(rtf) == "Olá ç\ndois\tx\ufffd—fim"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>um</w:t><w:t> dois</w:t></w:p><w:p/><w:p><w:t>três</w:t></w:p></w:document>')
    assert convert.office_text(buffer.getvalue()) == "um dois\ntrês" and convert.office_text(b"nonsense") is None
    assert [convert.decode_bytes(x) for x in ("é".encode(), "é".encode("cp1252"), b"\x81\xe9", "é".encode("utf-16"))] == ["é", "é", "\x81é", "é"]


def test_pages_images_bins(spark):
    p = spark.createDataFrame([("x" * 100, "x" * 70, 0.0), ("stamp " * 5, "", 0.9), ("", "", 0.0), ("stamp only here, nothing more", "s", 0.1)], "t string, u string, c double")
    assert [r.s for r in p.select(convert.page_status(F.col("t"), F.col("u"), F.col("c")).alias("s")).collect()] == ["read", "unread", "empty", "stamp only"]
    img = spark.createDataFrame([("d", 1, "h", 40.0, 100.0), ("d", 2, "h", 80.0, 100.0), ("d", 2, "g", 80.0, 100.0)], "d string, p int, h string, a double, pa double")
    assert rows(convert.image_cover(img, ["d", "p"], "a", "pa"), "p", "image_cover") == [(1, 0.4), (2, 1.0)]
    assert rows(convert.furniture(img, "d", "p", "h", spark.createDataFrame([("d", 4)], "d string, n_pages int")), "h") == [("h",)]
    assert rows(convert.first_images(img.withColumn("content", F.encode("h", "utf-8")), "d", "content", ["p"]), "p", "h") == [(1, "h"), (2, "g")]
    hist = spark.createDataFrame([(1, b, 10 if b in (10, 11, 200, 201) else 0) for b in range(256)], "page int, bin int, n int")
    assert 11 <= convert.otsu(hist, ["page"]).first().threshold < 200
    parts = spark.createDataFrame([("f", i, s) for i, s in enumerate([5.0, 4.0, 3.0, 20.0, 1.0])], "f string, i int, s double")
    assert rows(convert.bins(parts, ["f"], "i", "s", 10.0), "i", "bin") == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4)]
    sampled = spark.createDataFrame([("d", True, False), ("d", False, True)], "d string, scan boolean, form boolean")
    assert convert.detect_profile(sampled, ["d"], [("form", F.col("form")), ("scan", F.col("scan"))]).first().profile == "form"


def test_tokens(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("CPF 123.456.789-0 (98) 99999-1234 José da Silva a@b.co".split())], "p int, n int, w string")
    got = {r.w: r.kind for r in convert.token_kinds(t, ["p"], "n", "w").collect()}
    assert got["123.456.789-0"] == "CPF" and got["(98)"] == "PHONE" and got["99999-1234"] == "PHONE" and got["a@b.co"] == "EMAIL" and got["José"] is None
    assert rows(convert.phrase_matches(t, ["p"], "n", "w", ["jose", "DA", "silva"]), "n") == [(4,)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    schema = "hash string, at timestamp, n int"
    at = dt.datetime(2024, 1, 1)
    first = [("a", at, 1), ("b", at, 2), ("a", at, 3), (None, at, 4)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    batch = incremental.unseen(spark.createDataFrame(first, schema), spark.createDataFrame([("b",)], "hash string"), "hash", ["n"])
    assert rows(batch, "hash", "n") == [("a", 1)]

    def run():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        keys = incremental.seen_key_stream(s.where("hash IS NOT NULL"), "hash", "at", "10 days").select("hash")
        keys.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"), "hash")

    assert run() == [("a",), ("b",)]
    spark.createDataFrame([("a", at, 5), ("c", at, 6)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    assert run() == [("a",), ("b",), ("c",)]  # state outlives the query


def test_windows_and_resumed_index(spark, tmp_path):
    schema = "k string, v string, c string"
    put = lambda folder, data: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{folder}")
    put(1, [("1", "a", "x"), ("2", "b", "x"), ("3", "c", "y")])

    def run(checkpoint="ck"):
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        incremental.resume_index(s, f"{tmp_path}/index", f"{tmp_path}/{checkpoint}", "k", "v").awaitTermination()
        return rows(incremental.current(spark, f"{tmp_path}/index", "k"), "k", "v", "c", "generation")

    assert run() == [("1", "a", "x", 0), ("2", "b", "x", 0), ("3", "c", "y", 0)]
    # A new version, a key that moves to another collection, a known version, a key that is repeated in the batch.
    put(2, [("2", "bb", "x"), ("3", "d", "x"), ("1", "a", "z"), ("4", "d", "x"), ("4", "e", "x"), (None, "n", "x")])
    # An attempt that died half-way has left something behind.
    spark.createDataFrame([("9", "z", "x", False)], schema + ", __gone boolean").write.parquet(f"{tmp_path}/index/generation=1")
    assert run() == [("1", "a", "x", 0), ("2", "bb", "x", 1), ("3", "d", "x", 1), ("4", "e", "x", 1)]
    # The same files read anew, as after a lost checkpoint, change nothing but come after what is there.
    again = run("other")
    assert [r[:3] for r in again] == [("1", "a", "x"), ("2", "bb", "x"), ("3", "d", "x"), ("4", "e", "x")]
    incremental.resync(spark, f"{tmp_path}/index", spark.createDataFrame([("1", "a", "x"), ("5", "f", "y")], schema), "k", "v", 9)
    assert rows(incremental.current(spark, f"{tmp_path}/index", "k"), "k", "v") == [("1", "a"), ("5", "f")]
    stages = spark.createDataFrame([("a", 5, 6), ("b", 7, 6), ("c", 1, None)], "s string, i int, o int")
    assert rows(incremental.stale(stages, "i", "o"), "s") == [("b",), ("c",)]
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "e") for m in (1, 2, 7)], "ts timestamp, k string")
    counted = incremental.windowed_counts(events, "ts", "1 minute", "5 minutes", ["k"])
    assert rows(counted, "n") == [(1,), (2,)]


def test_text_of_notes_has_a_hook(spark):
    assert spark.range(1).select(tx.first_useful_line(F.lit("---\n# T\n\n> q\nprimeira **linha**")).alias("h")).first().h == "primeira linha"


def test_listing_over_http(spark):
    """Pages come with a failure before them, one is missing, and the records lie below the root."""
    import http.server
    import json
    import threading

    from quire.sources import readers

    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.split("=")[1])
            seen[page] = seen.get(page, 0) + 1
            code = 503 if seen[page] == 1 else 404 if page == 3 else 200
            body = json.dumps({"itens": [{"id": page * 10 + i} for i in range(2)]}).encode() if code == 200 else b""
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(readers.HttpListing)
    read = lambda **more: spark.read.format("http_listing").options(url=f"http://127.0.0.1:{server.server_port}/list?page={{page}}", field="itens", wait="0.01", per_partition="2", **more).load()
    got = rows(read(pages="5"), "page", "record")
    assert got == [(p, json.dumps({"id": p * 10 + i})) for p in (1, 2, 4, 5) for i in range(2)]
    seen.clear()
    with pytest.raises(Exception, match="503"):
        read(pages="1", tries="1").collect()
    server.shutdown()


def test_pdf_text_layers():
    import zlib

    from quire.operators import pdf
    from quire.plans.files import _pdf

    assert pdf.read_pages(_pdf(["a (b) \\ c\nsecond", "", "três"], True)) == (["a (b) \\ c\nsecond", "", "três"], None)
    # Fonts with a map from codes to text, kerning as spaces, hexadecimal strings, objects inside a stream of objects.
    codes = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00E7> endbfchar 1 beginbfrange <41> <43> <0061> endbfrange"
    inner = [(5, b"<< /Type /Pages /Kids [7 0 R] /Count 1 >>"), (7, b"<< /Type /Page /Parent 5 0 R /Resources << /Font << /F1 8 0 R >> >> /Contents [9 0 R 10 0 R] >>")]
    bodies = b" ".join(b for _, b in inner)
    head = b"5 0 7 %d " % (len(inner[0][1]) + 1)
    packed = zlib.compress(head + bodies)
    parts = {
        1: b"<< /Type /Catalog /Pages 5 0 R >>", 2: b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(head), packed), 8: b"<< /Type /Font /ToUnicode 11 0 R >>",
        9: b"<< >>\nstream\nBT /F1 9 Tf [(A) -20 (B) -300 <4301>] TJ T* (C) ' ET\nendstream", 10: b"<< /Filter /DCTDecode >>\nstream\nxx\nendstream", 11: b"<< >>\nstream\n" + codes + b"\nendstream",
    }
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in parts.items())
    assert pdf.read_pages(data) == (["ab cç\nc"], None)
    assert pdf.read_pages(None) == ([], "no file") and pdf.read_pages(b"x")[1] == "not a PDF file" and pdf.read_pages(b"%PDF-1.4 /Encrypt 3 0 R")[1] == "encrypted"


def test_deliveries_stop_when_a_target_is_full(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(10)], "k long, v string").coalesce(1).sortWithinPartitions("k")

    def send(record):
        if record["k"] == 2:
            raise OSError
        if record["k"] >= 5:
            raise MemoryError

    log = f"{tmp_path}/log"
    assert rows(sinks.deliver(df, "k", send, log), "k", "outcome") == [(k, "failed" if k == 2 else "sent" if k < 5 else "stopped") for k in range(10)]
    again = sinks.deliver(df, "k", lambda record: None, log)
    assert again.where("outcome = 'sent'").count() == 10 and again.groupBy("k").count().where("count > 2").count() == 0


def test_locks(spark, tmp_path):
    from quire.sources import scratch

    path = f"{tmp_path}/lock"
    assert scratch.lock(spark, path, "a", 60) and not scratch.lock(spark, path, "b", 60)
    assert scratch.lock(spark, path, "b", -1) and not scratch.unlock(spark, path, "a") and scratch.unlock(spark, path, "b")
    assert scratch.lock(spark, path, "c", 60)
