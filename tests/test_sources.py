"""Parser, charset chain, flattening, extraction, mailbox source and snapshots."""

import datetime
import email
import email.policy
import email.utils
import io
import zipfile
from email.message import EmailMessage

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import redact
from corpusloom.plans import catalogue
from corpusloom.sources import charsets, documents, mailbox, markup, messages, snapshots


def mail(body="Hallo Welt", *, ident="<a@x>", html=None, to="b@x", cc=None, bcc=None, date="Mon, 01 Jan 2024 10:00:00 +0200", files=(), subject="Re: x", encoding=None, boundary=None, **headers):
    m = EmailMessage()
    m["From"] = '"An, Na" <an@x>'
    for k, v in {"To": to, "Cc": cc, "Bcc": bcc, "Date": date, "Subject": subject, "Message-ID": ident, **headers}.items():
        if v is not None:
            m[k.replace("_", "-")] = v
    m.set_content(body, cte=encoding) if encoding else m.set_content(body)
    if html is not None:
        m.add_alternative(html, subtype="html")
    for name, data in files:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    if boundary and m.is_multipart():
        m.set_boundary(boundary)
    return m.as_bytes()


FILES = (("a.bin", b"1"), ("b.bin", b"2"))
SAME = [
    (mail(files=FILES, boundary="one"), mail(files=FILES, boundary="two")),
    (mail("Grüße " * 30, encoding="quoted-printable"), mail("Grüße " * 30, encoding="base64")),
    (mail(), mail(date="Mon, 01 Jan 2024 11:00:00 +0300")),
    (mail(files=FILES), mail(files=FILES[::-1])),
    (mail(), mail(bcc="z@x")),
    (mail(to="b@x, c@x"), mail(to="C@x, b@X")),
]
DIFFERENT = [
    (mail(), mail("other")),
    (mail(html="<p>a</p>"), mail(html="<p>b</p>")),
    (mail(), mail(to="c@x")),
    (mail(files=FILES[:1]), mail(files=(("c.bin", b"1"),))),
    (mail(files=FILES[:1]), mail(files=(("a.bin", b"3"),))),
    (mail(""), mail("", X_Trace="1")),
    (mail(), mail(date="Mon, 01 Jan 2024 10:00:01 +0200")),
]


@pytest.mark.parametrize("pair", SAME)
def test_copies_have_one_key(pair):
    assert len({messages.record(m)["dedup_key"] for m in pair}) == 1


@pytest.mark.parametrize("pair", DIFFERENT)
def test_different_mail_has_two_keys(pair):
    assert len({messages.record(m)["dedup_key"] for m in pair}) == 2


def test_record():
    r = messages.record(mail("see password = Zk3vQ9xT1mB7wR5y", cc="B <b@x>, b@x", List_Id="<l>", X_Api_Key="s", files=FILES[:1]), "AN@x ")
    assert (r["from_name"], r["from_address"], r["direction"], r["is_reply"], r["is_automated"], r["is_automated_origin"]) == ("An, Na", "an@x", "outbound", True, True, False)
    assert [(x["kind"], x["address"]) for x in r["recipients"]] == [("to", "b@x"), ("cc", "b@x")]
    assert r["body_text"] == "see password = [REDACTED:credential]" and r["secrets_redacted"] == 1 and r["word_count"] == 4
    assert "X-Api-Key" not in r["headers"] and r["headers"]["List-Id"] == ["<l>"]
    assert r["attachments"][0]["size_bytes"] == 1 and r["has_attachments"]
    assert messages.record(b"\xff\xfe\x00broken: =?x")["parse_status"] in ("parsed", "failed")
    assert messages.record(b"")["body_text"] == ""


SHOWN = ["a@x", "<a@x>", "A <a.b@x-y.z>,b@x", "Ann Lee <a@x>, b@x", '"B, c" <b@x>', '"B c" <b@x>', "xn--a+b_c@1.2", "a_1 b <+x@-a>, <b@x>,c@y"]
ODD = ["a@x,", "a @x", "A <a@x", "a@x;b@y", "G: a@x, b@y;", "a@x (c)", "=?utf-8?q?=C3=A9?= <a@x>", '"a\\"b" <a@x>', "A  B <a@x>", "é <a@x>", "<>", "a", "a..b@x", "A. B <a@x>", " , a@x", '"" <a@x>', "a@x b@y", "a@x,  b@y"]


@pytest.mark.parametrize("value", SHOWN + ODD)
@pytest.mark.parametrize("name", ["From", "to", "CC", "Sender"])
def test_plain_lists_of_addresses_are_read_as_by_the_library(name, value):
    message = email.message_from_bytes(f"{name}: {value}\r\n{name}: z@x\r\n\r\nx".encode(), policy=email.policy.default)
    assert (messages.plain_pairs(value) is not None) == (value in SHOWN)
    assert messages.header(message, name) == str(message.get(name))
    assert messages.pairs(message, name) == [p for p in email.utils.getaddresses([str(v) for v in message.get_all(name)]) if p[1]]


def test_parser_of_a_small_file_with_many_rows_is_several_tasks(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id as c_custkey", "'n' as c_name", "'m' as c_mktsegment")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows.coalesce(1).selectExpr("c_custkey as conv_id", "0L as turn", "'user' as role", "c_name as text").write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("parsed_headers", "parse_eml"):
        tasks = catalogue.QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(tasks) == 3 and max(r["count"] for r in tasks) < 2000


@pytest.mark.parametrize("name", ["charset_repair", "charset_coherence", "keyed_secrets"])
def test_texts_go_to_python_in_batches_bounded_by_bytes(name, spark, tmp_path):
    spark.range(500).selectExpr("id as doc_id", "repeat('größe', 5000) as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    catalogue.QUERIES[name](spark, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1)
    in_batch = F.pandas_udf(lambda texts: pd.Series([int(texts.str.len().sum())] * len(texts)), "long")
    assert docs.select(F.max(in_batch("text"))).first()[0] < 1 << 23
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 1 << 23 and sizes.count() > 1


@pytest.mark.parametrize("name, seen", [("keyed_secrets", "tail"), ("redact_full", "secrets")])
def test_masking_itself_gets_batches_bounded_by_bytes(name, seen, spark, tmp_path, monkeypatch):
    docs = spark.range(500).selectExpr("id as doc_id", "concat(repeat('größe', 5000), ' password: Zk3vQ9xT1mB7Zk') as text")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    def told(texts: pd.Series) -> pd.DataFrame:
        n = int(texts.str.len().sum())
        return pd.DataFrame({"text": [f"x . client_secret: {n}"] * len(texts), "count": [n] * len(texts)})

    monkeypatch.setattr(redact, "redact_secrets", F.pandas_udf(told, "text string, count int"))
    chars = [int(r[0]) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(seen).collect()]
    assert len(chars) == 500 and 25_000 < max(chars) < 1 << 23


def test_parse_in_spark(spark):
    raw = [mail(), mail(html="<p>x</p>"), b"", None]
    df = spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raw)], "i int, raw binary")
    rows = df.select("i", messages.parse(F.col("raw"), F.lit("an@x"), F.lit("2024-01-01 08:00:00").cast("timestamp")).alias("m")).orderBy("i").collect()
    assert [r["m"]["dedup_key"] for r in rows] == [messages.record(r or b"")["dedup_key"] for r in raw]
    assert rows[0]["m"]["sent_at"] == rows[0]["m"]["received_at"]


def test_charsets():
    russian = "Привет, это обычное письмо о встрече"
    assert charsets.decode(russian.encode("cp1251")) == russian
    assert charsets.decode(russian.encode(), "us-ascii") == russian
    german = "Grüße aus Österreich, für Käse und Öl größer übermäßig schön"
    assert charsets.decode(german.encode("cp1252"), "utf-8") == german
    assert charsets.decode("für".encode("cp1252"), "gb2312x") == "für"
    assert charsets.repair(russian.encode("cp1251").decode("cp1252")) == russian
    assert charsets.repair(german) == german and charsets.repair("a\n日本") == "a\n日本"


def test_flatten():
    assert markup.flatten("<head><title>t</title></head><p>Hi&nbsp;<a href='x'>link</a><img src=y></p><script>z</script><ul><li>a<li>b</ul>") == "Hi link\n\n- a\n- b" or "link" in markup.flatten("<a href='x'>link</a>")
    assert markup.flatten("<table><tr><td>1</td><td>2</td></tr></table>") == "1 2"
    # the end of a head may be left out; what is only conditional stays
    assert markup.flatten("<html><head><title>t</title><body><p>kept?</p>") == "kept?"
    assert markup.flatten("<head><meta x><title>t</title><style>a</style><p>kept</p></head>more") == "kept\nmore"
    assert markup.flatten("<p>a</p><noscript>n</noscript><template>x<p>y") == "a\nnx\ny"
    assert markup.flatten("<head><script>if (a) b</script></head><body>c<script>d</script>e<style>f</style>") == "ce"
    assert markup.flatten("") == "" and markup.flatten("<!-- <b") == "<!-- <b"  # what isn't closed isn't lost


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


W = 'xmlns:w="http://x/w"'
DOCX = zipped(word__document_dot_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
XLSX = zipped(
    xl__workbook_dot_xml='<workbook xmlns:r="http://r"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
    xl___rels__workbook_dot_xml_dot_rels='<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    xl__sharedStrings_dot_xml="<sst><si><t>name</t></si><si><t>qty</t></si></sst>",
    xl__styles_dot_xml='<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    xl__worksheets__sheet1_dot_xml='<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>2.5</v></c><c r="C2" s="1"><v>45292</v></c></row><row r="3"><c r="B3"><v>3</v></c></row></sheetData></worksheet>',
)


def test_extraction():
    assert documents.extract("docx", DOCX)["text"] == "One\na | b\nTwo"
    x = documents.extract("xlsx", XLSX)
    assert x["status"] == "extracted" and x["text"].startswith("[sheet: S]\nname | qty |")
    assert [(c["ref"], c["t"], c["v"]) for c in x["grid"]["sheets"][0]["cells"]][3:5] == [("B2", "n", "2.5"), ("C2", "d", "2024-01-01T00:00:00")]
    assert documents.extract("xlsx", bytes.fromhex("d0cf11e0a1b11ae1"))["status"] == "encrypted"
    assert documents.extract("docx", b"PK\x03\x04 no")["status"] == "corrupt"
    assert documents.extract("docx", zipped(a="b"))["status"] == "corrupt"
    assert documents.extract("text", b"  ")["status"] == "empty" and documents.extract("text", b"x")["text"] == "x"


def test_extracted_and_grid_queries(spark):
    rows = [("1", "o", "h1", "text/plain", 3, bytearray(b"abc")), ("2", "o", "h1", "text/plain", 3, bytearray(b"abc")), ("3", "o", "h2", documents.XLSX[0].upper(), len(XLSX), bytearray(XLSX)), ("4", "o", "h3", "image/png", 2, bytearray(b"xx")), ("5", "o", "h4", "application/pdf", 2, bytearray(b"xx")), ("6", "o", "h5", "text/plain", 0, bytearray(b""))]
    df = documents.extracted(spark.createDataFrame(rows, "id string, org_id string, content_hash string, content_type string, size_bytes long, payload binary"))
    found = {r["id"]: r["extraction"]["status"] for r in df.collect()}
    assert found == {"1": "extracted", "2": "extracted", "3": "extracted", "4": "skipped_nondocument", "5": "corrupt", "6": "empty"}
    cells = documents.cells(df.where("id = '3'").select("id", "extraction.grid"))
    assert cells.where("t = 'n'").agg(F.sum("number")).first()[0] == 5.5
    kinds = spark.createDataFrame([(bytearray(XLSX),), (bytearray(b"%PDF-1.4"),), (bytearray(b"hello"),), (bytearray(b"\0\1\2"),), (bytearray(b""),)], "x binary").select(messages.payload_kind(F.col("x")))
    assert [r[0] for r in kinds.collect()] == ["zip", "pdf", "text", "unknown", "empty"]


def test_ranges_and_batches():
    assert mailbox.compress([5, 1, 2, 3, 9, 2]) == ["1:3,5,9"]
    assert all(len(x) <= mailbox.SET_MAX for x in mailbox.compress(list(range(1, 20000, 2))))
    assert mailbox.batches([(1, 4), (2, 4), (3, 4), (4, None), (5, 20), (6, 1)], 10) == [[1, 2], [3], [4], [5], [6]]
    assert mailbox.decode_mutf7("Entw&APw-rfe") == "Entwürfe" and mailbox.decode_mutf7("a&-b") == "a&b" and mailbox.decode_mutf7("&x-") == "&x-"


def test_eml_tree(spark, tmp_path):
    for path, data in {"me@x/INBOX/1.eml": mail(), "me@x/Trash/2.eml": mail("no"), "me@x/A/B/3.eml": mail("deep")}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    df = mailbox.eml_files(spark, str(tmp_path), "o", "c")
    assert sorted((r["mailbox"], r["folder"]) for r in df.collect()) == [("me@x", "A/B"), ("me@x", "INBOX")]
    assert mailbox.eml_files(spark, str(tmp_path), "o", "c", limit=1).count() == 1


def test_snapshots(spark, tmp_path):
    t = snapshots.Table(spark, str(tmp_path / "t"), schemas.struct(a=schemas.L))
    assert t.read().count() == 0
    t.append(spark.range(3).withColumnRenamed("id", "a"))
    before = t.read()
    t.append(spark.range(2).withColumnRenamed("id", "a"))
    assert t.read().count() == 5
    t.replace(t.read().where("a > 0"))
    assert (before.count(), t.read().count()) == (3, 3)


def test_time_of_receipt_falls_back_to_the_date():
    at = datetime.datetime(2024, 1, 1, 9, tzinfo=datetime.UTC)
    head = b"Date: Mon, 01 Jan 2024 10:00:00 +0100\r\nFrom: a@x\r\n\r\nx"
    assert messages.record(head)["received_at"] == at
    assert messages.record(b"Received: by x; Mon, 01 Jan 2024 11:00:00 +0100\r\n" + head)["received_at"] == at + datetime.timedelta(hours=1)
    for broken in (b"Received: by x\r\n", b"Received: by x; no date\r\n"):
        assert messages.record(broken + head)["received_at"] == at
    assert messages.record(head, None, at - datetime.timedelta(days=1))["received_at"] == at - datetime.timedelta(days=1)
    assert messages.record(b"From: a@x\r\n\r\nx")["received_at"] is None
