"""Every measure over a small corpus that was taken in and resolved. Their faults of all kinds are in the stored tables of test_catalogue."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import graph
from corpusloom.plans import measures
from corpusloom.sources import messages

from .test_sources import mail


@pytest.fixture(scope="module")
def tables(spark):
    raw = [
        mail("Hallo", ident="<1@x>", to="bo@shop.example, info@nowhere.example"),
        mail("Hallo", ident="<2@x>", to="joe.b@gmail.com, jo.eb+x@gmail.com", In_Reply_To="<1@x>", References="<1@x> <none@x>", List_Id="<l>"),
        mail("other text", ident="<2@x>", subject="Ref: y", to="bo@gmaill.com"),
        mail("x", ident="<3@x>", subject="=?x?q?y?=", to="bo@under_score", files=(("a.txt", b"data"),), date=None),
        mail("late", ident="<4@x>", date="Mon, 01 Jan 1980 10:00:00 +0000", to="ann@x.acme.org"),
    ]
    rows = [("o", "c", "me@acme.org", "INBOX", 1, i, i, bytearray(r), datetime.datetime(2024, 1, 1 + i)) for i, r in enumerate(raw)]
    df = spark.createDataFrame(rows, schemas.RAW_MESSAGE)
    parsed = df.select("org_id", "connection_id", "seq", "mailbox", F.length("raw").alias("raw_size"), messages.parse(F.col("raw"), F.col("mailbox"), F.col("internal_date")).alias("m")).persist()
    t = messages.to_rows(parsed)
    seen = graph.sightings(parsed.select("org_id", "connection_id", "seq", "mailbox", "m.*"))
    t |= graph.resolve(seen)
    of = t["person_email"].select("org_id", "email", "person_id")
    from corpusloom.functions.addresses import normalize_email

    t["email_recipient"] = t["email_recipient"].withColumn("email", normalize_email(F.col("address"))).join(of, ["org_id", "email"], "left").drop("email")
    t["email_message"] = t["email_message"].withColumn("email", normalize_email(F.col("from_address"))).join(of.withColumnRenamed("person_id", "from_person_id"), ["org_id", "email"], "left").drop("email")
    t["email_attachment"] = t["email_attachment"].select("*", F.lit(None).cast("string").alias("extracted_text"), F.lit("extracted").alias("extraction_status"))
    for name in ("person_email", "company_domain"):
        t[name] = t[name].withColumn("source", F.lit(None).cast("string"))
    t["connector_connection"] = spark.createDataFrame([("o", "c", "me@acme.org")], "org_id string, id string, username string")
    t["audit_log"] = spark.createDataFrame([("o", str(i), datetime.datetime(2024, 1, 1, i), "a", "u") for i in range(5)], "org_id string, id string, occurred_at timestamp, action string, actor_id string")
    t["organizations"] = spark.createDataFrame([("o", "Org")], "org_id string, name string")
    return {k: v.persist() for k, v in measures.tenant(t, "o").items()}


WANT = {
    "K01": {(0,)}, "K02": {("role", 1)}, "K03": {(6, 7, 5, 5, 7)}, "K04": {(6, 7)}, "A01": {(0, 0)}, "A02": {(0, 0, 0)}, "A03": {(0, 7)}, "A04": {(0, 0)},
    "B01": {("joeb", "gmail.com", 2)}, "B02": set(), "B03": set(), "B04": {(0, 0)}, "B05": {(4, 1)}, "B06": {(0,)}, "C01": {(1, 1, 1)}, "C02": {(0,)}, "C03": {("gmaill.com",)}, "C04": {("under_score",), ("x",)},
    "D01": set(), "D02": {(0, 1)}, "D03": set(), "D04": {(5,)}, "E01": {(0, 1)}, "E02": {(0,)}, "E02_mix": {("inbound", 5)}, "E03": {(0,)}, "E04": {(0, 0)},
    "F01": {(0, 0, 0)}, "F02": {(0, 0)}, "F03": {(0,)}, "F04": {(0, 0)}, "F05": {(0, 5)}, "F06": {(1, 0, 0, 0)}, "F07": {(0, 0)}, "G01": {("2@x", 2, 1, 2, 2)}, "G02": {(2, 1, 1, 0)}, "G03": {(0,)},
    "H01": {("application/octet-stream", 1, 1, 4)}, "H02": {(0,)}, "H03": {(0, 0)}, "I01": {(6, 6, 0, 7)}, "I02": {(1,)}, "I03": {(0,)}, "I04": {(210, 283, 0)}, "J01": {(0,)}, "J02": {(1,)}, "J03": {(0, 0, 0)},
    "R1": set(), "R2": {(0,)}, "R3": {(0, 0, 0, 0)}, "R4": {(0, 0)}, "R5": {(1, 0)},
}


@pytest.mark.parametrize("name", sorted(measures.MEASURES))
def test_measure(name, tables):
    got = {tuple(r) for r in measures.MEASURES[name](tables).collect()}
    assert got == WANT[name]


def test_questions(tables):
    assert {r["email"] for r in measures.who_works_at(tables, "shop.example").collect()} == {"bo@shop.example"}
    assert measures.activity(tables, "bo@shop.example").first()["received"] == 1
    stamp = lambda x: F.lit(x).cast("timestamp")
    assert measures.topic(tables, "LATE", stamp("2024-01-01"), stamp("2024-02-01")).count() == 1
    assert measures.top_counterparties(tables).count() > 0
    assert [a["id"] for a in measures.compliance_export(tables, 3).first()["audit"]] == ["4", "3", "2"]
    assert measures.MEASURES["F06"](tables).first()["early"] == 1 and measures.MEASURES["F07"](tables).first()["encoded"] <= 1
