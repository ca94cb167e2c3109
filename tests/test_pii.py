"""Detection, resolution and redaction on small texts with known answers."""

import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import names, pii
from maskwright.operators import redact as R


def redact(spark, texts, unstructured=True):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    extra = names.unstructured(F.col("text")) if unstructured else F.array().cast(f"array<{pii.SPAN}>")
    rows = rows.withColumn("found", pii.all_spans(F.col("text"), extra)).withColumn("spans", pii.resolved(F.col("found")))
    return [r.r for r in rows.orderBy("id").select(R.redacted(F.col("text"), F.col("spans")).alias("r")).collect()]


CASES = [
    ("Contact 9876543210@example.com now", "Contact [PII_EMAIL_01] now"),
    ("Card 1234 5678 9012 3456 on file", "Card [PII_CARD_01] on file"),
    ("OTP is 123456 sent to 9876543210", "[PII_OTP_01] sent to [PII_PHONE_01]"),
    ("a@b.co and again a@b.co", "[PII_EMAIL_01] and again [PII_EMAIL_01]"),
    ("a@b.co then c@d.org then a@b.co", "[PII_EMAIL_01] then [PII_EMAIL_02] then [PII_EMAIL_01]"),
    ("Account holder: Anita Sharma, phone 9876543210", "Account holder: [PII_NAME_01], phone [PII_PHONE_01]"),
    ("PAN ABCDE1234F, Aadhaar 4321 8765 2109", "PAN [PII_PAN_01], Aadhaar [PII_AADHAAR_01]"),
    ("Call 022-24567890 or +91 98765 43210", "Call [PII_PHONE_01] or [PII_PHONE_02]"),
    ("naïve é9876543210 x", "naïve é[PII_PHONE_01] x"),
    ("no data here", "no data here"),
    ("", ""),
    ("😀 a@b.co 😀", "😀 [PII_EMAIL_01] 😀"),
]


def test_golden_texts(spark):
    got = redact(spark, [t for t, _ in CASES])
    assert [r.text for r in got] == [want for _, want in CASES]
    assert got[1].matches[0].confidence == 0.7 and not got[1].requires_review
    assert got[3].tokens == 1 and got[4].tokens == 2


def test_shape_only_name_is_held_for_review(spark):
    (r,) = redact(spark, ["Contact Vikrant Bhardwaj about the file"])
    assert r.requires_review and r.text == "Contact [PII_NAME_01] about the file" and r.matches[0].confidence == 0.5


@pytest.mark.parametrize("text", ["OTP 123456 sent to 9876543210", "Download Report", "Simple Tables", "Press Ctrl+Shift+P", "Terms Of Use", "Reliance Industries Limited", "Skip to main content", "Find An ATM Near You", "Free shipping over 29.45 today"])
def test_no_unstructured_match(text):
    assert names.Rules().spans(text) == []


@pytest.mark.parametrize(
    "text,kind,value,confidence",
    [
        ("Signed in as Ramesh Iyer\nShop", "NAME", "Ramesh Iyer", 0.95),
        ("Dr. Sengupta will call", "NAME", "Sengupta", 0.9),
        ("Patient: Zubin Mistry", "NAME", "Zubin Mistry", 0.9),
        ("Claim filed by O'Brien D'Souza today", "NAME", "O'Brien D'Souza", 0.5),
        ("Address: Flat 12, Nehru Road, Pune 411001", "ADDRESS", "Flat 12, Nehru Road, Pune 411001", 0.95),
        ("27 MG Road, Kochi 682016", "ADDRESS", "27 MG Road, Kochi 682016", 0.9),
        ("Shipped via Green Street corner", "ADDRESS", "Shipped via Green Street corner", 0.5),
    ],
)
def test_unstructured_match(text, kind, value, confidence):
    found = [s for s in names.Rules().spans(text) if s["type"] == kind]
    assert [(s["value"], s["confidence"]) for s in found] == [(value, confidence)]
    assert text[found[0]["start"] : found[0]["end"]] == value


def test_prefilter_loses_nothing():
    lines = [t for t, _ in CASES] + ["Mr. Rao", "Fatima Sheikh", "O'Neil McDonald paid", "near the Salai", "house no. 5, Gali 3, Delhi"]
    rules = names.Rules()
    for line in lines:
        assert not rules.names(line) or names.CAPITALS.search(line)
        assert not rules.addresses(line) or names.may_place(line)


def test_address_keeps_its_tail(spark):
    (r,) = redact(spark, ["a@b.co 27 MG Road, Kochi 682016"])
    assert r.text == "[PII_EMAIL_01] [PII_ADDRESS_01]" and r.matches[1].start == 7


def test_nothing_is_left_after_redaction(spark):
    for r in redact(spark, [t for t, _ in CASES]):
        assert not re.search(r"\d{10}|@", r.text)


def test_rejected_names_go_before_resolution(spark):
    rows = spark.createDataFrame([("name: Anita Sharma",)], "text string").withColumn("found", names.unstructured(F.col("text")))
    kept = rows.select(pii.without(F.col("found"), F.array(F.lit("6:18"))).alias("k")).first().k
    assert kept == []


def test_scope_tokens_and_null_text(spark):
    rows = spark.createDataFrame([(1, 1, "a@b.co"), (1, 2, "x c@d.org a@b.co"), (2, 1, "c@d.org"), (2, 2, None)], "scope_id int, ord int, text string")
    rows = rows.withColumn("spans", pii.structured(F.col("text")))
    got = {(r.scope_id, r.ord): r.text for r in R.redact_scopes(rows).collect()}
    assert got == {(1, 1): "[PII_EMAIL_01]", (1, 2): "x [PII_EMAIL_02] [PII_EMAIL_01]", (2, 1): "[PII_EMAIL_01]", (2, 2): ""}


def test_tokens_past_99(spark):
    r = spark.range(1).select(pii.token(F.lit("OTP"), F.lit(100)).alias("a"), pii.token(F.lit("OTP"), F.lit(7)).alias("b")).first()
    assert (r.a, r.b) == ("[PII_OTP_100]", "[PII_OTP_07]")


def test_bands(spark):
    rows = spark.createDataFrame([(0.39,), (0.4,), (0.6,)], "c double").select(pii.decision(F.col("c")).alias("d")).collect()
    assert [r.d for r in rows] == ["allow", "review", "mask"]


def test_audit_refuses_structured_data(spark, tmp_path):
    from maskwright.sources.readers import append_audit, read_audit

    good = spark.createDataFrame([("t1", "act", "clicked [PII_EMAIL_01] by Anita Sharma", True), ("t2", "act", "ok", True)], "task_id string, stage string, detail string, ok boolean")
    path = str(tmp_path / "audit")
    append_audit(good, path)
    assert read_audit(spark, path, "t1").count() == 1 and read_audit(spark, path).count() == 2
    bad = good.withColumn("detail", F.lit("mail a@b.co"))
    with pytest.raises(Exception, match="personal data"):
        append_audit(bad, path)


def test_text_with_very_many_matches(spark):
    """Folds are in blocks, so a long text isn't quadratic; the numbers are those of the first appearances."""
    import random

    rng = random.Random(3)
    for n, kinds in ((40, 7), (700, 50), (20_000, 9_000)):
        text = " ".join(rng.choice([f"user{rng.randrange(kinds)}@example.com", f"é call 98765{rng.randrange(kinds):05d} now", "plain é words"]) for _ in range(n))
        seen: dict = {}

        def token(m, seen=seen):
            kind = "EMAIL" if "@" in m[0] else "PHONE"
            own = seen.setdefault(kind, {})
            return f"[PII_{kind}_{own.setdefault(m[0], len(own) + 1):02d}]"

        want = re.sub(r"user\d+@example\.com|98765\d{5}", token, text)
        (r,) = redact(spark, [text], unstructured=False)
        assert r.text == want and r.tokens == sum(map(len, seen.values()))
