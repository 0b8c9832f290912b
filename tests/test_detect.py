import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillguard import schemas as S
from quillguard.functions import patterns as P
from quillguard.functions import spans
from quillguard.functions import text as X
from quillguard.operators import detect


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = detect.scan_findings(df, "t", **options).orderBy("i").collect()
    return [[(f["type"].removeprefix("PII:"), f["start"], f["end"], f["text"]) for f in r["findings"]] for r in rows]


def test_single_types(spark):
    out = found(
        spark,
        [
            "Please mail to nadia@mill.test by noon",
            "From: a@x.com To: b@y.co",
            "Ring 415-555-0132 after six",
            "Ward list has MRN: K7654321 admitted",
            "415.555.1234",
            "",
            None,
        ],
    )
    assert out[0] == [("email_address", 15, 30, "nadia@mill.test")]
    assert out[1] == [("email_address", 6, 13, "a@x.com"), ("email_address", 18, 24, "b@y.co")]
    assert out[2] == [("phone_number", 5, 17, "415-555-0132")]
    assert out[3] == [("us_medical_record_number", 14, 27, "MRN: K7654321")]
    assert out[4] == out[5] == out[6] == []


def test_phone_takes_cards_and_npis_first(spark):
    out = found(
        spark,
        [
            "Card: 4111111111111111",
            "NPI: 1234567890 DEA Number: AB1234567 DOB: 01/09/1982",
            "Card 4111 1111 1111 1111 cvv: 123 exp: 12/29",
        ],
    )
    assert out[0] == [("phone_number", 6, 22, "4111111111111111")]
    assert [f[0] for f in out[1]] == ["phone_number", "us_dea", "us_date_of_birth"]
    assert [f[0] for f in out[2]] == ["phone_number", "pci_cvv", "pci_expiry"]


def test_specific_first_finds_the_specific_type(spark):
    out = found(
        spark,
        [
            "Card: 4111111111111111",
            "lot 1234567890123456 of the barn",
            "NPI: 1234567890",
            "host 10.0.0.1 not 300.1.1.1",
            "pay DE89 3704 0044 0532 0130 00 not DE88370400440532013000",
            "ssn 123-45-6789 not 000-12-3456",
            "ghp_ABCDEFGHIJKLMNOP1234 eyJhbGciOi.eyJzdWIiOi.c2ln",
        ],
        profile="specific_first",
    )
    assert out[0] == [("credit_card", 6, 22, "4111111111111111")]
    assert [f[0] for f in out[1]] == ["phone_number"]
    assert [f[0] for f in out[2]] == ["us_npi"]
    assert [(f[0], f[3]) for f in out[3]] == [("ip_address", "10.0.0.1")]
    assert ("iban_code", "DE89 3704 0044 0532 0130 00") in [(f[0], f[3]) for f in out[4]]
    assert not any(f[0] == "iban_code" and f[3].startswith("DE88") for f in out[4])
    assert ("us_ssn", "123-45-6789") in [(f[0], f[3]) for f in out[5]]
    assert ("us_ssn", "000-12-3456") not in [(f[0], f[3]) for f in out[5]]
    assert [f[0] for f in out[6]] == ["jwt_token", "api_key"]


def test_offsets_count_code_points(spark):
    text = "🙂é x@y.zz 🙂"
    (f,) = found(spark, [text])[0]
    assert text[f[1] : f[2]] == "x@y.zz"


def test_scores(spark):
    df = spark.createDataFrame([("a@x.com cvv: 123 exp: 12/29 DEA AB1234567 DOB 1/2/1990",)], "t string")
    row = detect.scan_findings(df, "t").first()
    assert {f["type"]: f["score"] for f in row["findings"]} == {
        "PII:email_address": 0.8,
        "PII:us_dea": 0.85,
        "PII:us_date_of_birth": 0.78,
        "PII:pci_cvv": 0.88,
        "PII:pci_expiry": 0.84,
    }


@pytest.mark.parametrize(
    "text, expected",
    [
        ("my ssn 123-45-6789", [(7, 18, 0.9)]),
        ("call 123-45-6789", [(5, 16, 0.7)]),
        ("number 219099999", []),
        ("tax id 219099999", [(7, 16, 0.9)]),
        ("123-45-6789 234-56-7890", [(0, 11, 0.7), (12, 23, 0.7)]),
        ("123-45-6789 987-65-4321", [(0, 11, 0.7)]),
        ("000-12-3456", [(0, 11, 0.7)]),
        ("nothing", []),
    ],
)
def test_ssn_needs_context_or_dashes(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    empty = detect.scan_findings(df, "t", profile=())
    row = detect.scan_ssn_context(empty, "t").first()
    assert [(f["start"], f["end"], f["score"]) for f in row["findings"]] == expected


def test_ssn_is_shadowed_after_the_full_scan(spark):
    df = spark.createDataFrame([("my ssn 123-45-6789",)], "t string")
    row = detect.scan_ssn_context(detect.scan_findings(df, "t"), "t").first()
    assert [f["type"] for f in row["findings"]] == ["PII:phone_number"]


def test_password_and_payment(spark):
    df = spark.createDataFrame([("password: $500 ok, Pwd=x 17 dollars \"price\": 3.50",)], "t string")
    row = detect.scan_password_payment(detect.scan_findings(df, "t"), "t").first()
    assert [f["text"] for f in row["password_findings"]] == ["password: $500", "Pwd=x"]
    assert [f["text"] for f in row["payment_findings"]] == ["$500", "17 dollars", '"price": 3.50']


def test_credentials(spark):
    df = spark.createDataFrame([("sk_ABCDEFGHIJKLMNOP pk_short eyJa.eyJb.c",)], "t string")
    row = detect.scan_credentials(df, "t").first()
    assert [(f["type"], f["text"]) for f in row["findings"]] == [
        ("PII:api_key", "sk_ABCDEFGHIJKLMNOP"),
        ("PII:jwt_token", "eyJa.eyJb.c"),
    ]


def test_false_positives(spark):
    rows = [
        ("PII:us_ssn", "ssn", "123-45-6789", True),
        ("PII:us_ssn", "user_secret", "123-45-6789", False),
        ("PII:us_ssn", "", "Password", False),
        ("PII:us_ssn", "", "111111111", False),
        ("PII:us_ssn", "", "123456789", True),
        ("PII:phone_number", "password", "111111111", True),
    ]
    df = spark.createDataFrame(rows, "type string, f string, v string, stays boolean")
    kept = detect.drop_false_positives(df, "f", "v").collect()
    assert len(kept) == 3 and all(r["stays"] for r in kept)


def test_profile_counts(spark):
    df = spark.createDataFrame(
        [("en", "a@x.com b@x.com 555-201-7788"), ("en", "c@x.com"), ("de", "none")], "lang string, t string"
    )
    rows = detect.corpus_pii_profile(detect.scan_findings(df, "t"), ["lang"]).collect()
    assert {(r["lang"], r["type"]): (r["n_findings"], r["n_rows"]) for r in rows} == {
        ("en", "PII:email_address"): (3, 2),
        ("en", "PII:phone_number"): (1, 1),
    }


def brute_force(text, specs):
    """First come, first kept, over Python's own regex engine. Digits outside ASCII weigh in the
    checksum by their code point."""
    kept = []
    for spec in specs:
        for m in re.finditer(spec.pattern, text):
            if spec.validator == "card":
                ds = [ord(c) - 48 for c in m.group() if c.isdigit()]
                total = sum(ds[-1::-2]) + sum(2 * d - 9 if d > 4 else 2 * d for d in ds[-2::-2])
                if not 13 <= len(ds) <= 19 or total % 10:
                    continue
            if all(m.end() <= s or m.start() >= e for _, s, e, _ in kept):
                kept.append((spec.pii_type, m.start(), m.end(), m.group()))
    return kept


def random_texts(n):
    rng = random.Random(7)
    parts = [
        "a@b.com", "é", "🙂", " ", "  ", "555-201-7788", "4111111111111111", "4111 1111 1111 1111", "MRN: A1234567",
        "mrn#ab-12-34", "Member ID 99-ABC-1", "NPI: 1234567890", "DEA AB1234567", "DOB: 1/2/1990", "cvv 123",
        "exp: 12/29", "valid thru 01/2031", "x", "@", "12", "٣٤٥٦٧٨٩٠١٢", " ", "\x1c", "\n", "+1 (555) 867-5309", ".",
        "policy number: QWERTY12", "security code: 9999", "-", " ", "word", "ſsn", "patIent id K12345678",
        "patıent ID ABC123456", "ſecurity code: 123", "poliCy NUMBER x1y2z3w4", "\ue000", "\ue001", "\ue000a@b.com\ue000",
    ]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_native_scan_equals_brute_force(spark):
    texts = random_texts(1500)
    assert found(spark, texts) == [brute_force(t, P.REGEX_PROFILE) for t in texts]


def test_cards_behind_the_phone_pattern(spark):
    specs = (P.EMAIL_SPEC, P.CARD_SPEC, P.PHONE_SPEC)
    texts = random_texts(400)
    assert found(spark, texts, profile=specs) == [brute_force(t, specs) for t in texts]


def test_arrow_scan_equals_native(spark):
    texts = random_texts(600)
    for profile in ("regex", "specific_first"):
        assert found(spark, texts, profile=profile, engine="arrow") == found(spark, texts, profile=profile)


def test_long_text_is_read_to_its_end(spark):
    text = ("lorem ipsum " * 20_000) + "end@of.text"
    assert found(spark, [text])[0] == [("email_address", 240_000, 240_011, "end@of.text")]


def test_email_scan_equals_its_pattern(spark):
    rng = random.Random(11)
    letters = ["a", "b.c", "@", "@", ".co", ".c", ".org", " ", "_", "-", "é", "%", "\t", "9", "@x.yz"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert found(spark, texts, profile=(P.EMAIL_SPEC,)) == [brute_force(t, (P.EMAIL_SPEC,)) for t in texts]
    masked = F.expr(X.mask_text("t")).getField("text")
    line = "id y.z@x.org, -a%b@x.org.q"
    out = spark.createDataFrame([(line,)], "t string").select(masked).first()[0]
    assert out == re.sub(P.EMAIL, r"\1***\2", line)


def test_a_megabyte_without_spaces(spark):
    text = "x" * 1_000_000 + " a@b.org " + "y@" * 1000 + "z" * 1_000_000
    started = time.perf_counter()
    assert found(spark, [text], profile=(P.EMAIL_SPEC,))[0] == [("email_address", 1_000_001, 1_000_008, "a@b.org")]
    assert time.perf_counter() - started < 20


def test_detection_is_not_repeated_by_a_filter(spark):
    df = spark.createDataFrame([("a@x.com",), ("none",)], "t string")
    hits = detect.scan_findings(df, "t").filter("size(findings) > 0")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    scans = sum(line.count(P.EMAIL[:20]) > 0 for line in plan.splitlines())
    assert scans == 1 and hits.count() == 1


def _plain_first_come(spans):
    kept = []
    for c in spans:
        if not any(c[1] > k[0] and c[0] < k[1] for k in kept):
            kept.append(c)
    return kept


def test_sweep_keeps_what_comparing_all_pairs_keeps(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        n, width = rng.choice([0, 1, 2, 5, 30, 120]), rng.choice([20, 200, 3000])
        starts = [rng.randrange(width) for _ in range(n)]
        rows.append((i, [(s, s + rng.randint(1, 12)) for s in starts]))
    rows.append((300, [(7 * i, 7 * i + 9) for i in range(4000)]))  # one chain
    df = spark.createDataFrame(rows, "id int, spans array<struct<a:int,b:int>>")
    found = df.select("id", F.expr("transform(spans, x -> named_struct('type', 't', 'start', x.a, 'end', x.b, 'score', 0.5D, 'text', ''))").cast(S.FINDINGS_DDL).alias("c"))
    kept = found.select("id", F.expr(spans.keep_first_come("c")).alias("k")).collect()
    want = dict(rows)
    for r in kept:
        assert [(f.start, f.end) for f in r.k] == _plain_first_come(want[r.id]), r.id


def test_splice_of_disjoint_and_overlapping_spans(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        text = "".join(rng.choices("abcé日🙂 \n", k=rng.choice([0, 5, 40, 2000])))
        bounds = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.choice([0, 1, 3, 12, 100]))))
        edits = [(bounds[j], bounds[j + 1], rng.choice(["", "<X>", None, "é"])) for j in range(0, len(bounds) - 1, 2)]
        if i % 4 == 0 and len(text) > 10:
            edits += [(1, 7, "<LONG>"), (3, 9, "y")]
        rng.shuffle(edits)
        rows.append((i, text, edits))
    long = "x@ " * 100_000
    rows.append((200, long, [(3 * j, 3 * j + 2, "<E>") for j in range(10_000)]))
    df = spark.createDataFrame(rows, "id int, t string, s array<struct<start:int,`end`:int,new:string>>")
    got = {r.id: r.o for r in df.select("id", F.expr(spans.splice("t", "s", lambda f: f"{f}.new")).alias("o")).collect()}
    for i, text, edits in rows:
        want = text
        for a, b, new in sorted(edits, key=lambda f: -f[0]):  # of equal starts the first listed first
            want = want if new is None else want[:a] + new + want[b:]
        assert got[i] == want, i


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("Order Number 123456", 0.75),
        ("order, (number): 123456", 0.75),
        ("number order 123456", 0.4),
        ("123456", 0.4),
        ("order number a b c 123456", 0.75),
        ("order number a b c d 123456", 0.4),
        ("123456 order number", 0.4),
        ("border numbers 123456", 0.4),
        ("order number " + "x" * 300 + " 123456", 0.4),
    ],
)
def test_context_words_raise_scores(spark, text, score):
    specs = [P.PatternSpec("ticket", r"\d{6}", 0.4, "", context=("order number",))]
    df = spark.createDataFrame([(text,)], "t string")
    (found,) = detect.scan_findings(df, "t", specs).first()["findings"]
    assert found["score"] == pytest.approx(score) and found["text"] == "123456"


def test_context_behind_floor_and_ceiling(spark):
    specs = [P.PatternSpec("low", r"\d{3}", 0.01, "", context=("code",)), P.PatternSpec("high", "[A-Z]{3}", 0.9, "", context=("code",))]
    df = spark.createDataFrame([("123 is the code, code ABC",), (None,)], "t string")
    rows = detect.scan_findings(df, "t", specs, context_after=3).collect()
    assert [(f["text"], f["score"]) for f in rows[0]["findings"]] == [("123", 0.4), ("ABC", 1.0)] and rows[1]["findings"] == []
