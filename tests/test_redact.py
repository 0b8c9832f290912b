import hashlib
import json

from pyspark.sql import functions as F

from quillguard.functions import text as X
from quillguard.operators import detect, redact


def tok(value):
    return "pii_" + hashlib.sha256((X.DEFAULT_SALT + value).encode()).hexdigest()[:8]


def test_masks(spark):
    cases = {
        "the mill answers under wheel@mill-lane.test on weekdays": ("the mill answers under w***@mill-lane.test on weekdays", ["email"]),
        "ring 555-201-7788 after noon": ("ring +***-***-**** after noon", ["phone"]),
        "Card: 4532015112830366": ("Card: +***-***-****", ["phone", "card"]),
        "lot 1234567890123456 of the barn": ("lot +***-***-**** of the barn", ["phone", "card"]),
        "NPI: 1234567890 DEA Number: AB1234567 DOB: 01/09/1982": (
            "NPI: +***-***-**** <USER_DEA> <USER_DOB>",
            ["phone", "us_npi", "us_dea", "us_date_of_birth"],
        ),
        "Card 4532 0151 1283 0366 cvv: 123 exp: 12/29": (
            "Card +***-***-**** <PCI_CVV> <PCI_EXPIRY>",
            ["phone", "card", "pci_cvv", "pci_expiry"],
        ),
        "clean": ("clean", []),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in redact.mask_text(df, "t").collect():
        masked, reasons = cases[r["t"]]
        assert (r["masked"], r["reasons"]) == (masked, [f"pii.redacted:{x}" for x in reasons])


def test_placeholders_are_spliced_right_to_left(spark):
    df = spark.createDataFrame([("a@x.com, 🙂 555-201-7788, b@x.com",)], "t string")
    row = redact.redact_placeholders(detect.scan_findings(df, "t"), "t").first()
    assert row["redacted"] == "<USER_EMAIL>, 🙂 <USER_PHONE>, <USER_EMAIL>"
    assert row["reasons"] == ["pii.redacted:email_address", "pii.redacted:phone_number"]


def test_overlapping_password_and_payment(spark):
    df = detect.scan_findings(spark.createDataFrame([("password: $500 ok",)], "t string"), "t")
    both = detect.scan_password_payment(df, "t")
    columns = ["findings", "password_findings", "payment_findings"]
    raw = redact.redact_placeholders(both, "t", columns, overlap="raw").first()
    assert raw["redacted"] == "<PASSWORD>MENT_AMOUNT> ok"
    first = redact.redact_placeholders(both, "t", columns).first()
    assert (first["redacted"], first["reasons"]) == ("<PASSWORD> ok", ["pii.redacted:password"])


def test_unknown_types_have_a_made_placeholder(spark):
    row = spark.sql(
        f"SELECT {X.placeholder(chr(39) + 'PII:shoe_size' + chr(39))} AS a, {X.placeholder(chr(39) + 'odd' + chr(39))} AS b"
    ).first()
    assert (row["a"], row["b"]) == ("<USER_SHOE_SIZE>", "<REDACTED>")


def transformed(spark, text, allow, mode):
    df = detect.scan_findings(spark.createDataFrame([(text, allow)], "t string, allow map<string,string>"), "t")
    row = redact.transform_by_tool(df, "t", "allow", mode=mode).first()
    return row["text_out"], row["reasons"]


TEXT = "a@x.com 555-201-7788 cvv: 123"


def test_transform_static(spark):
    text, reasons = transformed(
        spark, TEXT, {"PII:email_address": "pass_through", "PII:phone_number": "tokenize"}, "static"
    )
    assert text == f"a@x.com {tok('555-201-7788')} <PCI_CVV>"
    assert reasons == ["pii.redacted:PII:pci_cvv", "pii.tokenized:PII:phone_number", "pii.allowed:PII:email_address"]
    assert transformed(spark, TEXT, None, "static")[0] == "a***@x.com +***-***-**** <PCI_CVV>"


def test_transform_payload(spark):
    allow = {"PII:email_address": "pass_through", "PII:phone_number": "tokenize", "PII:pci_cvv": "mystery"}
    assert transformed(spark, TEXT, allow, "payload") == (
        f"a@x.com {tok('555-201-7788')} cvv: 123",
        ["tokenized:PII:phone_number"],
    )
    assert transformed(spark, TEXT, {}, "payload") == (
        "[PII:EMAIL_ADDRESS] [PII:PHONE_NUMBER] [PII:PCI_CVV]",
        ["redacted:PII:pci_cvv", "redacted:PII:phone_number", "redacted:PII:email_address"],
    )


def test_tokens_and_collisions(spark):
    df = spark.createDataFrame([("wheel@mill-lane.test", 5), ("ü", 6)], "v string, n int")
    rows = redact.tokenize_column(df, ["v", "n"]).collect()
    assert [(r["v_token"], r["n_token"]) for r in rows] == [
        (tok("wheel@mill-lane.test"), tok("5")),
        (tok("ü"), tok("6")),
    ]
    shared = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("a", "t1"), ("c", "t2")], "v string, t string")
    assert [tuple(r) for r in redact.token_collisions(shared, "v", "t").collect()] == [("t1", 2)]


DOC = {
    "msg": "email dev@example.com",
    "count": 5,
    "api_key": "k",
    "user": {"email": "a@b.com", "none": None},
    "list": ["clean", "bob@b.com"],
    "passwords": ["p@q.com"],
}

def test_nested_json(spark):
    df = spark.createDataFrame([(json.dumps(DOC),), ('{"msg":"fine"}',)], "doc string")
    first, second = redact.redact_nested(df, "doc").collect()
    assert json.loads(first["doc_out"]) == {
        "msg": "email d***@example.com",
        "count": 5,
        "api_key": "<PASSWORD>",
        "user": {"email": "a***@b.com", "none": None},
        "list": ["clean", "b***@b.com"],
        "passwords": ["p***@q.com"],  # elements of a list have no key
    }
    assert first["reasons"] == ["field.redacted:password", "pii.redacted:email"]
    assert second["doc_out"] == '{"msg":"fine"}' and second["reasons"] == []  # absent keys stay absent


def test_nested_columns_and_maps(spark):
    df = spark.createDataFrame(
        [({"Auth_Code": "x", "note": "a@b.com", "void": None}, None)],
        "m map<string,string>, s struct<email:string>",
    )
    row = redact.redact_nested(df, "m").first()
    assert row["m_out"] == {"Auth_Code": "<PASSWORD>", "note": "a***@b.com", "void": None}
    assert row["reasons"] == ["field.redacted:password", "pii.redacted:email"]
    empty = redact.redact_nested(df, "s").first()
    assert empty["s_out"] is None and empty["reasons"] == []


def test_paths(spark):
    doc = json.dumps({"user": {"email": "a@b.com", "age": 7, "ok": True}, "note": "n"})
    payloads = spark.createDataFrame(
        [(1, doc, {"PII:e": "tokenize", "PII:p": "pass_through"}), (2, doc, {}), (3, doc, {})],
        "id int, doc string, allow map<string,string>",
    )
    findings = spark.createDataFrame(
        [
            (1, 0, "PII:e", "$.user.email"),
            (1, 1, "PII:e", "$.user.ok"),
            (1, 2, "PII:p", "$.gone"),
            (1, 3, "PII:x", "$.gone"),
            (1, 4, "PII:x", "user.email"),
            (2, 0, "PII:x", "$.user.email"),
            (2, 1, "PII:x", "$.user.age"),
            (2, 2, "PII:x", "$.user"),
        ],
        "id int, ord int, type string, path string",
    )
    rows = {
        r["id"]: (json.loads(r["doc_out"]), r["reasons"])
        for r in redact.redact_paths(payloads, findings, "id", "doc", "allow").collect()
    }
    assert rows[1] == (
        {"user": {"email": tok("a@b.com"), "age": 7, "ok": tok("True")}, "note": "n"},
        ["pii.tokenized:PII:e", "pii.tokenized:PII:e", "pii.allowed:PII:p"],
    )
    assert rows[2] == ({"user": "<REDACTED>", "note": "n"}, ["pii.redacted:PII:x"] * 3)
    assert rows[3] == (json.loads(doc), [])


def test_hmac(spark):
    import hmac

    for key in ("k", "long" * 40):
        row = spark.range(1).select(X.hmac_sha256(key, F.lit("müsli")).alias("h")).first()
        assert row["h"] == hmac.new(key.encode(), "müsli".encode(), hashlib.sha256).hexdigest()


def test_redact_nested_leaves_nothing_unread(spark):
    docs = ['{"a":"mail nadia@mill.test"}', '{"a":5}', '{"a":["x","nadia@mill.test"]}', "nadia@mill.test {", '["nadia@mill.test"]']
    out = redact.redact_nested(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()
    assert all("nadia@mill.test" not in (r["doc_out"] or "") for r in out)
    assert [bool(r["reasons"]) for r in out] == [True, False, True, True, True]
    assert out[1]["doc_out"] == '{"a":5}'


def nested(spark, *docs):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    return [(r["doc_out"], r["reasons"]) for r in redact.redact_nested(rows, "doc").orderBy("i").collect()]


def test_nested_text_keeps_what_it_does_not_redact(spark):
    doc = '{ "n" : 1.50, "k\\"ey":[ {"pass\\u0077ord" : "x\\"y"}, null ], "late": {"new": "a\\u0062c" } }'
    (out, reasons), = nested(spark, doc)
    assert out == doc.replace('"x\\"y"', '"<PASSWORD>"') and reasons == ["field.redacted:password"]


def test_nested_text_that_is_no_document_is_masked_whole(spark):
    docs = ['{"a":1} nadia@mill.test', '{"a":1} 555-201-7788', '{"a":"nadia@mill.test","a":2}', "{'a':'nadia@mill.test'}",
            '[1],["nadia@mill.test"]', "5552017788", "", "null"]
    for out, _ in nested(spark, *docs):
        assert "nadia" not in out and "7788" not in out
    assert nested(spark, None, "", "[]") == [(None, []), ("", []), ("[]", [])]


def test_nested_long_strings(spark):
    (out, reasons), = nested(spark, json.dumps({"a": "\n\"x " * 200_000 + "nadia@mill.test"}))
    assert json.loads(out)["a"].endswith("n***@mill.test") and reasons == ["pii.redacted:email"]


def test_variants(spark):
    df = spark.createDataFrame([('{"a":[{"secret_password":"x"},"nadia@mill.test",5]}',), ('"nadia@mill.test"',), ("5",), (None,)], "t string")
    out = redact.redact_nested(df.selectExpr("parse_json(t) AS v"), "v").selectExpr("to_json(v_out) AS t").collect()
    assert [r["t"] for r in out] == ['{"a":[{"secret_password":"<PASSWORD>"},"n***@mill.test",5]}', '"n***@mill.test"', "5", None]


def test_paths_without_schema(spark):
    docs = {
        1: ('{ "a": {"b" : 7.50, "c":["x"]}, "extra": 1 }', ["$.a.b", "$.a.c", "$.gone"]),
        2: ('{"a":{"b":"nadia@mill.test"},"x.y":"q"}', ["$.a.b", "$.a", "$.x.y"]),
        3: ('["nadia@mill.test"]', ["$.a"]),
        4: ("nadia@mill.test {", ["$.a"]),
        5: (None, ["$.a"]),
        6: ('{"a":{"a":{"b":null}}}', ["$.a.a.b", "$.a.b"]),
    }
    payloads = spark.createDataFrame([(i, d, {}) for i, (d, _) in docs.items()], "id int, doc string, allow map<string,string>")
    findings = [(i, n, f"t{n}", p) for i, (_, paths) in docs.items() for n, p in enumerate(paths)]
    found = spark.createDataFrame(findings, "id int, ord int, type string, path string")
    rows = redact.redact_paths(payloads, found, "id", "doc", "allow").collect()
    assert {r["id"]: (r["doc_out"], r["reasons"]) for r in rows} == {
        1: ('{ "a": {"b" :"<REDACTED>", "c":"<REDACTED>"}, "extra": 1 }', ["pii.redacted:t0", "pii.redacted:t1"]),
        2: ('{"a":"<REDACTED>","x.y":"q"}', ["pii.redacted:t0", "pii.redacted:t1"]),
        3: ('["nadia@mill.test"]', []),
        4: ("n***@mill.test {", []),
        5: (None, []),
        6: ('{"a":{"a":{"b":null}}}', []),
    }


def test_types_of_ones_own(spark):
    table = spark.createDataFrame(
        [("b", "[0-9]+", 0.5, 2, None, None), ("a", "x[0-9]", 0.5, 1, None, "<A>")],
        "type string, pattern string, score double, priority int, validator string, placeholder string",
    )
    specs = detect.pattern_specs(table)
    assert [s.pii_type for s in specs] == ["a", "b"]
    found = detect.scan_findings(spark.createDataFrame([("x1 22",)], "t string"), "t", specs)
    assert redact.redact_placeholders(found, "t", specs=specs).first()["redacted"] == "<A> <USER_B>"


def test_collisions_are_dealt_out_once(spark):
    rows = [(f"v{i % 70}", f"t{i % 70 // 2 if i % 70 < 20 else i % 70}") for i in range(700)] + [(None, "t99"), ("x", "t99"), ("x", None), ("y", None)]
    df = spark.createDataFrame(rows, "v string, t string")
    for parts in (None, 3):
        out = redact.token_collisions(df, "v", "t", parts)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
        want = df.filter("v IS NOT NULL").groupBy("t").agg(F.countDistinct("v").alias("n")).filter("n > 1")
        assert sorted(out.collect(), key=str) == sorted(want.collect(), key=str)
        assert out.schema["n_values"].dataType.simpleString() == "bigint"
