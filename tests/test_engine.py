"""Detectors, linking, replacement and checks on the inputs that define them."""

import base64
import hashlib
import hmac
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from maskloom.functions import keys, text
from maskloom.operators import compose, detect, evaluate, link, names, plan, pseudonyms, verify
from maskloom.plans.redaction import redact, spans_of
from maskloom.schema import Config, load, merged

CASES = {
    "email": [("john.doe@example.com", 1), ("user+tag@sub.example.co.uk", 1), ('"odd..name"@Example.ORG', 1), ("(john@example.org),", 1), ("john@example", 0), ("foo@-example.com", 0), ("foo@bar.c", 0), ("foo @example.com", 0)],
    "phone": [("415-555-2671", 1), ("+1 (212) 555-0000 ext. 23", 1), ("(650) 253-0000, (650) 253-0001", 2), ("+49 89 636-48018;", 1), ("020 7946 0958", 0), ("2020-12-31", 0), ("03/04/2021", 0), ("SSN 123-45-6789", 0), ("4111 1111 1111 1111", 0), ("No. 1234", 0), ("4155550000@example.com", 0)],
    "account_ids": [("IBAN GB82 WEST 1234 5698 7654 32", 1), ("DEUTDEFF", 1), ("Routing number (ABA): 021000021", 1), ("4111 1111 1111 1111", 1), ("123-45-6789", 1), ("12-3456789", 1), ("Acct # 0034-567-89012", 1), ("Ref: 123-456", 1), ("bare 021000022", 1), ("acct abcdefghij", 0), ("Ref: 12-34", 0), ("2021-03-04", 0), ("1,234.56", 0)],
    "bank_org": [("Chase Bank, N.A.", 1), ("Bank of Example, N.A.", 1), ("Acme Credit Union", 1), ("State Street Bank & Trust Company", 1), ("The Food Bank gives", 0), ("your bank account number", 0), ("Bank holiday today", 0)],
    "date_dob": [("DOB: 03/18/1976", 1), ("Born on May 9, 1960", 1), ("Date of Birth:\nMay 9, 1960", 1), ("DOB 03/18/1976", 1), ("Executed on May 9, 1960", 0), ("DOB: February 29, 2021", 0)],
    "date_generic": [("May 9, 1960 and 9 May 1960", 2), ("2020-01-02", 1), ("3/4/2020", 1), ("February 29, 2021", 1), ("12 apples", 0)],
    "aliases": [('John Doe, hereinafter "Morgan", agrees', 1), ('Acme LLC (hereinafter referred to as "Seller")', 1), ('Jane Smith, a/k/a "Janie"', 1), ("shall hereinafter be referred to as the institution", 0)],
    "address_line": [("366 Broadway", 1), ("1600 Pennsylvania Ave NW", 1), ("P.O. Box 123", 1), ("San Francisco, CA 94105", 1), ("Suite 210", 1), ("Apt 5B", 1), ("Address: 123 Main St", 1), ("Bank of Example, N.A.", 0), ("Main Street", 0)],
}
DOC = """Signed by John Doe, hereinafter "Morgan", of Acme LLC.

Address: 123 Main St
Suite 210

San Francisco, CA 94105

Morgan agrees. DOB: 03/18/1976. E-mail john.doe+x@acme.com, phone (650) 253-0000, card 4111 1111 1111 1111.
IBAN GB82 WEST 1234 5698 7654 32, Routing number (ABA): 021000021, SSN 123-45-6789. At Chase Bank, N.A."""


@pytest.mark.parametrize("name", CASES)
def test_detectors(spark, name):
    df = spark.createDataFrame([(t, n) for t, n in CASES[name]], "text string, n int")
    for r in df.select("text", "n", detect.detect("text", Config(), (name,)).alias("s")).collect():
        assert all(r.text[s.start : s.end] == s.text for s in r.s)
        assert len(r.s) == r.n or r.text.startswith("bare"), (r.text, [s.text for s in r.s])


def test_addresses_in_long_lines(spark):
    rest = " is where the parties of this agreement met" * 9
    starts = ["123 Main St", "P.O. Box 12", "1600 Pennsylvania Ave NW"]
    df = spark.createDataFrame([(i, f"{a}{rest}\nnext line") for i, a in enumerate(starts)] + [(3, f"Address: 123 Main St{rest}"), (4, f"Main Street{rest}")], "doc_id long, text string")
    found = {r.doc_id: [s.text for s in r.s] for r in df.select("doc_id", detect.detect("text", Config(), ("address_line",)).alias("s")).collect()}
    assert found == {i: [a] for i, a in enumerate(starts)} | {3: ["123 Main St"], 4: []}
    assert all(a not in r.redacted for r, a in zip(redact(df, Config(secret="k")).orderBy("doc_id").collect(), starts))


@pytest.fixture(scope="module")
def redacted(spark):
    df = spark.createDataFrame([(1, DOC), (2, None), (3, ""), (4, DOC)], "doc_id long, text string")
    return {r.doc_id: r for r in redact(df, Config(secret="k")).collect()}


def test_redaction(redacted):
    r = redacted[1]
    assert redacted[4].redacted == r.redacted and redacted[2].redacted == redacted[3].redacted == ""
    assert r.report.residual_count == 0
    by = {(e.label, e.original): e.replacement for e in r.plan}
    assert {"PERSON", "ORG", "BANK_ORG", "ALIAS_LABEL", "EMAIL", "PHONE", "DOB", "ADDRESS_BLOCK", "ACCOUNT_ID"} <= {k[0] for k in by}
    assert all(k[1] != v for k, v in by.items()) and not any(k[1] in r.redacted for k in by)
    ends = [(e.start, e.end) for e in sorted(r.plan)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert len(r.redacted) == len(r.norm) + sum(len(e.replacement) - (e.end - e.start) for e in r.plan)
    assert by["PHONE", "(650) 253-0000"][6:9] == "555" and by["EMAIL", "john.doe+x@acme.com"].endswith("+x@example.org")
    assert by["ADDRESS_BLOCK", "123 Main St\nSuite 210\n\nSan Francisco, CA 94105"].count("\n") == 3
    assert by["ALIAS_LABEL", "Morgan"] == by["PERSON", "John Doe"].split()[0]
    assert r.redacted.count(by["ALIAS_LABEL", "Morgan"]) >= 2


def test_plan_errors_and_idempotence(spark):
    kind = "text string, plan array<struct<start:int,end:int,original:string,replacement:string,label:string,subtype:string,source:string,entity_id:string,skip:boolean>>"
    entry = lambda a, b, r: (a, b, "", r, "PERSON", None, "x", None, False)
    run = lambda t, p: spark.createDataFrame([(t, p)], kind).select(plan.applied(F.col("text"), F.col("plan"))).first()[0]
    assert run("AliceBob", [entry(5, 8, "Y"), entry(0, 5, "Xx")]) == "XxY" and run("a", []) == "a"
    assert run("XxY", [entry(0, 5, "Xx"), entry(5, 8, "Y")]) == "XxY"
    for bad in ([entry(0, 5, "X"), entry(4, 8, "Y")], [entry(0, 50, "X")]):
        with pytest.raises(Exception, match="plan entr"):
            run("AliceBob", bad)


def test_keys(spark):
    r = spark.range(1).select(keys.hmac_sha256(F.lit("hé"), "sec").alias("h"), keys.luhn_completed(F.lit("411111111111111")).alias("l"), keys.iban_completed(F.lit("GB"), F.lit("WEST12345698765432")).alias("i"), keys.poured(F.lit("1-2"), F.lit("98")).alias("p")).first()
    assert r.h == hmac.new(b"sec", "hé".encode(), hashlib.sha256).hexdigest()
    assert (r.l, r.i, r.p) == ("4111111111111111", "GB82WEST12345698765432", "9-8")


def test_text(spark):
    df = spark.createDataFrame([("A​ B co-\noperate café\r\nx\n",)], "t string")
    r = df.select(text.normalized(compose.composed(F.col("t"))).alias("n"), F.size(text.lines(F.col("t"))).alias("k"), *(text.match_case(F.lit(a), F.lit(b)) for a, b in (("McDONALD", "Smithson"), ("UP", "low")))).first()
    assert tuple(r) == ("A B cooperate café\r\nx\n", 3, "SmITHSON", "LOW")
    for a, b, c in (("SMITH-JONES", "Carter Green", "CARTER-GREEN"), ("O'NEIL", "Dangelo", "D'ANGELO"), ("John's", "Alex", "Alex's"), ("J. D.", "Alex Carter", "A. C.")):
        assert compose.shaped_like(a, b) == c
    assert compose.with_map("co-\noperate") == ("cooperate", [0, 1, *range(4, 11)])


def test_names(spark):
    good, bad = ["J. D. Salinger", "Ludwig van Beethoven", "JOHN DOE"], ["Buyer", "Bank of America", "UNITED STATES", "Section 2.1"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", names.score(F.col("t"))).collect()}
    assert all(got[x] >= names.LEAST for x in good) and all(got[x] < names.LEAST for x in bad), got


def test_evaluation(spark):
    span = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([(1, [(0, 10, "DOB"), (20, 30, "EMAIL")], [(0, 12, "DATE_GENERIC"), (20, 30, "EMAIL"), (50, 60, "PHONE")])], f"doc_id long, gold {span}, found {span}")
    rows = evaluate.outcomes(df)
    assert sorted(map(str, ((r.gold, r.found) for r in rows.collect()))) == sorted(map(str, [("DOB", "DATE_GENERIC"), ("EMAIL", "EMAIL"), (None, "PHONE")]))
    total = {r.label: r for r in evaluate.prf(rows).collect()}[None]
    assert (total.tp, total.fp, total.fn) == (1, 2, 1)
    texts = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    assert evaluate.variants(texts, 4, 1).collect() == evaluate.variants(texts, 4, 1).collect()


def test_audit_summary(spark):
    df = spark.createDataFrame([(1, "EMAIL", 3, False, 0), (1, "EMAIL", -1, True, 2), (1, "PHONE", 0, False, 1), (2, "PHONE", 5, False, 0)], "doc_id long, label string, length_delta int, skip_replacement boolean, safety_retries int")
    assert {tuple(r) for r in verify.audit_summary(df).collect()} == {("EMAIL", 2, 2, 1, 2, 1), ("PHONE", 2, 5, 0, 1, 1), (None, 4, 7, 1, 3, 2)}
    by_doc = {tuple(r) for r in verify.audit_summary(df, "doc_id").collect()}
    assert by_doc == {(1, "EMAIL", 2, 2, 1, 2, 1), (1, "PHONE", 1, 0, 0, 1, 1), (1, None, 3, 2, 1, 3, 2), (2, "PHONE", 1, 5, 0, 0, 0), (2, None, 1, 5, 0, 0, 0)}


def test_configuration(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("ner: false\nprecedence: [EMAIL, PHONE]\n")
    cfg = load(str(path), env={"MASKLOOM_SECRET": "s"})
    assert not cfg.ner and cfg.secret == "s" and cfg.precedence == ("EMAIL", "PHONE") and "s'" not in repr(cfg)
    assert merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    for bad in ({"min_confidence": 1.1}, {"nonsense": 1}):
        with pytest.raises(ValueError):
            load(overrides=bad)


MORE = {
    "email": [("user+tag@sub.example.co.uk", ["user+tag@sub.example.co.uk"]), ('"odd..name"@Example.ORG', ['"odd..name"@Example.ORG']), ("(john@example.org),", ["john@example.org"]), ("john..doe@example.com", []), ("john.@example.com", []), (".john@example.com", []), ("foo@example-.com", []), ("a@b.co.x1 and c@d.org.", ["a@b.co", "c@d.org"])],
    "bank_org": [("Chase Bank, N.A. lends", ["Chase Bank, N.A."]), ("Citibank, N.A. lends", ["Citibank, N.A."]), ("Example Trust Company", ["Example Trust Company"]), ("Standard Chartered Bank PLC and us", ["Standard Chartered Bank PLC"]), ("State Street Bank & Trust Company", ["State Street Bank & Trust Company"]), ("the bank shall pay", []), ("First National Bank of Ohio, National Association.", ["First National Bank of Ohio, National Association"])],
    "ner_regex": [("John Doe executed this with Acme LLC.", ["John Doe", "Acme LLC"]), ("(John Doe), who", ["John Doe"]), ("Buyer", []), ("of Acme Inc. and Acme Inc", ["Acme Inc.", "Acme Inc"]), ("Mary-Jane O'Neill", []), ("at Springfield, IL since", ["Springfield, IL"]), ("Jean-Luc Picard's ship", ["Jean-Luc Picard"]), ("Anna-Maria Smith's ship", ["Anna-Maria Smith"])],
    "aliases": [('Acme LLC (hereinafter referred to as "Seller")', ["Seller"]), ('Jane Smith, a/k/a "Janie"', ["Janie"]), ("Robert Roe fka “Rob Roe”", ["Rob Roe"]), ("aka the party", []), ("“johnny”", []), ('John Doe\nHereinafter "Morgan" signs', ["Morgan"]), ('he is hereinafter "a long name of more than six words"', [])],
    "date_dob": [("D.O.B.—  03/18/1976. Executed on May 9, 1960", ["03/18/1976"]), ("DOB: February 29, 2021", []), ("born on May 9, 1960", ["May 9, 1960"])],
    "account_ids": [("Ref: 123-456", ["123-456"]), ("Account: 1234 5678", ["1234 5678"]), ("eIBAN 12345678", ["12345678"])],
}


@pytest.mark.parametrize("name", MORE)
def test_what_detectors_find(spark, name):
    df = spark.createDataFrame(MORE[name], "text string, want array<string>")
    for r in df.select("text", "want", detect.detect("text", Config(), (name,)).alias("s")).collect():
        assert [s.text for s in r.s if s.subtype != "swift_bic"] == r.want, r.text


def test_alias_subjects(spark):
    texts = ['John Doe, hereinafter "Morgan", agrees', 'John Doe\nHereinafter "Morgan" signs', 'We, the undersigned,\n\nJohn Doe of Acme\n\nand hereafter "Morgan" signs', 'nobody\nhereinafter "Morgan" signs']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.s[0] for r in df.select("id", detect.detect("text", Config(), ("aliases",)).alias("s")).collect()}
    pick = lambda i: (got[i].confidence, got[i].attrs["subject_text"], got[i].attrs["subject_guess"], got[i].attrs["subject_guess_line"])
    assert [pick(i) for i in range(4)] == [(0.99, "John Doe", None, None), (0.97, None, "John Doe", "0"), (0.97, None, "John Doe of Acme", "2"), (0.95, None, None, None)]
    spans = {r.id: r.spans for r in spans_of(df, Config(), "text").collect()}
    person, alias = ({s.label: s for s in spans[2]}[x] for x in ("PERSON", "ALIAS_LABEL"))
    assert person.text == "John Doe" and alias.entity_id == person.entity_id


def test_a_half_replaced_name_is_a_leak(spark):
    """What is left of a name stands beside the pseudonym: the finding meets a replaced place but isn't inside it."""
    plan_of = lambda start, end, new: [(start, end, "Smith", new, "PERSON", None, "x", None, False, 0, None)]
    kind = "text string, plan array<struct<start:int,end:int,original:string,replacement:string,label:string,subtype:string,source:string,entity_id:string,skip:boolean,retries:int,reason:string>>"
    rows = [("we saw Mary Alice Jones there", plan_of(12, 17, "Alice")), ("we saw Alice Jones there", plan_of(7, 12, "Alice Jones")), ("so we saw Alice Jones Ray", plan_of(10, 20, "Alice Jones"))]
    got = verify.scan(spark.createDataFrame(rows, kind), "text", "plan", Config()).select("text", "findings", "report").collect()
    assert [(r.report.residual_count, r.report.score, [f.ignored for f in r.findings]) for r in got] == [(1, 3.0, [None]), (0, 0.0, ["replacement_match"]), (1, 3.0, [None])]
    text = "Email john@acme.com, Phone +12125550000, SSN 123-45-6789. John Doe signed."
    r = verify.scan(spark.createDataFrame([(text,)], "text string"), "text", None, Config(min_confidence=0.0)).first()
    assert {f.label: f.ignored for f in r.findings} == {"EMAIL": None, "PHONE": None, "ACCOUNT_ID": None, "PERSON": None} and r.report.score == 11.0


def test_safety(spark):
    """Draws that are rejected are counted with their reason, and a name that nothing can replace gets a placeholder."""
    texts = ["We met Of Of today", "mail me@acme.com or call +1 (650) 253-0000; SSN 123-45-6789, card 4111 1111 1111 1111, EIN 12-3456789"]
    rows = redact(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), Config(secret="k")).orderBy("doc_id").collect()
    (entry,) = rows[0].plan
    assert entry.replacement.startswith("PERSON_") and (entry.retries, entry.reason) == (3, "matches_source")
    assert len(rows[1].plan) == 5 and all(e.retries == 0 and e.reason is None and e.replacement != e.original for e in rows[1].plan)
    kinds = "label string, subtype string, text string, x string, want string"
    bad = [("EMAIL", None, "a@b.com", "a@b.com", "matches_source"), ("EMAIL", None, "a@b.com", "c@evil.com", "unsafe_domain"), ("EMAIL", None, "a@b.com", "@example.org", "empty_local"), ("EMAIL", None, "a@b.com", "c@bé.org", "non_ascii_domain"), ("PHONE", None, "650-253-0000", "650-253-0001", "unsafe_non_555"), ("PHONE", None, "650-253-0000", "650-555-00012", "invalid_digit_count"), ("ACCOUNT_ID", "cc", "4111111111111111", "4440001234567891", "luhn_invalid"), ("ACCOUNT_ID", "routing_aba", "021000021", "021000022", "aba_invalid"), ("ACCOUNT_ID", "ssn", "123-45-6789", "666-45-6789", "ssn_invalid"), ("ACCOUNT_ID", "swift_bic", "DEUTDEFF", "DEUT DEF", "unsafe_bic"), ("PERSON", None, "John", "Avery", None)]
    df = spark.createDataFrame(bad, kinds)
    assert [r[0] for r in df.select(pseudonyms.unsafe(F.struct("label", "subtype", "text"), F.col("x"))).collect()] == [b[4] for b in bad]


def test_many_spans_in_one_text(spark):
    """Twenty thousand addresses in one text: plan, application and second scan take seconds."""
    import time

    text = " ".join(f"user{i}@acme{i % 7}.com" for i in range(20_000))
    began = time.time()
    r = redact(spark.createDataFrame([(1, text)], "doc_id int, text string"), Config(secret="k", detectors=("email",))).select("redacted", "report", F.size("plan").alias("n")).first()
    assert r.n == 20_000 and r.report.residual_count == 0 and "acme" not in r.redacted and time.time() - began < 60


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"mail jo{i}@acme.com") for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    done = redact(spark.read.parquet(str(tmp_path / "t")), Config(secret="k")).where("doc_id = 5").select("doc_id", "redacted")
    assert "EqualTo(doc_id,5)" in done._jdf.queryExecution().executedPlan().toString() and done.count() == 1


def test_own_detector_and_model(spark):
    """A pandas UDF in a detector of one's own, and one that clusters mentions."""
    import pandas as pd

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def words(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": m.start(), "end": m.end()} for m in re.finditer("secret-[0-9]+", t)])

    def find(text, cfg):
        m = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substr(text, x["start"] + 1, x["end"] - x["start"]).alias("text"))
        return F.transform(words(text), lambda x: detect.span(m(x), "OTHER", "own", 0.9))

    before = list(detect.REGISTRY)
    try:
        detect.register(detect.Detector("own", find))
        df = spark.createDataFrame([("a secret-12 b",)], "text string")
        assert [s.text for s in df.select(detect.detect("text", Config(), ("own",)).alias("s")).first().s] == ["secret-12"]
    finally:
        detect.REGISTRY[:] = before

    @F.pandas_udf("array<array<struct<start:int,end:int>>>")
    def mentions(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [[{"start": m.start(), "end": m.end()} for m in re.finditer(r"\bMr Doe|John Doe|\bhe\b", t)]])

    text = "John Doe came. Then Mr Doe said that he left. Mary Roe stayed."
    r = redact(spark.createDataFrame([(text,)], "text string"), Config(), check=False, coref=mentions).first()
    ids = {s.text: s.entity_id for s in r.spans}
    assert ids["John Doe"] == ids["Then Mr Doe"] != ids["Mary Roe"]


def test_variants(spark):
    texts = spark.createDataFrame([(i, DOC) for i in range(4)] + [(9, None)], "doc_id int, text string")
    got = evaluate.variants(texts, 6, 1).collect()
    assert len(got) == 30 and len({r.text for r in got}) > 15 and {r.text for r in got if r.doc_id == 9} == {""}
    assert sorted(map(tuple, got)) == sorted(map(tuple, evaluate.variants(texts.repartition(3), 6, 1).collect()))
    for r in got:
        key, want = hashlib.sha256(f"1:{r.doc_id}:{r.variant}".encode()).hexdigest(), "" if r.doc_id == 9 else DOC
        for k, (rx, choices) in enumerate(evaluate.CHANGES):
            if int(key[4 * k : 4 * k + 2], 16) % 2 == 0:
                want = re.sub(rx, choices[int(key[4 * k + 2 : 4 * k + 4], 16) % len(choices)].replace("$1", r"\1").replace("$2", r"\2"), want)
        assert r.text == want


def test_nfc(spark):
    """Composition against Unicode's own: Latin with up to three marks, kana, Indic and Arabic letters, Hangul, singletons."""
    plain = ["café \u1e69 \u01d7 \u1ed9 q\u0323\u0307", "がぎぐげごパピプ ヴ", "한국어 각 뷁 가나다 힣", "\u0958 \u09cb \u0bca \u0cca \u0d4a \u0623 \u0624 \u0626", "\u212b \u2126 \u212a \u1fbe \uf900 \u037e \U0002f800", "\u2260 \u226e \u2204", "x" * 50, "", "\u1112\u1161\u11ab\u1100\u1173\u11af jamo"]
    texts = plain + [unicodedata.normalize("NFD", t) for t in plain]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", compose.composed(F.col("t")).alias("n")).collect()}
    assert got == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_places_and_ids(spark):
    r = spark.range(1).select(text.line_col(F.array(F.lit(0), F.lit(4), F.lit(9)), F.lit(6)).alias("p"), F.length(keys.stable_id("k", F.lit("x"), F.lit("GLOBAL"), None, 52)).alias("n")).first()
    assert (r.p.line, r.p.col, r.n) == (1, 2, 52)
    whole = base64.b32encode(hashlib.sha256(b"x").digest()).decode().lower().rstrip("=")
    assert spark.range(1).select(keys.base32(F.sha2(F.lit("x"), 256), 52)).first()[0] == whole
    with pytest.raises(ValueError):
        keys.stable_id("k", F.lit("x"), F.lit("GLOBAL"), None, 53)
    assert [detect.region_of(x) for x in ("en_US", "en-GB", "US", "en", "xx_ZZ")] == ["US", "GB", "US", None, None]


def test_evaluation_of_texts(spark):
    gold = "array<struct<start:int,end:int,label:string,subtype:string>>"
    rows = [(1, "mail jo@acme.com, SSN 123-45-6789", [(5, 16, "EMAIL", None), (22, 33, "ACCOUNT_ID", "ssn")]), (2, "call +1 650 253 0000", [(5, 20, "PHONE", None)]), (3, "DOB: 03/18/1976", [(5, 15, "DOB", None)])]
    df = spark.createDataFrame(rows, f"doc_id int, text string, gold {gold}")
    by = {r.label: r for r in evaluate.prf(evaluate.evaluated(df, fine=True)).collect()}
    assert all((by[x].tp, by[x].fp, by[x].fn) == (1, 0, 0) for x in ("EMAIL", "PHONE", "ACCOUNT_ID:ssn"))
    assert by["DOB"].tp + by["DOB"].fn == 1 and by[None].fn == by["DOB"].fn
    s = {r.average: r for r in evaluate.summary(evaluate.prf(evaluate.evaluated(df)).where("label is null or label in ('EMAIL', 'PHONE')")).collect()}
    assert s["macro"].f1 == 1.0 and 0 < s["micro"].f1 <= 1
    assert "ACCOUNT_ID" in {r.gold_label for r in evaluate.confusion(evaluate.evaluated(df)).collect()}


def test_drawn_values_are_made_once(spark):
    """An expression repeated in a lambda is computed for each element: what is drawn must stand once in what is built."""
    seed = F.col("seed")
    made = {"routing": pseudonyms.routing(F.lit("021000021"), seed), "phone": pseudonyms.phone(F.lit("(650) 253-0000"), seed), "date": pseudonyms.date(F.lit("May 9, 1960"), seed)}
    assert {name: str(c).count("sha2(") for name, c in made.items()} == {"routing": 2, "phone": 7, "date": 3}


def test_a_plus_begins_a_phone_number(spark):
    """Digits before a number may be its own, but not before a plus."""
    rows = ["44.144.126.223 +1 (906) 555-7738 Th", "card 4387393285946913 +1 (438) 555-5817", "4111 (222) 333-4444", "a+1 (906) 555-7738"]
    df = spark.createDataFrame([(t,) for t in rows], "text string").select(F.transform(detect.detect("text", Config(), ("phone",)), lambda s: s["text"]).alias("s"))
    assert [r.s for r in df.collect()] == [["+1 (906) 555-7738"], ["+1 (438) 555-5817"], [], []]


def test_long_runs_need_no_stack(spark):
    """Thousands of words with capitals in a row, and of characters in quotes, in a thread's usual stack."""
    n = 6000
    rows = ["De " * n, "Acme, " * n + "Chase Bank", '"' + "x" * 40000 + '"@example.com', "Lora " * 11 + "Zugeü und"]
    count = lambda d: F.size(detect.detect("text", Config(), (d,))).alias(d)
    df = spark.createDataFrame([(t,) for t in rows], "text string").select(*map(count, ("ner_regex", "bank_org", "email")))
    got = df.collect()
    assert got[0].ner_regex == n // 4 and got[1].bank_org == 1 and got[2].email == 1
    assert got[3].ner_regex == 3  # four, four and three: the last is followed by a word that is no name


def test_every_phone_pseudonym_is_found_again(spark):
    """Whatever digits it has and whatever stands next to it: each is a finding that is ours, and nothing else is left."""
    n = 40
    rows = [(i, f"call +1 (4{i:02}) 555-58{i:02} or {'x' * i}y@acme.com now") for i in range(n)] + [(i, f"+1 (438) 555-5{i} {'q' * (i - 99)}@acme.com") for i in range(100, 130)]
    rows.append((999, " and ".join(f"+1 (43{i % 10}) 555-{2000 + i}" for i in range(300))))
    out = redact(spark.createDataFrame(rows, "doc_id int, text string"), Config(detectors=("email", "phone")))
    of = lambda c: F.sort_array(F.transform(F.filter(c, lambda x: x["label"] == "PHONE"), lambda x: F.coalesce(x["text" if c == "findings" else "replacement"], F.lit(""))))
    ignored = F.array_distinct(F.transform("findings", lambda f: f["ignored"]))
    got = out.select("doc_id", of("findings").alias("again"), of("plan").alias("made"), ignored.alias("ignored"), "report.residual_count").collect()
    assert all(r.again == r.made and r.made and r.ignored == ["replacement_match"] and r.residual_count == 0 for r in got)
