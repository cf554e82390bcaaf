"""Queries over the test tables, one for each group of operators, and the SQL that gives the same rows where there is such.

The documents hold e-mail addresses, phone and card numbers; what they don't hold is looked for in texts made of the columns of
other tables (``shapes``), the same in both. The SQL is in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import compose, detect, evaluate, link, names, plan, pseudonyms, verify
from ..schema import Config
from ..streaming.redaction import stream_files
from . import shapes
from .oracles import ORACLE_SQL  # noqa: F401
from .redaction import coverage, redact, spans_of

CFG = Config()
#: A run that looks for e-mail addresses alone: SQL can follow it from the text to the audit.
EMAILS = Config(detectors=("email",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(df: DataFrame, detector: str, cfg: Config = CFG) -> DataFrame:
    """The spans of one detector, a row each."""
    df = text.step(df.select("id", "text"), "s", detect.detect("text", cfg, (detector,)))
    one = lambda s: text.record(start=s["start"], end=s["end"], found=s["text"], label=s["label"], subtype=s["subtype"], normalized=s["attrs"]["normalized"])
    return df.select("id", F.inline(F.transform("s", one)))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def made(spark: SparkSession, d: str, name: str, key: str, expression: str) -> DataFrame:
    return table(spark, d, name).select(F.col(key).alias("id"), F.expr(expression).alias("text"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    norm = text.normalized(compose.composed(F.coalesce("text", F.lit(""))))
    return texts(spark, d).select("id", norm.alias("norm"), (norm != F.coalesce("text", F.lit(""))).alias("changed"))


def line_index(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", F.posexplode(text.lines(F.col("text"))).alias("line", "x")).select("id", "line", "x.start", "x.end")


def email_spans(spark: SparkSession, d: str) -> DataFrame:
    return found(texts(spark, d), "email").select("id", "start", "end", "found", "normalized")


def email_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    return found(texts(spark, d), "email").groupBy(F.substring_index("normalized", "@", -1).alias("domain")).agg(F.count("*").alias("n"))


def phone_spans(spark: SparkSession, d: str) -> DataFrame:
    return found(texts(spark, d), "phone").select("id", "start", "end", "found")


def account_spans(spark: SparkSession, d: str) -> DataFrame:
    return found(texts(spark, d), "account_ids")


def card_spans(spark: SparkSession, d: str) -> DataFrame:
    return account_spans(spark, d).where("subtype = 'cc'").select("id", "start", "end", "normalized")


def card_scheme_counts(spark: SparkSession, d: str) -> DataFrame:
    spans = text.step(texts(spark, d), "s", detect.detect("text", CFG, ("account_ids",))).select(F.inline("s"))
    return spans.where("subtype = 'cc'").groupBy(F.col("attrs")["scheme"].alias("scheme"), F.col("attrs")["length"].cast("int").alias("length")).agg(F.count("*").alias("n"))


def email_attrs(spark: SparkSession, d: str) -> DataFrame:
    spans = text.step(texts(spark, d), "s", detect.detect("text", CFG, ("email",))).select("id", F.inline("s"))
    return spans.select("id", "start", *(F.col("attrs")[c].alias(c) for c in ("local", "domain", "base_local", "tag", "tld")))


def of_shapes(spark: SparkSession, d: str, made: shapes.Made, detector: str, *columns: str) -> DataFrame:
    return found(made.texts(spark, d), detector).select("id", "start", "end", "found", *columns)


def ssn_spans(spark: SparkSession, d: str) -> DataFrame:
    df = made(spark, d, "orders", "o_orderkey", "concat('SSN ', lpad(o_orderkey % 1000, 3, '0'), '-', lpad(o_custkey % 100, 2, '0'), '-', lpad(o_orderkey % 10000, 4, '0'), ' on file')")
    return found(df, "account_ids").where("subtype = 'ssn'").select("id", "start", "end", "normalized")


def ssn_ein_spans(spark: SparkSession, d: str) -> DataFrame:
    return of_shapes(spark, d, shapes.EINS, "account_ids", "subtype", "normalized")


def bic_spans(spark: SparkSession, d: str) -> DataFrame:
    return of_shapes(spark, d, shapes.BICS, "account_ids", "normalized")


def generic_id_spans(spark: SparkSession, d: str) -> DataFrame:
    return of_shapes(spark, d, shapes.GENERICS, "account_ids", "normalized")


def aba_spans(spark: SparkSession, d: str) -> DataFrame:
    df = made(spark, d, "orders", "o_orderkey", "concat('routing number ', lpad(o_orderkey * 7919 % 1000000000, 9, '0'))")
    return found(df, "account_ids").where("subtype = 'routing_aba'").select("id", "start", "end", "normalized")


def iban_valid(spark: SparkSession, d: str) -> DataFrame:
    """Right IBANs, and of every four rows three that are wrong: in a check digit, in the order of two digits, in their length."""
    k = F.col("c_custkey")
    right = keys.iban_completed(F.lit("DE"), F.lpad((k * 7 + 12).cast("string"), 18, "0"))
    wrong = F.when(k % 4 == 1, F.concat(F.substring(right, 1, 3), F.pmod(F.substring(right, 4, 1).cast("int") + 1, F.lit(10)).cast("string"), F.substring(right, 5, 40)))
    wrong = wrong.when(k % 4 == 2, F.concat(F.substring(right, 1, 20), F.substring(right, 22, 1), F.substring(right, 21, 1))).when(k % 4 == 3, F.concat(right, F.lit("0")))
    iban = F.coalesce(wrong, right)
    return table(spark, d, "customer").select(k.alias("id"), iban.alias("iban"), keys.iban_valid(iban).alias("valid"))


def generic_dates(spark: SparkSession, d: str) -> DataFrame:
    df = made(spark, d, "orders", "o_orderkey", "concat('Signed ', date_format(o_orderdate, 'MMMM d, yyyy'), ', due ', date_format(o_orderdate, 'yyyy-MM-dd'), ' or ', date_format(o_orderdate, 'MM/dd/yyyy'), '.')")
    return found(df, "date_generic").select("id", "start", "end", "found", "normalized")


def dob_spans(spark: SparkSession, d: str) -> DataFrame:
    return of_shapes(spark, d, shapes.BIRTHS, "date_dob", "normalized")


def bank_spans(spark: SparkSession, d: str) -> DataFrame:
    return of_shapes(spark, d, shapes.BANKS, "bank_org")


def address_lines(spark: SparkSession, d: str) -> DataFrame:
    return found(shapes.LINES.texts(spark, d), "address_line").select("id", "start", "end", "found", F.col("subtype").alias("kind"))


def address_blocks(spark: SparkSession, d: str) -> DataFrame:
    df = shapes.ADDRESSES.texts(spark, d)
    out = text.step(df, "found", detect.detect("text", CFG, ("address_line",))).select("id", F.inline(link.address_blocks(F.col("text"), F.col("found"))))
    return out.where("source = 'address_block_merge'").select("id", "start", "end", F.col("text").alias("found"))


def alias_links(spark: SparkSession, d: str) -> DataFrame:
    out = spans_of(shapes.ALIASES.texts(spark, d), CFG, "text").select("id", F.inline("spans")).where("label = 'ALIAS_LABEL'")
    return out.select("id", "start", "end", "source", F.col("text").alias("found"))


def alias_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How often each alias stands after its definition, and whether it and its subject have one entity."""
    out = spans_of(shapes.ALIASES.texts(spark, d), CFG, "text")
    subject = F.get(F.filter("spans", lambda s: s["label"].isin("PERSON", "ORG")), 0)["entity_id"]
    out = out.select("id", subject.alias("subject"), F.inline("spans")).where("label = 'ALIAS_LABEL'")
    return out.groupBy("id", F.col("text").alias("alias")).agg(F.count_if(F.col("source") == "alias_resolver").alias("mentions"), F.every(F.col("entity_id") == F.col("subject")).alias("joined"))


def alias_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Who is called what: names as text, since DuckDB and Spark hold lists apart."""
    out = link.clusters(spans_of(shapes.ALIASES.texts(spark, d), CFG, "text"), id_col="id").where("size(aliases) + size(role_aliases) > 0")
    return out.select("id", "primary_surface", "kind", F.array_join("aliases", "|").alias("aliases"), F.array_join("role_aliases", "|").alias("role_aliases"), "mentions")


def guard_filter(spark: SparkSession, d: str) -> DataFrame:
    out = text.step(shapes.GUARDED.texts(spark, d), "found", detect.detect("text", CFG, ("ner_regex", "address_line")))
    kept = out.select("id", F.inline(link.guarded(F.col("text"), F.col("found"), CFG)))
    return kept.select("id", "start", "end", F.col("text").alias("found"), "label")


def name_spans(spark: SparkSession, d: str) -> DataFrame:
    return of_shapes(spark, d, shapes.NAMES, "ner_regex", "label")


def document_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of the documents themselves, by label and text."""
    return found(texts(spark, d), "ner_regex").groupBy("label", "found").agg(F.count("*").alias("n"))


def name_scores(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr(shapes.SCORED.case("c_custkey"))
    parts = names.parsed(name)
    joined = [F.array_join(parts[c], " ").alias(c) for c in ("honorifics", "given", "particles", "surname", "suffixes")]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), names.score(name).alias("score"), (names.score(name) >= names.LEAST).alias("probable"), *joined)


def heading_ranges(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", F.inline(text.headings(F.col("text")))).select("id", "start", "end")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("id", F.inline(text.sentences(F.col("text")))).select("id", "start", "end")


def document_spans(spark: SparkSession, d: str) -> DataFrame:
    """All detectors over all documents, merged."""
    out = text.step(text.step(texts(spark, d), "found", detect.detect("text", CFG)), "spans", link.merged(F.col("found"), CFG))
    return out.select("id", F.inline("spans")).select("id", "start", "end", "label", "source")


def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    """The greedy choice among spans made of order keys: of equal ranges, of one within another, touching, in chains."""
    none = {"subtype": F.lit(None).cast("string"), "attrs": F.create_map().cast("map<string,string>"), "entity_id": F.lit(None).cast("string")}
    one = lambda m: text.record(**{c: F.expr(v).cast(t) for (c, t), v in zip(shapes.MERGED_COLUMNS, m)}, **none)
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(*map(one, shapes.MERGED)).cast(shapes.SPANS).alias("found"))
    return text.step(df, "spans", link.merged(F.col("found"), CFG)).select("id", F.inline("spans")).select("id", "start", "end", "label", "source")


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), keys.digest("entity", F.col("c_name"), F.lit("GLOBAL"), None).alias("digest"))


def entity_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), keys.stable_id("entity", F.col("c_name"), F.lit("GLOBAL"), "secret").alias("token"))


def pseudonym_kinds(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # a small file is one task, and to draw takes far longer than to deal the rows out
        df = df.repartition(2 * cores)
    df = text.step(df, "seed", keys.digest("PERSON", F.col("c_name"), F.lit("GLOBAL"), None))
    seed, p = F.col("seed"), pseudonyms
    made = {"person": (p.person, "John O'Neil Jr."), "org": (p.organisation, "Acme LLC"), "address": (p.address, "123 Main St, Springfield, IL 62704"), "phone": (p.phone, "(650) 253-0000")}
    made |= {"ssn": (p.ssn, "123-45-6789"), "routing": (p.routing, "021000021"), "date": (p.date, "May 9, 1960"), "bic": (p.bic, "DEUTDEFF")}
    return df.select("id", *(make(F.lit(source), seed).alias(name) for name, (make, source) in made.items()))


def match_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.match_case(F.col("p_brand"), F.col("p_name")).alias("cased"), text.case_of(F.col("p_name")).alias("kind"))


def shaped(spark: SparkSession, d: str) -> DataFrame:
    source, other = F.expr(shapes.SHAPED.case("p_partkey", 0)), F.expr(shapes.SHAPED.case("p_partkey", 1))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), compose.format_like(source, other).alias("shaped"))


def run(spark: SparkSession, d: str, cfg: Config = CFG, check: bool = True) -> DataFrame:
    return redact(table(spark, d, "documents").select("doc_id", "text"), cfg, check=check)


def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d).select("doc_id", "redacted", "report.residual_count", "report.score")


def replacement_plan(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, check=False).select("doc_id", F.inline("plan"))


def leakage(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d).select("doc_id", F.explode("findings").alias("f")).groupBy("f.label", F.coalesce("f.ignored", F.lit("residual")).alias("status")).agg(F.count("*").alias("n"))


def audit_entries(spark: SparkSession, d: str) -> DataFrame:
    return verify.audit_entries(run(spark, d, check=False))


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return verify.audit_summary(audit_entries(spark, d))


def html_diff(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, check=False).select("doc_id", F.sha2(verify.html_diff(F.col("norm"), F.col("redacted"), F.col("plan")), 256).alias("html_sha256"))


def coref_links(spark: SparkSession, d: str) -> DataFrame:
    df = spans_of(shapes.COREFS.texts(spark, d), CFG, "text")
    return df.select("id", F.inline(link.coreferences(F.col("text"), F.col("spans")))).select("id", "start", "end", F.col("text").alias("found"), "entity_id")


def emails(spark: SparkSession, d: str, check: bool = False) -> DataFrame:
    return redact(table(spark, d, "documents").select("doc_id", "text"), EMAILS, check=check)


def email_redacted(spark: SparkSession, d: str) -> DataFrame:
    return emails(spark, d).select("doc_id", "redacted")


def email_plan(spark: SparkSession, d: str) -> DataFrame:
    return emails(spark, d).select("doc_id", F.inline("plan")).select("doc_id", "start", "end", "original", "replacement", "label", "source", "skip", "retries")


def redact_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each replacement begins in the new text, and that it stands there."""
    e = emails(spark, d).select("doc_id", "redacted", F.inline(F.arrays_zip("plan", plan.new_starts(F.col("plan")).alias("at"))))
    there = F.substr("redacted", F.col("at") + 1, F.length("plan.replacement")) == F.col("plan.replacement")
    return e.select("doc_id", F.col("plan.start").alias("start"), F.col("at").alias("new_start"), there.alias("there"))


def email_audit(spark: SparkSession, d: str) -> DataFrame:
    audit = verify.audit_entries(emails(spark, d))
    return audit.select("doc_id", "id", "start", "end", "new_start", "label", "original_text", "replacement_text", "skip_replacement", "safety_retries", "length_delta")


def email_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return verify.audit_summary(verify.audit_entries(emails(spark, d)))


def email_leakage(spark: SparkSession, d: str) -> DataFrame:
    f = verify.scan(emails(spark, d), "redacted", "plan", EMAILS).select("doc_id", F.inline("findings"))
    return f.groupBy("label", F.coalesce("ignored", F.lit("residual")).alias("status")).agg(F.count("*").alias("n"))


def residual_scan(spark: SparkSession, d: str) -> DataFrame:
    """The second scan over the texts as they are: nothing is ours, so all but safe addresses are residuals."""
    out = verify.scan(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", None, EMAILS)
    return out.select("doc_id", *(F.col(f"report.{c}").alias(c) for c in ("total_found", "total_ignored", "residual_count", "score")))


def email_diff(spark: SparkSession, d: str) -> DataFrame:
    return emails(spark, d).select("doc_id", F.sha2(verify.html_diff(F.col("norm"), F.col("redacted"), F.col("plan")), 256).alias("html_sha256"))


def document_audit(spark: SparkSession, d: str) -> DataFrame:
    done = emails(spark, d, check=True)
    return verify.document_audit(done, EMAILS.secret)


def email_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(emails(spark, d, check=True), EMAILS)


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Gold and found spans made of order keys: some alike, some moved, some of another label, some missing."""
    one = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), label.alias("label"))
    k = F.col("o_orderkey")
    gold = F.array(one(F.lit(0), F.lit(10), F.lit("PERSON")), one(F.lit(20), F.lit(30), F.lit("DOB")))
    hit = F.array(one(k % 4, 10 + k % 4, F.lit("PERSON")), one(F.lit(20), F.lit(30), F.when(k % 3 == 0, "DATE_GENERIC").otherwise("DOB")))
    df = table(spark, d, "orders").select(k.alias("doc_id"), gold.alias("gold"), F.when(k % 5 == 0, F.slice(hit, 1, 1)).otherwise(hit).alias("found"))
    return evaluate.outcomes(df)


def metrics_prf(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.prf(outcomes(spark, d))


def metrics_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(outcomes(spark, d))


def fuzz_variants(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.variants(table(spark, d, "documents").select("doc_id", "text"), 3, seed=7)


def stream_of_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The plan over a stream: the conversations come as files, what is there is redacted and written, and the result is read."""
    return stream_files(spark, f"{d}/conversations.parquet", EMAILS).select("conv_id", "turn", "redacted")


def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders for customers, the same wherever the name stands."""
    seed = keys.digest("PERSON", F.col("c_name"), F.lit("GLOBAL"), None)
    labels = {"person": "PERSON", "account": "ACCOUNT_ID", "email": "EMAIL", "phone": "PHONE"}
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *(pseudonyms.placeholder(F.lit(label), seed).alias(name) for name, label in labels.items()))


def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(metrics_prf(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    normalize_text, line_index, email_spans, email_attrs, email_domain_counts, phone_spans, account_spans, card_spans, card_scheme_counts, ssn_spans, ssn_ein_spans, bic_spans, aba_spans, generic_id_spans, iban_valid,
    generic_dates, dob_spans, bank_spans, address_lines, address_blocks, alias_links, alias_mentions, alias_clusters, guard_filter, name_spans, document_names, name_scores, heading_ranges, sentence_split, document_spans,
    merge_spans, stable_ids, entity_tokens, name_tokens, pseudonym_kinds, match_case, shaped, redact_documents, replacement_plan, leakage, audit_entries, audit_summary, html_diff, coref_links, email_redacted, email_plan,
    redact_offsets, email_audit, email_audit_summary, email_leakage, residual_scan, email_diff, email_coverage, document_audit, metrics_prf, metrics_summary, metrics_confusion, fuzz_variants, stream_of_conversations,
)}
