import pytest
from pyspark.sql import functions as F

from textloom.functions import pii, rules, text, url
from textloom.operators import curation
from textloom.sources.html import plain_text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "masked", "n"),
    [
        ("Write to ann.b@mail.example.org now", "Write to |||EMAIL_ADDRESS||| now", 1),
        ("a@b.co and c@d.net", "|||EMAIL_ADDRESS||| and |||EMAIL_ADDRESS|||", 2),
        ("was |||EMAIL_ADDRESS||| and x@y.com", "was |||EMAIL_ADDRESS||| and |||EMAIL_ADDRESS|||", 1),
        ("no address", "no address", 0),
        (None, "", 0),
    ],
)
def test_emails(spark, given, masked, n):
    row = pii.mask_all(spark.createDataFrame([(given,)], "text string")).first()
    assert (row["masked"], row["emails"]) == (masked, n)


@pytest.mark.parametrize("number", ["4155550132", "(415)-555-0132", "(415) 555 0132", "415-555-0132"])
def test_phones(spark, number):
    row = pii.mask_all(spark.createDataFrame([(f"call {number}!",)], "text string")).first()
    assert (row["masked"], row["phones"]) == ("call |||PHONE_NUMBER|||!", 1)


@pytest.mark.parametrize(("address", "n"), [("198.51.100.23", 1), ("255.255.255.255", 1), ("256.1.1.1", 0), ("1.2.3", 0), ("0.0.0.0 10.0.0.1", 2)])
def test_addresses(spark, address, n):
    assert pii.mask_all(spark.createDataFrame([(f"at {address} .",)], "text string")).first()["ips"] == n


def test_masking_twice_changes_nothing(spark):
    first = pii.mask_all(spark.createDataFrame([("a@b.org 415-555-0132 10.1.1.1",)], "text string")).select(F.col("masked").alias("text"))
    row = pii.mask_all(first).first()
    assert row["masked"] == row["text"] and row["emails"] + row["phones"] + row["ips"] == 0


@pytest.mark.parametrize(
    ("words", "keep"),
    [
        (["word"] * 50, True),
        (["word"] * 49, False),
        (["abc"] * 100, True),
        (["ab"] * 100, False),
        (["a" * 10] * 100, True),
        (["a" * 11] * 100, False),
        (["word"] * 80 + ["1234"] * 20, True),
        (["word"] * 79 + ["1234"] * 21, False),
    ],
)
def test_gopher_bounds(spark, words, keep):
    found = one(spark, " ".join(words), lambda t: rules.gopher(text.words(t), text.lines(t)))
    assert found["keep"] is keep


@pytest.mark.parametrize(("dotted", "ok"), [(3, True), (4, False)])
def test_gopher_ellipsis(spark, dotted, ok):
    lines = ["one two three four five six..."] * dotted + ["one two three four five six"] * (10 - dotted)
    assert one(spark, "\n".join(lines), lambda t: rules.gopher(text.words(t), text.lines(t)))["ellipsis_ok"] is ok


def test_gopher_many_words(spark):
    assert one(spark, "word " * 100000, lambda t: rules.gopher(text.words(t), text.lines(t)))["keep"]
    assert not one(spark, "word " * 100001, lambda t: rules.gopher(text.words(t), text.lines(t)))["keep"]


def test_keywords_count_as_substrings(spark):
    assert one(spark, "the casinos", lambda t: rules.keyword_hits(F.lit("u"), t)) == 2
    assert one(spark, "poker", lambda t: rules.keyword_hits(F.lit("http://slots.example"), t)) == 2
    assert one(spark, "x" * 2000 + " poker slots", lambda t: rules.keyword_hits(F.lit(None), t)) == 0


def test_parked(spark):
    assert one(spark, "This Domain Has Expired.", rules.is_parked)
    assert not one(spark, "a domain", rules.is_parked)


@pytest.mark.parametrize(
    ("given", "keep"),
    [
        ("a\na\nb\nc\nd", True),
        ("a\na\na\nb\nc", False),
        ("", False),
        (" ".join(f"w{i}" for i in range(80)) + " log in" * 2, True),
        (" ".join(f"w{i}" for i in range(80)) + " log in" * 3, False),
        ("a b c d " * 50, False),
        (" ".join(f"w{i % 60}" for i in range(200)), True),
    ],
)
def test_boilerplate(spark, given, keep):
    assert one(spark, given, lambda t: rules.boilerplate(text.lines(t), text.normalize(t)))["keep"] is keep


def test_normalize_unicode_space(spark):
    assert one(spark, " a  b\t\n c ", text.normalize) == "a b c"
    assert one(spark, None, text.normalize) == ""


def test_canonical(spark):
    assert one(spark, "ﬁ  ÜNÏ Café", text.canonical) == "fi uni cafe"
    assert one(spark, "Plain  Text", text.canonical) == "plain text"


@pytest.mark.parametrize(("given", "grams"), [("a b c d", ["a b c", "b c d"]), ("a b", ["a b"]), ("", []), ("a a a a", ["a a a"])])
def test_ngrams(spark, given, grams):
    assert one(spark, given, lambda t: text.ngrams(text.words(t), 3)) == grams


def test_treebank(spark):
    assert one(spark, 'He said, "don\'t (go)" to Mr. Smith.', text.treebank) == ["He", "said", ",", "``", "do", "n't", "(", "go", ")", "''", "to", "Mr.", "Smith", "."]


@pytest.mark.parametrize(
    ("given", "domain"),
    [("http://a.b.example.com/x", "example.com"), ("https://u@www.site.co.uk:8080/", "site.co.uk"), ("http://10.0.0.1/x", "10.0.0.1"), ("no url", "no url"), (None, "")],
)
def test_domains(spark, given, domain):
    assert one(spark, given, url.registered_domain) == domain


def test_plain_text(spark):
    page = "<html><head><title>t</title></head><body><h1>A  b</h1><p>One <a href='x'>link</a>.</p><img src=i><ul><li>x</li></ul><script>1</script></body></html>"
    assert one(spark, page, plain_text) == "A b\n\nOne link.\n\n  • x"


def test_first_failure_order(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [
        (0, None, good, "en", "missing_uri"),
        (1, "u", "  ", "en", "empty_text"),
        (2, "u", "short", "en", "too_short"),
        (3, "u", good + " casinos", "en", "blocked_topic"),
        (4, "u", good + " buy this domain", "de", "parked_domain"),
        (5, "u", good, "de", "non_english"),
        (6, "u", good + "...", "en", "low_gopher_quality"),
        (7, "u", "\n".join([" ".join(f"w{i}ord" for i in range(20))] * 3 + ["other words here"] * 2 + ["x"]), "en", "boilerplate"),
        (8, "u", good, "en", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, uri string, text string, lang string, want string")
    found = curation.first_failure(df, F.col("lang"), F.lit(1.0), F.lit(None).cast("string")).select("doc_id", "want", "reason").collect()
    assert all(r["want"] == r["reason"] for r in found), found


def test_duplicates_before_cap(spark):
    rows = [(0, "a", "x"), (1, "a", "y"), (2, "a", "z"), (3, "b", "z"), (4, "b", "q")]
    df = spark.createDataFrame(rows, "doc_id long, domain string, normalized string").withColumn("reason", F.lit(None).cast("string"))
    out = curation.curate(df, F.col("domain"), [], config=curation.FilterConfig(max_per_domain=2))
    assert {r["doc_id"]: r["reason"] for r in out.collect()} == {0: None, 1: None, 2: "domain_cap", 3: "exact_duplicate", 4: None}
    counts = {r["reason"]: r["n"] for r in curation.failure_counts(out).collect()}
    assert len(counts) == 12 and counts["domain_cap"] == counts["exact_duplicate"] == 1


def test_harm():
    config = curation.FilterConfig()
    assert config.max_nsfw_score == 0.95
