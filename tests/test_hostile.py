"""The guard before Base64 decoding, and the linear forms of patterns, against the plain ones."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from textwarden import rules as R
from textwarden.functions import redaction as red
from textwarden.functions.injection import injection_score
from textwarden.operators.findings import secret_findings

col = F.col
SECRETS = [
    "password: x", "Secret_Key =v", "TOKEN:a", "apikey=1", "Api-Key: 2", "api_key :3", "Authorization : Bearer",
    "https://u:p@h", "FTP sftp://u:p@h", "AKIA" + "9" * 16, "akia" + "z" * 16, "-----BEGIN X PRIVATE KEY-----",
    "SECRET of the pass", "my Token, my secret", "to\u212aen=v", "pa\u017f\u017fword=v", "\u017fecret=v", "api\u212aey=v",
    "a\u212aia" + "0" * 16, "http\u017f://u:p@h",
]


def texts(frame, name="x"):
    return [r[name] for r in frame.select(name).collect()]


def test_guard_lets_every_encoded_secret_through(spark):
    """Each detector's words at each of the three places, in random surroundings."""
    rng = random.Random(3)
    rows = []
    for secret in SECRETS:
        for _ in range(60):
            before = "".join(rng.choices("abc ,.\u00e9\u4e2d", k=rng.randint(0, 7)))
            after = "".join(rng.choices("xyz ,.\u00fc", k=rng.randint(0, 7)))
            blob = base64.b64encode(f"{before} {secret} {after}".encode()).decode()
            rows.append((f"see {blob} there",))
    df = spark.createDataFrame(rows, "x string")
    plain = F.exists(F.regexp_extract_all("x", F.lit(red.BASE64), F.lit(0)), red.blob_is_secret)
    missed = df.where(plain & ~red.may_hold_encoded(col("x")))
    assert df.where(plain).count() == len(rows) and texts(missed) == []
    assert df.where(red.redact_encoded(col("x")) != "see [REDACTED_SECRET] there").count() == 0


def test_guard_agrees_with_decoding_on_random_blobs(spark):
    rng = random.Random(4)
    words = ["hello", "word", "secret", "pass", "token", "=", ":", " ", "api", "key", "://", "PRIVATE", "\u212a", "\xff"]
    rows = [
        (base64.b64encode("".join(rng.choices(words, k=rng.randint(3, 9))).encode("latin-1", "replace")).decode(),)
        for _ in range(3000)
    ]
    df = spark.createDataFrame([*rows, ("",), (None,)], "x string")
    plain = F.exists(F.regexp_extract_all("x", F.lit(red.BASE64), F.lit(0)), red.blob_is_secret)
    differ = df.where(~red.has_encoded_secret(col("x")).eqNullSafe(plain))
    assert texts(differ) == []
    assert texts(df.where(~red.redact_encoded(col("x")).eqNullSafe(red.splice_encoded(col("x"))))) == []


def test_prose_is_seldom_decoded(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert docs.where(red.may_hold_encoded(col("text"))).count() * 20 < docs.count()


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("url_credentials", ["http://", "sftp", "://", "a", ":", "@", " ", "\n", "HTTPS://u", "/", "http\u017f://", "\u0085"]),
        ("curl_pipe", ["curl", "CURL ", " ", "\n", "|", "x", "\t", "cur", "\u00a0", "\r"]),
        ("wget_pipe", ["wget", "WGET ", " ", "\n", "|", "x", "\t", "wge", "\u3000"]),
    ],
)
def test_linear_tests_agree_with_plain_patterns(spark, name, parts):
    rng = random.Random(6)
    rules = (*R.DETECT_RULES, *R.INJECTION_RULES)
    rule = R.rule_named(rules, name)
    rows = [("".join(rng.choices(parts, k=rng.randint(1, 14))),) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "x string")
    plain, linear = col("x").rlike(R.spark_pattern(rule)), col("x").rlike(R.spark_test(rule))
    assert texts(df.where(plain != linear)) == []
    found = df.where(plain).count()
    assert 0 < found < len(rows)


def test_key_blocks_agree_with_the_plain_pattern(spark):
    rng = random.Random(7)
    parts = ["-----BEGIN A PRIVATE KEY-----", "-----END A PRIVATE KEY-----", "END B PRIVATE KEY-----", "BEGIN C PRIVATE KEY-----",
             "-----", "x", "\n", "-----END PRIVATE KEY-----", "\U0001f511"]
    rows = [("".join(rng.choices(parts, k=rng.randint(1, 12))),) for _ in range(10_000)]
    df = spark.createDataFrame([*rows, (None,)], "x string")
    rule = R.rule_named(R.REPLACE_RULES, "pem_block")
    plain = F.regexp_replace("x", R.spark_pattern(rule), R.spark_replacement(rule))
    assert texts(df.where(~plain.eqNullSafe(red.apply_rule(col("x"), rule)))) == []
    counted = F.regexp_count("x", F.lit(R.spark_pattern(rule)))
    assert texts(df.where(counted != F.regexp_count(red.in_reach(col("x"), rule), F.lit(R.spark_pattern(rule))))) == []


HOSTILE = {
    "unfinished key headers": "-----BEGIN RSA PRIVATE KEY-----\n" * 31_250,
    "ends before headers": "-----END A PRIVATE KEY-----" + "-----BEGIN A PRIVATE KEY-----" * 34_000,
    "urls without a host": "http://a:" * 111_000,
    "urls in long words": "http://" + "b" * 1_000_000,
    "curl without a pipe": "curl x " * 143_000,
    "curl and blanks": "curl " + " \n" * 500_000,
    "wget without a pipe": "wget\t" * 200_000,
    "emoji and curl": "\U0001f511x curl " * 77_000,
    "one long blob": "QUJD" * 250_000,
    "nearly words, encoded": "c2VjcmV" * 143_000,
}


def seconds(frame):
    """Least of three runs, planning left out."""
    frame._jdf.queryExecution().executedPlan()
    took = []
    for _ in range(3):
        start = time.time()
        frame.collect()
        took.append(time.time() - start)
    return min(took)


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_linear_time(spark, name):
    """A megabyte each, within two seconds for all that is done to a text."""
    df = spark.createDataFrame([(HOSTILE[name],)], "text string").coalesce(1).cache()
    df.count()
    out = red.with_redaction(df, "text", "redacted", "secret").withColumn("score", injection_score(col("text")))
    assert seconds(out.select(F.length("redacted"), "secret", "score")) < 2
    assert seconds(secret_findings(df)) < 2
    df.unpersist()
