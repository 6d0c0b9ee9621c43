"""Operators that read one text at a time."""

import base64
import hashlib
import random
import re

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from lapsewise.llm import bpe, html_text, language, pii, secrets, urls

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts(spark, *values):
    return spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)] + [(None, None, "clash")], "doc_id long, text string, id string")


def test_urls(spark):
    values = [
        "http://A.B.NET/x", "https://www.Example.net/en/a?b#c", "http://example.com/de/x", "http://x.org/fr/", "http://x.org/FR/", "ftp://net", "http://xnet/",
        "no scheme", None, "", "a://b://c/d", "http://www.cheap-pills.example.org/en/3", "http://garden-news.example.org/en/4", "http://h#/en/",
    ]
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "page_id long, url string, score string")
    model = urls.fit_urls(spark)
    rows = {r.id: r for r in urls.judge_urls(df, model).collect()}
    assert [(rows[i].host, rows[i].path) for i in (0, 1, 5, 7, 8, 10, 13)] == [
        ("a.b.net", "/x"), ("www.example.net", "/en/a"), ("net", ""), ("", ""), ("", ""), ("b:", "//c/d"), ("h", ""),
    ]
    assert [rows[i].rule for i in range(7)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None]
    assert [rows[i].verdict for i in (0, 1, 2, 3, 11, 12)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert urls.judge_urls(df.limit(0), model).count() == 0


def test_pii(spark):
    text = (
        "é a.b@c.d_x@y.zz mail 1.2.3.4.5.6.7.8 256.1.1.1 card 4111 1111 1111 1111, 4111111111111112 +1 (234) 555-2345 "
        "iban DE89 3704 0044 0532 0130 00 DE88370400440532013000 social 123-45-6789 " + "9" * 30
    )
    rows = {r.id: r.spans for r in pii.find_pii(texts(spark, text, "", "1" * 50_000 + "a" * 50_000)).collect()}
    assert [(s.kind, s.value) for s in rows[0]] == [
        ("email", "a.b@c.d"), ("email", "_x@y.zz"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"),
        ("phone", "+1 (234) 555-2345"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"),
    ]
    assert all(text[s.start : s.end] == s.value for s in rows[0])
    assert rows[1] == rows[2] == rows[None] == []
    digest = pii.digest(pii.find_pii(texts(spark, text))).where("doc_id = 0").first()
    base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in rows[0][:6])
    assert digest.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (digest.n_email, digest.n_card) == (2, 1)


def test_secrets(spark):
    value = "q7Zp2LxV9sKd4TnB8wYc"
    text = f"é PassWord = 'abc123' token:12345 toKen : abcdefg AKIA{'A1' * 8} {'0f' * 12} auth {value} and then no more but plain words {'a' * 30}1"
    rows = {r.id: r.spans for r in secrets.find_secrets(texts(spark, text, "", "x" * 100_000, "to\u212aen=abcdefgh")).collect()}
    assert [(s.kind, text[s.start : s.end]) for s in rows[0]][:4] == [
        ("assign", "PassWord = 'abc123"), ("assign", "toKen : abcdefg"), ("access", "AKIA" + "A1" * 8), ("hex", "0f" * 12),
    ]
    assert ("novel", value) in [(s.kind, text[s.start : s.end]) for s in rows[0]]
    assert rows[1] == rows[2] == rows[3] == rows[None] == []
    clean = {r.doc_id: r.text for r in secrets.masked(texts(spark, text, "fine")).collect()}
    assert clean[1] == "fine" and clean[None] is None and "abc123" not in clean[0] and clean[0].startswith("é <secret>")


def test_secrets_behind_names():
    value = "wJ4lrXUtnFEMiK7MDENGbPxRf2CYzQ81kLmT0v6H"
    forms = [
        "aws_secret_access_key = @", "AWS_SECRET_ACCESS_KEY=@", "db_pwd=@", "my_access_key: @", "private_key=@", "client_private_key = ...\n@", "see ?auth=@&x=1",
        "dbKey: @", "awsAPIKey=@", "userPWD = @", "x2key @", "a=b=auth=@", "auth=@=",
    ]
    for form in forms:
        text = form.replace("@", value)
        assert value in [text[a:b].rstrip("=") for kind, a, b, _ in secrets.spans_of(text) if kind == "novel"], form
        assert re.search(secrets.NEEDED.replace("*+", "*"), text)
    for form in ["monkey @", "a turkey=@", "the rapid @"]:
        assert secrets.spans_of(form.replace("@", value)) == [], form


def test_secrets_that_stand_twice():
    rnd = random.Random(5)
    for size in (16, 24, 40, 64):
        value = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(size - 2)) + "a1"
        for gap in (5, 100, 505, 530):
            between = ("and so on " * 60)[:gap]
            text = f"auth {value} {between} bearer {value} {between} key={value}=="
            found = [text[a:b].rstrip("=") for kind, a, b, _ in secrets.spans_of(text) if kind == "novel"]
            assert found == [value] * 3
            clean = secrets.without_spans(text, secrets.spans_of(text), "")
            assert value not in clean


def test_language(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat is on the mat and the dog", "en"), ("le chat est sur la table et le chien", "fr")] * 20)]
    model = language.fit_languages(spark.createDataFrame(rows + [(99, None, "en"), (98, "x", None)], "k long, text string, lang string"), VOCABULARY, "k")
    df = texts(spark, "The dog and the cat", "la table et le chat", "", "12 !?", "a" * 5000)
    found = {r.id: r for r in language.predict_languages(df, model).collect()}
    assert [found[i].lang for i in (0, 1, 2, 3, None)] == ["en", "fr", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in found.values())
    empty = language.fit_languages(spark.createDataFrame([], "k long, text string, lang string"), VOCABULARY, "k")
    assert {r.lang for r in language.predict_languages(df, empty).collect()} == {"und"}


def test_segmentations_are_summed():
    import numpy as np

    model = language.LanguageModel(["x"], {"a": 0, "b": 1, "ab": 2}, np.array([[0.2], [0.3], [0.5]]))
    assert abs(float(model.score_word("ab")[0]) - np.log(0.2 * 0.3 + 0.5)) < 1e-12
    words = ["ab", "b", "abxab", "a" * 40, "ab" * 3, "x"]
    assert np.allclose(model.score_words(words)[:, 0], [model.score_word(w)[0] for w in words], rtol=1e-12)
    assert abs(float(model.score_words(["ab"])[0, 0]) - np.log(0.2 * 0.3 + 0.5)) < 1e-12
    # "ab" twice and "b" once: of "ab", the share 0.06 / 0.56 is cut in two.
    cut = 0.06 / 0.56
    assert np.allclose(model.expected(["ab", "b"], np.array([2.0, 1.0]), 0), [2 * cut, 2 * cut + 1, 2 * (1 - cut)])


def test_held_out(spark):
    import zlib

    rows = spark.range(50).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad box">Buy <div>now</div> please</div>
<article><header><h1>Title &amp; more</h1></header><p>The first of the <b>words</b> and&nbsp;the rest.<br>Next   line<p>Short.</p>
<table><tr><td>cell</table><div id="comments"><p>The reader said that it is of no use to them and to us.</p></div></article>
<form><input value="x">Form</form><footer>&copy; all the rights</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", "<article><p>cut &am", 0), (5, "u", "<p>a<foo" + "<div>" * 3000, 0)],
        "page_id long, url string, html string, text int",
    )
    rows = {r.id: r for r in html_text.extract_text(pages).collect()}
    assert rows[1].text == "Title & more\n\nThe first of the words and the rest. Next line\n\nShort.\n\ncell"
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text == rows[3].text == "" and rows[None].text == "cut &am"
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_html_rules_without_an_article():
    good = "It is the story of the man and of the sea that he was in for all of his life and there it was. " * 3
    page = f"<div><a href=x>one of the links that is here</a></div><p>{good}</p><p>short one</p><p>{good}</p><div>odd</div>"
    assert html_text.main_text(page).count("\n\n") == 3 and "links" not in html_text.main_text(page)


def test_bpe(spark, docs, no_docs, corpus):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = texts(spark, "a  b\n\n c  ", "'s it's ' sabc  \t x", "日本語 😀 \u0301", "<|endoftext|>", "z" * 3000)
    for frame in (docs, extra):
        want = sorted(
            (-1 if r.doc_id is None else r.doc_id, len(ids := codec.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
            for r in frame.collect()
        )
        rows = bpe.encode_corpus(frame, RANKS, public_tokenizers.PATTERN).collect()
        assert sorted((-1 if r.id is None else r.id, *r[1:]) for r in rows) == want
    assert bpe.encode_corpus(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packed_numbers():
    import numpy as np

    for top in (5, 191, 14527, 14528, 500_000, 5_000_000):
        x = np.random.default_rng(top).integers(0, top + 1, 1000).astype(np.uint32)
        x[0] = top
        assert (bpe.unpack_numbers(bpe.pack_numbers(x)) == x).all()


def test_registry_names():
    from lapsewise.llm.registry import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
