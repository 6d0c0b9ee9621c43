"""Operators without a SQL twin against plain versions written from their contracts."""

import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from lapsewise.llm import html_text, language, pii, registry, secrets, urls

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def mixed(rnd, parts, n):
    return "".join(rnd.choice(parts) for _ in range(n))


# Personal data


def plain_pii(text):
    """Base spans by the patterns of the contract, read literally."""
    good = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 13 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and plain_luhn(d),
        "phone": lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if good[k](m[0])]


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_iban(value):
    moved = value.replace(" ", "")[4:] + value.replace(" ", "")[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def with_check_digit(rnd):
    digits = mixed(rnd, "0123456789", rnd.randrange(12, 19))
    return next(d for c in "0123456789" if plain_luhn(d := digits + c))


def with_check_number(rnd):
    body = mixed(rnd, "0123456789ABCXYZ", rnd.randrange(11, 27))
    return next(v for n in range(2, 99) if plain_iban(v := f"DE{n:02d}{body}"))


def pii_texts():
    rnd = random.Random(11)
    bits = list("0123456789") * 2 + list("abZ. @-+()_%é") + ["\U0001f600", "1.2.3.4", "@x.y", "256.", "+1 ", " mail ", "\n", "ssn ", "iban "]
    texts = [mixed(rnd, bits, rnd.randrange(0, 120)) for _ in range(400)]
    for _ in range(100):
        forms = [with_check_digit(rnd), "-".join(with_check_digit(rnd)), with_check_number(rnd), "iban " + with_check_number(rnd), "social 123-45-6789"]
        texts.append(" ".join(mixed(rnd, bits, 8) + " " + rnd.choice(forms) for _ in range(6)))
    return [None, "", *texts, texts[0], "1" * 20_000 + " a@b.c " * 2_000]


def test_pii_of_the_contract(spark):
    texts = pii_texts()
    rows = {r.doc_id: r for r in pii.digest(pii.find_pii(documents(spark, texts))).collect()}
    order = {k: i for i, k in enumerate(pii.BASE)}
    assert len(rows) == len(texts)
    kinds = set()
    for i, text in enumerate(texts):
        base = sorted(plain_pii(text), key=lambda s: (order[s[0]], s[1]))
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE], text
        assert rows[i].base_sha256 == sha(",".join("%s:%d:%d" % s for s in base)), text
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in rows[i].spans.split(",") if s)]
        assert [s for s in spans if s[0] in order] == base
        kinds |= {s[0] for s in spans}
        for kind, a, b in spans:
            if kind == "iban":
                assert plain_iban(text[a:b])
            if kind == "ssn":
                assert re.search(r"(?i)\b(social|security|ssn)", text[max(0, a - 40) : a] + " " + text[b : b + 40])
    assert kinds == {*pii.BASE, *pii.MORE}


def test_pii_query_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.QUERIES["op10_pii"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.base_sha256 == sha(",".join("%s:%d:%d" % s for s in plain_pii(texts[r.doc_id])))


# Secrets


def plain_secrets(text):
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", m.start(), m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def check_secrets(rows, texts):
    for r in rows:
        base = plain_secrets(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in secrets.KINDS] == [sum(s[0] == k for s in base) for k in secrets.KINDS], texts[r.doc_id]
        assert r.base_sha256 == sha(",".join("%s:%d:%d" % s for s in base)), texts[r.doc_id]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("novel")] == ["%s:%d:%d" % s for s in base]
        for kind, a, b in (s.split(":") for s in spans):
            assert 0 <= int(a) < int(b) <= len(texts[r.doc_id])


def test_secrets_of_the_contract(spark):
    rnd = random.Random(12)
    bits = ["password", "PassWd", "SECRET", "to\u212aen", "token", "api_key", "ApiKey", "api__key", '"', "'", " ", "=", ":", " : ", "AKIA", "AKIA" + "Z9" * 8, "A1", "Z9Z9Z9Z9"]
    bits += ["0f", "deadbeef", "0123456789abcdef", "-", "_", "/", "x", "é", "\U0001f600", "\n", "F"]
    texts = [mixed(rnd, bits, rnd.randrange(0, 60)) for _ in range(600)]
    texts += [None, "", texts[0], "AKIA" * 5_000, "token=" * 5_000, "secret = " + "Aa1" * 20_000]
    rows = secrets.digest(secrets.find_secrets(documents(spark, texts))).collect()
    assert len(rows) == len(texts) and all(sum(r[f"n_{k}"] for r in rows) > 20 for k in secrets.KINDS)
    check_secrets(rows, texts)


def test_secrets_query_on_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.QUERIES["op9_secrets"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check_secrets(rows, texts)


# URLs


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    fits = [r for r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = max(fits, key=len, default=None)
    return best, rules.get(best)


def plain_grams(host, path):
    found = set()
    for mark, text in (("h", host), ("p", path)):
        padded = "^" + re.sub("[0-9]", "0", text) + "$"
        found |= {mark + padded[i : i + urls.GRAM] for i in range(max(1, len(padded) - urls.GRAM + 1))}
    return found


def check_urls(rows, values, model):
    weights, bias = model.regression.coefficients.toArray(), model.regression.intercept
    buckets = {}
    for key, host, path, rule, verdict, score in rows:
        assert (host, path) == plain_split(values[key]), values[key]
        expected, decided = plain_rule(host, path)
        hashed = {buckets[g] if g in buckets else buckets.setdefault(g, model.hashing.indexOf(g)) for g in plain_grams(host, path)}
        chance = 1 / (1 + math.exp(-(bias + sum(weights[i] for i in hashed))))
        assert abs(chance - score) < 1e-9
        assert rule == expected and verdict == (decided or ("block" if chance >= 0.5 else "allow")), values[key]


def test_urls_of_the_contract(spark):
    rnd = random.Random(13)
    bits = ["http", "://", "net", "org", "com", ".", "example", "/", "/en/", "/de/", "/fr/", "?", "#", "X", "É", "\U0001f600", "@", "cheap-pills", "\n", "İ"]
    values = [mixed(rnd, bits, rnd.randrange(0, 12)) for _ in range(500)]
    values += [f"s://{h}{p}" for h in ("net", "a.net", "anet", "Example.NET", "b.example.net", "example.com", "org", "x.org") for p in ("", "/", "/en/", "/en", "/de/1", "/fr/")]
    values += [None, "", values[-1], "h://" + "a" * 30_000]
    df = spark.createDataFrame(list(enumerate(values)), "page_id long, url string").repartition(3)
    model = urls.fit_urls(spark)
    rows = [tuple(r) for r in urls.judge_urls(df, model).collect()]
    assert len(rows) == len(values) and {r[3] for r in rows} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}
    check_urls(rows, values, model)


def test_urls_query_on_the_whole_table(spark, sf_dir):
    values = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = registry.QUERIES["op1_url_filter"](spark, sf_dir).select("page_id", "host", "path", "rule", "verdict", "score").collect()
    assert sorted(r.page_id for r in rows) == sorted(values)
    check_urls([tuple(r) for r in rows], values, urls.fit_urls(spark))


# Languages


def segmentations(word, index):
    """All ways to cut a word into pieces, or single characters that are no piece."""
    if not word:
        yield ()
    for size in range(1, len(word) + 1):
        if word[:size] in index or size == 1:
            for rest in segmentations(word[size:], index):
                yield (index.get(word[:size], -1), *rest)


def chance_of(way, chances):
    return math.prod(chances[i] if i >= 0 else language.UNKNOWN for i in way)


def plain_fit(rows, index, rounds):
    """Expectation and maximisation over every segmentation, one by one."""
    names = sorted({lang for _, lang in rows})
    chances = {name: np.full(len(index), 1 / len(index)) for name in names}
    for _ in range(rounds):
        fresh = {name: np.full(len(index), language.PSEUDO) for name in names}
        for text, name in rows:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                ways = list(segmentations("▁" + word, index))
                weights = [chance_of(w, chances[name]) for w in ways]
                for way, weight in zip(ways, weights):
                    for i in way:
                        if i >= 0:
                            fresh[name][i] += weight / sum(weights)
        chances = {name: c / c.sum() for name, c in fresh.items()}
    return chances


def test_languages_by_every_segmentation(spark):
    taught = [("the dog is on the mat", "en"), ("and the cat sat by it", "en"), ("le chien est sur la table", "fr"), ("et le chat dort ici", "fr"), ("der hund ist im haus", "de")]
    asked = ["The cat is here", "la table est ici", "das haus ist da", "a", "zq xj the", "le the der", "ж", "Ⅷ the", None, "", "1 2", "the dog " * 3]
    index = {p: i for i, p in enumerate(language.word_pieces(VOCABULARY))}
    chances = plain_fit(taught, index, language.ROUNDS)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(taught)], "doc_id long, text string, lang string")
    model = language.fit_languages(df, VOCABULARY, "doc_id")
    assert model.languages == sorted(chances)
    for i, name in enumerate(model.languages):
        assert np.allclose(model.chances[:, i], chances[name], rtol=1e-9)
    rows = {r.id: r for r in language.predict_languages(documents(spark, asked), model).collect()}
    for i, text in enumerate(asked):
        words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(map(str.isalpha, w))]
        if not words:
            assert (rows[i].lang, rows[i].score) == ("und", 0.0)
            continue
        logs = [sum(math.log(sum(chance_of(s, chances[n]) for s in segmentations("▁" + w, index))) for w in words) for n in model.languages]
        best = int(np.argmax(logs))
        assert rows[i].lang == model.languages[best], text
        assert math.isclose(rows[i].score, 1 / sum(math.exp(v - logs[best]) for v in logs), rel_tol=1e-9)


def test_long_words_teach_like_short_ones(monkeypatch):
    index = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "abbabaab" * 3])}
    rnd = random.Random(14)
    model = language.LanguageModel(["x"], index, np.array([[0.3], [0.2], [0.2], [0.1], [0.1], [0.1]]))
    words = [mixed(rnd, "aabx", n) for n in (1, 5, 20, 31, 33)] + ["abbabaab" * 4]
    counts = np.arange(1.0, len(words) + 1)
    monkeypatch.setattr(language, "SHORT", 1_000)
    together, scores = model.expected(words, counts, 0), model.score_words(words)
    monkeypatch.setattr(language, "SHORT", 0)
    assert np.allclose(model.expected(words, counts, 0), together, rtol=1e-9) and together[-1] > 0
    assert np.allclose(model.score_words(words), scores, rtol=1e-12)
    # Sums over 3,000 letters would underflow; the letters covered are all of them.
    uses = model.expected(["ab" * 1_500], np.array([2.0]), 0)
    assert math.isclose(sum(uses[i] * len(p) for p, i in index.items()), 6_000, rel_tol=1e-9)


def test_ties_and_held_out_rows(spark, sf_dir):
    # Where languages score alike, the first by name is taken.
    df = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    row = language.predict_languages(documents(spark, ["same"]), language.fit_languages(df, VOCABULARY, "doc_id")).first()
    assert row.lang == "a" and math.isclose(row.score, 0.5, rel_tol=1e-9)
    given = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.QUERIES["op4_language"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(given)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    kept = [r for r in rows if r.held_out and r.lang_pred != "und" and given[r.doc_id]]
    assert sum(r.lang_pred == given[r.doc_id] for r in kept) >= 0.95 * len(kept)


# Pages

WORDS = "the of and to in is that for on with river stone market letter window".split()


def passage(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def marked_up(rnd, text):
    """The same text with markup, references and loose white space inside."""
    words = []
    for w in text.split(" "):
        form = rnd.choice(["{}", "{}", "{}", "<b>{}</b>", "<i class=x>{}</i>", "<!-- no -->{}", '<a href="/?a=1&b">{}</a>' if rnd.random() < 0.1 else "{}"])
        words.append(form.format(html.escape(w) if rnd.random() < 0.8 else "".join(f"&#{ord(c)};" for c in w)))
    return "".join(w + rnd.choice([" ", "  ", "\n", "\t "]) for w in words)


def made_page(rnd):
    """A page, and the text that the contract wants of it."""
    wanted, inside = [], []
    for _ in range(rnd.randrange(0, 8)):
        tag = rnd.choice(["p", "p", "h2", "blockquote", "li", "pre"])
        text = passage(rnd, rnd.randrange(12, 60)) + rnd.choice(["", " & more", " <3", " é\u00a0x"])
        wanted.append(" ".join(text.split()))
        inside.append(f"<{tag}>{marked_up(rnd, text)}</{tag}>")
        if rnd.random() < 0.4:
            kind = rnd.choice(["aside", "form", "script", "style", 'div class="ad"', 'div id="comments"', 'section class="share-box"', "nav"])
            inside.append(f"<{kind}>{passage(rnd, 30)}</{kind.split()[0]}>")
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:5])
    before = f"<html><head><title>{passage(rnd, 5)}</title></head><body><header><h1>Site</h1><nav><ul>{menu}</ul></nav></header>"
    after = f'<div class="sidebar">{passage(rnd, 40)}</div><div role="alert">{passage(rnd, 20)}</div><footer>{passage(rnd, 20)}</footer></body></html>'
    return f"{before}<article>{''.join(inside)}</article>{after}", "\n\n".join(wanted)


@pytest.mark.parametrize("seed", range(3))
def test_pages_of_known_text(spark, seed):
    rnd = random.Random(seed)
    made = [made_page(rnd) for _ in range(80)]
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(made)]
    found = {r.id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(found) == len(made)
    for i, (page, text) in enumerate(made):
        assert found[i].text == text, page
        assert found[i].n_chars == len(text)
