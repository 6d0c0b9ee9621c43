import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lapsewise.llm import bpe, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, id_to_drop string, _found string"
COMMON = ["the", "and", "of", "to", "in", "is", "that", "for", "with", "as"]


def prose(rnd, n=80):
    return " ".join(rnd.choice(COMMON) if rnd.random() < 0.4 else "".join(rnd.choice(["ba", "lo", "mi", "ren", "tu", "sk"]) for _ in range(3)) for _ in range(n))


def documents():
    rnd = random.Random(11)
    texts = {i: prose(rnd) for i in range(16)}
    passage = prose(rnd, 20)
    near = texts[0].split()
    near[40] = "changed"
    texts |= {30: " ".join(near), 31: texts[3], 32: texts[4].upper()}  # later copies
    texts |= {40: None, 41: "", 42: "12 34 !!"}  # no language
    texts |= {50: f"{texts[7][:100]} {passage} {prose(rnd)}"}  # holds a benchmark passage
    texts |= {60: prose(rnd) + ' password = "q8Zr4LmX0pTkW2vB" ' + prose(rnd, 10), 61: "é日本 " + prose(rnd)}
    rows = list(texts.items()) + [(5, texts[5]), (None, prose(rnd)), (None, None)]
    return [(i, t, "en", "s", 1, "x", "y", "z") for i, t in rows], passage


def plain_pipeline(rows, passage):
    """What is left, decided row by row with plain loops."""
    docs = [(r[0], r[1]) for r in rows]
    no_language = {i for i, t in docs if i is not None and not any(c.isalpha() for c in t or "")}
    docs = [(i, t) for i, t in docs if i not in no_language]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    def copy_of_earlier(i, t):
        mine = shingles(t)
        return any(j is not None and j < i and mine and 100 * len(mine & shingles(u)) >= 75 * len(mine | shingles(u)) for j, u in docs)

    docs = [(i, t) for i, t in docs if i is None or not copy_of_earlier(i, t)]
    docs = [(i, t) for i, t in docs if i is None or passage not in (t or "")]
    return [(i, None if t is None else secrets.without_spans(t, secrets.spans_of(t), "<secret>")) for i, t in docs]


@pytest.fixture
def folder(spark, tmp_path):
    rows, passage = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, passage


def test_rows_of_the_pipeline(spark, folder):
    path, rows, passage = folder
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in plain_pipeline(rows, passage):
        ids = codec.encode_ordinary(t or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest()))
    found = [tuple(r) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    kept = {r[0] for r in found}
    assert not kept & {30, 31, 32, 40, 41, 42, 50} and {0, 3, 4, 5, 60, 61, None} <= kept


def test_stages_keep_all_columns_but_the_last(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, path)
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0


def test_secrets_are_gone(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    hidden = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, folder[0])
    assert "q8Zr4LmX0pTkW2vB" not in " ".join(r["text"] or "" for r in hidden.collect())
