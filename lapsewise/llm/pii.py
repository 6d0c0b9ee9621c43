"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import count_of, keyed_text, spans_digest

# What each kind looks like. A look-behind or ``\G`` lets a match begin only
# at the start of a run or right after the last match, where the plain pattern would begin
# it too; possessive loops never go back. Both keep the time linear in the text.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][ -]))[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]{4}){2,7}+(?: ?+[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Kinds that are always reported, and the others, which need their score.
BASE = ["email", "ip", "card", "phone"]
MORE = ["iban", "ssn"]
# Score before context, and words nearby that raise it.
START = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|host|server|login",
    "card": "card|credit|visa|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "social|security|ssn",
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.2
LEAST_SCORE = 0.6
GROUP, CHUNK = 256, 512


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches.

    Text between the matches and the matches themselves are taken apart, and their
    lengths in code points are summed up, in groups of GROUP matches and over the groups,
    as an array grows by copying it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    entry = "struct<start:int,end:int,value:string>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    none = F.array().cast(f"array<{entry}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    last = F.greatest(F.floor((F.size(found) - 1) / GROUP).cast("int"), F.lit(0))
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.aggregate(F.slice(pairs, g * GROUP + 1, GROUP), zero, step))
    lengths = F.transform(groups, lambda g: g["at"])
    starts = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def moved(group: Column, by: Column) -> Column:
        return F.transform(group["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    spans = F.flatten(F.zip_with(groups, F.slice(starts, 1, F.size(groups)), moved))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's check; at most 19 digits are looked at."""
    padded = F.lpad(number, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.ascii(F.substring(padded, i + 1, 1)) - 48
        total = total + (d if i % 2 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN leaves 1 when divided by 97, letters counting from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)),
        )
    if kind == "card":
        number = digits(value)
        return F.length(number).between(13, 19) & luhn(number)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    return F.lit(True)


def piece(chunks: Column, start: Column, size: Column) -> Column:
    """Some characters, fewer than CHUNK, of a text in chunks: a text as a whole would be
    read from its begin each time."""
    i = F.floor(start / CHUNK).cast("int")
    return F.substr(F.array_join(F.slice(chunks, i + 1, 2), ""), start - i * CHUNK + 1, size)


def score(kind: str, chunks: Column, span: Column) -> Column:
    low = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    around = F.concat_ws(" ", piece(chunks, low, span["start"] - low), piece(chunks, span["end"], F.lit(CONTEXT_CHARS)))
    near = F.lower(around).rlike(rf"\b(?:{CONTEXT[kind]})")
    return F.round(F.lit(START[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0.0), 2)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """One row per input row: ``id`` and ``spans`` (kind, start, end, value, score).

    Positions are code points, the end exclusive. Kinds in BASE are reported whenever
    their checksum or digit count holds; the others when their score, raised by words
    within CONTEXT_CHARS, reaches ``least_score``. Overlapping spans of different kinds
    are all kept. A null or empty text has no spans; a null key is kept as it is;
    repeated rows each give a row; columns beyond key and text are ignored.
    """
    df = keyed_text(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    body = F.col("text")
    df = df.withColumns({f"raw_{kind}": matches(body, p) for kind, p in PATTERNS.items()})
    # Only a text with matches is cut into chunks.
    some = F.greatest(*[F.size(f"raw_{kind}") for kind in PATTERNS]) > 0
    df = df.withColumn("chunks", F.when(some, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def confirmed(kind: str) -> Column:
        good = F.filter(F.col(f"raw_{kind}"), lambda s: valid(kind, s["value"]))
        full = F.transform(
            good,
            lambda s: F.struct(
                F.lit(kind).alias("kind"), s["start"], s["end"], s["value"], score(kind, F.col("chunks"), s).alias("score")
            ),
        )
        return full if kind in BASE else F.filter(full, lambda s: s["score"] >= least_score)

    return df.select("id", F.concat(*map(confirmed, [*BASE, *MORE])).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [count_of(kind) for kind in BASE]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(spans_digest(base), 256).alias("base_sha256"), spans_digest(F.col("spans")).alias("spans")
    )
