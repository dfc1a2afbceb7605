"""Normal forms, checksums, guards, field extraction and hashed vectors of request texts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.surrogate import table
from .text import SHAPES, _tokens, holds, mask_shapes, stems

# Letters that look like Latin ones (Cyrillic, then Greek), and digits that stand for letters.
LOOKALIKES = ("аеорсхуіјѕԁһкмтвАВЕКМНОРСТХІЈЅУ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρακυ" "ГΓԌгγɡ", "aeopcxyijsdhkmtbABEKMHOPCTXIJSY" "ABEZHIKMNOPTYXovipaku" "GGGggg")
LEET = ("103457@", "ioeasta")
# The Verhoeff checksum's permutation, applied again for each place, and its inverses.
PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
INVERSES = (0, 4, 3, 2, 1, 5, 6, 7, 8, 9)


def dihedral(a: int, b: int) -> int:
    """The product of two elements of the symmetries of a pentagon, rotations 0 to 4 and reflections 5 to 9."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + (5 if (a < 5) != (b < 5) else 0)


PRODUCTS = [dihedral(a, b) for a in range(10) for b in range(10)]
PLACES = list(range(10))
for _ in range(7):
    PLACES += [PERMUTATION[x] for x in PLACES[-10:]]


def verhoeff_digit(digits: Column) -> Column:
    """Check digit of a string of digits; null where it is null, empty or holds anything else."""
    products, places, inverses = (F.array(*map(F.lit, x)) for x in (PRODUCTS, PLACES, INVERSES))
    order = F.sequence(F.lit(1), F.length(digits))
    value = F.aggregate(order, F.lit(0), lambda c, i: F.get(products, c * 10 + F.get(places, (i % 8) * 10 + F.substring(F.reverse(digits), i, F.lit(1)).cast("int"))))
    return F.when(digits.rlike("^[0-9]+$"), F.get(inverses, value))


def verhoeff_valid(digits: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.coalesce(verhoeff_digit(body) == F.substring(digits, F.length(digits), F.lit(1)).cast("int"), F.lit(False))


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


#: Characters that are their own compatibility form and never compose with their neighbours; a text of them alone is
#: its own normal form.
_BEYOND = r"\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u2013-\u2015\u2018-\u201F\u20AC"
PLAIN = r"\x00-\x7F" + _BEYOND
#: Any other character. The matcher asks the long class only of characters beyond ASCII.
UNPLAIN = rf"[[^\x00-\x7F]&&[^{_BEYOND}]]"


def normalize_text(text: Column) -> Column:
    """Without control and format characters (tabs and line ends stay), compatibility forms and look-alikes folded.

    Only texts with other characters than PLAIN go to Python, which has the compatibility forms."""
    x = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")
    return F.translate(F.coalesce(_compatible(F.when(x.rlike(UNPLAIN), x)), x), *LOOKALIKES)


def fold_leet(text: Column) -> Column:
    """For detection only."""
    return F.translate(text, *LEET)


def one_liner(text: Column, most: int = 220) -> Column:
    """White space collapsed, cut to ``most`` characters with three dots at the end."""
    x = F.trim(F.regexp_replace(text, "[ \t\r\n]+", " "))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def first_sentences(text: Column, n: int = 2) -> Column:
    return F.trim(F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), 0), 1, n), ""))


#: Own rules for texts that try to steer a model, tried on the plain and on the leet view.
STEERING = (r"ignore (all|any|the|previous|prior)", r"disregard (all|any|the|previous)", r"system prompt", r"you are now", r"act as (a|an|the)", r"reveal (the|your)", r"password (is|to)", r"developer mode")


def steering(text: Column) -> Column:
    # a text is tried for the rules whose fixed beginning it holds
    views = (F.lower(text), F.lower(fold_leet(text)))
    return F.coalesce(reduce(Column.__or__, [holds(v, p, p.split("(")[0]) for v in views for p in STEERING]), F.lit(False))


def over_length(text: Column, most: int = 4000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("[truncated]"))).otherwise(text)


FIELDS = (("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,10}"), ("phone", r"\+1[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}"), ("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("link", r"https?://[A-Za-z0-9./_-]+"))


def extract_fields(text: Column) -> Column:
    """map<field, first value>; fields that are not found are left out."""
    fixed = {"email": "@", "phone": "+1", "link": "http"}
    found = {n: F.regexp_extract(text, p, 0) for n, p in FIELDS}
    m = F.create_map(*[c for n, v in found.items() for c in (F.lit(n), F.when(text.contains(fixed[n]), v).otherwise("") if n in fixed else v)])
    return F.map_filter(m, lambda _, v: v != "")


def ungrounded_numbers(turns: DataFrame) -> DataFrame:
    """Per conversation the different numbers of answers that no other turn of it holds."""
    x = turns.select("conv_id", (F.col("role") == "assistant").alias("answer"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0))).alias("number"))
    x = x.groupBy("conv_id", "number").agg(F.min("answer").alias("only_answers"))
    return x.groupBy("conv_id").agg(F.count("*").alias("n_numbers"), F.count_if("only_answers").alias("n_ungrounded"))


def id_quality(df: DataFrame) -> DataFrame:
    """(source, field, flag, n) of card-like runs (checksum) and dotted addresses (octets); never values."""
    card = F.transform(F.regexp_extract_all("text", F.lit("[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4}"), 0), lambda v: F.struct(F.lit("card").alias("field"), F.when(F.call_function("luhn_check", F.replace(v, F.lit(" "), F.lit(""))), "valid").otherwise("checksum").alias("flag")))
    ip = F.transform(F.regexp_extract_all("text", F.lit(FIELDS[2][1]), 0), lambda v: F.struct(F.lit("address").alias("field"), F.when(F.forall(F.split(v, "[.]"), lambda o: o.cast("int") <= 255), "valid").otherwise("format").alias("flag")))
    return df.select("source", F.explode(F.concat(card, ip)).alias("x")).groupBy("source", "x.field", "x.flag").agg(F.count("*").alias("n"))


def contacts(df: DataFrame) -> DataFrame:
    """Normalised mail addresses and phones of each language: found, and different ones."""
    mail = F.transform(F.regexp_extract_all("text", F.lit(FIELDS[0][1]), 0), lambda v: F.struct(F.lit("email").alias("kind"), F.lower(v).alias("v")))
    phone = F.transform(F.regexp_extract_all("text", F.lit(FIELDS[1][1]), 0), lambda v: F.struct(F.lit("phone").alias("kind"), F.substring(F.regexp_replace(v, "[^0-9]", ""), F.lit(2), F.lit(10)).alias("v")))
    x = df.select("lang", F.explode(F.concat(mail, phone)).alias("x")).groupBy("lang", "x.kind", "x.v").agg(F.count("*").alias("n"))
    return x.groupBy("lang", "kind").agg(F.sum("n").alias("n_found"), F.count("*").alias("n_different"))


def mask_tokens(df: DataFrame) -> DataFrame:
    x = df.select("source", F.explode(F.regexp_extract_all(mask_shapes(F.col("text")), F.lit(r"\[(EMAIL|PHONE|ID)\]"), 0)).alias("token"))
    return x.groupBy("source", "token").agg(F.count("*").alias("n"))


def hashed_buckets(text: Column, size: int = 512) -> Column:
    """The bucket of each stem of a text: its md5 modulo ``size``, which divides 4096."""
    return buckets_of(stems(text), size)


def buckets_of(words: Column, size: int = 512) -> Column:
    return F.transform(words, lambda t: F.conv(F.right(F.md5(t.cast("binary")), F.lit(3)), 16, 10).cast("int") % size)


def hashed_vectors(df: DataFrame, key: str, text: str = "text", size: int = 512) -> DataFrame:
    """Sparse unit vectors (key, bucket, weight) of stems; a stem's bucket is its md5 modulo ``size``, which divides 4096."""
    x = df.select(key, F.explode(stems(F.col(text))).alias("t")).select(key, (F.conv(F.right(F.md5(F.col("t").cast("binary")), F.lit(3)), 16, 10).cast("int") % size).alias("bucket"))
    x = x.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return x.join(norm, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def turn_similarity(turns: DataFrame) -> DataFrame:
    """Cosine of each turn's hashed vector with that of the turn before it in its conversation."""
    v = hashed_vectors(turns.withColumn("id", F.struct("conv_id", "turn")), "id").select("id.conv_id", "id.turn", "bucket", "weight")
    before = v.select("conv_id", (F.col("turn") + 1).alias("turn"), "bucket", F.col("weight").alias("w"))
    return v.join(before, ["conv_id", "turn", "bucket"]).groupBy("conv_id", "turn").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("cosine"))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


QUERIES = {
    "verhoeff_digits": lambda s, d: table(s, d, "orders").select("o_orderkey", verhoeff_digit(F.col("o_orderkey").cast("string")).alias("check_digit")),
    "normalize_text": lambda s, d: _docs(s, d).select("doc_id", _md5(normalize_text(F.col("text"))).alias("normal_md5")),
    "fold_leet": lambda s, d: _docs(s, d).select("doc_id", _md5(fold_leet(F.col("text"))).alias("leet_md5")),
    "one_liner": lambda s, d: _docs(s, d).select("doc_id", one_liner(F.col("text")).alias("line")),
    "first_sentences": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", first_sentences(F.col("text")).alias("head")),
    "steering_flags": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", steering(F.col("text")).alias("steering")),
    "over_length": lambda s, d: _docs(s, d).select("doc_id", _md5(over_length(F.col("text"))).alias("cut_md5"), (F.length(F.col("text")) > 4000).alias("is_long")),
    "extract_fields": lambda s, d: _docs(s, d).select("doc_id", F.explode(extract_fields(F.col("text"))).alias("field", "value")),
    "ungrounded_numbers": lambda s, d: ungrounded_numbers(table(s, d, "conversations")),
    "id_quality": lambda s, d: id_quality(_docs(s, d)),
    "contacts": lambda s, d: contacts(_docs(s, d)),
    "mask_tokens": lambda s, d: mask_tokens(_docs(s, d)),
    "hashed_embedding": lambda s, d: hashed_vectors(table(s, d, "benchmark"), "item_id").withColumn("weight", F.round("weight", 6)),
    "turn_similarity": lambda s, d: turn_similarity(table(s, d, "conversations")),
}
_MASKED = "text"
for _, _token, _p in SHAPES:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{_token}', 'g')"
_BUCKET = "(CAST('0x' || right(md5(token), 3) AS INT) % 512)"


def _vectors(frame: str, key: str) -> str:
    return f"n AS (SELECT {key}, {_BUCKET} AS bucket, count(*) AS n FROM {_tokens(frame, key)} GROUP BY ALL), v AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM n)"


SQL = {
    "verhoeff_digits": f"SELECT o_orderkey, {list(INVERSES)}[list_reduce(list_prepend(0, [{PLACES}[(i % 8) * 10 + CAST(reverse(CAST(o_orderkey AS VARCHAR))[i] AS INT) + 1] for i in range(1, length(CAST(o_orderkey AS VARCHAR)) + 1)]), lambda c, x: {PRODUCTS}[c * 10 + x + 1]) + 1] AS check_digit FROM orders",
    "fold_leet": f"SELECT doc_id, md5(translate(text, '{LEET[0]}', '{LEET[1]}')) AS leet_md5 FROM documents",
    "one_liner": "WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 220 THEN left(t, 217) || '...' ELSE t END AS line FROM x",
    "first_sentences": "SELECT conv_id, turn, trim(array_to_string(regexp_extract_all(text, '[^.!?]+[.!?]*')[1:2], ''), ' ') AS head FROM conversations",
    "steering_flags": f"SELECT conv_id, turn, coalesce(regexp_matches(lower(text), '{'|'.join(STEERING)}') OR regexp_matches(lower(translate(text, '{LEET[0]}', '{LEET[1]}')), '{'|'.join(STEERING)}'), false) AS steering FROM conversations",
    "over_length": "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN left(text, 4000) || '[truncated]' ELSE text END) AS cut_md5, length(text) > 4000 AS is_long FROM documents",
    "extract_fields": " UNION ALL ".join(f"SELECT doc_id, '{n}' AS field, regexp_extract(text, '{p}') AS value FROM documents WHERE regexp_matches(text, '{p}')" for n, p in FIELDS),
    "ungrounded_numbers": "WITH x AS (SELECT conv_id, role = 'assistant' AS answer, unnest(regexp_extract_all(text, '[0-9]+')) AS number FROM conversations), y AS (SELECT conv_id, number, bool_and(answer) AS alone FROM x GROUP BY ALL) SELECT conv_id, count(*) AS n_numbers, count(*) FILTER (alone) AS n_ungrounded FROM y GROUP BY 1",
    "id_quality": f"""WITH c AS (SELECT source, reverse(replace(unnest(regexp_extract_all(text, '[0-9]{{4}} ?[0-9]{{4}} ?[0-9]{{4}} ?[0-9]{{4}}')), ' ', '')) AS r0 FROM documents), d AS (SELECT source, list_transform(range(1, 17), lambda i: r0[i]) AS s FROM c),
e AS (SELECT source, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN (2 * CAST(s[i] AS INT)) // 10 + (2 * CAST(s[i] AS INT)) % 10 ELSE CAST(s[i] AS INT) END)) % 10 = 0 AS ok FROM d),
a AS (SELECT source, unnest(regexp_extract_all(text, '{FIELDS[2][1]}')) AS v FROM documents), f AS (SELECT source, list_max(list_transform(string_split(v, '.'), lambda o: CAST(o AS INT))) <= 255 AS ok FROM a)
SELECT source, 'card' AS field, CASE WHEN ok THEN 'valid' ELSE 'checksum' END AS flag, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT source, 'address', CASE WHEN ok THEN 'valid' ELSE 'format' END, count(*) FROM f GROUP BY ALL""",
    "contacts": f"""WITH x AS (SELECT lang, 'email' AS kind, lower(unnest(regexp_extract_all(text, '{FIELDS[0][1]}'))) AS v FROM documents UNION ALL SELECT lang, 'phone', substr(regexp_replace(unnest(regexp_extract_all(text, '{FIELDS[1][1]}')), '[^0-9]', '', 'g'), 2, 10) FROM documents) SELECT lang, kind, count(*) AS n_found, count(DISTINCT v) AS n_different FROM x GROUP BY ALL""",
    "mask_tokens": f"WITH x AS (SELECT source, unnest(regexp_extract_all({_MASKED}, '\\[(EMAIL|PHONE|ID)\\]')) AS token FROM documents) SELECT source, token, count(*) AS n FROM x GROUP BY ALL",
    "hashed_embedding": f"WITH {_vectors('benchmark', 'item_id')} SELECT item_id, bucket, round(weight, 6) AS weight FROM v",
    "turn_similarity": f"WITH t AS (SELECT conv_id, turn, {{'c': conv_id, 't': turn}} AS id, text FROM conversations), {_vectors('t', 'id')} SELECT a.id.c AS conv_id, a.id.t AS turn, round(sum(a.weight * b.weight), 6) AS cosine FROM v a JOIN v b ON a.id.c = b.id.c AND a.id.t = b.id.t + 1 AND a.bucket = b.bucket GROUP BY ALL",
}
