"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Built-in functions only.  Spark's pattern functions return matches without places, so a
match is placed by the lengths of the pieces between matches: ``split`` and
``regexp_extract_all`` walk the same matcher, and a running sum over both gives starts.

The patterns are written with possessive quantifiers and run-start guards.  They accept
the same leftmost matches as the plain forms, in time linear in the text, and without
recursion in the matcher for very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.text import own_columns

#: Kinds in the order that breaks ties between spans with one start; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
}
#: What a text must hold before a pattern is tried.
GUARDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|e-mail",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|credit|master|amex|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(s: Column) -> Column:
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _octet_ok(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _confirm(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _octet_ok(match)
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _placed(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end, score>> of the confirmed matches of one kind."""
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    empty = F.expr("cast(array() as array<struct<start:int,hit:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct(
            (start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(start.alias("start"), x["hit"].alias("hit")))).alias("out"),
        )

    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    sound = F.filter(placed, lambda x: _confirm(kind, x["hit"]))

    def scored(x: Column) -> Column:
        lead = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, lead + 1, x["start"] - lead)).rlike(rf"\b(?:{CONTEXT[kind]})\b")
        return F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (x["start"] + F.length(x["hit"])).alias("end"),
            F.when(near, F.lit(min(1.0, SCORE[kind] + CONTEXT_BONUS))).otherwise(F.lit(SCORE[kind])).alias("score"),
        )

    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,score:double>>)")
    has_digit = text.rlike("[0-9]") if kind not in ("email",) else F.lit(True)
    guard = has_digit & (F.contains(text, F.lit(GUARDS[kind])) if kind in GUARDS else F.lit(True))
    return F.when(guard & F.rlike(text, F.lit(pattern)), F.transform(sound, scored)).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array<struct<start, kind, end, score>>, sorted by start, then kind.

    Places count code points from 0; the end is exclusive.  Kinds index :data:`KINDS`.
    Null and empty texts have no spans; a null id is passed on; repeated rows are handled
    one by one; an empty table gives an empty result; other columns are ignored.
    """
    base = own_columns(docs, id_col, text_col).toDF("_id", "_text").select("_id", F.coalesce("_text", F.lit("")).alias("_text"))
    spans = F.array_sort(F.concat(*[_placed(F.col("_text"), k) for k in KINDS]))
    return base.select(F.col("_id").alias(id_col), spans.alias("spans"))


def mask_pii(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of at least ``min_score`` replaced by ``<KIND>`` in ``text_col``; of overlapping spans the first wins."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.filter(F.array_sort(F.concat(*[_placed(text, k) for k in KINDS])), lambda s: s["score"] >= min_score)

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.lit("<"), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)), F.lit(">"))
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], piece, tag).alias("out")))

    folded = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, F.concat(folded["out"], F.substring(text, folded["at"] + 1, F.length(text)))).otherwise(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
