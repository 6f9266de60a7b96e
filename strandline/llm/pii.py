"""Personal data: pattern spans, and terms whose co-occurrence discloses a protected entity.

DataFrame functions only. Positions come from split() and regexp_extract_all() with one
pattern: the pieces between matches and the matches alternate, and a fold adds up their
code points. Quantifiers are possessive and runs are entered at their start only (or where
the last match ended), so long texts are read in linear time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import dropped, stored

KINDS = ("email", "ip", "card", "phone", "term")
_AT = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_AT})){_AT}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[^\x20\x09-\x0D]+"
#: A term within CONTEXT words of an entity discloses it if PMI(term; entity) >= IC(entity) / ALPHA. Where fewer than LEAST_TEXTS
#: different texts show them together, PMI must reach the whole of IC: the term stands nowhere else.
ALPHA, LEAST_TEXTS, CONTEXT = 1.25, 2, 5
#: Rows of terms, and of texts with terms, up to which they are broadcast; beyond it they are joined by key.
BROADCAST_ROWS = 500_000


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits):
    """Digits as a string of at most 19; every second one from the right is doubled."""
    n = F.length(digits)
    term = F.transform(F.sequence(F.lit(1), n), lambda i: F.expr("0") + (
        F.when(i % 2 == 0, F.substr(digits, n - i + 1, F.lit(1)).cast("int") * 2).otherwise(F.substr(digits, n - i + 1, F.lit(1)).cast("int"))))
    folded = F.transform(term, lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(folded, F.lit(0), lambda a, d: a + d) % 10 == 0


def _passes(kind: str, m):
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(\.{_BYTE}){{3}}$")
    n = F.length(_digits(m))
    if kind == "phone":
        return n.between(10, 15)
    return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(False)


SPAN = "array<struct<start:bigint,rank:int,stop:bigint,value:string>>"


def _spans(text, pattern: str, rank: int, passes):
    """Spans (start, rank, stop, value) of the matches that pass, as an array column."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), m.alias("m"), (m.isNotNull() & F.coalesce(passes(m), F.lit(False))).alias("ok")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPAN})").alias("got"))

    def step(s, x):
        begin = s["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["m"]).cast("long"), F.lit(0).cast("long"))
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"), x["m"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(s["got"], one)).otherwise(s["got"]).alias("got"))

    fold = F.aggregate(both, start, step)["got"]
    return F.when(text.rlike(pattern), fold).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _base(body):
    """Pattern spans of a text column, sorted by start, then kind."""
    kinds = [_spans(body, PATTERNS[k], i, lambda m, k=k: _passes(k, m)) for i, k in enumerate(KINDS[:4])]
    return F.array_sort(F.concat(*kinds))


def _whole(docs: DataFrame) -> DataFrame:
    """row (all columns of docs) and body (text, null as empty): names of docs can't clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("body"))


def _words(body):
    """The different words of a text that may be terms, lower-cased: 4 characters or more, no digit and no '@'."""
    return F.filter(F.array_distinct(F.split(F.lower(body), r"[\x20\x09-\x0D]+")), lambda w: (F.length(w) >= 4) & ~w.rlike("[0-9@]"))


def _sized(df: DataFrame) -> DataFrame:
    """A stored table for a join: broadcast up to BROADCAST_ROWS rows, else joined by sorted keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def disclosing_terms(bodies: DataFrame, alpha: float = ALPHA, least: int = LEAST_TEXTS, context: int = CONTEXT) -> DataFrame:
    """term of each word that discloses an entity; bodies: (body), a row a text, none null.

    p(entity) and p(term) are shares of all texts, copies counted as often as they occur, and
    p(term, entity) of texts where the term is within `context` words of the entity's value.
    The threshold is IC / alpha if at least `least` of these texts differ, else IC: one text
    and its copies only show that the term never stands without the entity.
    """
    n = bodies.count()
    around = stored(bodies.withColumn("base", _base(F.col("body"))).where(F.size("base") > 0).select("body", F.xxhash64("body").alias("t"), F.explode("base").alias("s"))
                    .select(*_context(context)))
    # one row a text and entity, however often the text holds it; equal texts are folded with their number
    seen = around.groupBy("entity", "t", "part").agg(F.count("*").alias("copies"), F.first("near").alias("near"))
    seen = stored(seen.groupBy("entity", "t").agg(F.max("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    entities = seen.groupBy("entity").agg(F.sum("copies").alias("ne"))
    joint = seen.select("entity", "t", "copies", F.explode("near").alias("term")).groupBy("entity", "term").agg(F.sum("copies").alias("nj"), F.count("*").alias("texts"))
    wanted = stored(joint.join(entities.hint("merge"), "entity"))
    # all words are counted before any join, so that common ones never multiply
    counts = bodies.select(F.explode(_words(F.col("body"))).alias("term")).groupBy("term").agg(F.count("*").alias("nt"))
    pmi, ic = F.expr(f"ln(nj * {n}D / (nt * ne))"), F.expr(f"ln({n}D / ne)")
    out = stored(counts.join(wanted.hint("merge"), "term").where(pmi >= ic / F.when(F.col("texts") >= least, alpha).otherwise(1.0) - 1e-9).select("term").distinct())
    dropped(around, seen, wanted)
    return out


def _context(context: int):
    """Columns t, entity, part (which occurrence in the text) and near (terms around it) of rows (body, t, s)."""
    # what touches the value and the next words by position, however far they are in characters
    nearest = rf"^[^\x20\x09-\x0D]*+(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++){{0,{context}}}+"
    left = _words(F.reverse(F.regexp_extract(F.reverse(F.expr("substring(body, 1, cast(s.start AS int))")), nearest, 0)))
    right = _words(F.regexp_extract(F.expr("substring(body, cast(s.stop + 1 AS int))"), nearest, 0))
    return ["t", F.xxhash64(F.lower("s.value")).alias("entity"), F.col("s.start").alias("part"), F.array_union(left, right).alias("near")]


def find(docs: DataFrame) -> DataFrame:
    """docs with `body` (text, null as empty), `base` (pattern spans) and `spans` (those of disclosing terms added, sorted).

    A term's span is an occurrence of it as a whole word, in any document. Null texts are
    empty. Repeated rows each get the same spans; null ids are a value like others; other
    columns stay, whatever their names, but for those three. Empty input gives no rows.
    """
    whole = _whole(docs.drop("body", "base", "spans"))
    terms = disclosing_terms(whole.select("body"))
    spans = F.col("base")
    if not terms.isEmpty():
        words = whole.select(F.xxhash64("body").alias("t"), F.explode(_words(F.col("body"))).alias("term"))
        hits = stored(words.join(_sized(terms), "term").groupBy("t").agg(F.collect_set("term").alias("terms")))
        whole = whole.withColumn("t", F.xxhash64("body")).join(_sized(hits), "t", "left")
        none = F.expr(f"cast(array() as {SPAN})")
        extra = F.when(F.col("terms").isNotNull(), _spans(F.col("body"), WORD, 4, lambda m: F.array_contains(F.col("terms"), F.lower(m)))).otherwise(none)
        spans = F.array_sort(F.concat("base", extra))
    return whole.withColumn("base", _base(F.col("body"))).withColumn("spans", spans).select("row.*", "body", "base", "spans")


def _listed(spans, kind_names=KINDS):
    names = F.array(*[F.lit(k) for k in kind_names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts, hash and list that op5 returns."""
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
                        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """found with text rewritten: each span becomes its kind in angle brackets; overlaps become the first's."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        out = F.concat(s["out"], F.substr(F.col("body"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.element_at(names, x["rank"] + 1))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(fresh, out).otherwise(s["out"]).alias("out"))

    done = F.aggregate("spans", start, step)
    text = F.concat(done["out"], F.substr(F.col("body"), (done["at"] + 1).cast("int"), F.length("body")))
    return found.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text")))
