"""Personal data: patterns, and terms that the corpus shows to reveal them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, materialise, spread_join, whole

KINDS = ("email", "ip", "card", "phone", "term")
# The base patterns. Runs are possessive and begin where no match could have begun earlier, so that a long
# run is read once; they match the same spans as the plain forms.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WORD = r"\p{L}{2,}"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A term must share this many lines with a kind, and tell this part of what knowing the kind would tell.
SUPPORT, DISCLOSURE = 5, 0.75
#: Terms are broadcast, or go with the plan, up to this number and this many characters, which are counted first; more are
#: joined by shuffle.
BROADCAST_TERMS, BROADCAST_CHARS = 200_000, 8_000_000
SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"
#: Matches whose places are found in one array: each match copies half a piece on average, and each piece all before it.
PIECE, MATCH = 64, "struct<start:bigint,stop:bigint,match:string>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _gate(kind: str, text: Column) -> Column:
    """Whether the text can hold a match at all."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _positions(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """Array of (start, stop, match) of all matches, in code points: what split leaves between them gives the places.

    keep: array of a boolean for each match, false where its place isn't wanted. Matches are taken PIECE at a time, as an
    array that grows is copied with each step.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = F.transform(found, lambda x: F.lit(True)) if keep is None else keep
    both = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), found.alias("match"), wanted.alias("keep"))

    def empty(at: Column, kind: str) -> Column:
        return F.struct(at.cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        stop = begin + F.coalesce(F.length(x["match"]), F.lit(0))
        found = F.struct(begin.alias("start"), stop.alias("stop"), x["match"].alias("match"))
        return F.struct(stop.alias("at"), F.when(x["keep"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    def piece(acc: Column, x: Column) -> Column:
        inner = F.aggregate(x, empty(acc["at"], f"array<{MATCH}>"), step)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def pieces(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(PIECE))
        return F.aggregate(F.transform(starts, lambda k: F.slice(x, k, PIECE)), empty(F.lit(0), f"array<array<{MATCH}>>"), piece, lambda acc: F.flatten(acc["out"]))

    return let(both, pieces)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, stop) of all valid base matches, in order; kind is the index in KINDS."""

    def of(i: int, kind: str) -> Column:
        found = F.filter(_positions(text, PATTERNS[kind]), lambda x: _valid(kind, x["match"]))
        spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["stop"].alias("stop")))
        return F.when(_gate(kind, text), spans).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*(of(i, kind) for i, kind in enumerate(KINDS[:4]))))


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def spans_string(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def without_emails(text: Column) -> Column:
    """The text with blanks for its email addresses: of the base matches, only these hold letters."""
    gaps, found = F.split(text, PATTERNS["email"], -1), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    blanked = F.zip_with(gaps, found, lambda gap, match: F.concat(gap, F.repeat(F.lit(" "), F.coalesce(F.length(match), F.lit(0)))))
    return F.when(_gate("email", text), F.array_join(blanked, "")).otherwise(text)


def kinds_of(line: Column) -> Column:
    """Array of the kinds of which the line holds a valid match. No match of any kind spans lines."""

    def of(i: int, kind: str) -> Column:
        held = F.exists(F.regexp_extract_all(line, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: _valid(kind, x))
        return F.when(_gate(kind, line) & held, F.lit(i))

    return F.array_compact(F.array(*(of(i, kind) for i, kind in enumerate(KINDS[:4]))))


def terms_of(line: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda x: F.lower(x)))


def listed(words: str, terms: list[str]) -> Column:
    """Array of a boolean for each word of the column named: whether its lower-case form is a term. Terms hold no quotes.

    The set goes with the plan, and a look-up costs the same whatever its size.
    """
    return F.expr(f"transform({words}, w -> lower(w) IN ({','.join(f"'{t}'" for t in terms)}))") if terms else F.transform(words, lambda w: F.lit(False))


def _few(terms: DataFrame) -> bool:
    n = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    return n["n"] <= BROADCAST_TERMS and n["chars"] <= BROADCAST_CHARS


def revealing_terms(texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, kinds) of texts (text): the terms that reveal a kind of personal data, and which.

    Over all lines of all rows, with n(t), n(k), n(t,k) of the N lines that hold the term t, the kind k, and both, a term
    tells PMI(t;k) = log(N n(t,k) / n(t) n(k)) of the information log(N / n(k)) in k. It reveals k where that part
    reaches `disclosure`, with n(t,k) at least `support`. Repeated rows count each. Words of an email address are no terms.
    """
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    held = lines.select(kinds_of(F.col("line")).alias("kinds"), "line").where(F.size("kinds") > 0)
    held = materialise(held.select("kinds", terms_of(without_emails(F.col("line"))).alias("terms")), "held")
    total = texts.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n")).first()["n"] or 0
    n_k = held.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_k"))  # a row per kind
    with_kind = held.select("kinds", F.explode("terms").alias("term")).select("term", F.explode("kinds").alias("kind")).groupBy("term", "kind").agg(F.count("*").alias("n_tk"))
    with_kind = materialise(with_kind.where(F.col("n_tk") >= support), "with-kind")
    candidates = with_kind.select("term").distinct()
    everywhere = lines.select(F.explode(terms_of(without_emails(F.col("line")))).alias("term"))
    if _few(candidates):
        everywhere = everywhere.join(F.broadcast(candidates), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    else:
        everywhere = everywhere.groupBy("term").agg(F.count("*").alias("n_t")).join(candidates, "term", "left_semi")
    n = F.lit(float(max(total, 1)))
    told = (F.log(n * F.col("n_tk") / (F.col("n_t") * F.col("n_k")))) / F.log(n / F.col("n_k"))
    reveals = with_kind.join(everywhere, "term").join(F.broadcast(n_k), "kind").where((F.col("n_k") < n) & (told >= disclosure))
    return materialise(reveals.groupBy("term").agg(F.array_sort(F.collect_set("kind")).alias("kinds")), "reveals")


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of docs: doc_id, base (array of start, kind, stop), spans (base and term spans, likewise).

    Base spans are the patterns' valid matches. The corpus tells which terms reveal a kind (revealing_terms); they are
    spans too, to be generalised or removed, wherever they stand in any text, outside email addresses.

    Texts never leave their place: what is shuffled are counts of terms, pre-aggregated, and places of revealing terms.
    Null and empty texts have no span. Rows that share identifier and text get the same spans; null identifiers are kept.
    Other columns don't matter.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), F.col("text"))))
    base = materialise(rows.select("doc_id", key.alias("key"), base_spans(F.col("text")).alias("base")), "base")
    reveals = revealing_terms(rows, support, disclosure).select("term")
    plain = rows.select(key.alias("key"), without_emails(F.col("text")).alias("plain"))
    if _few(reveals):
        terms = [r["term"] for r in reveals.collect()]
        flagged = plain.withColumn("words", F.regexp_extract_all("plain", F.lit(WORD), F.lit(0))).withColumn("keep", listed("words", terms))
        places = flagged.where(F.exists("keep", lambda x: x)).select("key", F.explode(_positions(F.col("plain"), WORD, F.col("keep"))).alias("w"))
        found = places.select("key", "w.start", "w.stop")
    else:
        words = plain.select("key", F.explode(_positions(F.col("plain"), WORD)).alias("w"))
        found = spread_join(words.select("key", F.lower("w.match").alias("term"), "w.start", "w.stop"), reveals, ["term"])
    found = found.groupBy("key").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "stop")).alias("terms"))
    out = spread_join(base, materialise(found, "terms"), ["key"], "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(SPAN)))).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with each span that find_pii() finds replaced by its kind in brackets; all other columns as they are.

    Rows meet their spans by identifier and text, null identifiers too, so rows that share an identifier are each cut at
    their own places. Overlapping spans are one, named by the first. A null text stays null; an empty table gives no row.
    """
    keyed = keyed_rows(docs, text, doc_id)
    at = docs.columns.index(text)
    own = keyed.select(F.col("row_key").alias("doc_id"), whole(f"row.c{at}").alias("text"))
    found = find_pii(own, support=support, disclosure=disclosure).groupBy(F.col("doc_id").alias("row_key")).agg(F.first("spans").alias("spans"))
    joined = spread_join(materialise(keyed, "rows"), materialise(found, "spans"), ["row_key"], "left").withColumn("_text", whole(f"row.c{at}"))
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr("_text", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.concat(acc["out"], gap, F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["stop"].alias("at"), new.alias("out")))

    clean = F.aggregate(F.coalesce("spans", F.array().cast(SPAN)), start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("_text"), (acc["at"] + 1).cast("int"))))
    clean = F.when(F.col(f"row.c{at}").isNotNull(), clean)
    return joined.select(*((clean if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)))
