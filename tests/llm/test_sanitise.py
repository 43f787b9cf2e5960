"""Sanitised texts against a cut by plain Python, whatever the rows' identifiers."""

from collections import Counter

from chronoglass.llm import pii

SCHEMA = "doc_id long, row_key string, text string, spans string, base int"
TEXTS = ["call +1 (555) 123-4567 or a@b.cd", "mail a@b.cd now", "mail a@b.cd now", None, "", "nothing é 漢 at all", "1.2.3.4 and 4111 1111 1111 1111.", "x@y.z\nx@y.z"]


def cut(text, spans):
    if text is None:
        return None
    at, out = 0, ""
    for start, kind, stop in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind]}]"
        at = max(at, stop)
    return out + text[at:]


def test_rows_are_cut_at_their_own_places(spark):
    rows = [(i, f"k{i}", t, "s", i) for i, t in enumerate(TEXTS)] + [(1, "again", TEXTS[0], None, 0), (1, "again", TEXTS[0], None, 0), (None, "none", TEXTS[1], "s", 1), (None, None, TEXTS[6], "s", 2), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = pii.sanitise(docs)
    assert got.columns == docs.columns
    spans = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame([(f"{n}", r[2]) for n, r in enumerate(rows)], "doc_id string, text string")).collect()}
    want = [(i, k, cut(t, [tuple(s) for s in spans[str(n)]]), s, b) for n, (i, k, t, s, b) in enumerate(rows)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert "mail [email] now" in {w[2] for w in want} and "call [phone] or [email]" in {w[2] for w in want}
    assert not any("@" in (w[2] or "") for w in want)


def test_nothing(spark):
    assert pii.sanitise(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pii.sanitise(spark.createDataFrame([(1, "k", None, None, None)], SCHEMA)).collect()[0].text is None
