"""Quality rules against counts by plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronoglass.llm import quality

SCHEMA = "doc_id long, text string, source string, host string, rid long, lines string, t1 int, row string, gone int"
LETTERS = str.maketrans("0123456789", "abcdefghij")
MENU = "Home  |  Contact\tus | Page 17"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def key(line):
    line = " ".join(re.findall(r"[^\x20\x09-\x0D]+", line))
    return re.sub("[1-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))


def brute(rows, docs=quality.LINE_DOCS, percent=quality.LINE_PERCENT):
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        hosts[s].add(t or "")
        for line in (t or "").split("\n"):
            held[s, key(line)].add(t or "")
    gone = {k for k, v in held.items() if k[1] and len(v) > docs and len(v) * 100 > percent * len(hosts[k[0]])}
    out = []
    for i, t, s in rows:
        t = t or ""
        n = base(t)
        lost = sum(len(key(x).split(" ")) for x in t.split("\n") if (s, key(x)) in gone)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        left = "\n".join(x for x in t.split("\n") if (s, key(x)) not in gone)
        out.append((i, *n, failed, lost, not failed and (n[0] - lost) * 100 >= n[0] * 30, left))
    return out


def rows_of():
    rows = [(i, f"{MENU}{i}\nunique words number {i} " + " ".join(f"w{i * 7 + k}" for k in range(i % 15)) + "\n" + MENU.lower(), f"src{i % 2}") for i in range(40)]
    rows += [(100 + i, f"alone {i} " * 3 + "\n\n \t\nend", None if i % 2 else "") for i in range(12)]
    rows += [(200, None, "src0"), (201, "", None), (202, "a b c d e f g a b c d e f g", "src1"), (203, "x" * 100_000 + " " + "y z " * 5000, "src1"), (204, " ".join(f"t{k}" for k in range(30_000)) + "\r\n\x0bé|#<>$ \xa0 z", "src1"), (None, "nobody's text has ten words or more so it stays here", "src0")]
    return rows + [rows[0]] * 30 + [(300 + i, "the same page of many copies has ten words at least", "src0") for i in range(60)]


def df_of(spark, rows):
    return spark.createDataFrame([(*r, "h", 7, "l", 1, "r", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("limits", [{}, {"line_docs": 2, "line_percent": 30}])
def test_against_plain_counts(spark, limits):
    rows = rows_of()
    want = brute(rows, *limits.values())
    got = quality.judge(df_of(spark, rows).repartition(5), **limits)
    assert got.columns == ["doc_id", *quality.COUNTS, "base_failed", "n_lost_words", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:-1] for r in want), key=repr)
    assert {r[-2] for r in want} == {True, False} and any(r[7] for r in want)
    left = quality.cleaned(df_of(spark, rows).repartition(5), **limits)
    assert left.columns == df_of(spark, rows).columns
    assert sorted(((r.doc_id, r.text, r.source) for r in left.collect()), key=repr) == sorted(((r[0], w[-1], r[2]) for r, w in zip(rows, want, strict=True) if w[-2]), key=repr)


def test_copies_dont_make_lines_common(spark):
    rows = [(i, "one page with its ten words that somebody copied often", "s") for i in range(500)] + [(1000 + i, f"another page with ten words of its own is {chr(97 + i % 26) * (1 + i // 26)}", "s") for i in range(30)]
    assert quality.judge(df_of(spark, rows)).where("kept").count() == 530


def test_hot_line_of_a_hot_host(spark):
    rows = [(i, MENU + "\n" + " ".join(f"{i}-{k}".translate(LETTERS) for k in range(30)), "hot" if i % 3 else f"h{i}") for i in range(3000)]
    got = quality.judge(df_of(spark, rows).repartition(8)).groupBy("n_lost_words", "kept").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(7, True): 2000, (0, True): 1000}


def test_nothing(spark):
    empty = df_of(spark, [])
    assert quality.judge(empty).count() == 0 and quality.cleaned(empty).count() == 0
    assert quality.judge(df_of(spark, [(1, None, None)])).collect()[0].kept is False


def test_repeated_words():
    for text in ("", "a", "a b c d e a b c d e", "a a a a a a", "a a a a a", "a b a b a b a b", "p q r s t u v w x y"):
        assert quality.repeated_words(text.encode().split()) == base(text)[4], text
